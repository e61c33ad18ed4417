"""Whole repeated passages are covered."""

import re

import pytest


def clean(spark, first, second, **args):
    from tagweave.llm import sentence_spans

    d = spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string")
    return {r.doc_id: r.clean_text for r in sentence_spans.remove_repeats(d, **args).collect()}


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n)) + "."


def test_the_last_sentence_of_a_passage_goes(spark):
    passage = f"{words('a', 12)} {words('b', 10)} {words('c', 3)}"
    first, second = f"{words('x', 5)} {passage} {words('y', 30)}", f"{words('u', 5)} {passage} {words('v', 30)}"
    assert clean(spark, first, second) == {1: first, 2: f"{words('u', 5)} {words('v', 30)}"}


def test_a_passage_wrapped_otherwise_goes(spark):
    passage = f"{words('a', 12)} {words('b', 10)} {words('c', 30)}"
    w = passage.split(" ")
    wrap = lambda n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    first, second = f"{words('x', 5)}\n\n{wrap(7)}\n\nEnd here.", f"{words('u', 5)}\n\n{wrap(9)}\n\nDone now."
    assert clean(spark, first, second) == {1: first, 2: f"{words('u', 5)}\n\nDone now."}


def test_repeated_lines_without_marks_go(spark):
    lines = "\n".join(f"line {i} one two three four five six" for i in range(4))
    first, second = f"Top here.\n{lines}\nmore own text", f"Other top.\n{lines}\nelse it ends"
    assert clean(spark, first, second) == {1: first, 2: "Other top.\nelse it ends"}


def test_short_repeated_documents(spark):
    assert clean(spark, "Same short text. Twice here.", "Same short text. Twice here.") == {1: "Same short text. Twice here.", 2: ""}
    assert clean(spark, "One. Other words.", "One. Own words.") == {1: "One. Other words.", 2: "One. Own words."}
    shared = ("Yes it is. No more.", "Yes it is. No more. Then other words.")
    assert clean(spark, *shared) == {1: shared[0], 2: shared[1]}
    assert clean(spark, *shared, run=2) == {1: shared[0], 2: "Then other words."}


def split(text, lines):
    """Sentences of words, by line ends too if lines; blank lines always end one."""
    out, run = [], []
    for block in re.split(r"\n[ \t\x0b-\r]*\n\s*", text):
        for line in block.split("\n"):
            for w in re.findall(r"[^\x20\x09-\x0D]+", line.lower()):
                run.append(w)
                bare = w[:-1] if w[-1] in "\"'”’»)]" and len(w) > 1 else w
                bare = bare[:-1] if bare[-1] in "\"'”’»)]" and len(bare) > 1 else bare
                if bare[-1] in ".!?…。！？":
                    out, run = [*out, tuple(run)], []
            if lines and run:
                out, run = [*out, tuple(run)], []
        if run:
            out, run = [*out, tuple(run)], []
    return out


@pytest.mark.parametrize("size", [2, 3])
def test_against_brute_force(spark, size):
    """All runs of a small table, in both forms, by a dictionary of whole runs: kept words are the same."""
    from tagweave.llm import sentence_spans
    from tests.conftest import SF
    from tests.oracle import duck

    docs = duck("SELECT doc_id, text FROM documents ORDER BY doc_id", SF)
    gone: dict[int, set[int]] = {}
    seen: dict[tuple, tuple] = {}
    for i, t in zip(docs.doc_id, docs.text):
        for lines in (True, False):
            s = split(t, lines)
            runs = [(sum(map(len, s[:k])), sum(s[k : k + size], ())) for k in range(len(s) - size + 1)]
            pairs = [(sum(map(len, s[:k])), sum(s[k : k + 2], ())) for k in range(len(s) - 1)]
            runs += [(at, whole) for at, whole in pairs if len(whole) >= 20 and size > 2]
            if s and len(split(t, False)) < size:
                runs = list(dict.fromkeys([*runs, (0, sum(s, ()))]))
            for at, whole in runs:
                if seen.setdefault(whole, (i, at)) != (i, at):
                    gone.setdefault(i, set()).update(range(at, at + len(whole)))
    r = sentence_spans.remove_repeats(spark.read.parquet(f"{SF}/documents.parquet"), ["doc_id"], run=size).toPandas().sort_values("doc_id")
    for i, t, got in zip(docs.doc_id, docs.text, r.clean_text):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert re.findall(r"[^\x20\x09-\x0D]+", got) == [x for k, x in enumerate(w) if k not in gone.get(i, ())], i


def test_columns_of_any_name_pass(spark):
    from tagweave.llm import sentence_spans

    d = spark.createDataFrame([(1, "A b. C d.", 5, 6, 7, 8, 9), (2, "A b. C d.", 5, 6, 7, 8, 9)], "doc_id long, text string, marks_ int, id_ int, key int, row int, text_key_ int")
    got = sentence_spans.remove_repeats(d).orderBy("doc_id").collect()
    assert [tuple(r)[2:7] for r in got] == [(5, 6, 7, 8, 9)] * 2 and [r.clean_text for r in got] == ["A b. C d.", ""]
