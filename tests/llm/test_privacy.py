"""Terms that reveal entities, or what recurs of them, over whole texts."""

import math
import random
import re

import pytest


def test_terms_of_entities_that_do_not_recur_and_far_from_them(spark):
    from tagweave.llm import privacy

    far = "and so on " * 60
    rows = [(i, f"text {i} of secretword {far} user{i}@x.org now") for i in range(4)] + [(i, f"plain text {i} and so on now") for i in range(10, 60)]
    done = privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 4").collect()
    assert len(done) == 4 and all("secretword" not in r.clean_text and "text" in r.clean_text and "now" in r.clean_text for r in done)


def own_terms(text):
    """Words of two or more letters, with apostrophes and hyphens within, and pairs and triples of Han characters."""
    low, out = text.lower(), set()
    for w in re.split(r"[ \t\n\x0b\f\r]+", low):
        core = re.sub(r"^[\W_]+|[\W_]+$", "", w)
        parts = re.split("['’-]", core)
        if core and all(p.isalpha() for p in parts) and len("".join(parts)) > 1:
            out.add(core)
    for n in (2, 3):
        out |= {low[i : i + n] for i in range(len(low) - n + 1) if all("一" <= c <= "鿿" for c in low[i : i + n])}
    return out


def own_entities(text):
    out = set()
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        value = m[0].lower()
        name, domain = value.split("@")
        out |= {"0", f"0:{value}", f"0:@{domain}", f"0:{name}@"}
    return out


def told_by(texts, min_texts=3, share=0.9):
    """{term: entities that it reveals}, every term against every entity."""
    each = [(own_terms(t), own_entities(t)) for t in set(texts)]
    n, out = len(each), {}
    for term in set().union(*(t for t, _ in each)):
        for entity in set().union(*(e for _, e in each)):
            both = sum(term in t and entity in e for t, e in each)
            n_entity, n_term = sum(entity in e for _, e in each), sum(term in t for t, _ in each)
            if both >= min_texts and n_entity < n and math.log2(n * both / (n_entity * n_term)) >= share * math.log2(n / n_entity):
                out[term] = out.get(term, 0) + 1
    return out


def test_terms_by_brute_force(spark):
    from tagweave.llm import privacy

    pick = random.Random(5)
    common = "the and of so it said would house river green walk Zürich 我们 今天 很好".split()
    rows = []
    for i in range(120):
        words = pick.choices(common, k=12)
        if i % 4 == 0:
            who = pick.choice([("Li", "a.org"), ("O'Brien", "b.org"), ("Jean-Luc", "a.org"), ("李明", "c.org")])
            words += [who[0] + pick.choice(["", ",", "!"]), f"user{pick.randrange(6)}@{who[1]}"]
        if i % 20 == 0:
            words.append("今天李明说很好")
        pick.shuffle(words)
        rows.append(" ".join(words))
    rows += rows[:9] + ["", ""]
    based = privacy.find_base(spark.createDataFrame([(t,) for t in rows], "text string"))
    got = {r.term: r.reveals for r in privacy.disclosing_terms(based).collect()}
    want = told_by(rows)
    assert got == want and {"jean-luc", "o'brien"} & set(got)


def test_short_names_and_names_without_blanks(spark):
    from tagweave.llm import privacy

    rows = [(i, f"{i}: Li 李明 said user{i}@x.org") for i in range(5)] + [(i, f"今天{i}李明{'去来看听'[i - 5]}说好 with user{i}@x.org") for i in range(5, 9)]
    rows += [(i, f"text {i} 今天说好 with others") for i in range(10, 80)]
    done = privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    told = {r.doc_id: r for r in done}
    assert all("李明" not in told[i].clean_text for i in range(9)) and all("Li" not in told[i].clean_text for i in range(5))
    assert told[7].clean_text.startswith("今天7[") and "说好" in told[7].clean_text
    assert all(told[i].clean_text == dict(rows)[i] for i in range(10, 80))
    for r in done:
        assert all(dict(rows)[r.doc_id][s.start : s.end] == s.value for s in r.spans_)


HELPERS = "row text_ t_ base_ spans_ clean_text own_ key_ k_ term class value start end kind m l_ v_ g_ b_ w_ h_ p_ q_ n_words kept text_key".split()


@pytest.mark.parametrize("name", ["privacy", "quality"])
def test_columns_with_any_name_pass(spark, name):
    from pyspark.sql import functions as F

    from tagweave.llm import privacy, quality

    operator, results = {"privacy": (privacy.sanitise, privacy.RESULTS), "quality": (quality.clean_lines, quality.RESULTS)}[name]
    plain = spark.createDataFrame([(1, "Mail me@x.org, please. " * 20), (2, None), (2, None)], "doc_id long, text string")
    more = plain.withColumns({h: F.lit(f"is {h}") for h in HELPERS}).withColumn("a.b", F.lit("is a.b"))
    done = operator(more)
    assert done.columns == [c for c in more.columns if c not in results] + results
    for r in done.collect():
        assert all(r[h] == f"is {h}" for h in [*HELPERS, "a.b"] if h not in results)
    order = ["doc_id", "text", *results]
    assert sorted(map(str, done.select(*order).collect())) == sorted(map(str, operator(plain).select(*order).collect()))
