"""The queries against SQL, or against brute force over the whole small tables."""

import collections
import hashlib
import itertools
import re
import struct
import zlib

import numpy as np
import pytest

from tagweave.llm import near_dup
from tagweave.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.conftest import SF
from tests.oracle import duck, same


@pytest.fixture(scope="module")
def docs():
    return duck("SELECT * FROM documents ORDER BY doc_id", SF)


def result(spark, name):
    return QUERIES[name](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    same(QUERIES[name](spark, SF).toPandas(), ORACLES[name], SF)


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(tokenizer_path()), 0
    for text, row in zip(docs.text, result(spark, "op2_token_frames").itertuples()):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_language(spark, docs):
    r = result(spark, "op3_language_id")
    assert (r.lang_pred == docs.lang)[r.held_out].mean() > 0.95
    assert [zlib.crc32(str(i).encode()) % 5 == 0 for i in r.doc_id] == list(r.held_out)


def shingles(text):
    w = text.lower().split()
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    return {g: n / len(grams) for g, n in collections.Counter(grams).items()}


def similarity(a, b):
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def test_near_duplicates(spark, docs):
    s = {i: shingles(t) for i, t in zip(docs.doc_id, docs.text)}
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and len(s[a].keys() & s[b].keys()) > 0.4 * max(len(s[a]), len(s[b])) and similarity(s[a], s[b]) >= 0.8 - 1e-9:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    r = result(spark, "op4_minhash")
    assert {i: find(i) for i in s} == dict(zip(r.doc_id, r.class_id))


def test_signatures_estimate_the_similarity():
    a, b = {i: 1 for i in range(100)}, {i: 1 + (i % 3) for i in range(20, 110)}
    a, b = ({k: v / sum(x.values()) for k, v in x.items()} for x in (a, b))
    doc = np.repeat([0, 1], [len(a), len(b)])
    item = near_dup.mix(np.array([*a, *b], np.uint64))
    sig = near_dup.prob_minhash(doc, item, np.array([*a.values(), *b.values()]), 2, 4096)
    want = similarity(a, b)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04
    of = lambda x, lo: (np.sort(item[lo : lo + len(x)]), np.array(list(x.values()))[np.argsort(item[lo : lo + len(x)])])
    assert near_dup.probability_jaccard(of(a, 0), of(b, len(a))) == pytest.approx(want)


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def base_spans(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()

    found = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text) if ok(kind, m[0]))
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in found)


def test_private_data(spark, docs):
    r = result(spark, "op5_private_data")
    want = [base_spans(t) for t in docs.text]
    assert [hashlib.sha256(x.encode()).hexdigest() for x in want] == list(r.base_sha256)
    assert all(set(filter(None, x.split(","))) <= set(y.split(",")) for x, y in zip(want, r.spans))


def test_private_data_edges_and_disclosure(spark):
    from pyspark.sql import functions as F

    from tagweave.llm import privacy

    odd = ["a@b.c_d@e.f g@h.i", "1.2.3.4.5.6.7.8 999.1.1.1", "4111 1111 1111 1111 1", "+1 (017) 555-7713", "é1.2.3.4", "x" * 5000 + " " + "1" * 5000, "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    got = privacy.find_base(df).orderBy("doc_id").select(privacy.span_string(F.col("base_"))).collect()
    assert [r[0] for r in got] == [base_spans(t or "") for t in odd]
    reveal = [(i, f"text {i} says secretword me@x.org now") for i in range(4)] + [(i, f"plain text {i} says now") for i in range(10, 60)]
    done = privacy.sanitise(spark.createDataFrame(reveal, "doc_id long, text string")).where("doc_id < 4")
    assert all("secretword" not in r.clean_text and "[EMAIL]" in r.clean_text and "says" in r.clean_text for r in done.collect())


def test_mix(spark, docs):
    r = result(spark, "op7_mix")
    assert list(r["size"]) == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in docs.text]
    assert (r.taken <= 3 * r["size"]).all()
    g = r.assign(source=docs.source).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert g.target.sum() == pytest.approx(r["size"].sum())
    assert ((g.taken - g.target).abs() <= 0.1 * g.target + 300).all()
    assert result(spark, "op7_mix").equals(r)


def test_benchmark_passages(spark, docs):
    items = duck("SELECT * FROM benchmark", SF)
    want = [sorted(i for i, b in zip(items.item_id, items.text) if b in t) for t in docs.text]
    r = result(spark, "op8_decontaminate")
    assert [list(x) for x in r.item_ids] == want
    assert list(r.contaminated) == [bool(x) for x in want]


def test_reparameterised_questions(spark):
    from tagweave.llm import decontaminate

    bench = spark.createDataFrame([(1, "A train leaves with Anna and 120 km to go while Anna walks 5 km to the old station near the river.")], "item_id long, text string")
    same_slots = "Yes. A train leaves with Berta and 90 km to go while Berta walks 7 km to the old station near the river."
    mixed_up = "Yes. A train leaves with Berta and 90 km to go while Clara walks 7 km to the old station near the river."
    d = spark.createDataFrame([(1, same_slots), (2, mixed_up), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontaminate.contaminated(d, bench).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_repeats(spark, docs):
    seen, hit = set(), set()
    for i, t in zip(docs.doc_id, docs.text):
        w = t.lower().split()
        own = {" ".join(w[k : k + 60]) for k in range(len(w) - 59)}
        hit |= {i} if own & seen else set()
        seen |= own
    r = result(spark, "op9_sentence_spans")
    assert hit and hit <= set(r.doc_id[r.n_removed > 0])


def test_repeats_keep_the_first(spark):
    from tagweave.llm import sentence_spans

    p = "One two three four five six seven eight nine ten. Eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty."
    d = spark.createDataFrame([(1, f"Begin here. {p} End."), (2, f"Other start. {p} Done now."), (3, None), (4, "Alone.")], "doc_id long, text string")
    got = {r.doc_id: r.clean_text for r in sentence_spans.remove_repeats(d).collect()}
    assert got == {1: f"Begin here. {p} End.", 2: "Other start. Done now.", 3: "", 4: "Alone."}


def test_toxicity_learns_pairs():
    from tagweave.llm import toxicity

    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(4000):
        insult, group = rng.random(2) < 0.4
        rows.append(np.array([10 + rng.integers(50), *([1] if insult else []), *([2] if group else [])]))
        y.append(float(insult and group))
    m = toxicity.fit(rows, np.array(y))
    z = lambda t: m.bias + m.weight[m.place[t]].sum() + 0.5 * ((m.factors[m.place[t]].sum(0) ** 2).sum() - (m.factors[m.place[t]] ** 2).sum())
    assert z([1, 2]) > 0 > max(z([1]), z([2]))


def test_seek_reads_single_documents(tmp_path):
    from tagweave.llm.token_frames import ShardReader, ShardWriter

    uri = f"file://{tmp_path}/s.zst"
    w = ShardWriter(uri, "try", frame_bytes=64)
    data = [struct.pack(f"<{n}I", *range(n)) for n in (3, 0, 100, 1)]
    for i, d in enumerate(data):
        w.add(None if i == 1 else i, d)
    assert w.close() == (4, 104)
    r = ShardReader(uri)
    assert [r.ids(i) for i in (2, 0, 3, 1)] == [data[2], data[0], data[3], data[1]]
    raw = bytearray((tmp_path / "s.zst").read_bytes())
    raw[10] ^= 255
    (tmp_path / "s.zst").write_bytes(raw)
    with pytest.raises(Exception):
        ShardReader(uri).ids(0)


def test_toxicity_of_held_out_documents(spark):
    r = QUERIES["op10_toxicity"](spark, SF.replace("0.001", "0.01")).toPandas().merge(duck("SELECT doc_id, toxic FROM labels", SF.replace("0.001", "0.01")), on="doc_id")
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in r.doc_id] == list(r.held_out)
    r = r[r.held_out]
    assert r.predicted[r.toxic == 1].mean() >= 0.5 and r.predicted[r.toxic == 0].mean() <= 0.02


def test_viterbi_against_all_paths():
    from tagweave.llm.language import viterbi

    rng = np.random.default_rng(3)
    for n, k, penalty in ((1, 3, 1.0), (5, 2, 0.7), (6, 3, 1.5), (4, 3, 0.0)):
        score = rng.normal(size=(n + 2, k))
        got = viterbi(score, np.array([0, n]), np.array([n, 2]), penalty)
        worth = lambda path, s: sum(s[i, x] for i, x in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
        for own, s in ((got[:n], score[:n]), (got[n:], score[n:])):
            assert worth(own, s) == pytest.approx(max(worth(p, s) for p in itertools.product(range(k), repeat=len(s))))


def test_pipeline(spark, docs, tmp_path):
    """Each stage against plain Python on what the one before kept."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from tagweave.llm import toxicity

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "decontamination", "mixing", "token_frames"]
    stage, left = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF}/documents.parquet")
    frames = {}
    for name in list(stage)[:-1]:
        stage[name](spark, left, SF).write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        assert left.columns == list(docs.columns)
        frames[name] = left.toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id"))
    assert list(frames["toxicity"].doc_id) == [i for i, t in zip(docs.doc_id, docs.text) if toxicity.scores([t], model)[0] < 0.3]
    kept, texts = [], dict(zip(frames["toxicity"].doc_id, map(shingles, frames["toxicity"].text)))
    group = {i: i for i in texts}
    for a, b in itertools.combinations(texts, 2):
        if len(texts[a].keys() & texts[b].keys()) > 0.4 * max(len(texts[a]), len(texts[b])) and similarity(texts[a], texts[b]) >= 0.8 - 1e-9:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {i: new if g == old else g for i, g in group.items()}
    kept = sorted(set(group.values()))
    assert list(frames["minhash"].doc_id) == kept
    items = duck("SELECT text FROM benchmark", SF).text
    assert list(frames["decontamination"].doc_id) == [i for i, t in zip(frames["minhash"].doc_id, frames["minhash"].text) if not any(b in t for b in items)]
    words_of = lambda f: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in f.text)
    assert words_of(frames["mixing"]) == pytest.approx(words_of(frames["decontamination"]), rel=0.02)
    own = dict(zip(frames["decontamination"].doc_id, frames["decontamination"].text))
    assert all(set(re.findall(r"[^\x20\x09-\x0D]+", t)) <= set(re.findall(r"[^\x20\x09-\x0D]+", own[i])) for i, t in zip(frames["mixing"].doc_id, frames["mixing"].text))
    got = stage["token_frames"](spark, left, SF).toPandas().sort_values("start", kind="stable")
    t, start = Tokenizer.from_file(tokenizer_path()), 0
    for (_, text), row in zip(sorted(zip(frames["mixing"].doc_id, frames["mixing"].text), key=lambda x: (x[0], x[1].encode())), got.itertuples()):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert len(got) == len(frames["mixing"])


@pytest.mark.parametrize("kind", ["edges", "empty"])
def test_pipeline_edges(spark, tmp_path, kind):
    import corpus_pipeline

    spark.createDataFrame(ROWS if kind == "edges" else [], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, None, None)] if kind == "edges" else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "a b c d e f g h i j")] if kind == "edges" else [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(got) == (kind == "edges")


ROWS = [(1, None, None, None, 0), (2, "", "s", "en", 0), (None, "a b", None, "en", 3), (3, "a b", "s", None, 3), (3, "a b", "s", None, 3), (4, "word " * 30_000, "s", "en", 0), (5, "x" * 200_000, None, "fr", 0), (6, " \n\t ", "s", "en", 0), (7, "He said it. \n" * 50, "t", "en", 0)]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


@pytest.mark.parametrize("rows", [ROWS, []], ids=["edges", "empty"])
def test_edges(spark, rows):
    """Nulls, empty and long texts, repeated rows, empty tables, columns with the names of results."""
    from pyspark.sql import functions as F

    from tagweave.llm import decontaminate, language, mixing, near_dup, privacy, quality, sentence_spans, token_frames, toxicity

    d = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("x")).withColumn("size", F.lit("y")).withColumn("score", F.lit("z"))
    n = len(rows)
    bench = spark.createDataFrame([(1, None), (None, "a b"), (2, "a b c d e f g h i j")], "item_id long, text string")
    model = toxicity.train(d.select("text", F.lit(1).alias("toxic")).limit(0))
    counts = {name: len(df.collect()) for name, df in {
        "quality": quality.clean_lines(d), "tokens": token_frames.tokenised(spark, d, tokenizer_path()),
        "language": language.identify(d, language.train(d), ["doc_id"]), "near": near_dup.near_duplicates(d),
        "private": privacy.sanitise(d), "mix": mixing.mixed_counts(d),
        "decontaminate": decontaminate.contaminated(d, bench), "repeats": sentence_spans.remove_repeats(d), "toxic": toxicity.score(d, model),
    }.items()}
    assert counts == dict.fromkeys(counts, n)
    assert decontaminate.contaminated(d, bench.limit(0)).where("contaminated").count() == 0
    assert len(near_dup.keep_one(d).collect()) == (6 if n else 0)
    mixed = mixing.mix_documents(d)
    assert mixed.columns == d.columns and bool(mixed.collect()) == bool(n)
    if n:
        r = {x.doc_id: x for x in quality.clean_lines(d).collect()}
        assert r[1].n_words == 0 and r[1].base_failed and r[4].n_repeat_words == 30_000
        langs = {x.doc_id: (x.lang_pred, x.score) for x in language.identify(d, language.train(d), ["doc_id"]).collect()}
        assert langs[1] == ("und", 0.0)


def test_tool_calls_edges(spark):
    from tagweave.llm import tool_calls

    tools = spark.createDataFrame([("f", "n", "integer", True, 1.0), ("f", "s", "string", False, None)], "name string, param string, type string, required boolean, minimum double")
    rows = [
        (1, 0, "assistant", None, "a", "f", '{"s":"é\\"","n":2}', None), (1, 1, "tool", "ok", "a", None, None, None),
        (1, 2, "assistant", None, "b", "f", '{"n":"x","z":1}', ["a"]), (1, 3, "assistant", None, "c", "g", "{}", ["d"]), (1, 4, "assistant", None, "d", "f", "no", ["c"]),
        (1, 5, "tool", "lost", "zz", None, None, None), (1, 6, "user", None, None, None, None, None), (None, 0, "user", "x", None, None, None, None),
    ]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id string, name string, arguments string, depends array<string>")
    got = {(r.conv_id, r.turn): r for r in tool_calls.format_messages(m, tools).collect()}
    assert len(got) == len(rows)
    assert got[1, 0].json == '{"arguments":{"n":2,"s":"é\\""},"id":"a","name":"f","problems":[],"role":"assistant"}'
    assert [(got[1, t].status, got[1, t].level) for t in range(7)] == [("linked", 0), ("linked", 0), ("invalid", 1), ("invalid", -1), ("invalid", -1), ("orphan", None), ("plain", None)]
    assert '"problems":["invalid n","unknown z"]' in got[1, 2].json
    assert tool_calls.format_messages(m.limit(0), tools).count() == 0
