"""The draw, its limits, and the parts of documents against a count in plain Python."""

import re

import numpy as np
import pytest


def docs(spark, sizes):
    rows = [(i, s, " ".join(f"w{k}" for k in range(n))) for i, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


@pytest.mark.parametrize("sizes", [[("a", 900), ("b", 40), ("c", 700), (None, 33), ("d", 0)], [(f"s{i % 6}", 10 + i % 90) for i in range(400)], [("a", 1)]], ids=["capped", "many", "one word"])
def test_parts_add_up(spark, sizes):
    from tagweave.llm import mixing

    d = docs(spark, sizes)
    r = mixing.mixed_counts(d, slots=16).toPandas().sort_values("doc_id")
    assert (r.taken <= 3 * r["size"]).all() and (r.target <= 3 * r.source_size).all()
    assert r.taken.sum() == pytest.approx(r["size"].sum(), abs=32 * 6)
    texts = mixing.mix_documents(d, slots=16).toPandas()
    assert sum(len(re.findall(r"\S+", t)) for t in texts.text) == r.taken.sum()
    by = r.assign(source=[s or "" for s, _ in sizes])
    per = by.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((per.taken - per.target).abs() <= 32 * 16).all()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_of_a_small_table(spark, seed):
    """Twenty sources and 400,000 words, three shards of full length: each source is near its target all the same."""
    from tagweave.llm import mixing

    table = spark.createDataFrame([(f"s{i:02}", 20_000, 20_000 * (0.5 + i / 19)) for i in range(20)], "source string, source_size long, target double")
    got = mixing.taken_blocks(table, seed=seed).groupBy("source").count().toPandas().set_index("source")["count"] * mixing.BLOCK_WORDS
    want = table.toPandas().set_index("source")["target"]
    assert ((got / want - 1).abs() < 0.02).all()


def test_rows_that_differ_elsewhere(spark):
    """Of rows with one id, source and text, the same one stands for all in every run; a changed order changes nothing."""
    from tagweave.llm import mixing

    d = spark.createDataFrame([(1, "a", "b c d", f"x{i}") for i in range(20)], "doc_id long, source string, text string, more string")
    runs = [{r.more for r in mixing.mix_documents(x).collect()} for x in (d, d.repartition(5), d.orderBy("more"))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 1


def test_shards_are_multinomial(spark):
    from tagweave.llm import mixing

    share = np.array([0.5, 0.3, 0.2])
    shards = spark.range(400).selectExpr("id as shard", "100L as n")
    p = mixing.draw(shards, share * 7, 1, 0).toPandas().pivot(index="shard", columns="source_no", values="n").fillna(0)
    assert (p.sum(axis=1) == 100).all()
    assert np.allclose(p.mean() / 100, share, atol=0.01)
    assert np.allclose(p.var(), 100 * share * (1 - share), rtol=0.25)


def test_permutations(spark):
    from tagweave.llm import mixing

    for n in (1, 2, 7, 64, 1000):
        j = np.arange(n)
        got = mixing._permute(j, np.full(n, n, np.uint64), np.full(n, 5, np.uint64))
        assert sorted(got.tolist()) == j.tolist()
