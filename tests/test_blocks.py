"""Block products, pruned postings and pages against plain NumPy over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.operators import blocks, pages, pruned, vectors
from tagweave.plans import adapters as ad


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def made(rng, rows, tags, density):
    return np.where(rng.random((rows, tags)) < density, rng.random((rows, tags)).round(3), 0)


def long(spark, x, names, key):
    return spark.createDataFrame([(names[i], f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], f"{key} string, tag string, w double")


@pytest.fixture(scope="module", params=[0.05, 0.3, 1.0])
def case(spark, request):
    rng = np.random.default_rng(int(request.param * 100))
    n, m, tags = 90, 7, 12
    ids, qs = sorted(str(x) for x in rng.choice(5000, n, replace=False)), [f"q{i}" for i in range(m)]
    v, f, q, g = (unit(made(rng, r, tags, request.param)) for r in (n, n, m, m))
    v[5] = v[6] = v[7]  # ties
    g[0] = 0  # a query without a full side
    frame = lambda x, k: spark.createDataFrame([(i,) for i in x], f"{k} string")
    items = blocks.packed("item_id", frame(ids, "item_id"), long(spark, v, ids, "item_id"), long(spark, f, ids, "item_id")).cache()
    queries = blocks.packed("query_id", frame(qs, "query_id"), long(spark, q, qs, "query_id"), long(spark, g, qs, "query_id")).cache()
    return ids, qs, v, q, g, (q @ v.T).round(9), (g @ f.T).round(9), items, queries


def norm(s):
    return (s - s.min(1, keepdims=True)) / (s.max(1, keepdims=True) - s.min(1, keepdims=True) + 1e-9)


def place(s):
    return np.argsort(np.argsort(-s, axis=1, kind="stable"), axis=1, kind="stable") + 1


def test_best_and_ranks(spark, case, monkeypatch):
    ids, qs, _, _, g, base, full, items, queries = case
    monkeypatch.setattr(blocks, "BLOCK", 20)
    monkeypatch.setattr(blocks, "TARGETS", 10)
    monkeypatch.setattr(blocks.over_blocks, "__defaults__", ((), 20))
    asked = blocks.with_bounds(items, queries)
    wanted = {"hybrid": np.where(g.any(1)[:, None], (0.6 * norm(base) + 0.4 * norm(full)).round(9), base), "0.3": (0.3 * norm(base) + 0.7 * norm(full)).round(9), "base": base}
    methods = [("hybrid", "hybrid"), ("0.3", 0.3), ("base", "base")]
    got = {(r.method, r.query_id, r["rank"]): (r.item_id, r.score) for r in blocks.best(items, asked, methods, 8).collect()}
    targets = spark.createDataFrame([(q, i) for q in qs for i in [*ids[::2], "none"]], "query_id string, item_id string")
    counted = {(r.method, r.query_id, r.item_id): r["rank"] for r in blocks.ranks(items, asked, targets, methods).collect()}
    assert len(counted) == 3 * len(qs) * len(ids[::2])
    for method, s in wanted.items():
        order = np.argsort(-s, axis=1, kind="stable")
        for i, q in enumerate(qs):
            assert [got[method, q, r + 1][0] for r in range(8)] == [ids[j] for j in order[i, :8]]
            assert [counted[method, q, x] for x in ids[::2]] == place(s)[i, ::2].tolist()


def test_fusion(spark, case):
    ids, qs, *_, base, full, items, queries = case
    fused = (1 / (3 + place(base)) + 1 / (3 + place(full))).round(9)
    order = np.argsort(-fused, axis=1, kind="stable")
    got = {(r.query_id, r["rank"]): r.item_id for r in blocks.fused_best(items, queries, 5, 3).collect()}
    own = spark.createDataFrame([(q, ids[(11 * i) % len(ids)]) for i, q in enumerate(qs)], "query_id string, item_id string")
    of_own = {r.query_id: r["rank"] for r in blocks.fused_ranks(items, queries, blocks.ranks(items, queries, own, blocks.SIDES), 3).collect()}
    for i, q in enumerate(qs):
        assert [got[q, r + 1] for r in range(5)] == [ids[j] for j in order[i, :5]]
        assert of_own[q] == place(fused)[i, (11 * i) % len(ids)]


def test_pruned(spark, case):
    ids, qs, v, q, *_ = case
    base = case[5]
    index = pruned.postings(long(spark, v, ids, "item_id"), shard=40, block=4).cache()
    got = pruned.top_items(long(spark, q, qs, "query_id"), index, 6).orderBy("query_id", F.desc("score"), "item_id").collect()
    for i, name in enumerate(qs):
        order = [j for j in np.argsort(-base[i], kind="stable")[:6] if base[i, j] > 0]
        mine = [r for r in got if r.query_id == name][:6]
        assert [r.item_id for r in mine if r.score > 0] == [ids[j] for j in order]
        assert [r.score for r in mine if r.score > 0] == pytest.approx([base[i, j] for j in order], abs=2e-9)


def test_few_pairs_are_scored(spark):
    """A tenth of the pairs at most, on vectors of which each has nearly half of all tags."""
    sf = "/root/testdata/sf0.1"
    h = ad.hair(spark, sf)
    w = vectors.idf(vectors.doc_freq(h, ad.vocab(spark)), ad.items(spark, sf))
    index = pruned.postings(vectors.normalize(h, w)).cache()
    asked = vectors.normalize(ad.queries(h), w, "query_id").cache()
    each = pruned.top_items(asked, index).groupBy("query_id").agg(F.max("n_scored").alias("n"))
    share = each.agg(F.sum("n") / F.count("*")).first()[0] / ad.items(spark, sf).count()
    assert share <= 0.1


@pytest.mark.parametrize("p", [1, 2, 5, 99])
def test_pages(spark, case, monkeypatch, p):
    ids, qs, *_, base, _, items, queries = case
    monkeypatch.setattr(pages, "FIRST", 1)
    monkeypatch.setattr(pages, "MORE", 2)
    rng = np.random.default_rng(p)
    wish = rng.integers(0, 9, len(ids))
    known = spark.createDataFrame(list(zip(ids, wish.tolist())), "item_id string, wish int")
    x = np.log1p(wish)
    near = (base - base.min(1, keepdims=True)) / np.where(np.ptp(base, axis=1, keepdims=True) > 0, np.ptp(base, axis=1, keepdims=True), 1)
    key = (0.6 * np.where(np.ptp(base, axis=1, keepdims=True) > 0, near, 0.5) + 0.4 * (x - x.min()) / np.ptp(x)).round(9)
    page = min(p, -(-len(ids) // 7))
    lo, hi = (page - 1) * 7, min(page * 7, len(ids))
    for got, s in ((pages.merged_page(items, queries, pages.popularity(known), p, 7), key), (pages.similar_page(items, queries, p, 7), base)):
        rows = {(r.query_id, r["rank"]): r for r in got.collect()}
        assert len(rows) == len(qs) * (hi - lo)
        for i, q in enumerate(qs):
            order = np.argsort(-s[i], kind="stable")
            assert [rows[q, r + 1].item_id for r in range(lo, hi)] == [ids[j] for j in order[lo:hi]]
        assert {(r.total, r.page, r.shown_from, r.shown_to) for r in rows.values()} == {(len(ids), page, lo + 1, hi)}


def test_recency(spark):
    rows = [("10", "2024-01-02"), ("9", None), ("11", "bad"), ("x", ""), ("-5", ""), ("7", "2024-01-02 00:00:01"), ("5000", ""), ("3", "1960-05-05")]
    got = pages.recency(spark.createDataFrame(rows, "item_id string, published_at string")).orderBy("prior").collect()
    assert [r.item_id for r in got] == ["x", "-5", "9", "11", "5000", "3", "10", "7"]
    assert [r.prior for r in got] == pytest.approx([i / 7 for i in range(8)])
