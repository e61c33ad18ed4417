"""Ranks, bounds and blends without listing all pairs, against plain NumPy over all pairs."""

import numpy as np
import pytest

from tagweave.operators import search


@pytest.mark.parametrize("density", [0.05, 0.3, 1.0])
def test_against_all_pairs(spark, density):
    rng = np.random.default_rng(int(density * 100))
    n, m, tags, k = 60, 7, 12, 8
    ids = sorted(str(x) for x in rng.choice(5000, n, replace=False))

    def table(rows):
        x = np.where(rng.random((rows, tags)) < density, rng.random((rows, tags)).round(3), 0)
        return x

    v, f, q, g = table(n), table(n), table(m), table(m)
    g[0] = 0  # a query without a full side
    idf = rng.random(tags) + 0.5
    long = lambda x, names, key: spark.createDataFrame([(names[i], f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], f"{key} string, tag string, conf double")
    qs = [f"q{i}" for i in range(m)]
    items = spark.createDataFrame([(i,) for i in ids], "item_id string")
    w = spark.createDataFrame([(f"t{j}", float(idf[j])) for j in range(tags)], "tag string, idf double")
    asked = spark.createDataFrame([(x,) for x in qs], "query_id string")
    fq = long(g, qs, "query_id")
    pairs = search.with_first_items(search.both_scores(long(q, qs, "query_id"), fq, long(v, ids, "item_id"), long(f, ids, "item_id"), w), asked, items, k)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    base, full = (unit(q * idf) @ unit(v * idf).T).round(9), (unit(g) @ unit(f).T).round(9)
    norm = lambda s: (s - s.min(1, keepdims=True)) / (s.max(1, keepdims=True) - s.min(1, keepdims=True) + 1e-9)
    rank = lambda s: np.argsort(np.argsort(-s, axis=1, kind="stable"), axis=1) + 1
    blend = np.where(g.any(1)[:, None], 0.6 * norm(base) + 0.4 * norm(full), base)
    fused = 1 / (60 + rank(base)) + 1 / (60 + rank(full))
    for got, want in ((search.blended(pairs, items, fq), blend), (search.rrf(pairs, items), fused), (pairs.withColumnRenamed("base", "score"), base)):
        top = {(r.query_id, r["rank"]): (r.item_id, r.score) for r in search.top_k(got, k).collect()}
        order = np.argsort(-want.round(9), axis=1, kind="stable")[:, :k]
        for i, x in enumerate(qs):
            assert [top[x, r + 1][0] for r in range(k)] == [ids[j] for j in order[i]]
            assert [top[x, r + 1][1] for r in range(k)] == pytest.approx(list(want[i, order[i]]), abs=2e-9)
