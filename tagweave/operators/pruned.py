"""The exact k best items of each query without scoring all pairs: impact-ordered postings in blocks, and upper bounds.

Items are dealt into shards. In a shard each tag has its items by falling weight, in blocks that know their largest weight. A
query goes over its tags by falling weight. Weights are of length one, so what the tags still to come can add is at most the
product of both rests' lengths: items, and whole blocks of items not met before, that cannot reach the k-th best known score
are passed over, and only what is left is scored in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Items of a shard, postings of a block, queries that go to a shard at once.
SHARD = 8192
POSTINGS = 64
QUERIES = 256
PLACES = 9
#: What rounding may add to a bound.
SLACK = 2e-9
#: After so many of a query's tags, that many items, the best by then, are scored in full: their k-th best is the first limit.
SEED_TAGS, SEED_ITEMS = 3, 48
#: Share of a shard's items: once no more are left, they are scored one by one.
FEW = 0.05


def postings(vectors: DataFrame, shard: int = SHARD, block: int = POSTINGS) -> DataFrame:
    """(shard, tag, block, w_max, items, ws) of vectors (item_id, tag, w) of length one: the index, to be written once."""
    n = max(1, -(-vectors.select("item_id").distinct().count() // shard))
    rows = vectors.where("w > 0").withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("long"))
    order = Window.partitionBy("shard", "tag").orderBy(F.desc("w"), "item_id")
    placed = rows.withColumn("block", F.floor((F.row_number().over(order) - 1) / block))
    lists = placed.groupBy("shard", "tag", "block").agg(F.max("w").alias("w_max"), F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("n"), "item_id"))).alias("p"))
    return lists.select("shard", "tag", "block", "w_max", F.col("p.item_id").alias("items"), F.transform("p.n", lambda x: -x).alias("ws"))


class Shard:
    """Postings of one shard as arrays; items are numbered in the order of their ids."""

    def __init__(self, tags: list[str], blocks: list[int], items: list[list[str]], ws: list[np.ndarray]):
        self.ids, number = np.unique(np.concatenate([np.array(x, object) for x in items]).astype(str), return_inverse=True)
        size = np.array([len(x) for x in items])
        cut = np.cumsum(size) - size
        w = np.concatenate(ws)
        self.lists: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rows: dict[str, list[int]] = {}
        for i in np.argsort(blocks, kind="stable").tolist():
            rows.setdefault(tags[i], []).append(i)
        self.tag_no = {t: i for i, t in enumerate(rows)}
        for t, own in rows.items():
            at = np.concatenate([np.arange(cut[i], cut[i] + size[i]) for i in own])
            first = np.cumsum([size[i] for i in own]) - np.array([size[i] for i in own])
            self.lists[t] = (number[at], w[at], first)
        tag_of = np.repeat([self.tag_no[t] for t in tags], size)
        order = np.argsort(number, kind="stable")
        self.tag, self.w = tag_of[order], w[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(self.ids)))])
        self.scored = 0

    def full_scores(self, items: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of single items, from their own tags."""
        size = self.at[items + 1] - self.at[items]
        take = np.repeat(self.at[items] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        self.scored += len(items)
        return np.bincount(np.repeat(np.arange(len(items)), size), weights[self.tag[take]] * self.w[take], minlength=len(items))

    def best(self, query: list[tuple[str, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(items, scores): the k best that share a tag, best first, ties by id."""
        query = sorted(((t, w) for t, w in query if w > 0), key=lambda x: (-x[1], x[0]))
        rest = np.sqrt(np.append(np.cumsum([w * w for _, w in query][::-1])[::-1], 0.0)) if query else np.zeros(1)
        weights = np.zeros(len(self.tag_no))
        for t, w in query:
            if t in self.tag_no:
                weights[self.tag_no[t]] = w
        limit = 0.0
        got, length, met = np.zeros(len(self.ids)), np.zeros(len(self.ids)), np.zeros(len(self.ids), bool)
        alive = np.empty(0, np.int64)
        for j, (t, q) in enumerate(query):
            if t in self.lists:
                items, w, blocks = self.lists[t]
                # An item met here first has at most q * w and the rests' product, which falls with w below its peak.
                peak = q / max(1e-300, float(np.hypot(q, rest[j + 1])))
                top = np.minimum(w[blocks], peak)
                open_ = np.flatnonzero(q * top + rest[j + 1] * np.sqrt(1 - top * top) >= limit)
                upto = (blocks[open_[-1] + 1] if open_[-1] + 1 < len(blocks) else len(items)) if len(open_) else 0
                keep = met[items]
                keep[:upto] = True
                items, w = items[keep], w[keep]
                got[items] += q * w
                length[items] += w * w
                met[items] = True
            alive = np.flatnonzero(met)
            if j == min(SEED_TAGS, len(query)) - 1 and len(alive) > k:
                seed = alive[np.argsort(-got[alive], kind="stable")[: max(SEED_ITEMS, 2 * k)]]
                limit = np.sort(self.full_scores(seed, weights))[-k] - SLACK
            alive = alive[got[alive] + rest[j + 1] * np.sqrt(np.maximum(0.0, 1 - length[alive])) >= limit]
            if rest[j + 1] < limit:  # nothing not met yet can come in
                out = np.ones(len(met), bool)
                out[alive] = False
                met &= ~out
                if len(alive) <= FEW * len(self.ids):
                    break
        score = np.round(self.full_scores(alive, weights), PLACES)
        order = np.lexsort((alive, -score))[:k]
        return self.ids[alive[order]], score[order]


def top_items(queries: DataFrame, index: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, item_id, score): for each query (query_id, tag, w) the k best items that share a tag, and per shard no more
    than k; n_scored says how many items of the shard were scored in full for the query. index: postings(), written.

    A shard's postings of the tags that a block of queries has, and the block, are one group.
    """
    lists = queries.groupBy("query_id").agg(F.collect_list(F.struct("tag", "w")).alias("tags"))
    n = max(1, -(-lists.count() // QUERIES))
    asked = lists.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n)))
    wanted = asked.select(F.col("qb").alias("of_qb"), F.explode("tags.tag").alias("tag")).distinct()
    left = index.join(wanted, "tag")
    last = index.agg(F.max("shard")).first()[0] or 0
    right = asked.withColumn("shard", F.explode(F.expr(f"sequence(0L, {last}L)")))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "item_id": [], "score": [], "n_scored": []}
        if left.num_rows and right.num_rows:
            whole = Shard(left.column("tag").to_pylist(), left.column("block").to_pylist(), left.column("items").to_pylist(), [np.asarray(x) for x in left.column("ws").to_pylist()])
            for q, tags in zip(right.column("query_id").to_pylist(), right.column("tags").to_pylist()):
                before = whole.scored
                ids, scores = whole.best([(t["tag"], t["w"]) for t in tags], k)
                out["query_id"] += [q] * len(ids)
                out["item_id"] += ids.tolist()
                out["score"] += scores.tolist()
                out["n_scored"] += [whole.scored - before] * len(ids)
        return pa.table(out, schema=pa.schema([("query_id", pa.string()), ("item_id", pa.string()), ("score", pa.float64()), ("n_scored", pa.int64())]))

    return left.groupBy("shard", "of_qb").cogroup(right.groupBy("shard", "qb")).applyInArrow(search, "query_id string, item_id string, score double, n_scored long")
