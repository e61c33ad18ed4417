"""Ranking items for many queries: cosines, blends, rank fusion, enrichment.

Only pairs that share a tag are scored. Weights are not negative, so all other pairs score 0: they matter to bounds (their
lower end is 0) and to ranks (they come last, by id), and both follow from counts, without listing them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.operators.vectors import normalize

ALPHA = 0.6
SWEEP = (0.3, 0.4, 0.5, 0.6, 0.7)
RRF_K = 60
PLACES = 9


def shared_scores(queries: DataFrame, items: DataFrame, by: tuple = ()) -> DataFrame:
    """(by, query_id, item_id, score) of pairs that share a tag; both sides are (by, id, tag, w) of length one. Scores have
    PLACES places, which any order of adding up leaves alone, so that ties are ties."""
    pairs = queries.join(items.select(*by, "item_id", "tag", F.col("w").alias("wi")), [*by, "tag"])
    return pairs.groupBy(*by, "query_id", "item_id").agg(F.round(F.sum(F.col("w") * F.col("wi")), PLACES).alias("score"))


def cosine_scores(queries: DataFrame, vectors: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id, score) of queries (query_id, tag, conf) and items (item_id, tag, conf) that share a tag."""
    return shared_scores(normalize(queries, weights, "query_id"), normalize(vectors, weights))


def both_scores(queries: DataFrame, full_queries: DataFrame, vectors: DataFrame, full: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, item_id, base, full) of pairs that share a tag on either side, in one join; 0 on the other side."""
    side = lambda df, n: df.withColumn("side", F.lit(n))
    q = side(normalize(queries, weights, "query_id"), 0).unionAll(side(normalize(full_queries, None, "query_id"), 1))
    v = side(normalize(vectors, weights), 0).unionAll(side(normalize(full), 1))
    pairs = q.join(v.select("side", "tag", "item_id", F.col("w").alias("wi")), ["side", "tag"])
    total = lambda n: F.round(F.coalesce(F.sum(F.when(F.col("side") == n, F.col("w") * F.col("wi"))), F.lit(0.0)), PLACES)
    return pairs.groupBy("query_id", "item_id").agg(total(0).alias("base"), total(1).alias("full"))


def with_first_items(pairs: DataFrame, queries: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """pairs and, with scores of 0, the first k items by id for each query. Items that share nothing come last by id, so
    no others can be among a query's k best. k rows are broadcast."""
    first = items.select("item_id").orderBy("item_id").limit(k)
    more = queries.select("query_id").distinct().crossJoin(F.broadcast(first)).join(pairs.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    scores = [c for c in pairs.columns if c not in ("query_id", "item_id")]
    return pairs.unionByName(more.select("query_id", "item_id", *[F.lit(0.0).alias(c) for c in scores]))


def top_k(scores: DataFrame, k: int = 10, score: str = "score", by: tuple = ()) -> DataFrame:
    """The k best items of each query with `rank`, ties by item_id."""
    order = Window.partitionBy(*by, "query_id").orderBy(F.desc(score), "item_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def minmax(pairs: DataFrame, items: DataFrame, scores: list[str]) -> DataFrame:
    """pairs with each score as (x - lo) / (hi - lo + 1e-9) over all items: lo is 0 if an item shares nothing. Bounds are a
    partial aggregate, joined back; the number of items is one row."""
    each = [f(c).alias(f"{n}_{c}") for c in scores for n, f in (("lo", F.min), ("hi", F.max))]
    n = items.agg(F.count("*").alias("all_"))
    bounds = pairs.groupBy("query_id").agg(F.count("*").alias("met_"), *each).crossJoin(n)
    out = pairs.join(bounds, "query_id")
    lo = lambda c: F.when(F.col("met_") < F.col("all_"), F.least(F.lit(0.0), F.col(f"lo_{c}"))).otherwise(F.col(f"lo_{c}"))
    return out.withColumns({c: (F.col(c) - lo(c)) / (F.col(f"hi_{c}") - lo(c) + 1e-9) for c in scores}).select(*pairs.columns)


def blended(pairs: DataFrame, items: DataFrame, full_queries: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(query_id, item_id, score): alpha of the normalised base score and 1 - alpha of the normalised full score; the plain
    base score for queries without a full side."""
    has = full_queries.select("query_id", F.lit(True).alias("has_")).distinct()
    mixed = minmax(pairs.withColumn("plain_", F.col("base")), items, ["base", "full"]).join(has, "query_id", "left")
    score = F.when(F.col("has_"), alpha * F.col("base") + (1 - alpha) * F.col("full")).otherwise(F.col("plain_"))
    return mixed.select("query_id", "item_id", F.round(score, PLACES).alias("score"))


def search(queries: DataFrame, full_queries: DataFrame, vectors: DataFrame, full: DataFrame, items: DataFrame, weights: DataFrame, k: int = 10, alpha: float = ALPHA) -> DataFrame:
    pairs = with_first_items(both_scores(queries, full_queries, vectors, full, weights), queries, items, k)
    return top_k(blended(pairs, items, full_queries, alpha), k)


def blend_sweep(pairs: DataFrame, items: DataFrame, alphas: tuple = SWEEP) -> DataFrame:
    """(alpha, query_id, item_id, score) for each alpha, in one pass over the normalised scores."""
    both = minmax(pairs, items, ["base", "full"]).withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    return both.select("alpha", "query_id", "item_id", F.round(F.col("alpha") * F.col("base") + (1 - F.col("alpha")) * F.col("full"), PLACES).alias("score"))


def running(df: DataFrame, by: list[str], sums: list[tuple[str, Column, list, Column]]) -> DataFrame:
    """df with the column of each of sums (name, bucket, order, value): the sum of value over the rows of `by` up to each
    row, in order of bucket and then of `order`.

    Buckets' sums are added up over one row per bucket, and each bucket's rows on their own, so that no list is in one task.
    df is read once for each sum besides, so it should be a table.
    """
    out = df.withColumns({f"bucket_{n}": bucket for n, bucket, _, _ in sums})
    for name, bucket, order, value in sums:
        inside = Window.partitionBy(*by, f"bucket_{name}").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(f"own_{name}", F.sum(value).over(inside))
    for name, bucket, _, value in sums:
        per = df.groupBy(*by, bucket.alias(f"bucket_{name}")).agg(F.sum(value).alias("sum_"))
        before = Window.partitionBy(*by).orderBy(f"bucket_{name}").rowsBetween(Window.unboundedPreceding, -1)
        base = per.select(*by, f"bucket_{name}", F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("base_"))
        out = out.join(base, [*by, f"bucket_{name}"]).withColumn(name, F.col("base_") + F.col(f"own_{name}")).drop("base_", f"own_{name}", f"bucket_{name}")
    return out


def rrf(pairs: DataFrame, items: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of the ranks among all items, ties by item_id. An item that scores 0 comes after those that
    do not, at its place by id among the rest."""
    prefix, sums = F.substring("item_id", 1, 3), []
    for c in ("base", "full"):
        some = (F.col(c) > 0).cast("int")
        sums += [(f"up_{c}", F.floor(-F.col(c) * 256), [F.desc(c), "item_id"], some), (f"before_{c}", prefix, ["item_id"], some)]
    n = pairs.groupBy("query_id").agg(*[F.count_if(F.col(c) > 0).alias(f"n_{c}") for c in ("base", "full")])
    ord_ = running(items.select("item_id").distinct(), [], [("ord", prefix, ["item_id"], F.lit(1))])
    df = running(pairs, ["query_id"], sums).join(ord_, "item_id").join(n, "query_id")
    rank = lambda c: F.when(F.col(c) > 0, F.col(f"up_{c}")).otherwise(F.col(f"n_{c}") + F.col("ord") - F.col(f"before_{c}"))
    return df.select("query_id", "item_id", F.round(1 / (k + rank("base")) + 1 / (k + rank("full")), PLACES).alias("score"))


def enrich(results: DataFrame, catalog: DataFrame, stats: DataFrame, entities: DataFrame, base_url: str = "https://example.com/items/") -> DataFrame:
    """Ranked ids with what is known of them: link (else built from the id), wish (else 0), date (else ""), sorted entities."""
    return (
        results.join(catalog, "item_id", "left").join(stats, "item_id", "left").join(entities, "item_id", "left")
        .withColumn("url", F.coalesce("url", F.concat(F.lit(base_url), "item_id")))
        .withColumn("wish", F.coalesce("wish", F.lit(0)))
        .withColumn("published_at", F.coalesce("published_at", F.lit("")))
        .withColumn("avatars", F.array_sort(F.coalesce("avatars", F.array().cast("array<string>"))))
    )
