"""Filters, orders and pages of given result lists; for pages without listing, see pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions.fields import normal_form
from tagweave.operators.vectors import STRONG

SIMILAR = 0.6
PAGE = 10


def contains_any(vectors: DataFrame, tags: list[str], thresh: float = STRONG) -> DataFrame:
    """(item_id) of items that hold a selected tag with at least thresh."""
    return vectors.where(F.col("tag").isin(tags) & (F.col("conf") >= thresh)).select("item_id").distinct()


def keyword_hit(items: DataFrame, keyword: str) -> DataFrame:
    """items whose name, a tag or description (all normalised before) contain the keyword's normal form; empty: all."""
    keyword = normal_form(keyword)
    kw = F.lit(keyword)
    return items.where(F.coalesce(F.col("name").contains(kw), F.lit(False)) | F.coalesce(F.exists("tags", lambda t: t.contains(kw)), F.lit(False)) | F.coalesce(F.col("description").contains(kw), F.lit(False))) if keyword else items


def filter_results(results: DataFrame, vectors: DataFrame, items: DataFrame, tag_only: bool, tags: list[str], keyword: str) -> DataFrame:
    """The tag filter if it is on and tags were selected, then the keyword filter if there is a keyword."""
    if tag_only and tags:
        results = results.join(contains_any(vectors, tags), "item_id", "left_semi")
    if keyword.strip():
        results = results.join(keyword_hit(items, keyword).select("item_id"), "item_id", "left_semi")
    return results


def _norm(df: DataFrame, column: str, out: str) -> DataFrame:
    bounds = df.groupBy("query_id").agg(F.min(column).alias("lo_"), F.max(column).alias("hi_"))
    return df.join(bounds, "query_id").withColumn(out, F.when(F.col("hi_") == F.col("lo_"), 0.5).otherwise((F.col(column) - F.col("lo_")) / (F.col("hi_") - F.col("lo_")))).drop("lo_", "hi_")


def sort_popular(results: DataFrame) -> DataFrame:
    """sort_key: 0.6 of the normalised score and 0.4 of the normalised ln(1 + wish), over each query's filtered list."""
    df = _norm(results.withColumn("pop_", F.log1p(F.coalesce("wish", F.lit(0)))), "pop_", "p_")
    return _norm(df, "score", "s_").withColumn("sort_key", SIMILAR * F.col("s_") + (1 - SIMILAR) * F.col("p_")).drop("pop_", "p_", "s_")


def sort_recent(results: DataFrame) -> DataFrame:
    """sort_key: 0.6 of the normalised score and 0.4 of the recency, the oldest-first position over n - 1. Items with a
    readable date come after those without, which are in the order of their numbers."""
    at = F.expr("try_to_timestamp(published_at)")
    df = results.withColumn("at_", at).withColumn("dated_", F.col("at_").isNotNull())
    order = Window.partitionBy("query_id").orderBy("dated_", "at_", F.expr("try_cast(item_id as bigint)"), "item_id")
    n = results.groupBy("query_id").agg(F.count("*").alias("n_"))
    df = df.withColumn("pos_", F.row_number().over(order) - 1).join(n, "query_id").withColumn("r_", F.col("pos_") / F.greatest(F.lit(1), F.col("n_") - 1))
    return _norm(df, "score", "s_").withColumn("sort_key", SIMILAR * F.col("s_") + (1 - SIMILAR) * F.col("r_")).drop("at_", "dated_", "pos_", "n_", "r_", "s_")


def sort_similarity(results: DataFrame) -> DataFrame:
    return results.withColumn("sort_key", F.col("score"))


def page(results: DataFrame, p: int, size: int = PAGE) -> DataFrame:
    """Page p of each query's list by sort_key, with rank, page, pages, shown_from, shown_to and total; p is clamped."""
    order = Window.partitionBy("query_id").orderBy(F.desc("sort_key"), "item_id")
    n = results.groupBy("query_id").agg(F.count("*").alias("total"))
    df = results.withColumn("rank", F.row_number().over(order)).join(n, "query_id")
    df = df.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size))).withColumn("page", F.greatest(F.lit(1), F.least(F.lit(p), F.col("pages"))))
    df = df.withColumn("shown_from", (F.col("page") - 1) * size + 1).withColumn("shown_to", F.least(F.col("page") * size, F.col("total")))
    return df.where((F.col("rank") >= F.col("shown_from")) & (F.col("rank") <= F.col("shown_to")))
