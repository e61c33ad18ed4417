"""Pages of filtered lists for many queries, without listing a query's items.

A batch of queries shares one filter. Its items have one order by popularity or by date, which all queries share; a query's own
order is by similarity. Both are merged in products of blocks, of which only a page's items and those before it come out.
Totals and page numbers are counts of the filtered items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.operators import blocks
from tagweave.operators.browse import PAGE, SIMILAR
from tagweave.operators.search import running
from tagweave.sources.scratch import written

PLACES = blocks.PLACES
#: Candidates that gather for a page before they are cut to its end: how many at least, and how many times as many as are kept.
FIRST, MORE = 1024, 4
PAGED: blocks.Methods = [("page", "page")]


def place(n: int, p: int, size: int = PAGE) -> tuple[int, int, int, int]:
    """(page, pages, from, to) of page p of n items, p clamped to the pages there are; to is under from if there are none."""
    pages = max(1, -(-n // size))
    page = max(1, min(p, pages))
    return page, pages, (page - 1) * size + 1, min(page * size, n)


def _numbered(df: DataFrame, n: int, p: int, size: int) -> DataFrame:
    page, pages, lo, hi = place(n, p, size)
    numbers = {"total": n, "pages": pages, "page": page, "shown_from": lo, "shown_to": hi}
    return df.where(F.col("rank").between(lo, hi)).withColumns({c: F.lit(v).cast("long") for c, v in numbers.items()})


def similar_page(items: DataFrame, queries: DataFrame, p: int, size: int = PAGE) -> DataFrame:
    """(query_id, item_id, score, rank, total, pages, page, shown_from, shown_to): page p of the packed items by base score,
    ties by item_id. Pages of the second half are read from the end."""
    n = items.count()
    _, _, lo, hi = place(n, p, size)
    if 2 * lo <= n + 1:
        found = blocks.best(items, queries, blocks.SIDES[:1], hi)
    else:
        found = blocks.best(items, queries, blocks.SIDES[:1], n - lo + 1, last=True).withColumn("rank", F.lit(n) - F.col("rank") + 1)
    return _numbered(found.drop("method"), n, p, size)


def normalised(df: DataFrame, column: str) -> DataFrame:
    """(item_id, prior): the column between its bounds over all rows, 0.5 if they are the same. Bounds are one row."""
    ends = df.agg(F.min(column).alias("lo_"), F.max(column).alias("hi_"))
    x = F.when(F.col("hi_") == F.col("lo_"), 0.5).otherwise((F.col(column) - F.col("lo_")) / (F.col("hi_") - F.col("lo_")))
    return df.join(F.broadcast(ends)).select("item_id", x.alias("prior"))


def popularity(items: DataFrame) -> DataFrame:
    """(item_id, prior) of the filtered items (item_id, wish): the normalised ln(1 + wish)."""
    return normalised(items.select("item_id", F.log1p(F.coalesce("wish", F.lit(0))).alias("x")), "x")


def recency(items: DataFrame) -> DataFrame:
    """(item_id, prior) of the filtered items (item_id, published_at): the oldest-first position over n - 1. Items without a
    readable date come before all others, by their numbers. Positions are counts by day, and by thousands of numbers."""
    number = F.expr("try_cast(item_id as bigint)")
    df = items.select("item_id", F.expr("try_to_timestamp(published_at)").alias("at")).withColumns({"dated": F.col("at").isNotNull(), "number": number})
    day, thousand = F.unix_date(F.col("at").cast("date")).cast("long"), F.floor(F.col("number") / 1000)
    df = written(df.withColumn("bucket", F.struct("dated", F.coalesce(F.when(F.col("dated"), day).otherwise(thousand), F.lit(-(1 << 62))).alias("n"))), "dated")
    n = df.count()
    pos = running(df, [], [("pos", F.col("bucket"), ["at", "number", "item_id"], F.lit(1))])
    return pos.select("item_id", ((F.col("pos") - 1) / max(1, n - 1)).alias("prior"))


def merged_page(items: DataFrame, queries: DataFrame, prior: DataFrame, p: int, size: int = PAGE, share: float = SIMILAR) -> DataFrame:
    """(query_id, item_id, sort_key, rank, total, pages, page, shown_from, shown_to): page p of the packed items by share of the
    normalised base score and 1 - share of the prior (item_id, prior between 0 and 1), ties by item_id. Pages of the second half
    are read from the end.

    All keys are formed in the blocks, for which the prior goes along with the items; only the first or last ones come out.
    """
    n = items.count()
    _, _, lo, hi = place(n, p, size)
    rows = blocks.dealt(items.join(prior, "item_id"), "item_id", ids=items)
    asked = blocks.with_bounds(rows, queries, ("base",)).withColumn("share_", F.lit(float(share)))
    if 2 * lo <= n + 1:
        found = blocks.best(rows, asked, PAGED, hi, gather=(FIRST, MORE))
    else:
        found = blocks.best(rows, asked, PAGED, n - lo + 1, last=True, gather=(FIRST, MORE)).withColumn("rank", F.lit(n) - F.col("rank") + 1)
    return _numbered(found.withColumnRenamed("score", "sort_key").drop("method"), n, p, size)
