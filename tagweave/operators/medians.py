"""Exact medians of few classes of many values, by refining histograms: no class' values meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of a pass: what comes to the driver has as many rows for each value that is looked for.
BUCKETS = 1024


def medians(df: DataFrame, by: str, value: str) -> dict:
    """{class: median} of the values (null and NaN ones aside); the mean of both middle values of an even number of them.

    A pass counts the values in equal buckets between the bounds of what is left, and goes on in the bucket that holds the
    wanted place, between the least and the greatest value there: a stretch of equal values ends it. Doubles take about six
    passes. Classes without a value are not listed. df should be a table, as each pass reads it.
    """
    rows = df.select(F.col(by).alias("class"), F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    found: dict[tuple, float] = {}
    open_: list[tuple] = []  # (class, which of both, place, from, to)
    for r in rows.groupBy("class").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
        open_ += [(r["class"], which, place, r["lo"], r["hi"]) for which, place in enumerate(((r["n"] - 1) // 2, r["n"] // 2))]
    kind = rows.schema["class"].dataType.simpleString()
    while open_:
        for c, which, _, lo, hi in open_:
            if lo == hi:
                found[c, which] = lo
        open_ = [t for t in open_ if t[3] < t[4]]
        if not open_:
            break
        ranges = rows.sparkSession.createDataFrame([(i, t[0], t[3], t[4]) for i, t in enumerate(open_)], f"i int, of {kind}, lo double, hi double")
        near = rows.join(F.broadcast(ranges), F.col("class").eqNullSafe(F.col("of")) & F.col("x").between(F.col("lo"), F.col("hi")))
        # Halves, as the width of the whole range of doubles is infinite; those of the least doubles are nothing.
        share = F.coalesce(F.try_divide(F.col("x") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2), (F.col("x") > F.col("lo")).cast("double"))
        bucket = F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)).alias("bucket")
        counts: dict[int, list] = {}
        for r in near.groupBy("i", bucket).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            counts.setdefault(r["i"], []).append(r)
        narrower = []
        for i, (c, which, place, _, _) in enumerate(open_):
            for r in sorted(counts[i], key=lambda r: r["bucket"]):
                if place < r["n"]:
                    narrower.append((c, which, place, r["lo"], r["hi"]))
                    break
                place -= r["n"]
        open_ = narrower
    return {c: (found[c, 0] + found[c, 1]) / 2 for c, _ in found}
