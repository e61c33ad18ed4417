"""Ranking quality: answer ranks, hit rates, grids of configurations, separability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.operators import blocks
from tagweave.operators.medians import medians
from tagweave.operators.vectors import STRONG
from tagweave.sources.scratch import written

NOT_FOUND = 1_000_000_000


def stem(file: Column) -> Column:
    return F.regexp_replace(file, r"\.[^.]*$", "")


def answer_id(file: Column, cut_dot: bool = False) -> Column:
    """The file's stem up to its first underscore; with cut_dot, the name up to its first underscore or dot."""
    return F.substring_index(F.substring_index(file, "_", 1), ".", 1) if cut_dot else F.substring_index(stem(file), "_", 1)


def is_distractor(file: Column) -> Column:
    return F.lower(stem(file)).startswith("x_") | ~answer_id(file).rlike("^[0-9]+$")


def eval_split(files: DataFrame) -> DataFrame:
    return files.select("file", answer_id(F.col("file")).alias("answer_id"), is_distractor(F.col("file")).alias("is_distractor"))


def missing_answers(evals: DataFrame, items: DataFrame) -> DataFrame:
    return evals.where("not is_distractor").select(F.col("answer_id").alias("item_id")).distinct().join(items.select("item_id"), "item_id", "left_anti")


def answer_rank(top: DataFrame, answers: DataFrame, by: tuple = ()) -> DataFrame:
    """(by, query_id, answer_id, rank) of each answer, as ranked (by, query_id, item_id, rank) says, else NOT_FOUND.

    answers has the columns `by` too. With ranks by counting, NOT_FOUND says that the answer is not in the table; with a list
    of the best, that it is not among them.
    """
    ranks = top.select(*by, "query_id", F.col("item_id").alias("answer_id"), "rank")
    return answers.join(ranks, [*by, "query_id", "answer_id"], "left").select(*by, "query_id", "answer_id", F.coalesce("rank", F.lit(NOT_FOUND)).cast("long").alias("rank"))


def hit_rate(ranks: DataFrame, by: tuple = (), found_only: bool = False) -> DataFrame:
    """hit1, hit5, hit10 over all queries, or over those whose answer is in the table (found_only), for which ranks must be
    those among all items, as blocks.ranks() counts them."""
    df = ranks.where(F.col("rank") < NOT_FOUND) if found_only else ranks
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit{k}")
    return df.groupBy(*by).agg(F.count("*").alias("n"), hit(1), hit(5), hit(10))


def compare(vectors: DataFrame, items: DataFrame, queries: DataFrame, answers: DataFrame, vocab: DataFrame) -> DataFrame:
    """(config, idf, ord, n, hit1, hit5, hit10) of vector tables with and without weights, over all queries, in one job.

    vectors: (config, item_id, tag, conf), a table; items: (config, item_id), with empty vectors too; queries: (query_id, tag, conf);
    answers: (query_id, answer_id). A weight is 1 when idf is off. Scores are products of blocks, ranks are counted.
    """
    n = items.groupBy("config").agg(F.count("*").alias("n_items"))
    df = vectors.where(F.col("conf") >= STRONG).groupBy("config", "tag").agg(F.count("*").alias("df"))
    weights = vocab.select("tag").crossJoin(F.broadcast(n)).join(df, ["config", "tag"], "left")
    idf = F.log((F.col("n_items") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    weights = weights.select("config", "tag", F.explode(F.array(F.struct(F.lit(False).alias("idf"), F.lit(1.0).alias("x")), F.struct(F.lit(True).alias("idf"), idf.alias("x")))).alias("w")).select("config", "tag", "w.idf", F.col("w.x").alias("x"))

    by, weights = ("config", "idf"), written(weights, "weights")
    each = F.explode(F.array(F.lit(False), F.lit(True))).alias("idf")
    # Weights of a configuration are one row.
    of = F.broadcast(weights.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("tag", "x"))).alias("of_")))

    def unit(lists: DataFrame) -> DataFrame:
        """Lists (base) of tags and values with those weights, of length one; tags without a weight drop out."""
        known = F.filter("base", lambda x: F.map_contains_key(F.col("of_"), x.tag))
        w = F.transform(known, lambda x: F.struct(x.tag.alias("tag"), (x.conf * F.col("of_")[x.tag]).alias("w")))
        norm = F.sqrt(F.aggregate("base", F.lit(0.0), lambda a, x: a + x.w * x.w))
        return lists.withColumn("base", w).withColumn("norm_", norm).withColumn("base", F.transform("base", lambda x: F.struct(x.tag.alias("tag"), (x.w / F.col("norm_")).alias("w")))).drop("of_", "norm_")

    def packs(rows: DataFrame) -> DataFrame:
        """Rows of an item lie together: its tags are listed, and weighted each way, where they are."""
        lists = rows.groupBy("config", "item_id", "block_").agg(F.collect_list(F.when(F.col("tag").isNotNull(), F.struct("tag", "conf"))).alias("base"))
        lists = lists.withColumn("full", F.expr("cast(array() as array<struct<tag: string, w: double>>)"))
        return unit(lists.join(of, "config"))

    grid = answers.crossJoin(F.broadcast(weights.select(*by).distinct()))  # a few rows, one per configuration
    all_ = vectors.select("config", "item_id", "tag", "conf").unionByName(items.select("config", "item_id", F.lit(None).cast("string").alias("tag"), F.lit(None).cast("double").alias("conf")))
    left = blocks.dealt(all_, "item_id", by, ids=items.select("config", "item_id", each).distinct(), then=packs)
    asked = queries.groupBy("query_id").agg(F.collect_list(F.struct("tag", "conf")).alias("base"))
    none = lambda kind: F.expr(f"cast(array() as array<struct<tag: string, {kind}: double>>)")
    asked = answers.select("query_id").distinct().join(asked, "query_id", "left").select("query_id", F.coalesce("base", none("conf")).alias("base"), none("w").alias("full"))
    right = written(unit(asked.crossJoin(of)), "queries")
    found = blocks.ranks(left, right, grid.select(*by, "query_id", F.col("answer_id").alias("item_id")), blocks.SIDES[:1], by)
    ord_ = F.row_number().over(Window.orderBy("config", "idf"))  # over one row per configuration
    return hit_rate(answer_rank(found, grid, by), by).withColumn("ord", ord_)


def best_config(grid: DataFrame) -> DataFrame:
    return grid.orderBy(F.desc("hit10"), F.desc("hit5"), F.desc("hit1"), "ord").limit(1)


def separability(top1: DataFrame) -> DataFrame:
    """(query_id, score, is_distractor) -> bounds and medians of both classes and a verdict. Medians come by counting."""
    top1 = written(top1.select("score", "is_distractor"), "top1")
    middle = medians(top1, "is_distractor", "score")
    side = lambda d, f: f(F.when(F.col("is_distractor") == d, F.col("score")))
    both = [(False, "scored"), (True, "distractor")]
    ends = top1.agg(*[side(d, f).alias(f"{n}_{name}") for d, name in both for f, n in ((F.min, "min"), (F.max, "max"))])
    out = ends.select(*[c for d, name in both for c in (f"min_{name}", F.lit(middle.get(d)).cast("double").alias(f"median_{name}"), f"max_{name}")])
    verdict = F.when(F.col("min_scored") > F.col("max_distractor"), "separable").when(F.col("median_scored") > F.col("median_distractor"), "shifted").otherwise("not separable")
    return out.withColumn("verdict", verdict).withColumn("threshold", F.when(F.col("verdict") == "separable", (F.col("min_scored") + F.col("max_distractor")) / 2))
