"""The model's tables derived from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.operators.vectors import to_vector

HAIR_DIMS = 40


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, tag, pos, score): three times each embedding component, negative values too."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("item_id"), F.posexplode("embedding").alias("pos", "x"))
    return e.select("item_id", F.concat(F.lit("t"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("tag"), "pos", (3 * F.col("x").cast("double")).alias("score"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_scores(spark, sf_dir).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("item_id"))


def vocab(spark: SparkSession) -> DataFrame:
    """The first dimensions as the curated vocabulary."""
    return spark.range(HAIR_DIMS).select(F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("tag"), F.col("id").cast("int").alias("pos"))


def hair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_vector(scores(spark, sf_dir), vocab(spark))


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_vector(scores(spark, sf_dir))


def queries(vectors: DataFrame, every: int = 20) -> DataFrame:
    """The items whose id is divisible by `every`, as (query_id, tag, conf); a query's answer is the item."""
    return vectors.where(F.col("item_id").cast("long") % every == 0).select(F.col("item_id").alias("query_id"), "tag", "conf")


def partial_queries(vectors: DataFrame, every: int = 20) -> DataFrame:
    """queries() without a third of their tags: how well items are found by a part of what they have."""
    return queries(vectors, every).where(F.substring("tag", 2, 2).cast("int") % 3 != 2)


def image_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, image_no, tag, conf): customers as items, orders as images, suppliers as tags."""
    o, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    j = line.select("l_orderkey", F.concat(F.lit("s"), (F.col("l_suppkey") % 20).cast("string")).alias("tag"), "l_quantity").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("image_no"), "tag").agg((F.max("l_quantity") / 50).alias("conf"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("image_no"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, pos, item_id): orders, newest first, 60 a page. They are numbered by dates' counts and within each date."""
    from pyspark.sql import Window

    o = read(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_custkey")
    dates = o.groupBy("o_orderdate").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("o_orderdate")).rowsBetween(Window.unboundedPreceding, -1)  # over one row a date
    base = dates.select("o_orderdate", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("o_orderdate").orderBy("o_orderkey")
    n = o.withColumn("at", F.row_number().over(inside) - 1).join(base, "o_orderdate").withColumn("n", F.col("base") + F.col("at"))
    return n.select(F.expr("cast(n div 60 as int) + 1").alias("page"), F.expr("cast(n % 60 as int)").alias("pos"), F.col("o_custkey").cast("string").alias("item_id"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").where("c_custkey % 50 <> 0").select(F.col("c_custkey").cast("string").alias("item_id"))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, wish, published_at, checked_at) of users with events."""
    e = read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("item_id")).agg(F.count_if(F.col("event_type") == "purchase").cast("int").alias("wish"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return e.select("item_id", "wish", F.when(F.col("item_id").cast("long") % 7 == 0, "").otherwise(day(F.col("first"))).alias("published_at"), F.when(F.col("item_id").cast("long") % 5 != 0, day(F.col("last"))).alias("checked_at"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, item_id, tags, description): parts whose brand and type carry support signals."""
    kana = F.translate(F.substring("p_brand", 7, 2), "0123456789", "アイウエオカキクケコ")
    low = F.concat(F.lit("Br"), F.substring("p_brand", 7, 2))
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("item_id"),
        F.array(F.concat(low, F.when(F.col("p_size") % 2 == 0, F.lit("対応")).otherwise(F.lit(""))), F.col("p_type")).alias("tags"),
        F.concat(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("対応アバター"), low, F.lit("/"), F.col("p_name"))).otherwise(F.lit("")), F.lit("\n"), F.when(F.col("p_size") % 5 == 0, F.concat(kana, F.lit("("), low, F.lit(")"))).otherwise(F.lit(""))).alias("description"),
    )


def item_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, json): parts as upstream JSON."""
    price = F.concat(F.lit("¥ "), F.format_number(F.col("p_retailprice").cast("int"), 0))
    obj = F.struct(F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.lit(" ").alias("name"))).alias("tags"), F.concat(F.lit(" "), F.col("p_name"), F.lit("\n\n"), F.col("p_type")).alias("description"), F.col("p_size").alias("wish_lists_count"), price.alias("price"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("item_id"), F.to_json(obj).alias("json"))


def dictionary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vocabulary, synonyms, combos): part names as tags, brands as surfaces, types as prefixes of the smaller parts' names."""
    part = read(spark, sf_dir, "part").withColumn("tag", F.translate("p_name", " ", "_"))
    synonyms = part.groupBy(F.col("p_brand").alias("surface")).agg(F.min("tag").alias("tag"), F.min("p_partkey").alias("ord"))
    kind = F.lower("p_type")
    combos = part.where("p_size <= 10").select(F.concat(kind, F.lit(" ")).alias("prefix"), F.col("tag").alias("base"), F.concat(kind, F.lit("_"), F.col("tag")).alias("tag")).distinct()
    return part.select("tag").distinct(), synonyms, combos


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token): names, brands, types and forms of them as a user might type them."""
    forms = F.array(
        "p_name", "p_brand", F.upper("p_brand"), F.concat_ws(" ", "p_type", "p_brand"), F.concat(F.lit(" "), F.substring_index("p_name", " ", -1), F.lit(" ")),
        F.concat(F.col("p_name"), F.lit(" XL")), "p_type",
    )
    return read(spark, sf_dir, "part").select(F.explode(forms).alias("token"))


def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(surface, tag, ord): brands and types with other tags than the dictionary's."""
    part = read(spark, sf_dir, "part").withColumn("tag", F.translate("p_name", " ", "_"))
    one = lambda c, size: part.where(size).groupBy(F.col(c).alias("surface")).agg(F.max("tag").alias("tag"), F.max("p_partkey").alias("ord"))
    return one("p_brand", "p_size > 49").unionAll(one("p_type", "p_size > 40"))
