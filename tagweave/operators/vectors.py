"""Sparse tag vectors as long tables (item_id, tag, conf): cutting, aggregating, weighting, vocabularies.

An item with an empty vector is in `items` alone and still counts. Null scores and null tags belong to no vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 0.05
STRONG = 0.2
GENERAL = 0


def general_scores(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of tags of the general category; labels: (name, category)."""
    names = labels.where(F.col("category") == GENERAL).select(F.col("name").alias("tag"))
    return scores.join(names, "tag", "left_semi")


def calibrate_scores(scores: DataFrame, image: str = "image_id") -> DataFrame:
    """If any score of an image is outside 0..1, the logistic function of all its scores."""
    bounds = scores.groupBy(image).agg(F.min("score").alias("lo_"), F.max("score").alias("hi_"))
    outside = (F.col("lo_") < 0) | (F.col("hi_") > 1)
    return scores.join(bounds, image).withColumn("score", F.when(outside, 1 / (1 + F.exp(-F.col("score")))).otherwise(F.col("score"))).drop("lo_", "hi_")


def to_vector(scores: DataFrame, vocab: DataFrame | None = None, eps: float = EPS, places: int = 4) -> DataFrame:
    """(item_id, tag, conf): tags of the vocabulary with a score of at least eps, tested before rounding."""
    kept = scores.where(F.col("score") >= eps)
    if vocab is not None:
        kept = kept.join(vocab.select("tag"), "tag", "left_semi")
    return kept.select("item_id", "tag", F.round("score", places).alias("conf"))


def aggregate_images(img_tags: DataFrame, images: DataFrame, how: str) -> DataFrame:
    """One vector per item from its images' (item_id, image_no, tag, conf): max, mean, best or cons2; at least EPS, four places.

    images lists all images, as one without a tag counts in the mean, and in cons2 the second-highest value of a tag that a
    single one of several images has is 0. best takes the image with the largest sum, the first of equals.
    """
    n = images.groupBy("item_id").agg(F.countDistinct("image_no").alias("n_images"))
    if how == "max":
        out = img_tags.groupBy("item_id", "tag").agg(F.max("conf").alias("conf"))
    elif how == "mean":
        out = img_tags.groupBy("item_id", "tag").agg(F.sum("conf").alias("s")).join(n, "item_id").select("item_id", "tag", F.round(F.col("s") / F.col("n_images"), 9).alias("conf"))
    elif how == "best":
        total = img_tags.groupBy("item_id", "image_no").agg(F.round(F.sum("conf"), 9).alias("s"))
        best = total.groupBy("item_id").agg(F.max(F.struct("s", (-F.col("image_no")).alias("no"))).alias("b")).select("item_id", (-F.col("b.no")).alias("image_no"))
        out = img_tags.join(best, ["item_id", "image_no"]).select("item_id", "tag", "conf")
    elif how == "cons2":
        order = Window.partitionBy("item_id", "tag").orderBy(F.desc("conf"))
        ranked = img_tags.withColumn("r", F.row_number().over(order)).where("r <= 2").join(n, "item_id")
        out = ranked.where("(n_images = 1 and r = 1) or (n_images > 1 and r = 2)").select("item_id", "tag", "conf")
    else:
        raise ValueError(how)
    return out.where(F.col("conf") >= EPS).select("item_id", "tag", F.round(F.col("conf").cast("decimal(18,9)"), 4).cast("double").alias("conf"))


def with_fallback(agg: DataFrame, images: DataFrame, single: DataFrame) -> DataFrame:
    """Items without images take their single-image vector."""
    return agg.select("item_id", "tag", "conf").unionAll(single.join(images.select("item_id"), "item_id", "left_anti").select("item_id", "tag", "conf"))


def doc_freq(vectors: DataFrame, vocab: DataFrame, thresh: float = STRONG) -> DataFrame:
    """(tag, df) of every vocabulary tag: items that have it with at least thresh."""
    seen = vectors.where(F.col("conf") >= thresh).groupBy("tag").agg(F.count("*").alias("df"))
    return vocab.select("tag").join(seen, "tag", "left").select("tag", F.coalesce("df", F.lit(0)).cast("long").alias("df"))


def idf(df: DataFrame, items: DataFrame) -> DataFrame:
    """(tag, idf): ln((N + 1) / (df + 1)) + 1, N being all items, with empty vectors too. N is one row."""
    n = items.agg(F.count("*").alias("n"))
    return df.crossJoin(n).select("tag", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def normalize(vectors: DataFrame, weights: DataFrame | None = None, key: str = "item_id") -> DataFrame:
    """(key, tag, w): weighted and of length one; a zero vector stays zero. Tags without a weight drop out."""
    v = vectors.select(key, "tag", "conf") if weights is None else vectors.join(weights, "tag").select(key, "tag", (F.col("conf") * F.col("idf")).alias("conf"))
    norm = F.sqrt(F.sum(F.col("conf") * F.col("conf")).over(Window.partitionBy(key)))
    return v.withColumn("norm", norm).select(key, "tag", F.when(F.col("norm") > 0, F.col("conf") / F.col("norm")).otherwise(0.0).alias("w"))


def idf_extremes(weights: DataFrame, n: int = 5) -> DataFrame:
    """The n lowest and n highest weights, ties by tag."""
    low = weights.orderBy("idf", "tag").limit(n).withColumn("side", F.lit("low"))
    return low.unionAll(weights.orderBy(F.desc("idf"), "tag").limit(n).withColumn("side", F.lit("high")))


def top_tags(vectors: DataFrame, n: int = 12) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("conf"), "tag")
    return vectors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def rebuild_vectors(scores: DataFrame, vocab: DataFrame, old: DataFrame, fresh_items: DataFrame) -> DataFrame:
    """Vectors cut anew with a new vocabulary; items without fresh scores keep their old ones (fresh = false)."""
    new = to_vector(scores, vocab).withColumn("fresh", F.lit(True))
    return new.unionAll(old.join(fresh_items.select("item_id"), "item_id", "left_anti").select("item_id", "tag", "conf").withColumn("fresh", F.lit(False)))


def build_vocab(allow: DataFrame, labels: DataFrame) -> DataFrame:
    """(tag, pos): allowed tags that the labels know, sorted. One row per vocabulary tag is ordered."""
    known = allow.select("tag").intersect(labels.select(F.col("name").alias("tag")))
    return known.withColumn("pos", F.row_number().over(Window.orderBy("tag")) - 1)


def load_vocab(file_vocab: DataFrame, labels: DataFrame) -> DataFrame:
    """file_vocab (tag, pos) without tags that the labels don't know, in the file's order, numbered anew."""
    known = file_vocab.join(labels.select(F.col("name").alias("tag")), "tag", "left_semi")
    return known.select("tag", (F.row_number().over(Window.orderBy("pos")) - 1).alias("pos"))


def vocab_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    a, b = old.select("tag"), new.select("tag")
    return b.subtract(a).withColumn("change", F.lit("added")).unionAll(a.subtract(b).withColumn("change", F.lit("removed")))


def full_vocab(vectors: DataFrame) -> DataFrame:
    return vectors.select("tag").distinct()


def tag_coverage(vectors: DataFrame, added: DataFrame) -> DataFrame:
    """(tag, n_items) of added tags, 0 kept."""
    seen = vectors.groupBy("tag").agg(F.countDistinct("item_id").alias("n"))
    return added.select("tag").join(seen, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).cast("long").alias("n_items"))


def is_vocab_tag(tags: DataFrame, vocab: DataFrame) -> DataFrame:
    """tags (any column tag) with is_vocab: whether the vocabulary has the tag."""
    known = vocab.select("tag").distinct().withColumn("is_vocab", F.lit(True))
    return tags.join(known, "tag", "left").withColumn("is_vocab", F.coalesce("is_vocab", F.lit(False)))


def searchable(items: DataFrame, catalog: DataFrame) -> DataFrame:
    return items.join(catalog.select("item_id"), "item_id", "left_semi")


def eval_population(hair_items: DataFrame, full_items: DataFrame) -> DataFrame:
    return hair_items.select("item_id").intersect(full_items.select("item_id"))


def diff_snapshots(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, status): added, removed, changed or same, columns compared null-safely."""
    o = old.select(F.col(key).alias("ko"), F.struct(*columns).alias("o"))
    n = new.select(F.col(key).alias("kn"), F.struct(*columns).alias("n"))
    status = F.when(F.col("ko").isNull(), "added").when(F.col("kn").isNull(), "removed").when(F.col("o").eqNullSafe(F.col("n")), "same").otherwise("changed")
    return o.join(n, F.col("ko") == F.col("kn"), "full_outer").select(F.coalesce("ko", "kn").alias(key), status.alias("status"))


def extract_query(scores: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query_id, tag, conf, strong) of the vocabulary, three places; strong tags are preselected."""
    v = to_vector(scores.withColumnRenamed("query_id", "item_id"), vocab, places=3)
    return v.select(F.col("item_id").alias("query_id"), "tag", "conf", (F.col("conf") >= STRONG).alias("strong"))


def edit_query(detected: DataFrame, selected: DataFrame) -> DataFrame:
    """Detected (query_id, tag, conf) and the user's selected (query_id, tag): strong tags not selected go, weak ones
    stay, selected tags that were not detected come in with 1.0."""
    both = detected.join(selected.withColumn("chosen", F.lit(True)), ["query_id", "tag"], "full_outer")
    keep: Column = F.col("chosen").isNotNull() | (F.col("conf") < STRONG)
    return both.where(keep).select("query_id", "tag", F.coalesce("conf", F.lit(1.0)).alias("conf"))
