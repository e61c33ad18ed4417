"""Which items contain which keywords: positional postings of character pairs, for tables of requests.

Every field of an item (name, tags, description, in normal form) lists the places of its character pairs. A keyword is looked
up by its two rarest pairs, whose places must be as far apart as in the keyword; what they meet at is compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions.fields import normalize_ja
from tagweave.sources.scratch import written


def fields(items: DataFrame) -> DataFrame:
    """(item_id, field, text) of items (item_id, name, tags, description), in normal form; empty and missing ones left out."""
    texts = F.concat(F.array("name", "description"), F.coalesce("tags", F.array().cast("array<string>")))
    rows = items.select("item_id", F.posexplode(texts).alias("field", "text")).withColumn("text", normalize_ja(F.col("text")))
    return rows.where("text <> ''")


def _pairs(text: Column) -> Column:
    """The text's character pairs with their places."""
    at = F.filter(F.sequence(F.lit(1), F.length(text) - 1), lambda i: (i >= 1) & (i < F.length(text)))
    return F.transform(at, lambda i: F.struct(F.substring(text, i, F.lit(2)).alias("gram"), i.alias("pos")))


def postings(texts: DataFrame) -> DataFrame:
    """(gram, item_id, field, pos) of fields(): every pair of characters at each of its places, and every single character at
    its first. The index, to be written once; it grows with the length of the texts."""
    single = texts.select("item_id", "field", F.explode(F.array_distinct(F.split("text", ""))).alias("gram"), F.lit(1).alias("pos")).where("gram <> ''")
    pairs = texts.select("item_id", "field", F.explode(_pairs(F.col("text"))).alias("g")).select("g.gram", "item_id", "field", "g.pos")
    return pairs.unionByName(single)


def hits(requests: DataFrame, index: DataFrame, texts: DataFrame) -> DataFrame:
    """(keyword, item_id) of distinct keywords (as typed) and the items that contain their normal form in any field.

    A blank keyword, which keeps all items, has no rows: nothing is to be looked up. index and texts are written tables. Of a
    keyword's pairs the two in the fewest places are joined, so a frequent pair is read only for keywords of nothing else.
    """
    kw = requests.select("keyword").where("keyword is not null").distinct().withColumn("norm", normalize_ja(F.col("keyword"))).where("norm <> ''")
    kw = written(kw, "keywords")
    whole = F.array(F.struct(F.col("norm").alias("gram"), F.lit(1).alias("pos")))
    grams = kw.select("keyword", F.explode(F.when(F.length("norm") == 1, whole).otherwise(_pairs(F.col("norm")))).alias("g")).select("keyword", "g.gram", F.col("g.pos").alias("at"))
    often = written(index.groupBy("gram").agg(F.count("*").alias("n")), "often")
    order = Window.partitionBy("keyword").orderBy("n", "at")
    rare = grams.join(often, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("nth", F.row_number().over(order)).where("nth <= 2")
    rare = written(rare.withColumn("least", F.min("n").over(Window.partitionBy("keyword"))).where("least > 0"), "rare")
    meet = lambda nth: rare.where(F.col("nth") == nth).join(index, "gram").select("keyword", "item_id", "field", (F.col("pos") - F.col("at")).alias("start"))
    alone = rare.groupBy("keyword").agg(F.max("nth").alias("grams")).where("grams = 1").select("keyword")
    first = meet(1)
    both = first.join(meet(2), ["keyword", "item_id", "field", "start"], "left_semi").unionAll(first.join(alone, "keyword", "left_semi"))
    near = both.join(kw, "keyword").join(texts, ["item_id", "field"])
    same = F.when(F.length("norm") == 1, True).otherwise(F.substring("text", F.col("start") + 1, F.length("norm")) == F.col("norm"))
    return near.where(same).select("keyword", "item_id").distinct()
