"""Compatible entities named in item texts: extraction, aliases, canonical names, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.dictionary import SEED_NAMES
from tagweave.operators.substrings import shortest_within

#: Support suffixes, name forms and the markers of a list of names.
SUFFIX = "(対応版|専用|対応|向け|用)$"
KANA = "[ぁ-んァ-ヶ一-龠]{2,12}"
LATIN = "[A-Za-z][A-Za-z0-9_]{1,14}"
MARKER = r"(?i)(?:\d+\s*(?:体|アバター|avatars?)\s*対応|対応アバター|Supported[^:]*:)([^\n]{0,300})"
#: Words that look like names but are none.
STOP = (
    "vrchat", "vrc", "vrc想定モデル", "3d", "3dモデル", "3d素材", "髪", "髪型", "ヘア", "ヘアー", "へあ", "hair", "アバター", "avatar", "ロング", "ショート", "ボブ",
    "ツインテール", "ポニーテール", "ウルフ", "ウルフカット", "セール", "sale", "liltoon", "modular", "modularavatar", "ma", "pb", "physbone", "quest", "pc",
    "オリジナル", "オリジナル3dモデル", "改変", "衣装", "アクセサリー", "アクセサリ", "vroid", "unity", "セール中", "無料", "free", "vtuber", "配信用", "アバター用", "女性", "男性",
    "女の子", "男の子", "ユニセックス", "中性的", "髪の毛", "3dモデル素材", "prefab", "material", "texture", "package", "shader", "wear", "jp", "zh", "en",
    "discord", "psd", "png", "めがね", "マスク", "マップ", "材質", "材质", "贴图", "预制件", "プレハブ", "本体", "利用規約", "使用条款", "お問い合わせ", "おまけ", "最新版推奨", "最新版",
    "改変前提",
)


def is_nameish(name: Column) -> Column:
    return (F.length(name) > 1) & ~F.lower(name).isin(*STOP)


def cleaned(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(token, r"(?U)^\s+|\s+$", ""), SUFFIX, ""), r"(?U)^\s+|\s+$", "")


def suffix_names(meta: DataFrame) -> DataFrame:
    """(item_id, name) from tags that end in a support suffix."""
    t = meta.select("item_id", F.explode("tags").alias("tag")).where(F.col("tag").rlike(SUFFIX))
    return t.select("item_id", cleaned(F.col("tag")).alias("name")).where(is_nameish(F.col("name"))).distinct()


def listed_names(meta: DataFrame, strip_lead: bool = False) -> DataFrame:
    """(item_id, name) from descriptions: what follows a marker on its line, split at separators.

    The first name keeps what stands before it after the marker, such as a colon, unless strip_lead.
    """
    part = meta.select("item_id", F.explode(F.regexp_extract_all("description", F.lit(MARKER), F.lit(1))).alias("list")).select("item_id", F.explode(F.split("list", r"[／/、,・|]")).alias("part"))
    raw = F.regexp_replace("part", r"(?U)^[\s:：]+", "") if strip_lead else F.col("part")
    return part.select("item_id", cleaned(raw).alias("name")).where(is_nameish(F.col("name"))).distinct()


def seed_names(spark: SparkSession) -> DataFrame:
    """(surface, canonical): the seed names, by their surface forms and by themselves."""
    return spark.createDataFrame(list({**SEED_NAMES, **{v.lower(): v for v in SEED_NAMES.values()}}.items()), "surface string, canonical string")


def raw_names(meta: DataFrame) -> DataFrame:
    return suffix_names(meta).unionAll(listed_names(meta)).distinct()


def mine_aliases(meta: DataFrame, raw: DataFrame, seeds: DataFrame) -> DataFrame:
    """(surface, canonical) over seeds (surface, canonical), from kana(latin) and latin(kana) pairs in texts.

    meta has `ord`, the items' order. Pairs with one lower-cased latin form only depend on each other: from the first that
    is known by itself (a form is a raw name, or the latin form is a seed) on, all count, and the last names the alias.
    """
    text = F.concat_ws(" ", "description", F.array_join("tags", " "))
    left = rf"({KANA})(?U)\s*[（(]\s*({LATIN})\s*[）)]"
    right = rf"({LATIN})(?U)\s*[（(]\s*({KANA})\s*[）)]"

    def pairs(pattern: str, kana: int, latin: int, kind: int) -> DataFrame:
        both = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(kana)).alias("kana"), F.regexp_extract_all("text", F.lit(pattern), F.lit(latin)).alias("latin"))
        return meta.select("ord", text.alias("text")).select("ord", F.posexplode(both).alias("nth", "p")).select(F.col("p.kana").alias("kana"), F.col("p.latin").alias("latin"), F.struct("ord", F.lit(kind).alias("kind"), "nth").alias("at"))

    found = pairs(left, 1, 2, 1).unionAll(pairs(right, 2, 1, 2)).groupBy("kana", "latin").agg(F.min("at").alias("at"))
    found = found.where(~F.lower("kana").isin(*STOP) & ~F.lower("latin").isin(*STOP)).withColumn("low", F.lower("latin"))
    names = raw.select("name").distinct()
    flag = lambda df, c, n: df.join(names.select(F.col("name").alias(c)).withColumn(n, F.lit(True)), c, "left")
    known = flag(flag(found, "kana", "k_"), "latin", "l_").join(seeds.select(F.col("surface").alias("low"), F.lit(True).alias("s_")).distinct(), "low", "left")
    known = known.withColumn("self", F.coalesce("k_", F.lit(False)) | F.coalesce("l_", F.lit(False)) | F.coalesce("s_", F.lit(False)))
    start = known.where("self").groupBy("low").agg(F.min("at").alias("start"))
    good = known.join(start, "low").where(F.col("at") >= F.col("start"))
    mined = good.groupBy("low").agg(F.max(F.struct("at", "kana")).alias("m")).select(F.col("low").alias("surface"), F.col("m.kana").alias("canonical"))
    own = good.select(F.lower("kana").alias("surface"), F.col("kana").alias("canonical")).distinct()
    new = mined.unionAll(own).dropDuplicates(["surface"])
    return seeds.join(new.select("surface"), "surface", "left_anti").select("surface", "canonical").unionAll(new)


def canonical_names(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    """(item_id, name): the alias of the lower-cased name, else the name, through the stop list again."""
    a = aliases.select(F.col("surface").alias("low"), "canonical")
    named = raw.withColumn("low", F.lower("name")).join(a, "low", "left").select("item_id", F.coalesce("canonical", "name").alias("name"))
    return named.where(is_nameish(F.col("name"))).distinct()


def item_avatars(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    return canonical_names(raw, aliases).groupBy("item_id").agg(F.array_sort(F.collect_set("name")).alias("avatars"))


def avatar_vocab(names: DataFrame, least: int = 2) -> DataFrame:
    """(name, n_items) of names on at least `least` items."""
    return names.groupBy("name").agg(F.countDistinct("item_id").alias("n_items")).where(F.col("n_items") >= least)


def known_avatars(vocab: DataFrame, names: DataFrame) -> DataFrame:
    return vocab.select("name").unionAll(names.select("name")).distinct()


def resolve_avatars(texts: DataFrame, aliases: DataFrame, known: DataFrame) -> DataFrame:
    """(text, name): alias of the lower-cased text, else the text if known, else the shortest known name that contains it
    or is contained in it, case aside, ties by name; else null. Blank texts resolve to null.

    Distinct texts only; those that equality leaves open go through the automata.
    """
    t = texts.select("text").distinct().withColumn("t", F.btrim("text")).withColumn("low", F.lower("t"))
    known = known.select("name").distinct()
    step = t.join(aliases.select(F.col("surface").alias("low"), "canonical"), "low", "left").join(known.select(F.col("name").alias("t"), F.lit(True).alias("same")), "t", "left")
    step = step.withColumn("hit", F.when(F.coalesce(F.col("t"), F.lit("")) == "", None).otherwise(F.coalesce("canonical", F.when(F.col("same"), F.col("t")))))
    open_ = step.where("hit is null and t <> ''").select(F.col("text").alias("token"), F.col("low").alias("form"))
    near = shortest_within(open_, known.select(F.col("name").alias("term"), F.lower("name").alias("form"))).select(F.col("token").alias("text"), F.col("term").alias("near"))
    return step.select("text", "hit").join(near, "text", "left").select("text", F.coalesce("hit", "near").alias("name"))
