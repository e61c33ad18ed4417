"""Resolving free user input onto the vocabulary through a dictionary of synonyms, compounds and text forms.

A dictionary is three tables: synonyms (surface, tag, ord), combos (prefix, base, tag) and the morph pairs of the text form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.dictionary import COMBOS, SYNONYMS, VOCAB
from tagweave.functions.fields import MORPH, normalize_ja
from tagweave.operators.substrings import shortest_within
from tagweave.sources.scratch import written


def synonym_index(synonyms: DataFrame, morph: list = MORPH) -> DataFrame:
    """(norm, tag): by normal form; of colliding entries the last one wins."""
    return synonyms.withColumn("norm", normalize_ja(F.col("surface"), morph)).groupBy("norm").agg(F.max_by("tag", "ord").alias("tag"))


def built_in(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vocabulary, synonyms, combos) of the built-in dictionary."""
    return (
        spark.createDataFrame([(v,) for v in VOCAB], "tag string"),
        spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(SYNONYMS.items())], "surface string, tag string, ord long"),
        spark.createDataFrame([(*k, t) for k, t in COMBOS.items()], "prefix string, base string, tag string"),
    )


OVERLAY = "synonyms map<string, string>, morph_canon array<array<string>>, prefix_combos map<string, string>"


def overlay_tables(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(synonyms (surface, tag, ord), morph (src, dst, ord), combos (key, tag)) of overlay files (json), one row each.

    Text that can't be read, missing sections and null entries give no rows; ord is the place in its file's section.
    """
    r = files.select(F.from_json("json", OVERLAY).alias("r"))
    synonyms = r.select(F.posexplode(F.map_entries("r.synonyms")).alias("ord", "e")).select(F.col("e.key").alias("surface"), F.col("e.value").alias("tag"), "ord").where("tag is not null")
    morph = r.select(F.posexplode("r.morph_canon").alias("ord", "p")).select(F.get("p", F.lit(0)).alias("src"), F.get("p", F.lit(1)).alias("dst"), "ord", F.size("p").alias("parts"))
    combos = r.select(F.explode(F.map_entries("r.prefix_combos")).alias("e")).select(F.col("e.key").alias("key"), F.col("e.value").alias("tag")).where("tag is not null")
    return synonyms, morph, combos


def _after(df: DataFrame, base: DataFrame, overlay: DataFrame) -> DataFrame:
    """df with after_: what puts the overlay's ords after all of the base's. One row of bounds."""
    ends = base.agg(F.max("ord").alias("last_")).join(overlay.agg(F.min("ord").alias("first_")))
    return df.join(F.broadcast(ends.select((F.coalesce("last_", F.lit(-1)) + 1 - F.coalesce("first_", F.lit(0))).alias("after_"))))


def merge_synonyms(base: DataFrame, overlay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged synonyms, one row n: entries that the overlay changed or added). A changed entry keeps its place; new ones come
    after all of the base's, in the overlay's order."""
    o = overlay.select("surface", F.col("tag").alias("new"), F.col("ord").alias("new_ord"))
    both = base.join(o, "surface", "full_outer")
    merged = _after(both, base, overlay).select("surface", F.coalesce("new", "tag").alias("tag"), F.coalesce("ord", F.col("new_ord") + F.col("after_")).alias("ord"))
    return merged, both.agg(F.count_if(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("tag"))).alias("n"))


def merge_combos(base: DataFrame, overlay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged combos (prefix, base, tag), one row n: changed or added). overlay: (key, tag) with key `prefix|base`; keys
    without the separator are left out."""
    o = overlay.where("instr(key, '|') > 0").select(F.substring_index("key", "|", 1).alias("prefix"), F.expr("substring(key, instr(key, '|') + 1)").alias("base"), F.col("tag").alias("new"))
    both = base.join(o, ["prefix", "base"], "full_outer")
    changed = both.agg(F.count_if(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("tag"))).alias("n"))
    return both.select("prefix", "base", F.coalesce("new", "tag").alias("tag")), changed


def merge_morph(base: DataFrame, overlay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged pairs (src, dst, ord), one row n: pairs added). New pairs come after all others, in the overlay's order."""
    new = overlay.where("parts = 2 and src is not null and dst is not null").groupBy("src", "dst").agg(F.min("ord").alias("ord")).join(base, ["src", "dst"], "left_anti")
    return base.select("src", "dst", "ord").unionAll(_after(new, base, overlay).select("src", "dst", F.col("ord") + F.col("after_"))), new.agg(F.count("*").alias("n"))


def lint_dict(synonyms: DataFrame, combos: DataFrame, vocab: DataFrame, keys: DataFrame | None = None, morph: DataFrame | None = None) -> DataFrame:
    """(kind, entry, tag) of targets that the vocabulary lacks; of overlay keys (key, tag) without a separator (`key`), and of
    replacements (src, parts) that are no pairs (`pair`)."""
    s = synonyms.select(F.lit("synonym").alias("kind"), F.col("surface").alias("entry"), "tag")
    c = combos.select(F.lit("combo").alias("kind"), F.concat_ws("|", "prefix", "base").alias("entry"), "tag")
    out = s.unionAll(c).join(vocab.select("tag"), "tag", "left_anti").select("kind", "entry", "tag")
    if keys is not None:
        out = out.unionAll(keys.where("instr(key, '|') = 0").select(F.lit("key"), "key", "tag"))
    if morph is not None:
        out = out.unionAll(morph.where("parts <> 2").select(F.lit("pair"), "src", F.lit(None).cast("string")))
    return out


def resolve_tags(tokens: DataFrame, vocab: DataFrame, synonyms: DataFrame, combos: DataFrame, morph: list = MORPH) -> DataFrame:
    """(token, tag) of distinct tokens: exact tag, synonym, synonym by normal form, prefix and known rest (a compound, or
    the rest's own tag), blanks and hyphens as underscores, then the shortest tag that contains the form or is contained
    in it, ties by name; else null.

    Each stage is an equality join, prefixes by the token's own, as long as the dictionary has any; only tokens that all other
    stages leave open go through the automata. Normal forms are made once and written.
    """
    vocab = vocab.select("tag").distinct()
    index = written(synonym_index(synonyms, morph), "index")
    t = tokens.select("token").distinct().withColumn("t", F.regexp_replace("token", r"(?U)^\s+|\s+$", "")).withColumn("norm", normalize_ja(F.col("t"), morph))
    t = written(t.withColumn("us", F.translate("norm", " -", "__")), "tokens")
    last = synonyms.groupBy("surface").agg(F.max_by("tag", "ord").alias("raw"))
    t = t.join(vocab.select(F.col("tag").alias("t"), F.col("tag").alias("exact")), "t", "left").join(last.select(F.col("surface").alias("t"), "raw"), "t", "left")
    t = t.join(index.select("norm", F.col("tag").alias("by_norm")), "norm", "left")
    prefixes = combos.select("prefix").distinct()
    longest = prefixes.agg(F.coalesce(F.max(F.length("prefix")), F.lit(0)).alias("longest_"))
    own = F.transform(F.sequence(F.lit(1), F.least(F.length("norm") - 1, "longest_")), lambda n: F.substring(F.col("norm"), F.lit(1), n))
    rest = t.join(F.broadcast(longest)).where("length(norm) > 1 and longest_ > 0").select("token", "norm", F.explode(own).alias("prefix")).join(prefixes, "prefix")
    rest = rest.withColumn("rest", F.expr("substring(norm, length(prefix) + 1)")).join(index.select(F.col("norm").alias("rest"), F.col("tag").alias("base")), "rest")
    rest = rest.join(combos.withColumnRenamed("tag", "made"), ["prefix", "base"], "left").groupBy("token").agg(F.max(F.struct(F.length("prefix"), F.coalesce("made", "base").alias("tag"))).alias("m")).select("token", F.col("m.tag").alias("composed"))
    t = t.join(rest, "token", "left").join(vocab.select(F.col("tag").alias("us"), F.col("tag").alias("by_us")), "us", "left")
    t = t.withColumn("hit", F.when(F.col("t") == "", None).otherwise(F.coalesce("exact", "raw", "by_norm", "composed", "by_us")))
    open_ = t.where("hit is null and us <> ''").select("token", "us")
    near = shortest_within(open_.select("token", F.col("us").alias("form")), vocab.select(F.col("tag").alias("term"), F.col("tag").alias("form"))).withColumnRenamed("term", "near")
    return t.select("token", "hit").join(near, "token", "left").select("token", F.coalesce("hit", "near").alias("tag"))


def resolve_lists(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """(request_id, tags in first-seen order, unresolved tokens, notes) of requests (request_id, tokens)."""
    t = requests.select("request_id", F.posexplode("tokens").alias("pos", "token")).join(resolved, "token", "left")
    first = t.where("tag is not null").groupBy("request_id", "tag").agg(F.min("pos").alias("pos"))
    tags = first.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("p")).select("request_id", F.col("p.tag").alias("tags"))
    rest = t.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("tag").isNull(), F.struct("pos", "token")))).alias("u"),
        F.array_sort(F.collect_list(F.when(F.col("tag") != F.col("token"), F.struct("pos", F.concat("token", F.lit("→"), "tag").alias("note"))))).alias("c"),
    )
    none = F.array().cast("array<string>")
    return rest.join(tags, "request_id", "left").select("request_id", F.coalesce("tags", none).alias("tags"), F.col("u.token").alias("unresolved"), F.col("c.note").alias("notes"))
