"""Personal data: patterns find protected entities, corpus co-occurrence finds terms that reveal them.

DataFrame functions only. A term discloses an entity if the pointwise mutual information of both over the corpus' texts
reaches a share of the entity's own information content: knowing the term then tells nearly as much as the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.shared import discard, durable, packed, unpacked

KINDS = ("email", "ip", "card", "phone", "term")
#: They match what the plain patterns match, but start only where a match can start and give nothing back, so long runs
#: of letters or digits take linear time. \G: a match may start where the last one ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
#: A word between blanks, without the punctuation around it: two letters or more, with apostrophes and hyphens between them.
SOLID = r"\p{L}\p{M}\p{N}"
TERM = (
    r"(?<![^ \t\n\x0b\f\r])[^\p{L}\p{M}\p{N} \t\n\x0b\f\r]*+"
    r"(\p{L}[\p{L}\p{M}]++(?:['’-][\p{L}\p{M}]++)*+|\p{L}(?:['’-][\p{L}\p{M}]++)++)"
    r"[^\p{L}\p{M}\p{N} \t\n\x0b\f\r]*+(?![^ \t\n\x0b\f\r])"
)
#: Scripts that put no blanks between words: two and three letters beside each other are terms, too.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
GRAMS = (2, 3)
#: Digits of a number that are looked at as its prefix.
PREFIX = 4
MIN_TEXTS = 3
DISCLOSURE = 0.9
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.reverse(_digits(x))
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.length(_digits(x))
        return F.when(n.between(12, 19), _luhn(x)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _found(text: Column, kind: str) -> Column:
    """Valid matches of a kind with their places, from the matches and the text between them."""
    at = PATTERNS[kind]
    hits, between = F.regexp_extract_all(text, F.lit(at), F.lit(0)), F.split(text, at, -1)
    empty = F.expr("cast(array() as array<struct<start: int, kind: int, end: int, value: string>>)")
    no = F.lit(KINDS.index(kind))

    def step(acc, pair):
        start = acc["pos"] + F.length(pair["b"])
        end = start + F.length(pair["h"])
        one = F.struct(start.alias("start"), no.alias("kind"), end.alias("end"), pair["h"].alias("value"))
        return F.struct(end.alias("pos"), F.when(_valid(kind, pair["h"]), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    pairs = F.arrays_zip(hits.alias("h"), F.slice(between, 1, F.size(hits)).alias("b"))
    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step)["out"]
    return F.when(text.rlike(NEEDS[kind]), walked).otherwise(empty)


def find_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `t_` (the text, null as empty) and `base_`: array of (start, kind, end, value) in order."""
    df = docs.withColumn("t_", F.coalesce(F.col(text), F.lit("")))
    for kind in KINDS[:4]:
        df = df.withColumn(f"{kind}_", _found(F.col("t_"), kind))
    return df.withColumn("base_", F.array_sort(F.concat(*[f"{k}_" for k in KINDS[:4]]))).drop(*[f"{k}_" for k in KINDS[:4]])


def _terms(text: Column) -> Column:
    """Lower-cased words of two or more letters, punctuation around them left out, and letters side by side in scripts without
    blanks, each once."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(1))
    grams = [F.regexp_extract_all(text, F.lit(f"(?=([{UNSPACED}]{{{n}}}))"), F.lit(1)) for n in GRAMS]
    return F.array_distinct(F.when(text.rlike(f"[{UNSPACED}]{{{GRAMS[0]}}}"), F.concat(words, *grams)).otherwise(words))


def _places(text: Column, term: Column) -> Column:
    """Spans of a term wherever it stands in the text, without overlaps."""
    empty = F.expr("cast(array() as array<struct<start: int, kind: int, end: int, value: string>>)")

    def step(acc, before):
        start = acc["pos"] + F.length(before)
        end = start + F.length(term)
        one = F.struct(start.alias("start"), F.lit(KINDS.index("term")).alias("kind"), end.alias("end"), term.alias("value"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

    between = F.split(text, term, -1)
    return F.aggregate(F.slice(between, 1, F.size(between) - 1), F.struct(F.lit(0).alias("pos"), empty.alias("out")), step)["out"]


def _levels(e: Column) -> Column:
    """What recurs of an entity besides its value: its kind; an e-mail's account name and domain; a number's first digits."""
    kind, value = e["kind"].cast("string"), F.lower(e["value"])
    mail = F.array(F.concat(kind, F.lit(":@"), F.substring_index(value, "@", -1)), F.concat(kind, F.lit(":"), F.substring_index(value, "@", 1), F.lit("@")))
    number = F.array(F.concat(kind, F.lit(":^"), F.when(e["kind"] == KINDS.index("ip"), F.substring_index(value, ".", 2)).otherwise(F.substring(_digits(value), 1, PREFIX))))
    return F.concat(F.array(kind, F.concat(kind, F.lit(":"), value)), F.when(e["kind"] == KINDS.index("email"), mail).otherwise(number))


def _class_of(entity: Column) -> Column:
    """What a term that reveals an entity, or what recurs of it, is generalised to."""
    kind, part = F.substring_index(entity, ":", 1).cast("int"), F.substring_index(entity, ":", -1)
    return (
        F.when((kind == KINDS.index("email")) & part.startswith("@"), "[ORGANISATION]").when(kind == KINDS.index("ip"), "[NETWORK]")
        .when(kind == KINDS.index("card"), "[ACCOUNT]").when((kind == KINDS.index("phone")) & part.startswith("^"), "[PLACE]").otherwise("[PERSON]")
    )


def disclosing_terms(based: DataFrame, min_texts: int = MIN_TEXTS, share: float = DISCLOSURE) -> DataFrame:
    """(term, reveals, class): terms that stand in at least min_texts different texts with an entity, or with what recurs of
    it, and whose mutual information with it reaches `share` of its information content; class follows from the entity that
    it reveals most. Copies of a text count once. Terms are counted with partial counts, after one row of each text is left.
    """
    based = based.select(F.xxhash64("t_").alias("key"), "t_", "base_")
    near = based.where(F.size("base_") > 0).dropDuplicates(["key"]).select("key", F.array_distinct(F.flatten(F.transform("base_", _levels))).alias("entities"), _terms(F.col("t_")).alias("terms"))
    near = durable(near, "contexts")
    spread = near.select(F.explode("entities").alias("entity"), "terms")
    # Written out, so that the joins of an entity of very many texts, such as a kind, can be split.
    entities = durable(spread.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= min_texts), "entities")
    shared = spread.join(entities, "entity", "left_semi").select("entity", F.explode("terms").alias("term"))
    both = durable(shared.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= min_texts), "cooccurrence")
    corpus = based.select("key", "t_").dropDuplicates(["key"]).select(F.explode(F.concat(_terms(F.col("t_")), F.array(F.lit("")))).alias("term"))  # "" counts the texts
    df = durable(corpus.groupBy("term").agg(F.count("*").alias("n_term")), "terms")
    total = df.where("term = ''").first()
    n = F.lit(float(total["n_term"] if total else 1))
    pmi = F.log2(n * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    content = F.log2(n / F.col("n_entity"))
    told = both.join(entities, "entity").join(df, "term").withColumn("pmi", pmi).where((content > 0) & (F.col("pmi") >= share * content))
    out = durable(told.groupBy("term").agg(F.count("*").alias("reveals"), _class_of(F.max_by("entity", F.struct("pmi", "entity"))).alias("class")), "disclosing")
    discard(near, entities, both, df)
    return out


#: Columns that sanitise() adds.
RESULTS = ["base_", "spans_", "clean_text"]


def sanitise(docs: DataFrame, text: str = "text", **args) -> DataFrame:
    """docs with base_, spans_ (base and terms: start, kind, end, value) and clean_text.

    Entities become [EMAIL], [IP], [CARD] or [PHONE]; disclosing terms become a class: [PERSON], [ORGANISATION], [PLACE],
    [NETWORK] or [ACCOUNT]. Spans that overlap become one mark, that of the first. Null texts are empty. Repeated rows
    are treated alike; an empty table gives no rows; texts may have any length. Columns with the names of results are
    replaced, all others pass, whatever their names.
    """
    told = disclosing_terms(find_base(docs.select(F.col(text).alias("text"))), **args)
    keyed = find_base(packed(docs, text)).withColumn("key_", F.xxhash64("t_"))
    where = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).select(F.xxhash64("t").alias("k_"), F.explode(_terms(F.col("t"))).alias("term"))
    own = durable(where.join(told, "term").groupBy("k_").agg(F.map_from_entries(F.collect_set(F.struct("term", "class"))).alias("own_")), "revealing")
    df = keyed.join(own, F.col("key_") == F.col("k_"), "left")
    blank = r"[^\x20\x09-\x0D]+"
    empty = F.expr("cast(array() as array<struct<start: int, kind: int, end: int, value: string>>)")

    def step(acc, pair):
        start = acc["pos"] + F.length(pair["b"])
        core = F.regexp_replace(pair["h"], f"^[^{SOLID}]+|[^{SOLID}]+$", "")
        lead = F.length(pair["h"]) - F.length(F.regexp_replace(pair["h"], f"^[^{SOLID}]+", ""))
        one = F.struct((start + lead).alias("start"), F.lit(4).alias("kind"), (start + lead + F.length(core)).alias("end"), core.alias("value"))
        hit = F.map_contains_key(F.col("own_"), F.lower(core))
        return F.struct((start + F.length(pair["h"])).alias("pos"), F.when(hit, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    hits, between = F.regexp_extract_all("t_", F.lit(blank), F.lit(0)), F.split("t_", blank, -1)
    pairs = F.arrays_zip(hits.alias("h"), F.slice(between, 1, F.size(hits)).alias("b"))
    words = F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step)["out"]
    unspaced = F.filter(F.map_keys("own_"), lambda k: k.rlike(f"^[{UNSPACED}]{{{GRAMS[0]},{GRAMS[-1]}}}$"))
    within = F.flatten(F.transform(unspaced, lambda k: _places(F.col("t_"), k)))
    term = F.when(F.col("own_").isNotNull(), F.array_distinct(F.concat(words, within))).otherwise(empty)
    df = df.withColumn("spans_", F.array_sort(F.concat(F.col("base_"), term)))

    def mark(s):
        by_kind = F.element_at(F.array(*[F.lit(MARKS[k]) for k in KINDS[:4]]), s["kind"] + 1)
        return F.when(s["kind"] < 4, by_kind).otherwise(F.element_at(F.col("own_"), F.lower(s["value"])))

    def put(acc, s):
        new = F.struct(s["end"].alias("pos"), F.concat(acc["out"], F.substring(F.col("t_"), acc["pos"] + 1, s["start"] - acc["pos"]), mark(s)).alias("out"))
        return F.when(s["start"] >= acc["pos"], new).otherwise(F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out")))

    done = F.aggregate("spans_", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), put)
    clean = F.when(F.size("spans_") == 0, F.col("t_")).otherwise(F.concat(done["out"], F.substring(F.col("t_"), done["pos"] + 1, F.length("t_"))))
    return unpacked(df.withColumn("clean_text", clean), RESULTS)


def span_string(spans: Column) -> Column:
    """kind:start:end, by start, then kind as listed, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
