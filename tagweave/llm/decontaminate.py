"""Benchmark decontamination by templates: numbers, names and units become typed slots, windows of templates are joined
by hash, and the slots of a match must be filled consistently. So a question with other numbers or names is found too.
Windows with names are joined in a second form as well, with names as literal words, so that capitals do not matter;
windows of hardly anything but numbers and units, whose template says too little, are joined word by word.
"""

from __future__ import annotations

from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.letters import letter_table
from tagweave.llm.shared import durable, map_arrow, new_path, slices, unpacked
from tagweave.llm.text_arrays import mix, part_hash, signed, window_hash, words

WINDOW = 8
MIN_LITERALS = 4
MIN_COVER = 0.5
#: Items of fewer words, such as `Yes` or `42`, tell nothing of a document that holds them.
MIN_WORDS = 4
MAX_SENT = 2_000_000
#: Units of measure that become slots after a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre "
    "kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh "
    "usd eur gbp dollar dollars cent cents euro euros percent % °c °f degree degrees w kw kwh v a hz kb mb gb tb"
).split()
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = 0x110000
    digit = np.fromiter((chr(i).isdigit() for i in range(n)), bool, n)
    upper = np.fromiter((chr(i).isupper() for i in range(n)), bool, n)
    return digit, upper, letter_table() | digit


@cache
def _units() -> np.ndarray:
    w = words([" ".join(UNITS)])
    return np.unique(part_hash(w, w.start, w.end))


def template(texts: list[str]):
    """(text index, template token, value, first, end, hash) of each word with a letter or digit; value is 0 for literals.

    Words are compared lower-cased and without the punctuation around them. A word of digits and number signs is a
    number; a unit is one of UNITS after a number; a name is a capitalised word that does not begin a sentence.
    """
    digit, upper, solid = _tables()
    w = words(texts)
    raw = w.points
    low = words([t.lower() for t in texts]) if all(len(t.lower()) == len(t) for t in texts) else None
    if low is None:  # a letter whose lower case is longer: leave such letters as they are
        low = words(["".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts])
    is_solid = np.concatenate([solid[raw], [False]])
    edge = np.flatnonzero(is_solid)
    a = np.searchsorted(edge, w.start)
    b = np.searchsorted(edge, w.end)
    on = a < b
    start, end, doc = edge[a[on]], edge[b[on] - 1] + 1, w.text[on]
    h = part_hash(low, start, end)
    digits = np.concatenate([[0], np.cumsum(digit[raw])])
    letters = np.concatenate([[0], np.cumsum(letter_table()[raw])])
    number = (digits[end] > digits[start]) & (letters[end] == letters[start])
    after = np.zeros(len(h), bool)
    after[1:] = number[:-1] & (doc[1:] == doc[:-1])
    unit = after & np.isin(h, _units())
    last = raw[w.end[on] - 1]
    stop = np.isin(last, [ord(c) for c in ".!?:;\"”»)…"])
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    begins = np.ones(len(h), bool)
    begins[1:] = stop[:-1] | (doc[1:] != doc[:-1]) | (lines[start[1:]] > lines[end[:-1]])
    name = upper[raw[start]] & ~begins & ~number & ~unit
    token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, h)))
    value = np.where(number | unit | name, mix(h ^ token) | np.uint64(1), np.uint64(0))
    return doc, token, value, start - w.first[doc], end - w.first[doc], h


def _forms(texts: list[str]):
    """(text index, the template's tokens and values, those with names as literals, those with all words as literals, whether a word is a name)."""
    doc, token, value, _, _, h = template(texts)
    name = token == NAME
    return doc, ((token, value), (np.where(name, h, token), np.where(name, np.uint64(0), value)), (mix(h + np.uint64(1)), np.zeros(len(h), np.uint64))), name


def _windows(batch: pa.RecordBatch, sizes: tuple, wanted: np.ndarray | None, keep: list[str]):
    for lo, hi, texts in slices(batch):
        doc, forms, name = _forms(texts)
        names = np.concatenate([[0], np.cumsum(name)])
        count = np.bincount(doc, minlength=hi - lo)
        first = np.cumsum(count) - count
        for n, (form, (token, value)) in product(sizes, enumerate(forms)):
            h = window_hash(token, n, n)
            if not len(h):
                continue
            slot = np.concatenate([[0], np.cumsum(forms[min(form, 1)][1] > 0)])
            told = n - (slot[n : n + len(h)] - slot[: len(h)]) >= min(MIN_LITERALS, n)
            ok = (doc[: len(h)] == doc[n - 1 :]) & (~told if form == 2 else told)
            if form == 1:  # windows without names have the first form alone
                ok &= names[n : n + len(h)] > names[: len(h)]
            at = np.flatnonzero(ok)
            if wanted is not None and len(wanted):
                h_ = h[at]
                i = np.minimum(np.searchsorted(wanted, h_), len(wanted) - 1)
                at = at[wanted[i] == h_]
            if not len(at):
                continue
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(at) + 1, n, dtype=np.int32)), pa.array(signed(value[at[:, None] + np.arange(n)].ravel())))
            own = [batch.column(batch.schema.get_field_index(c)).take(pa.array(doc[at] + lo)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array((at - first[doc[at]]).astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), pa.array(count[doc[at]].astype(np.int32)), pa.array(signed(h[at])), values],
                [*keep, "pos", "n", "size", "hash", "slots"],
            )


def _windowed(df: DataFrame, keep: list[str], sizes: tuple, wanted: np.ndarray | None = None) -> DataFrame:
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", pos int, n int, size int, hash long, slots array<long>"
    return map_arrow(df.select(*keep, "text"), _windows, schema, sizes=sizes, wanted=wanted, keep=keep)


def _size(batch: pa.RecordBatch):
    for lo, hi, texts in slices(batch):
        n = np.bincount(template(texts)[0], minlength=hi - lo).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array(n)], ["item_id", "text", "size"])


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_cover: float = MIN_COVER, max_sent: int = MAX_SENT) -> DataFrame:
    """(doc_id, key, item_id, covered, size): benchmark items found in documents; key tells texts of one doc_id apart.

    Items shorter than a window are matched whole. An item is found if windows at one offset, or at neighbouring ones (words
    put in or left out between them), cover at least min_cover of its words (and a whole window). Windows with a value of the
    item that the document fills with several values do not count; different values may be filled with the same. Benchmark
    windows are sent to the tasks in blocks of about max_sent hashes, one block at a time, with a pass over the documents
    for each; what passes is appended to a table and joined with the benchmark by hash. Null texts match nothing; empty
    tables give no rows.
    """
    items = map_arrow(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), _size, "item_id long, text string, size int").distinct()
    sizes = tuple(sorted({min(window, r["size"]) for r in items.select(F.least("size", F.lit(window)).alias("size")).distinct().collect() if r["size"]}))
    parts = _windowed(items, ["item_id"], sizes).where(F.col("n") == F.least("size", F.lit(window)))
    parts = durable(parts.withColumnsRenamed({"pos": "item_pos", "slots": "item_slots"}), "benchmark")
    hashes = parts.select("hash").distinct()
    blocks = max(1, -(-hashes.count() // max_sent))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    path, spark = new_path(docs.sparkSession, "windows"), docs.sparkSession
    for k in range(blocks):
        wanted = np.sort(hashes.where(F.pmod("hash", F.lit(blocks)) == k).toPandas()["hash"].to_numpy(np.int64).view(np.uint64))
        own = _windowed(source if len(wanted) else source.limit(0), ["doc_id", "key"], sizes or (window,), wanted)
        own.write.mode("append").parquet(path)
    found = spark.read.schema(own.schema).parquet(path)
    hit = durable(found.drop("size").distinct().join(parts, ["hash", "n"]).withColumn("shift", F.col("pos") - F.col("item_pos")).select("doc_id", "key", "item_id", "shift", "item_pos", "n", "size", "slots", "item_slots"), "hits")
    pair = ["doc_id", "key", "item_id"]
    # Offsets no further than a window from the next are neighbours.
    order = Window.partitionBy(*pair).orderBy("shift")
    step = F.col("shift") - F.lag("shift").over(order)
    near = hit.withColumn("run", F.coalesce((step > window).cast("int"), F.lit(0))).withColumn("run", F.sum("run").over(order))
    way = lambda level, x: F.struct(F.lit(level).alias("level"), F.col(x).cast("long").alias("at"))
    each = durable(near.withColumn("way", F.explode(F.array(way(0, "shift"), way(1, "run")))).select(*pair, "way", "item_pos", "n", "size", "slots", "item_slots"), "alignments")
    where = [*pair, "way"]
    filled = each.select(*where, F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).where("s.item_slots <> 0")
    several = filled.groupBy(*where, F.col("s.item_slots").alias("x")).agg(F.countDistinct("s.slots").alias("ys")).where("ys > 1").groupBy(*where).agg(F.collect_set("x").alias("bad"))
    same = [F.col(f"h.{x}").eqNullSafe(F.col(f"f.{x}")) for x in where]
    good = each.alias("h").join(several.alias("f"), same, "left").where("f.bad is null or not arrays_overlap(h.item_slots, f.bad)").select("h.*")
    cover = good.groupBy(*where, "size", "n").agg(F.sort_array(F.collect_set("item_pos")).alias("at")).select(
        *pair, "size", F.expr("aggregate(transform(at, (p, i) -> if(i + 1 = size(at), n, least(n, at[i + 1] - p))), 0, (a, x) -> a + x)").alias("covered")
    )
    return cover.where(F.col("covered") >= min_cover * F.col("size")).groupBy(*pair).agg(F.max("covered").alias("covered"), F.max("size").alias("size"))


#: Columns that contaminated() adds.
RESULTS = ["item_ids", "n_items", "short_item_ids", "contaminated"]


def _marked(docs: DataFrame, benchmark: DataFrame, min_words: int, **args) -> DataFrame:
    """(row, item_ids, n_items, short_item_ids, contaminated): all columns of docs in one struct, and the results."""
    ids = lambda some: F.sort_array(F.collect_set(F.when(some, F.col("item_id"))))
    found = durable(matches(docs, benchmark, **args), "found").groupBy(F.col("doc_id").alias("found_id"), F.col("key").alias("found_key")).agg(
        ids(F.col("size") >= min_words).alias("long_"), ids(F.col("size") < min_words).alias("short_")
    )
    mine = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    none = F.array().cast("array<bigint>")
    both = mine.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key")), "left")
    both = both.select("row", F.coalesce("long_", none).alias("item_ids"), F.coalesce("short_", none).alias("short_item_ids"))
    return both.withColumns({"n_items": F.size("item_ids").cast("long"), "contaminated": F.size("item_ids") > 0})


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, **args) -> DataFrame:
    """docs with n_items (benchmark items found), item_ids (their list, ascending), short_item_ids and contaminated.

    Items of fewer than min_words words are reported in short_item_ids alone and contaminate nothing. Repeated rows are
    judged alike; null and empty texts are clean; an empty table gives no rows, an empty benchmark leaves all documents
    clean; texts may have any length. Columns with the names of results are replaced, all others pass, whatever their names.
    """
    return unpacked(_marked(docs, benchmark, min_words, **args), RESULTS)


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, **args) -> DataFrame:
    """The rows of docs without a benchmark item, with all their columns, those with the names of results too."""
    return _marked(docs, benchmark, min_words, **args).where("not contaminated").select("row.*")
