"""Mixing sources to target weights by blocks.

Each source's documents form one stream of words, cut into blocks of a fixed number of words. Output shards have a fixed
number of slots; each shard draws multinomially how many slots a source gets. A source's j-th slot takes the block that a
pseudorandom permutation of its block numbers gives for j; every pass over the blocks has a permutation of its own. Slots and blocks meet in a join by source and block number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tagweave.llm.shared import column, durable, map_arrow, slices
from tagweave.llm.text_arrays import mix, words

BLOCK_WORDS = 32
SHARD_SLOTS = 4096
#: A mix has about this many shards at least, so that the last one's draw is a small part of any table.
MIN_SHARDS = 256
BUCKETS = 4096
MOST = 3
#: Shards whose slots are added up at a time.
RUN = 1024
SEED = 20_240_501


def sizes(docs: DataFrame) -> DataFrame:
    """docs with `size`: the number of runs of characters other than space and U+0009..U+000D (null: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, target). Sources in code point order, null last, weigh 1, 2, 3, repeating.

    The targets are the least of `most` times the size and the weight times one level, the level being such that they add
    up to all words: in ascending order of size per weight, a source is capped while the level that the words and
    weights after it would give is above its own. The window runs over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    w = per.withColumn("weight", ((rank - 1) % 3 + 1).cast("long"))
    order = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").isNull(), "source")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumns({
        "left": F.sum("source_size").over(every) - F.coalesce(F.sum(most * F.col("source_size")).over(upto), F.lit(0)),
        "nth": F.row_number().over(order),
        "weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0)),
    })
    w = w.withColumn("open", F.col("left") * F.col("weight") <= most * F.col("source_size") * F.col("weights"))
    level = F.min(F.when(F.col("open"), F.struct("nth", (F.col("left") / F.col("weights")).alias("level")))).over(every)["level"]
    return w.withColumn("level", level).select("source", "source_size", F.least(F.col("level") * F.col("weight"), (most * F.col("source_size")).cast("double")).alias("target"))


def _permute(j: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of 0..n-1 for each key: a four-round Feistel network over the least even power of two, walked until it is inside."""
    half = np.zeros(len(n), np.uint64)
    while True:
        small = (np.uint64(1) << (half * np.uint64(2))) < n
        if not small.any():
            break
        half[small] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = j.astype(np.uint64)
    walk = np.arange(len(j))
    while len(walk):
        x, h, m, k = out[walk], half[walk], mask[walk], key[walk]
        left, right = x >> h, x & m
        for i in range(4):
            left, right = right, left ^ (mix(right + k + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)) & m)
        out[walk] = (left << h) | right
        walk = walk[out[walk] >= n[walk]]
    return out


def draw(shards: DataFrame, want: np.ndarray, seed: int, wave: int) -> DataFrame:
    """(shard, source_no, n): multinomial counts of the sources in the n slots of each shard (shard, n); want: the sources'
    weights. Each task holds one number per source."""
    share = want / want.sum()

    def one(batches):
        for pdf in batches:
            drawn = [np.random.default_rng([seed, wave, int(k)]).multinomial(int(n), share) for k, n in zip(pdf["shard"], pdf["n"])]
            some = [np.flatnonzero(x) for x in drawn]
            yield pd.DataFrame({
                "shard": np.repeat(pdf["shard"].to_numpy(np.int64), [len(x) for x in some]),
                "source_no": np.concatenate([np.empty(0, np.int64), *some]).astype(np.int32),
                "n": np.concatenate([np.empty(0, np.int64), *(x[i] for x, i in zip(drawn, some))]).astype(np.int64),
            })

    return shards.mapInPandas(one, "shard long, source_no int, n long")


def _begins(counts: DataFrame) -> DataFrame:
    """counts with `begin`: the source's slots in the shards before, by sums over runs of shards and within them."""
    c = counts.withColumn("run", F.expr(f"shard div {RUN}"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    per = c.groupBy("source_no", "run").agg(F.sum("n").alias("all_"))
    base = per.select("source_no", "run", F.coalesce(F.sum("all_").over(before("source_no").orderBy("run")), F.lit(0)).alias("base"))
    inside = c.withColumn("inside", F.coalesce(F.sum("n").over(before("source_no", "run").orderBy("shard")), F.lit(0)))
    return inside.join(base, ["source_no", "run"]).select("shard", "source_no", "n", (F.col("base") + F.col("inside")).alias("begin"))


def placed(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """docs with size, key and `at`: the words of its source before it.

    The order within a source is by a hash bucket, then doc_id and text hash; buckets' sums are added up over one row
    per bucket, and each bucket's documents on their own, so no source is ordered in one task.
    """
    sized = sizes(docs).withColumn("key", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)))
    per = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(F.col("source").alias("s_"), F.col("bucket").alias("b_"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    df = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = df.join(base, df["source"].eqNullSafe(base["s_"]) & (df["bucket"] == base["b_"]))
    return joined.withColumn("at", F.col("base") + F.col("inside")).drop("s_", "b_", "base", "inside", "bucket")


def taken_blocks(table: DataFrame, block: int = BLOCK_WORDS, slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(source, block, epoch) of every slot of the mix. table: source, source_size, target.

    The shards draw in waves of three quarters of those left, down to one: the weights of a wave are what the sources
    still lack, so chance moves a source's total by no more than one shard's draw does. A shard has `slots` slots at most, and
    fewer where there would be less than MIN_SHARDS shards. A source takes MOST passes over its
    blocks at most; slots drawn beyond that are drawn again in the next wave among the others. The driver sees the sources'
    table and their totals: a row per source, not per document, shard or slot.
    """
    spark = table.sparkSession
    t = table.where("source_size > 0").toPandas()
    t = t.assign(null=t["source"].isna()).sort_values(["null", "source"]).reset_index(drop=True)
    size = t["source_size"].to_numpy(np.int64)
    blocks = -(-size // block)
    want = t["target"].to_numpy(float) * blocks / size if len(t) else np.empty(0)
    total, limit = int(round(want.sum())), MOST * blocks
    slots = max(1, min(slots, -(-total // MIN_SHARDS)))
    n_shards = -(-total // slots)
    filled, pending, each, lo, wave = np.zeros(len(t), np.int64), None, None, 0, 0
    while lo < n_shards or pending is not None:
        hi = lo + max(1, 3 * (n_shards - lo) // 4) if lo < n_shards else lo
        of = spark.range(lo, hi, numPartitions=max(1, (hi - lo) // RUN)).select(F.col("id").alias("shard"), F.least(F.lit(slots), F.lit(total) - F.col("id") * slots).alias("n"))
        of = of if pending is None else of.unionAll(pending)
        lack = np.where(filled < limit, np.clip(want - filled, 0, None), 0)
        counts = durable(_begins(draw(of, lack if lack.sum() > 0 else limit - filled, seed, wave)), "counts")
        got = counts.groupBy("source_no").agg(F.sum("n").alias("n")).toPandas()
        drawn = np.zeros(len(t), np.int64)
        drawn[got["source_no"]] = got["n"]
        room = spark.createDataFrame(pa.table({"source_no": np.arange(len(t), dtype=np.int32), "room": limit - filled, "filled": filled}))  # by Arrow: pandas rows would pass through Python workers
        c = counts.join(F.broadcast(room), "source_no").withColumn("fits", F.greatest(F.lit(0), F.least("n", F.col("room") - F.col("begin"))))
        some = c.where("fits > 0").select("source_no", (F.col("filled") + F.col("begin")).alias("j"), "fits")
        each = some if each is None else each.unionAll(some)
        pending = durable(c.where("fits < n").groupBy("shard").agg(F.sum(F.col("n") - F.col("fits")).alias("n")), "again") if (drawn > limit - filled).any() else None
        filled, lo, wave = np.minimum(limit, filled + drawn), hi, wave + 1
    if each is None:
        return spark.createDataFrame([], "source string, block long, epoch int")
    each = each.select("source_no", F.explode(F.sequence("j", F.col("j") + F.col("fits") - 1)).alias("j"))
    names = [None if x else s for s, x in zip(t["source"], t["null"])]

    def number(batches):
        for batch in batches:
            no, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            n = blocks[no]
            epoch = j // n
            key = mix((no.astype(np.uint64) << np.uint64(8)) + epoch.astype(np.uint64) + np.uint64(seed))
            b = _permute(j % n, n.astype(np.uint64), key).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in no.tolist()], pa.string()), pa.array(b), pa.array(epoch.astype(np.int32))], ["source", "block", "epoch"])

    return each.mapInArrow(number, "source string, block long, epoch int")


def mix_parts(docs: DataFrame, block: int = BLOCK_WORDS, slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with place, sources' targets, parts): a part is a document's words from_word..to_word in one epoch."""
    place = durable(placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")).drop("text"), "places")
    table = durable(targets(place), "targets")
    taken = durable(taken_blocks(table, block, slots, seed), "slots")
    cut = place.where("size > 0").select("doc_id", "key", "source", "size", "at", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).alias("block"))
    # A block's documents and its slots, three at most, meet by source and block number.
    on = cut["source"].eqNullSafe(taken["source"]) & (cut["block"] == taken["block"])
    parts = cut.join(taken, on).select(
        "doc_id", "key", cut["source"], "size", "at", "epoch",
        F.greatest(cut["block"] * block - F.col("at"), F.lit(0)).alias("from_word"),
        F.least((cut["block"] + 1) * block - F.col("at"), F.col("size")).alias("to_word"),
    )
    return place, table, parts


def mixed_counts(docs: DataFrame, **args) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    Null texts have no words and are never taken; a null source is a source. Repeated rows stand at places of their own,
    so each has its own count. Runs agree: order, draws and permutations depend on the rows and the seed alone.
    """
    place, table, parts = mix_parts(docs, **args)
    per = parts.groupBy("doc_id", "key", "source", "at").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    p, s, t = place.alias("p"), per.alias("s"), table.alias("t")
    same = F.col("p.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("p.key") == F.col("s.key")) & F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.at") == F.col("s.at")) & (F.col("p.size") > 0)
    return p.join(s, same, "left").join(t, F.col("p.source").eqNullSafe(F.col("t.source"))).select(
        "p.doc_id", "p.size", "t.source_size", "t.target", F.coalesce("s.taken", F.lit(0)).cast("long").alias("taken")
    )


def _cut(batch: pa.RecordBatch, columns: list[str]):
    row = column(batch, "row")
    flat = pa.RecordBatch.from_arrays([row.field(i) for i in range(len(columns))], columns)
    for lo, hi, texts in slices(pa.RecordBatch.from_arrays([flat.column(columns.index("text"))], ["text"])):
        part, own, out = batch.slice(lo, hi - lo), flat.slice(lo, hi - lo), []
        for text, piece, size in zip(texts, column(part, "pieces").to_pylist(), column(part, "size").to_pylist()):
            ranges = sorted((p["from_word"], p["to_word"]) for p in piece)
            if sum(b - a for a, b in ranges) == size:
                out.append(text)
                continue
            w = words([text])
            end = np.append(w.start[1:], len(text))
            runs: list[list[int]] = []
            for a, b in ranges:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            out.append("\n".join(text[w.start[a] : end[b - 1]].rstrip() for a, b in runs))
        new = {"text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())}
        yield pa.RecordBatch.from_arrays([new[c] if c in new else own.column(i) for i, c in enumerate(columns)], columns)


def mix_documents(docs: DataFrame, **args) -> DataFrame:
    """The mix itself, with the columns of docs: a row per document and epoch it is taken in, whose text is the taken words
    (n_chars, where docs has it, is their length). A document taken whole keeps its text as it was.

    Repeated rows have a place each, and each gives its own rows; of rows with one doc_id, source and text but other columns
    that differ, the one whose columns have the least hash stands for all, so runs agree. A document that is not taken,
    such as one without words, gives none; an empty table gives no rows; texts may have any length. Columns may have any name.
    """
    _, _, parts = mix_parts(docs, **args)
    own = parts.groupBy("doc_id", "key", "source", "at", "size", "epoch").agg(F.collect_list(F.struct("from_word", "to_word")).alias("pieces"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").alias("of"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.xxhash64("*").alias("hash"))
    rows = rows.groupBy("id", "of", "text_key").agg(F.min_by("row", "hash").alias("row"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_key") == F.col("key")) & F.col("of").eqNullSafe(F.col("source"))
    both = rows.join(own, same).select("row", "size", "pieces")
    schema = StructType([StructField(f.name, LongType()) if f.name == "n_chars" else f for f in docs.schema])
    return map_arrow(both, _cut, schema, columns=docs.columns)
