"""Substring de-duplication by sliding sentence spans.

Every run of RUN consecutive sentences is hashed, and every run of two that has PAIR_WORDS words, so a longer repeated passage
is covered by its runs; a text of fewer sentences is one run. Runs are taken with line ends as ends of sentences, and again without, so that a passage wrapped at
other widths is found as well. They are joined over all documents by hash; every sentence that a repeated run covers is
removed, except in the run's first occurrence (the least doc_id, then the earliest place).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tagweave.llm.shared import column, discard, durable, map_arrow, slices
from tagweave.llm.text_arrays import mix, part_hash, signed, words

#: Sentences of a run.
RUN = 3
#: Words with which two sentences are a run.
PAIR_WORDS = 20
ENDS = ".!?…。！？"
CLOSING = "\"'”’»)]"


def sentences(texts: list[str]):
    """(words, first word of each sentence, their end as a word index, text index, the sentence ends whatever the wrapping).

    A sentence ends after a word whose last character, closing quotes and brackets aside, is one of ENDS, at a line's
    end, and at the text's end. Characters between sentences belong to the earlier one.
    """
    w = words([t.lower() if len(t.lower()) == len(t) else t for t in texts])
    if not len(w.start):
        return w, *(np.empty(0, np.int64),) * 3, np.empty(0, bool)
    p = w.points
    last = w.end - 1
    for _ in range(2):
        last = np.where(np.isin(p[last], [ord(c) for c in CLOSING]) & (last > w.start), last - 1, last)
    stop = np.isin(p[last], [ord(c) for c in ENDS])
    lines = np.concatenate([[0], np.cumsum(p == 10)])
    apart = lines[w.start[1:]] - lines[w.end[:-1]]
    firm = stop.copy()
    firm[:-1] |= (apart > 1) | (w.text[1:] != w.text[:-1])
    firm[-1] = True
    stop[:-1] |= apart > 0
    stop |= firm
    end = np.flatnonzero(stop) + 1
    first = np.concatenate([[0], end[:-1]])
    return w, first, end, w.text[first], firm[end - 1]


def spans(texts: list[str], run: int = RUN):
    """(text index, number of its first sentence in the text, sentences, two hashes) of every run of `run` sentences, of
    every two with PAIR_WORDS words, and of texts that have fewer than `run`."""
    w, first, end, doc, firm = sentences(texts)
    if not len(first):
        e = np.empty(0, np.int64)
        return e, e, e, e.view(np.uint64), e.view(np.uint64)
    found = []
    for last in (np.arange(len(first)), np.flatnonzero(firm)):  # last line of each sentence, with line ends as ends and without
        begin = np.concatenate([[0], last[:-1] + 1])
        for size in {2, run}:
            at, to = begin[: max(0, len(last) - size + 1)], last[size - 1 :] + 1
            far = (end[to - 1] - first[at] >= PAIR_WORDS) | (size == run)
            found.append((at[far], to[far]))
    few = np.bincount(doc[firm], minlength=len(texts)) < run
    ends_at = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1
    begins_at = np.append(0, ends_at[:-1])
    found.append((begins_at[few[doc[begins_at]]], ends_at[few[doc[begins_at]]]))
    at, to = np.unique(np.concatenate([np.stack(x, 1) for x in found]), axis=0).T
    ok = doc[to - 1] == doc[at]
    at, to = at[ok], to[ok]
    h = part_hash(w, w.start, w.end)
    power = np.full(len(h) + 1, np.uint64(0x9E3779B97F4A7C15), np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    inverse = np.full(len(h) + 1, np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    a, b = first[at], end[to - 1]
    both = []
    for seed in (np.uint64(1), np.uint64(0x51ED270B7A9C1F35)):
        cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ seed) * power[: len(h)])])
        both.append(mix((cum[b] - cum[a]) * inverse[a]))
    start = np.searchsorted(doc, doc[at])
    return doc[at], at - start, to - at, both[0], both[1]


def _spans(batch: pa.RecordBatch, run: int):
    for lo, _, texts in slices(batch):
        doc, i, n, h1, h2 = spans(texts, run)
        if len(doc):
            take = pa.array(doc + lo)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(i.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(signed(h1)), pa.array(signed(h2))],
                ["doc_id", "key", "i", "n", "h1", "h2"],
            )


def repeated(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, key, marks): the spans to remove of each document that has some, as (first sentence, sentences).

    Counting shuffles partial counts; only spans found twice or more are looked at again.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    found = durable(map_arrow(source, _spans, "doc_id long, key long, i int, n int, h1 long, h2 long", run=run), "spans")
    # Written out, counts stand beside the spans as plain tables, and a hot span's join can be split.
    often = durable(found.groupBy("h1", "h2").agg(F.count("*").alias("times")).where("times > 1").select("h1", "h2"), "often")
    again = durable(found.join(often, ["h1", "h2"]), "repeats")
    head = durable(again.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "key", "i")).alias("head")), "heads")
    discard(found, often)
    later = again.join(head, ["h1", "h2"]).where(~(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("key") == F.col("head.key")) & (F.col("i") == F.col("head.i"))))
    return later.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("i", "n"))).alias("marks"))


def _clean(batch: pa.RecordBatch):
    for lo, hi, texts in slices(batch):
        part = batch.slice(lo, hi - lo)
        marks = column(part, "marks").to_pylist()
        kept, count, cut, ranges = [], [], [], []
        w, first, end, doc, _ = sentences(texts)
        at = np.searchsorted(doc, np.arange(hi - lo + 1))
        for k in range(hi - lo):
            a, b = at[k], at[k + 1]
            count.append(int(b - a))
            gone = np.zeros(b - a, bool)
            for m in marks[k] or ():
                gone[m["i"] : m["i"] + m["n"]] = True
            cut.append(int(gone.sum()))
            if not gone.any():
                kept.append(texts[k])
                ranges.append([])
                continue
            begin = w.start[first[a:b]] - w.first[k]
            begin[0] = 0
            stop = np.append(begin[1:], len(texts[k]))
            kept.append("".join(texts[k][x:y] for x, y, g in zip(begin, stop, gone) if not g))
            edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            ranges.append([f"{begin[x]}:{stop[y - 1]}" for x, y in zip(edge[0::2], edge[1::2])])
        yield pa.RecordBatch.from_arrays(
            [column(part, "row"), pa.array(kept, pa.string()), pa.array(count, pa.int64()), pa.array(cut, pa.int64()), pa.array(ranges, pa.list_(pa.string()))], ["row", *RESULTS]
        )


#: Columns that remove_repeats() adds.
RESULTS = ("clean_text", "n_sentences", "n_removed", "removed")


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, run: int = RUN) -> DataFrame:
    """The columns `keep` of docs (all, if not given) with clean_text, n_sentences, n_removed and removed (start:end, in characters of the text).

    A null text is empty; a text with fewer sentences than a run goes if another is the same; others may have any length. An
    empty table gives no rows. Rows with equal doc_id and text are one document: none of them is the other's repeat. A null
    doc_id comes before all others. Columns with the names of results are replaced, all others pass, whatever their names.
    """
    keep = [c for c in (keep or docs.columns) if c not in RESULTS]
    marks = durable(repeated(docs, run), "marks")
    mine = docs.select(F.struct(*keep).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    both = mine.join(marks, mine["id"].eqNullSafe(marks["doc_id"]) & (mine["text_key"] == marks["key"]), "left").select("row", "text", "marks")
    text, long = StringType(), LongType()
    schema = StructType([mine.schema["row"], *(StructField(n, t) for n, t in zip(RESULTS, (text, long, long, ArrayType(text))))])
    return map_arrow(both, _clean, schema).select("row.*", *RESULTS)
