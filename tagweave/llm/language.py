"""Language identification: scripts narrow the candidates of each word, then Viterbi labels spans of words.

A word's score for a language is the log-likelihood of its character trigrams. A change of language between words costs
a penalty, so single odd words do not break a span but longer passages in another language do.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from tagweave.llm.letters import OTHER, letter_runs, script_table
from tagweave.llm.shared import column, map_arrow, slices, unpacked
from tagweave.llm.text_arrays import mix

BUCKETS = 1 << 16
SAMPLE = 20_000
PENALTY = 8.0
MIN_SCRIPT_SHARE = 0.01
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    log_p: np.ndarray  # (BUCKETS, languages), float32
    scripts: np.ndarray  # (scripts + 1, languages): the language is a candidate for the script


def _trigrams(points: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around each character; blanks mark word ends."""
    c = points.astype(np.uint64)
    before = np.concatenate([[np.uint64(10)], c[:-1]])
    after = np.concatenate([c[1:], [np.uint64(10)]])
    for x in (before, after):
        x[x < 33] = 32
    return (mix((before << np.uint64(42)) | (c << np.uint64(21)) | after) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _count(batch: pa.RecordBatch):
    langs = column(batch, "lang")
    for lang in sorted(set(langs.to_pylist())):
        own = batch.filter(pc.equal(langs, lang))
        counts, scripts = np.zeros(BUCKETS, np.int64), np.zeros(OTHER + 1, np.int64)
        for _, _, texts in slices(own):
            w = letter_runs(texts)
            letters = w.points > 32
            counts += np.bincount(_trigrams(w.points)[letters], minlength=BUCKETS)
            scripts += np.bincount(script_table()[w.points[letters]], minlength=OTHER + 1)
        some, seen = np.flatnonzero(counts), np.flatnonzero(scripts)
        n = len(some) + len(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * n), pa.array(np.concatenate([some, -1 - seen]).astype(np.int32), pa.int32()), pa.array(np.concatenate([counts[some], scripts[seen]]), pa.int64())],
            ["lang", "bucket", "n"],
        )


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from (text, lang) rows. At most about `sample` rows are read, chosen by a hash of the text; the counts
    that reach the driver have a row per language and trigram bucket at most, whatever the input's size.

    Rows with a null text or lang teach nothing. Without any row the model has no languages.
    """
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    total = rows.count()
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    got = map_arrow(rows, _count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["lang"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    scripts = np.zeros((OTHER + 1, len(languages)))
    for k, lang in enumerate(languages):
        own = got[got["lang"] == lang]
        b, n = own["bucket"].to_numpy(), own["n"].to_numpy()
        counts[b[b >= 0], k] = n[b >= 0]
        scripts[-1 - b[b < 0], k] = n[b < 0]
    log_p = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS)) if languages else counts
    return Model([str(x) for x in languages], log_p.astype(np.float32), scripts >= MIN_SCRIPT_SHARE * scripts.sum(0) if languages else scripts > 0)


def viterbi(score: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """Label of each row of score: texts are runs of `count` rows from `first`; changing labels within one costs penalty."""
    label = np.zeros(len(score), np.int64)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    alive = np.searchsorted(-count, -np.arange(1, (count[0] if len(count) else 0) + 1), side="right")
    stay, best = np.ones(score.shape, bool), np.zeros(len(score), np.int64)
    total = score[first[: alive[0]]].astype(np.float64) if len(alive) else score
    for t in range(1, len(alive)):
        a = alive[t]
        at, now = first[:a] + t, total[:a]
        top = now.argmax(1)
        jump = now[np.arange(a), top][:, None] - penalty
        keep = now >= jump
        stay[at], best[at] = keep, top
        total[:a] = score[at] + np.where(keep, now, jump)
    state = total.argmax(1) if len(alive) else None
    for t in range(len(alive) - 1, -1, -1):
        a = alive[t]
        at = first[:a] + t
        label[at] = state[:a]
        if t:
            state[:a] = np.where(stay[at, state[:a]], state[:a], best[at])
    return label


def label_words(texts: list[str], model: Model, penalty: float = PENALTY):
    """(words, label of each word): words are letter runs of the lower-cased texts."""
    w = letter_runs(texts)
    letters = np.flatnonzero(w.points > 32)
    k = len(model.languages)
    score = np.zeros((len(w.start), k), np.float32)
    if len(w.start) and k:
        at = np.searchsorted(letters, w.start)
        score = np.add.reduceat(model.log_p[_trigrams(w.points)[letters]], at, axis=0)
        allowed = model.scripts[script_table()[w.points[w.start]]]
        none = ~allowed.any(1)
        score = np.where(allowed, score, score.min(1, keepdims=True) - np.float32(30))
        score[none] = 0
    count = np.bincount(w.text, minlength=len(texts))
    some = np.flatnonzero(count)
    return w, viterbi(score, np.searchsorted(w.text, some), count[some], penalty) if k else np.zeros(len(w.start), np.int64)


def _predict(batch: pa.RecordBatch, model: Model, penalty: float):
    k, names = len(model.languages), np.array([*model.languages, UNKNOWN], object)
    for lo, hi, texts in slices(batch):
        n = hi - lo
        w, label = label_words(texts, model, penalty)
        letters = np.bincount(w.text, weights=w.end - w.start, minlength=n)
        share = np.bincount(w.text * max(k, 1) + label, weights=w.end - w.start, minlength=n * max(k, 1)).reshape(n, max(k, 1))
        known = (letters > 0) & (k > 0)
        top = np.where(known, share.argmax(1), k)
        change = np.ones(len(label), bool)
        change[1:] = (label[1:] != label[:-1]) | (w.text[1:] != w.text[:-1])
        spans: list[list[str]] = [[] for _ in range(n)]
        at = np.flatnonzero(change)
        stop = w.end[np.append(at[1:], len(label)) - 1] if len(at) else at
        for i, s, e, x in zip(w.text[at].tolist(), w.start[at].tolist(), stop.tolist(), label[at].tolist()):
            spans[i].append(f"{names[x] if k else UNKNOWN}:{s - int(w.first[i])}:{e - int(w.first[i])}")
        score = np.divide(share.max(1), letters, out=np.zeros(n), where=known)
        out = {"lang_pred": pa.array(names[top], pa.string()), "score": pa.array(score), "lang_spans": pa.array(spans, pa.list_(pa.string()))}
        part = batch.slice(lo, n)
        keep = [c for c in part.schema.names if c not in out and c != "text"]
        yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + list(out.values()), keep + list(out))


#: Columns that identify() adds.
RESULTS = ["lang_pred", "score", "lang_spans"]


def identify(docs: DataFrame, model: Model, keep: list[str], penalty: float = PENALTY) -> DataFrame:
    """The columns `keep` of docs with lang_pred, score (share of letters in spans of that language) and lang_spans
    (language:start:end, character offsets in the lower-cased text).

    A text that is null or has no letter gets `und`, score 0 and no spans. Ties go to the language first in order. Repeated
    rows are labelled alike, an empty table gives no rows, texts may have any length. A column of `keep` with the name of a
    result is replaced; others pass, whatever their names.
    """
    own = docs.select(F.struct(*keep).alias("row"), "text")
    schema = StructType([own.schema["row"]]).add("lang_pred", "string").add("score", "double").add("lang_spans", ArrayType(StringType()))
    return unpacked(map_arrow(own, _predict, schema, model=model, penalty=penalty), RESULTS)
