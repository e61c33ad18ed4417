"""Toxicity: a factorization machine over hashed terms.

Terms are the distinct lower-cased letter runs of a text and their first four and five letters, hashed. The score is the
logistic function of a bias, a weight per term and the inner products of all pairs of terms' vectors, so a pair of terms
can count for more, or less, than its parts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.letters import letter_runs
from tagweave.llm.shared import column, map_arrow, slices
from tagweave.llm.text_arrays import mix, part_hash

BUCKETS = 1 << 20
FACTORS = 4
SAMPLE = 16_000
STEPS = 1200
BATCH = 128
MIN_ROWS = 3
MIN_G2 = 11.0
#: Of the terms that tell nothing alone, those in the most rows are looked at in pairs: so many of them, in at least so many
#: rows. A pair counts if what the linear model leaves over is that many standard deviations from nothing on its rows.
JOINT_TERMS, JOINT_ROWS, JOINT_Z = 1500, 20, 6.0
#: Spread of the factors at first, of terms that count alone and of those that count in pairs.
SPREAD, JOINT_SPREAD = 0.01, 0.2
THRESHOLD = 0.3


class Model(NamedTuple):
    bias: float
    place: np.ndarray  # bucket -> row of weight and factors, -1 if unknown
    weight: np.ndarray
    factors: np.ndarray


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of the distinct terms of each text, ordered."""
    w = letter_runs(texts)
    size = w.end - w.start
    doc, bucket = [], []
    for kind, n in ((1, None), (2, 4), (3, 5)):
        on = slice(None) if n is None else size >= n
        start = w.start[on]
        h = part_hash(w, start, w.end[on] if n is None else start + n)
        doc.append(w.text[on])
        bucket.append(mix(h + np.uint64(kind)) & np.uint64(BUCKETS - 1))
    pair = np.unique(np.concatenate(doc).astype(np.int64) * BUCKETS + np.concatenate(bucket).astype(np.int64))
    return pair // BUCKETS, pair % BUCKETS


def _features(batch: pa.RecordBatch):
    toxic = column(batch, "toxic")
    for lo, hi, texts in slices(batch):
        doc, bucket = terms(texts)
        cut = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([toxic.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cut), pa.array(bucket.astype(np.int32)))], ["toxic", "terms"])


def associated(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Buckets in at least MIN_ROWS rows whose presence and the label depend on each other: their log-likelihood ratio
    (G squared) reaches MIN_G2. Without this the many rare words of a text drown those that matter."""
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    label = np.repeat(toxic, [len(r) for r in rows]) if rows else np.empty(0)
    n = np.bincount(flat, minlength=BUCKETS).astype(float)
    a = np.bincount(flat, label, BUCKETS)
    some = np.flatnonzero(n >= MIN_ROWS)
    n, a, total, bad = n[some], a[some], float(len(rows)), float(toxic.sum())
    cells = ((a, n * bad), (n - a, n * (total - bad)), (bad - a, (total - n) * bad), (total - bad - n + a, (total - n) * (total - bad)))
    g2 = np.zeros(len(some))
    for seen, product in cells:
        with np.errstate(divide="ignore", invalid="ignore"):
            g2 += np.where(seen > 0, 2 * seen * np.log(seen * total / product), 0)
    return some[g2 >= MIN_G2]


def jointly(rows: list[np.ndarray], toxic: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Buckets that tell nothing alone, but do together with another: of pairs of frequent terms, those on whose rows the
    residual of the linear model of the `single` terms is too large to be chance."""
    n = np.bincount(np.concatenate(rows), minlength=BUCKETS) if rows else np.zeros(BUCKETS, np.int64)
    varied = np.minimum(n, len(rows) - n)
    varied[single] = 0
    frequent = np.flatnonzero(varied >= JOINT_ROWS)
    frequent = frequent[np.argsort(-varied[frequent], kind="stable")[:JOINT_TERMS]]
    if not len(frequent):
        return frequent
    linear = _fit(rows, toxic, single, np.empty(0, np.int64), factors=0)
    both = np.concatenate([frequent, single[np.argsort(-n[single], kind="stable")[:JOINT_TERMS]]])
    place = np.full(BUCKETS, -1, np.int32)
    place[both] = np.arange(len(both))
    total, spread = (np.zeros((len(frequent), len(both)), np.float32) for _ in range(2))
    for lo in range(0, len(rows), 2000):
        part = rows[lo : lo + 2000]
        x = np.zeros((len(part), len(both)), np.float32)
        z = np.full(len(part), linear.bias)
        for i, r in enumerate(part):
            x[i, place[r][place[r] >= 0]] = 1
            z[i] += linear.weight[linear.place[r][linear.place[r] >= 0]].sum()
        p = (1 / (1 + np.exp(-np.clip(z, -30, 30)))).astype(np.float32)[:, None]
        total += (x[:, : len(frequent)] * (toxic[lo : lo + 2000, None].astype(np.float32) - p)).T @ x
        spread += (x[:, : len(frequent)] * (p * (1 - p))).T @ x
    far = np.abs(total) >= JOINT_Z * np.sqrt(spread + 1)
    far[np.arange(len(frequent)), np.arange(len(frequent))] = False
    return np.unique(np.concatenate([frequent[far.any(1)], both[far.any(0)]]))


def fit(rows: list[np.ndarray], toxic: np.ndarray, factors: int = FACTORS, steps: int = STEPS, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Logistic loss, Adagrad, `steps` batches in a fixed pseudorandom order. The terms are those that are associated() with
    the label by themselves, or jointly() with another."""
    single = associated(rows, toxic)
    return _fit(rows, toxic, single, np.setdiff1d(jointly(rows, toxic, single), single), factors, steps, rate, decay)


def _fit(rows: list[np.ndarray], toxic: np.ndarray, single: np.ndarray, joint: np.ndarray, factors: int = FACTORS, steps: int = STEPS, rate: float = 0.1, decay: float = 1e-5) -> Model:
    often = np.sort(np.concatenate([single, joint]).astype(np.int64))
    place = np.full(BUCKETS, -1, np.int32)
    place[often] = np.arange(len(often))
    rng = np.random.default_rng(7)
    k = max(1, len(often))
    w, v = np.zeros(k), rng.normal(0, SPREAD, (k, factors))
    v[: len(often)][np.isin(often, joint)] *= JOINT_SPREAD / SPREAD
    gw, gv = np.full(k, 1e-2), np.full((k, factors), 1e-2)
    share = min(max(toxic.mean() if len(toxic) else 0.0, 1e-3), 1 - 1e-3)
    bias, gb = float(np.log(share / (1 - share))), 1e-2
    rows = [p[p >= 0] for p in (place[r] for r in rows)]
    for _ in range(-(-steps * BATCH // len(rows)) if rows else 0):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            own = [rows[i] for i in some]
            at = np.concatenate(own)
            row = np.repeat(np.arange(len(some)), [len(x) for x in own])
            va = v[at]
            s = np.stack([np.bincount(row, va[:, f], len(some)) for f in range(factors)], 1) if factors else np.zeros((len(some), 0))
            pairs = 0.5 * ((s**2).sum(1) - np.bincount(row, (va**2).sum(1), len(some)))
            z = bias + np.bincount(row, w[at], len(some)) + pairs
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[some]
            gb += g.mean() ** 2
            bias -= rate * g.mean() / np.sqrt(gb)
            slot, back = np.unique(at, return_inverse=True)
            d = np.bincount(back, g[row], len(slot)) / len(some) + decay * w[slot]
            gw[slot] += d**2
            w[slot] -= rate * d / np.sqrt(gw[slot])
            dv = g[row][:, None] * (s[row] - va)
            for f in range(factors):
                d = np.bincount(back, dv[:, f], len(slot)) / len(some) + decay * v[slot, f]
                gv[slot, f] += d**2
                v[slot, f] -= rate * 0.2 * d / np.sqrt(gv[slot, f])
    return Model(bias, place, w.astype(np.float32), v.astype(np.float32))


def with_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text) with their labels (doc_id, toxic): about twice as many labels as train() uses, drawn by doc_id
    before any text is moved. So few are sent to all tasks, after they are counted; if ids that stand often make them more
    than that, texts and labels are shuffled."""
    known = labels.where("toxic is not null and doc_id is not null")
    total = known.count()
    if total > 2 * sample:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(2_000_000 * sample / total))
    few = known.count() <= 4 * sample
    return docs.join(F.broadcast(known) if few else known, "doc_id")


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from (text, toxic) rows, of which at most about `sample` are used, chosen by a hash of all their columns: with
    doc_id among them, copies of a text are drawn one by one, so that the bound holds for them too.

    The sample is fitted in one task, and its terms' weights come back as the model. Null labels teach nothing, null
    texts are empty; without rows the model gives every text a score near 0. Rows repeated as a whole are drawn together.
    """
    rows = labelled.where("toxic is not null")
    total = rows.count()
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64(*labelled.columns, F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    rows = rows.select("text", F.col("toxic").cast("int").alias("toxic"))

    def one(batches):
        got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1)) for b in batches if b.num_rows]
        sets = [np.asarray(x.values.to_numpy(zero_copy_only=False))[a:b] for _, col in got for x, a, b in ((col, int(p), int(q)) for p, q in zip(col.offsets.to_numpy()[:-1], col.offsets.to_numpy()[1:]))]
        m = fit(sets, np.concatenate([t for t, _ in got]).astype(np.float64) if got else np.empty(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.bias]), pa.array([np.flatnonzero(m.place >= 0).astype(np.int32).tobytes()], pa.binary()), pa.array([m.weight.tobytes()], pa.binary()), pa.array([m.factors.tobytes()], pa.binary())],
            ["bias", "buckets", "weight", "factors"],
        )

    got = map_arrow(rows, _features, "toxic int, terms array<int>").repartition(1).mapInArrow(one, "bias double, buckets binary, weight binary, factors binary").collect()
    if not got:
        return fit([], np.empty(0))
    buckets = np.frombuffer(bytes(got[0]["buckets"]), np.int32)
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    return Model(got[0]["bias"], place, np.frombuffer(bytes(got[0]["weight"]), np.float32), np.frombuffer(bytes(got[0]["factors"]), np.float32).reshape(-1, FACTORS))


def scores(texts: list[str], model: Model) -> np.ndarray:
    doc, bucket = terms(texts)
    at = model.place[bucket]
    doc, at = doc[at >= 0], at[at >= 0]
    n = len(texts)
    v = model.factors[at].astype(np.float64)
    s = np.stack([np.bincount(doc, v[:, f], n) for f in range(v.shape[1])], 1)
    z = model.bias + np.bincount(doc, model.weight[at], n) + 0.5 * ((s**2).sum(1) - np.bincount(doc, (v**2).sum(1), n))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _score(batch: pa.RecordBatch, model: tuple):
    m = unpacked(model)
    got = np.concatenate([scores(texts, m) for _, _, texts in slices(batch)])
    keep = [c for c in batch.schema.names if c not in ("text_", "toxicity")]
    yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(got)], [*keep, "toxicity"])


_held: list = [None, None]


def packed(m: Model) -> tuple:
    """Without the buckets that no row had: what tasks are sent has the size of the fitted terms."""
    return m.bias, np.flatnonzero(m.place >= 0).astype(np.int32), m.weight, m.factors


def unpacked(model: tuple) -> Model:
    if _held[0] is not model:
        place = np.full(BUCKETS, -1, np.int32)
        place[model[1]] = np.arange(len(model[1]))
        _held[:] = [model, Model(model[0], place, model[2], model[3])]
    return _held[1]


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with toxicity, 0 to 1. A null text scores as an empty one: by the bias alone. Repeated
    rows score alike, an empty table gives no rows, texts may have any length, and a column toxicity is replaced."""
    keep = keep or docs.columns
    names = [c for c in keep if c != "toxicity"]
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + ", toxicity double"
    need = docs.select(*names) if "text" in names else docs.select(*names, "text")
    if "text" not in names:

        def fn(batch, model):
            for out in _score(batch, model):
                i = out.schema.get_field_index("text")
                yield pa.RecordBatch.from_arrays([c for k, c in enumerate(out.columns) if k != i], [c for c in out.schema.names if c != "text"])

        return map_arrow(need, fn, schema, model=packed(model))
    return map_arrow(need, _score, schema, model=packed(model))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score is under the threshold, with their columns as they were."""
    return score(docs, model).where(F.col("toxicity") < threshold).select(*docs.columns)
