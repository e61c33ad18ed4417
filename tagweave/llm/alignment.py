"""Alignment of two tokenizers over a corpus: which ids of one stand where which ids of the other stand.

Byte offsets at which tokens of both end cut a text into groups; ids whose byte ranges overlap are linked. The identity map
gives for each A id the B id of the same bytes. Groups of one such pair are by far the most: they are counted in vectors as
long as the vocabulary, added up over tasks. Only the pairs of other groups go through a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tagweave.llm.shared import column, discard, durable, release, slices

#: Characters of a text that are encoded at once, if it can be cut: between two letters or digits with one blank between
#: them, which no token of either tokenizer spans.
PART = 50_000
_CUT = re.compile(r"[^\W_] (?=[^\W_])")
#: Code points below this are classed alike by the regular expressions of both libraries that can encode by A.
PLAIN = 0x250
#: Irregular pairs that are looked up in the tasks, the most frequent ones; all others are joined.
FREQUENT = 100_000
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_own: dict[tuple[str, str], Tokenizers] = {}


def _byte_of() -> dict[str, int]:
    """The bytes behind the characters of a byte-level vocabulary: printable ones stand for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of their ids and the identity map."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        byte = _byte_of()
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = {bytes(byte[c] for c in s): i for s, i in model["vocab"].items()}
        # The same merges in another library, several times as fast; its ranks are the ids, in the order of the merges.
        in_order = all(model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] == 256 + i for i, m in enumerate(model["merges"]))
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={}) if in_order else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = self._table(plain)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        as_byte = [re.fullmatch(r"<0x([0-9A-F]{2})>", p) for p in pieces]
        self.b_bytes = [bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode() for p, m in zip(pieces, as_byte)]
        self.cuttable = not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_size, self.b_size = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))
        same = {b: i for i, b in enumerate(self.b_bytes) if as_byte[i]} | {b: i for i, b in enumerate(self.b_bytes) if not as_byte[i]}
        self.same = np.fromiter((same.get(b, -1) for b in self.a_bytes), np.int64, len(self.a_bytes))
        a_names, b_names = ([str(i).encode() for i in range(len(t))] for t in (self.a_bytes, self.b_bytes))
        # What an id is written as: within its side, at the side's end.
        self.written = np.array([x + y for names, last in ((a_names, b"|"), (b_names, b";")) for x in names for y in (b",", last)], object)

    @staticmethod
    def _table(vocab: dict[bytes, int]) -> list[bytes]:
        out = [b""] * (max(vocab.values()) + 1)
        for b, i in vocab.items():
            out[i] = b
        return out

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A of the texts and by B of the texts without their first character, a blank."""
        a: list = [None] * len(texts)
        slow = []
        for i, t in enumerate(texts):
            if self.fast and len(t) <= 2 * PART and (t.isascii() or ord(max(t)) < PLAIN):
                a[i] = self.fast.encode_ordinary(t)
            else:
                slow.append(i)
        if slow:
            for i, e in zip(slow, self.a.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)):
                a[i] = e.ids
        return a, self.b.encode([t[1:] for t in texts], num_threads=1)

    def parts(self, text: str) -> Iterator[str]:
        """The text with a blank before it, in parts that each begin with a blank."""
        text, lo = " " + text, 0
        while self.cuttable and len(text) - lo > PART:
            m = _CUT.search(text, lo + PART)
            if not m:
                break
            yield text[lo : m.start() + 1]
            lo = m.start() + 1
        yield text[lo:]

    def fits(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = text.encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One for each worker process."""
    if (a_path, b_path) not in _own:
        _own[a_path, b_path] = Tokenizers(a_path, b_path)
    return _own[a_path, b_path]


class _Document:
    """What the parts of one text add up to."""

    def __init__(self):
        self.counts, self.sha, self.fits, self.empty = np.zeros(4, np.int64), hashlib.sha256(), True, True
        self.regular, self.other = [], []

    def row(self) -> tuple:
        if not self.fits or self.empty:
            none = np.empty(0, np.int32)
            return (0, 0, 0, 0, "", none, none, none, none, none)
        return (*self.counts.tolist(), self.sha.hexdigest(), *(_joined(self.regular, 2)), *(_joined(self.other, 3)))


def _joined(parts: list, n: int) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]).astype(np.int32) if parts else np.empty(0, np.int32) for i in range(n)]


def _distinct(key: np.ndarray, documents: int, span: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rest, count) of the distinct keys of each document; a key is document * span + rest."""
    found, n = np.unique(key, return_counts=True)
    at = np.searchsorted(found, np.arange(documents + 1) * span)
    return [(found[lo:hi] - d * span, n[lo:hi]) for d, (lo, hi) in enumerate(zip(at[:-1], at[1:]))]


def align_parts(t: Tokenizers, parts: list[str], owner: list[int], documents: dict[int, _Document]) -> None:
    """Add the parts (of texts in order) to the documents that own them."""
    ids_a, ids_b = t.encode(parts)
    good = [i for i, p in enumerate(parts) if t.fits(p, ids_a[i], ids_b[i])]
    for i in set(range(len(parts))) - set(good):
        documents[owner[i]].fits = False
    good = [i for i in good if documents[owner[i]].fits]
    if not good:
        return
    names = list(dict.fromkeys(owner[i] for i in good))
    place = {d: k for k, d in enumerate(names)}
    of_part = np.array([place[owner[i]] for i in good])
    a, b = (np.concatenate([np.asarray(ids[i], np.int64) for i in good]) for ids in (ids_a, ids_b))
    doc_a, doc_b = (np.repeat(of_part, [len(ids[i]) for i in good]) for ids in (ids_a, ids_b))
    end_a, end_b = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    merged = np.sort(np.concatenate([end_a, end_b]), kind="stable")  # two runs in order
    again = np.append(False, merged[1:] == merged[:-1])
    ends, both = merged[~again], merged[again]
    link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)  # each stretch between two ends is a link
    group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
    in_a, in_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
    single = (in_a == 1) & (in_b == 1)
    la, lb, doc = a[link_a], b[link_b], doc_a[link_a]
    regular = single[np.searchsorted(both, ends)] & (t.same[la] == lb)
    k, va, vb = len(names), len(t.a_size), len(t.b_size)
    of_one = _distinct(doc[regular] * va + la[regular], k, va)
    of_other = _distinct((doc[~regular] * va + la[~regular]) * vb + lb[~regular], k, va * vb)
    last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = 2 * a + last_a
    order[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * va + 2 * b + last_b
    n_a, n_b = np.bincount(doc_a, minlength=k), np.bincount(doc_b, minlength=k)
    n_groups, n_links = np.bincount(doc_a[np.searchsorted(end_a, both)], minlength=k), np.bincount(doc, minlength=k)
    upto = np.concatenate([[0], np.cumsum(n_a + n_b)])
    for i, name in enumerate(names):
        d = documents[name]
        said = b"".join(t.written[order[upto[i] : upto[i + 1]]].tolist())[:-1]
        d.sha.update(said if d.empty else b";" + said)
        d.empty = False
        d.counts += (n_a[i], n_b[i], n_groups[i], n_links[i])
        if len(of_one[i][0]):
            d.regular.append(of_one[i])
        if len(of_other[i][0]):
            d.other.append((of_other[i][0] // vb, of_other[i][0] % vb, of_other[i][1]))


def encoded(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """A written row of each document: row_ (a number of its own), kept_ (its other columns), n_a, n_b, n_groups, n_links,
    groups_sha256, its distinct pairs of the identity map (reg_a, reg_n) and other pairs (irr_a, irr_b, irr_n) with how often.

    A is the byte-level BPE of a JSON file, B a sentence-piece model. Null and empty texts, and those whose tokens' bytes are
    not the text's, have no tokens. Long texts are cut where neither tokenizer spans the cut; one without such a place is
    encoded whole, and a task holds one document's pairs at a time.
    """
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.monotonically_increasing_id().alias("row_"), F.struct(*others or [F.lit(1).alias("row")]).alias("kept_"), F.col(text).alias("text"))
    schema = StructType(rows.drop("text").schema.fields).add("n_a", "long").add("n_b", "long").add("n_groups", "long").add("n_links", "long").add("groups_sha256", "string")
    for name in ("reg_a", "reg_n", "irr_a", "irr_b", "irr_n"):
        schema = schema.add(name, ArrayType(IntegerType()))

    def over(batches):
        t = tokenizers(a_path, b_path)
        for batch in batches:
            for lo, hi, texts in slices(batch):
                documents, parts, owner, size = {i: _Document() for i in range(len(texts))}, [], [], 0
                for i, x in enumerate(texts):
                    for part in t.parts(x) if x else ():
                        parts.append(part)
                        owner.append(i)
                        size += len(part)
                        if size >= 10 * PART:
                            align_parts(t, parts, owner, documents)
                            parts, owner, size = [], [], 0
                if parts:
                    align_parts(t, parts, owner, documents)
                found = list(zip(*(documents[i].row() for i in range(len(texts)))))
                own = [pa.array(v, f) for v, f in zip(found, [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int32())] * 5)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([column(part, "row_"), column(part, "kept_"), *own], schema.names)
        release()

    return durable(rows.mapInArrow(over, schema), "encoded")


def _irregular(enc: DataFrame) -> DataFrame:
    at = F.explode(F.arrays_zip("irr_a", "irr_b", "irr_n")).alias("p")
    return enc.select("row_", at).select("row_", F.col("p.irr_a").alias("a"), F.col("p.irr_b").alias("b"), F.col("p.irr_n").alias("m"))


def pair_counts(enc: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a, b, n, best) of all linked id pairs: n links of the corpus hold the pair, best if no A id has more with this b.

    Pairs of the identity map come as one vector of each task.
    """

    def vectors(batches):
        t = tokenizers(a_path, b_path)
        total = np.zeros(len(t.same), np.int64)
        for batch in batches:
            ids, n = (column(batch, c).flatten().to_numpy() for c in ("reg_a", "reg_n"))
            np.add.at(total, ids, n)
        a = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(t.same[a], pa.int32()), pa.array(total[a])], ["a", "b", "n"])

    regular = enc.select("reg_a", "reg_n").mapInArrow(vectors, "a int, b int, n long")
    both = regular.unionAll(_irregular(enc).select("a", "b", F.col("m").cast("long").alias("n")))
    pairs = durable(both.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))  # a row for each B id at most
    return pairs.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """The other columns of docs and n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair is linked as often in the corpus as any pair of its B id; count_sum: those counts over all links.
    A row for each row; repeated rows count each; an empty table gives no rows; columns named like a result give way to it.
    """
    enc = encoded(docs, a_path, b_path, text)
    pairs = durable(pair_counts(enc, a_path, b_path), "counted")
    t = tokenizers(a_path, b_path)
    identity = np.flatnonzero(t.same >= 0)
    spark = docs.sparkSession
    known = spark.createDataFrame(pa.table({"a": pa.array(identity, pa.int32()), "b": pa.array(t.same[identity], pa.int32())}))
    n, best = np.zeros(len(t.same), np.int64), np.zeros(len(t.same), bool)
    for r in pairs.join(F.broadcast(known), ["a", "b"]).toArrow().to_pylist():  # an A id's one row at most
        n[r["a"]], best[r["a"]] = r["n"], r["best"]
    often = pairs.orderBy(F.desc("n"), "a", "b").limit(FREQUENT).toArrow()
    key = column_of(often, "a") * len(t.b_size) + column_of(often, "b")
    order = np.argsort(key)
    table = spark.sparkContext.broadcast((n, best, key[order], column_of(often, "n")[order], column_of(often, "best")[order].astype(bool)))
    vb = len(t.b_size)
    results = (*COUNTS, "n_best", "count_sum", "groups_sha256")
    schema = StructType([f for f in enc.schema.fields if not f.name.startswith(("reg_", "irr_"))]).add("n_best", "long").add("count_sum", "long")
    for name in ("irr_a", "irr_b", "irr_n"):
        schema = schema.add(name, ArrayType(IntegerType()))

    def look_up(batches):
        n, best, keys, key_n, key_best = table.value
        for batch in batches:
            of = lambda c: (np.asarray(column(batch, c).value_lengths()), column(batch, c).flatten().to_numpy().astype(np.int64))
            (size, ids), (_, times) = of("reg_a"), of("reg_n")
            (size_i, ia), (_, ib), (_, im) = of("irr_a"), of("irr_b"), of("irr_n")
            row, row_i = np.repeat(np.arange(batch.num_rows), size), np.repeat(np.arange(batch.num_rows), size_i)
            total, top = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, row, times * n[ids])
            np.add.at(top, row, times * best[ids])
            want = ia * vb + ib
            at = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
            hit = keys[at] == want if len(keys) else np.zeros(len(want), bool)
            np.add.at(total, row_i[hit], im[hit] * key_n[at[hit]])
            np.add.at(top, row_i[hit], im[hit] * key_best[at[hit]])
            left = np.concatenate([[0], np.cumsum(np.bincount(row_i[~hit], minlength=batch.num_rows))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~hit].astype(np.int32))) for x in (ia, ib, im)]
            yield pa.RecordBatch.from_arrays([*(column(batch, f) for f in enc_names), pa.array(top), pa.array(total), *rest], schema.names)
        release()

    enc_names = [f.name for f in enc.schema.fields if not f.name.startswith(("reg_", "irr_"))]
    done = durable(enc.mapInArrow(look_up, schema), "looked_up")
    discard(enc)
    rare = _irregular(done).join(pairs, ["a", "b"]).groupBy("row_").agg(F.sum(F.col("m") * F.col("n")).alias("sum_"), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("top_"))
    out = done.join(rare, "row_", "left").withColumn("n_best", F.col("n_best") + F.coalesce("top_", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("sum_", F.lit(0)))
    keep = [f"kept_.{f.name}" for f in enc.schema["kept_"].dataType.fields if f.name in docs.columns and f.name not in results]
    return out.select(*keep, *results)


def column_of(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)
