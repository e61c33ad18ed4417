"""Token ids in binary shards: independent Zstandard frames, per-frame checksums and a trailing seek table.

A shard file is a sequence of frames, an index and a seek table, all readable by ordinary Zstandard tools:

  frame ...       each an independent Zstandard frame; its content is ids as little-endian unsigned 32-bit integers
  index           a skippable frame (magic 0x184D2A50) with one entry of four little-endian 64-bit integers a document:
                  doc_id (0 if null), 1 if doc_id is null, ids of all documents before it in the shard, its own ids
  seek table      a skippable frame (magic 0x184D2A5E) as in the published seekable format: for each frame its compressed
                  size, its content's size and the low 32 bits of the XXH64 of its content; then the number of frames,
                  a descriptor byte (0x80: checksums) and the magic 0x8F92EAB1. The index counts as a frame without content.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.llm.shared import new_path, release, slices

FRAME_BYTES = 1 << 20
#: Words that a worker keeps with their ids before it begins anew.
CACHE = 150_000
#: Characters of a shard, at least and at most, and the number of shards up to which they stay at the least.
SHARD_CHARS, MOST_SHARD_CHARS, SHARDS = 16_000_000, 1_000_000_000, 4096
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them, with each distinct word encoded once.

    Valid for byte-level tokenizers that normalise by NFC and then lower case, drop white space and treat the parts of
    PARTS one by one, as word_bpe_49k.json does: a part goes to the library's model alone. A text goes to the library
    whole if it holds what could read differently by the word: the start of a special token, a letter whose lower case
    depends on its place, control characters that only Python takes for white space, or characters on which the Unicode
    versions of the library and of Python differ.
    """

    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    ASCII_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"
    ODD = ("<|", "Σ", "İ", "\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, path: str, most: int = CACHE):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.tokenize = self.whole.model.tokenize
        self.parts, self.ascii_parts = regex.compile(self.PARTS), re.compile(self.ASCII_PARTS)
        self.letters = byte_letters()
        self.most = most
        self.known: dict[str, bytes] = {}
        self.checked: set[str] = set()
        self.odd: set[str] = set(self.ODD)

    def _lettered(self, part: str) -> str:
        return part if part.isascii() and part.isprintable() else "".join([self.letters[b] for b in part.encode()])

    def _part(self, part: str) -> bytes:
        out = self.known[part] = array("I", [t.id for t in self.tokenize(self._lettered(part))]).tobytes()
        return out

    def _check(self, new: set[str]) -> None:
        """Note characters that the library's Unicode version splits or lowers otherwise than Python's."""
        for c in new:
            text = f"a{c}{c}a !{c}! a\u0301{c}\u0323"
            own = [self._lettered(p) for w in unicodedata.normalize("NFC", text).lower().split() for p in self.parts.findall(w)]
            if own != [p for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(text))]:
                self.odd.add(c)
        self.checked |= new

    def _learn(self, new: set[str]) -> None:
        known = self.known
        for word in new:
            if word.isalpha():
                self._part(word)
            else:
                parts = (self.ascii_parts if word.isascii() else self.parts).findall(word)
                known[word] = b"".join([known.get(p) or self._part(p) for p in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain, words = [], []
        for i, text in enumerate(texts):
            if not text.isascii() and (new := set(text) - self.checked):
                self._check(new)
            if any(x in text for x in (self.ODD if text.isascii() else self.odd)):
                out[i] = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                plain.append(i)
                words.append((text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split())
        if len(self.known) > self.most:
            self.known = {}
        self._learn(set(chain.from_iterable(words)) - self.known.keys())
        ids = self.known.__getitem__
        for i, w in zip(plain, words):
            out[i] = b"".join(map(ids, w))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, whose cache serves all of its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; close() gives (documents, ids). Nothing is visible under the final name before close()."""

    def __init__(self, uri: str, attempt: str, frame_bytes: int = FRAME_BYTES):
        self.fs, self.path = _store(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{attempt}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.frame_bytes, self.pending, self.size = frame_bytes, [], 0
        self.frames: list[tuple[int, int, int]] = []
        self.index = array("q")
        self.ids = 0
        self.pack = zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index.extend((doc_id or 0, int(doc_id is None), self.ids, len(ids) // 4))
        self.ids += len(ids) // 4
        self.pending.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        data = b"".join(self.pending)
        for lo in range(0, len(data), self.frame_bytes):
            part = data[lo : lo + self.frame_bytes]
            packed = self.pack.compress(part)
            self.out.write(packed)
            self.frames.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.pending, self.size = [], 0

    def close(self) -> tuple[int, int]:
        self._flush()
        index = np.array(self.index, "<i8").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.frames.append((8 + len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return len(self.index) // 4, self.ids


class ShardReader:
    """Reads documents of a shard by position, decompressing only the frames they lie in and checking each frame."""

    def __init__(self, uri: str):
        fs, path = _store(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError(f"{uri} has no seek table")
        table = np.frombuffer(self.file.read_at(12 * count, size - 9 - 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.content = np.concatenate([[0], np.cumsum(table[:, 1])])
        self.sums = table[:, 2]
        magic, length = struct.unpack("<II", self.file.read_at(8, int(self.at[-2])))
        if magic != SKIPPABLE_INDEX:
            raise ValueError(f"{uri} has no index")
        self.index = np.frombuffer(self.file.read_at(length, int(self.at[-2]) + 8), "<i8").reshape(-1, 4)
        self.unpack = zstandard.ZstdDecompressor()
        self.held = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            data = self.unpack.decompress(self.file.read_at(int(self.at[k + 1] - self.at[k]), int(self.at[k])))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k] or len(data) != self.content[k + 1] - self.content[k]:
                raise ValueError(f"frame {k} is damaged")
            self.held = (k, data)
        return self.held[1]

    def ids(self, i: int) -> bytes:
        lo, hi = int(self.index[i, 2]) * 4, int(self.index[i, 2] + self.index[i, 3]) * 4
        out, k = [], int(np.searchsorted(self.content, lo, side="right")) - 1
        while lo < hi:
            to = min(hi, int(self.content[k + 1]))
            out.append(self.frame(k)[lo - int(self.content[k]) : to - int(self.content[k])])
            lo, k = to, k + 1
        return b"".join(out)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, shards: int | None = None, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write documents in ascending doc_id order (null first) as shards under folder; return (shard, uri, documents, ids).

    Without `shards`, their number follows from the texts' size. Null texts are empty; each document ends with end_id. Documents of one doc_id follow in the order of their texts.
    An empty table gives no shards. A task that runs again writes the same bytes under the same name.
    """
    if shards is None:
        chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
        shards = max(1, -(-chars // min(MOST_SHARD_CHARS, max(SHARD_CHARS, chars // SHARDS))))
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    )

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        encode, writer = encoder(tokenizer), None
        end = struct.pack("<I", end_id)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if writer is None:
                uri = f"{folder}/shard-{task.partitionId():06d}.ids.zst"
                writer = ShardWriter(uri, f"part-{task.taskAttemptId()}")
            for lo, hi, texts in slices(batch, 2_000_000):
                for i, ids in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), encode.encode(texts)):
                    writer.add(i, ids + end)
        if writer is not None:
            documents, count = writer.close()
            release()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([uri]), pa.array([documents]), pa.array([count])], ["shard", "uri", "documents", "ids"])

    return ordered.mapInArrow(write, "shard int, uri string, documents long, ids long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(shard, doc_id, start_in_shard, n_tokens, ids_crc32, ids as bytes are checked but not returned) of all documents."""

    def read(batches):
        for batch in batches:
            for shard, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                r = ShardReader(uri)
                for lo in range(0, len(r.index), 20_000):
                    part = r.index[lo : lo + 20_000]
                    crc = [zlib.crc32(r.ids(i)) for i in range(lo, lo + len(part))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), shard, np.int32)), pa.array(part[:, 0], mask=part[:, 1] == 1), pa.array(part[:, 2]), pa.array(part[:, 3]), pa.array(crc, pa.int64())],
                        ["shard", "doc_id", "start_in_shard", "n_tokens", "ids_crc32"],
                    )

    spread = manifest.select("shard", "uri").repartitionByRange(max(1, manifest.count()), "shard")
    return spread.mapInArrow(read, "shard int, doc_id long, start_in_shard long, n_tokens long, ids_crc32 long")


def tokenised(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write docs, read the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard.

    The manifest has one row per shard; it is written before anything is read, and its running sum gives each shard's start.
    """
    folder = folder or new_path(spark, "ids")
    path = new_path(spark, "manifest")
    written = write_shards(docs, tokenizer, folder)
    written.write.parquet(path)
    manifest = spark.read.schema(written.schema).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = manifest.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return read_shards(manifest).join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32", "shard")
