"""Large JSON files, one array or one object each, read by byte ranges in many tasks.

Whether a byte is inside a string, and how deep it is nested, depends on all bytes before it. So a first pass tells of each
range what it changes, for both answers to "does it begin inside a string"; sums over a file's ranges give each range's
beginning, and a second pass cuts out the elements that begin in it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.sources.scratch import written

RANGE = 8_000_000
_OPEN, _CLOSE, _QUOTE, _SLASH, _COMMA = (np.frombuffer(x, np.uint8) for x in (b"[{", b"]}", b'"', b"\\", b","))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, size) of a file, or of the files of a folder; a missing path gives no rows. Names come from the driver's listing."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    if fs.exists(there):
        for s in fs.listStatus(there):
            if s.isFile() and not s.getPath().getName().startswith(("_", ".")):
                found.append((str(s.getPath().toString()), int(s.getLen())))
    return spark.createDataFrame(found, "file string, size long")


def _source(file: str) -> pa.NativeFile:
    fs, name = pafs.FileSystem.from_uri("file://" + file.removeprefix("file:") if file.startswith("file:/") and not file.startswith("file:///") else file)
    return fs.open_input_file(name)


def _quotes(data: np.ndarray, before: int) -> np.ndarray:
    """Which bytes are quotes that begin or end a string; `before` backslashes stand before the data."""
    slash = data == _SLASH
    at = np.arange(len(data))
    last = np.maximum.accumulate(np.where(slash, -1 - before, at)) if len(data) else at
    run = np.append(before, at - np.where(last < 0, -1 - before, last))[: len(data)]  # backslashes right before each byte
    return (data == _QUOTE) & (run % 2 == 0)


def _backslashes(source: pa.NativeFile, lo: int) -> int:
    """How many backslashes end at lo."""
    n, step = 0, 64
    while lo > 0:
        part = source.read_at(min(step, lo), lo - min(step, lo))
        n += len(part) - len(part.rstrip(b"\\"))
        if part.rstrip(b"\\"):
            return n
        lo, step = lo - len(part), 2 * step
    return n


def _scan(source: pa.NativeFile, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, quotes before each byte, nesting change of each byte as if it were outside strings)."""
    data = np.frombuffer(source.read_at(hi - lo, lo), np.uint8)
    quote = _quotes(data, _backslashes(source, lo))
    seen = np.cumsum(quote, dtype=np.int32)
    step = np.isin(data, _OPEN).astype(np.int8) - np.isin(data, _CLOSE).astype(np.int8)
    return data, seen, step


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], []]
        for file, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(3))):
            _, seen, step = _scan(_source(file), lo, hi)
            out[0].append(int(seen[-1]))
            for inside in (0, 1):
                out[1 + inside].append(int(step[(seen + inside) % 2 == 0].sum(dtype=np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, pa.int64()) for x in out)], ["file", "lo", "hi", "quotes", "outer", "inner"])


def _marks(source: pa.NativeFile, lo: int, hi: int, inside: int, depth: int) -> tuple[list[tuple[int, bool]], int, int]:
    """Places where an element of the outermost container begins (after them) or just ends, and the state at hi."""
    data, seen, step = _scan(source, lo, hi)
    out = (seen + inside) % 2 == 0
    deep = depth + np.cumsum(np.where(out, step, 0), dtype=np.int64)
    first = out & (step > 0) & (deep == 1)
    comma = out & (data == _COMMA) & (deep == 1)
    last = out & (step < 0) & (deep == 0)
    at = np.flatnonzero(first | comma | last)
    return [(lo + int(i), not last[i]) for i in at], (inside + int(seen[-1])) % 2 if len(seen) else inside, int(deep[-1]) if len(deep) else depth


def _cut_out(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, lo, hi, end, inside, depth in zip(*(batch.column(i).to_pylist() for i in range(6))):
            source = _source(file)
            marks, inside, depth = _marks(source, lo, hi, inside, depth)
            at = hi
            while marks and marks[-1][1] and at < end:  # the last element goes on in the next ranges
                more, inside, depth = _marks(source, at, min(end, at + size), inside, depth)
                at = min(end, at + size)
                marks += more[:1]
                if more:
                    break
            begins = [(p + 1, q) for (p, starts), (q, _) in zip(marks, marks[1:]) if starts and p < hi]
            rows = [(b, t) for b, t in ((b, source.read_at(q - b, b).decode("utf-8", "replace").strip()) for b, q in begins) if t]
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array([b for b, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["file", "at", "element"])


def elements(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, at, element): the text of each element of the outermost array or object of each file, with its place in bytes.

    A range is one task's read of `size` bytes, or up to the end of the element that begins last in it. A file that breaks off
    gives the elements that are whole; a missing path and empty files give none.
    """
    at = F.explode(F.expr(f"sequence(0L, size - 1, {size}L)")).alias("lo")
    ranges = files(spark, path).where("size > 0").select("file", at, "size").select("file", "lo", F.least(F.col("lo") + size, "size").alias("hi"), "size")
    told = written(ranges.select("file", "lo", "hi").repartition("file", "lo").mapInArrow(_summaries, "file string, lo long, hi long, quotes long, outer long, inner long"), "ranges")
    before = Window.partitionBy("file").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a file
    told = told.withColumn("inside", F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)))
    told = told.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside") == 0, F.col("outer")).otherwise(F.col("inner"))).over(before), F.lit(0)))
    whole = told.join(ranges.select("file", "lo", "size"), ["file", "lo"]).select("file", "lo", "hi", "size", "inside", "depth")
    return whole.repartition("file", "lo").mapInArrow(lambda b: _cut_out(b, size), "file string, at long, element string")


def entries(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, at, key, value): elements() of objects, as their key and the text of their value; of equal keys of one file all."""

    def split(batches):
        for batch in batches:
            rows = []
            for file, at, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    key, upto = json.JSONDecoder().raw_decode(text)
                except ValueError:
                    continue
                rest = text[upto:].lstrip()
                if isinstance(key, str) and rest.startswith(":"):
                    rows.append((file, at, key, rest[1:].strip()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], ["file", "at", "key", "value"])

    return elements(spark, path, size).mapInArrow(split, "file string, at long, key string, value string")


def last_entries(spark: SparkSession, path: str, kind: str, size: int = RANGE) -> DataFrame:
    """(item_id, v) of objects {item_id: value}: values of the type `kind`; of one file's equal keys the last counts."""
    last = entries(spark, path, size).groupBy("file", "key").agg(F.max_by("value", "at").alias("value"))
    return last.select(F.col("key").alias("item_id"), F.from_json("value", kind).alias("v")).where("v is not null")
