"""Tables cut out of the lineage, and Arrow maps over batches of rows."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that are worked on at once: work arrays are some tens of times as large.
SLICE_BYTES = 500_000
#: Bytes of an Arrow batch of texts, by bounded_batches(). Spark's own bounds are 10,000 rows and 64 MB.
BATCH_BYTES = 2_000_000
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_own_folder: list[str] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where none is set and the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="tagweave-"))
    return _own_folder[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later steps survive lost executors without recomputing it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that durable() wrote, once all that is read from them is written itself."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, text): all columns of docs in one struct, beside which an operator's own columns cannot clash with them."""
    return docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))


def unpacked(df: DataFrame, results: list[str]) -> DataFrame:
    """The columns within `row`, then the results; a column with the name of a result, in any case, is replaced."""
    names = {r.lower() for r in results}
    own = [F.col("row").getField(f.name).alias(f.name) for f in df.schema["row"].dataType if f.name.lower() not in names]
    return df.select(*own, *results)


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks and serve other operators' tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have about BATCH_BYTES each, or one longer row: a batch stands in the executor's
    direct memory and in the worker, whole, beside the slice that is worked on. A bound that is set already stays. Frames
    run after the caller has returned, so the setting is not taken back."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def map_arrow(df: DataFrame, fn, schema: str | StructType, **args) -> DataFrame:
    """fn(batch, **args) -> RecordBatch for each Arrow batch of df."""

    def over(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch, **args)
        release()

    return df.mapInArrow(over, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Strings of a column, null as the empty text."""
    return [t or "" for t in column(batch, name).to_pylist()]


def cuts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(from, to) ranges of rows whose sizes add up to about limit; a larger row stands alone."""
    upto, lo = np.cumsum(sizes), 0
    while lo < len(upto):
        before = int(upto[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + limit, side="right")))
        yield lo, hi
        lo = hi


def sizes_of(batch: pa.RecordBatch, name: str = "text") -> np.ndarray:
    """Bytes of each string of a column."""
    return pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES, name: str = "text") -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, texts) of runs of rows with about limit bytes of text each; only one run's texts are strings at a time."""
    for lo, hi in cuts(sizes_of(batch, name), limit):
        yield lo, hi, texts_of(batch.slice(lo, hi - lo), name)
