"""Item records as a stream: each id once, the newest statistics kept, exactly once over restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time of a record, for the watermark.
TIME = "event_time"


def newest(rows: DataFrame, order: list[str], key: str = "item_id") -> DataFrame:
    """The row of each key that is last in `order`."""
    others = [c for c in rows.columns if c not in (key, *order)]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *others)).alias("m")).select(key, "m.*").select(*rows.columns)


def stream_update(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, order: list[str], files_per_batch: int = 1) -> int:
    """Read what has arrived under source and write each batch's newest rows as a part of the snapshot; return the number of
    the last part, -1 without any.

    A part's number is its batch, so a batch that runs again overwrites its own result; no batch reads or rewrites others.
    """
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def step(batch: DataFrame, number: int) -> None:
        newest(batch.select(*names), order).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    last = _parts(spark, schema, sink).agg(F.max("batch")).first()[0]
    return -1 if last is None else last


class NewestState(StatefulProcessor):
    """One value per id, its newest record; a batch gives the record of each id whose state it changes.

    `order` names the columns that tell which of two records is newer, the first of them microseconds since 1970. A state
    lives until the watermark is `keep_ms` past its record: all that comes then for the id is newer, so nothing is lost.
    """

    def __init__(self, columns: list[str], schema: StructType, order: list[str], keep_ms: int) -> None:
        self.columns, self.schema, self.keep_ms = columns, schema, keep_ms
        self.rank = [columns.index(c) for c in order]

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("newest", self.schema)

    def _newer(self, row: tuple) -> tuple:
        """The columns in order, then all others; null before any value, so that repeated ids and ties are settled alike in any order."""
        first = [row[i] for i in self.rank]
        return tuple((v is not None, v) for v in first) + tuple((v is not None, str(v)) for v in row)

    def _dies(self, row: tuple) -> int | None:
        at = row[self.rank[0]]
        return None if at is None else at // 1000 + 1 + self.keep_ms

    def handleInputRows(self, key, rows, timerValues):
        known = self.last.get()
        old = None if known is None else tuple(known)
        new = max((tuple(r[c] for c in self.columns) for r in rows), key=self._newer)
        if old is not None and self._newer(new) <= self._newer(old):
            return
        if old is not None and self._dies(old) is not None:
            self.handle.deleteTimer(self._dies(old))
        self.last.update(new)
        if self._dies(new) is not None:
            self.handle.registerTimer(self._dies(new))
        yield Row(**dict(zip(self.columns, new)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def keyed_update(
    spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, order: list[str], late: str = "7 days", keep_ms: int = 0, files_per_batch: int = 1, key: str = "item_id"
) -> int:
    """As stream_update, but each id's newest record is state of the stream, so a part holds only records that change something;
    return the number of the last part, -1 without any.

    The first column of `order` is the event's time in microseconds since 1970. Records later than `late` behind the newest one
    are dropped, so state need not be kept for ever; one without a time is older than all others and never late. State lies in the checkpoint: a restart goes on where the stream stopped.
    """
    shape = StructType.fromDDL(schema)
    columns = shape.fieldNames()
    before = spark.conf.get(STORE, None)

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    rows = spark.readStream.schema(shape).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    timed = rows.withColumn(TIME, F.timestamp_micros(F.col(order[0]).cast("long"))).withWatermark(TIME, late)
    stream = timed.groupBy(key).transformWithState(NewestState(columns, shape, order, keep_ms), shape, "Update", "EventTime")
    spark.conf.set(STORE, ROCKSDB)  # the store that keyed state needs
    try:
        stream.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
    last = _parts(spark, schema, sink).agg(F.max("batch")).first()[0]
    return -1 if last is None else last


def _parts(spark: SparkSession, schema: str, sink: str) -> DataFrame:
    there = spark._jvm.org.apache.hadoop.fs.Path(sink)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").parquet(sink)


def snapshot(spark: SparkSession, schema: str, sink: str, order: list[str]) -> DataFrame:
    """The newest row of each id over all parts."""
    return newest(_parts(spark, schema, sink).drop("batch"), order)


def compact(spark: SparkSession, schema: str, sink: str, target: str, order: list[str]) -> None:
    """The snapshot as one part of a new sink, from time to time, so that readers need not merge many parts."""
    snapshot(spark, schema, sink, order).write.parquet(f"{target}/batch=0")
