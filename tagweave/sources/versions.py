"""Tables in buckets by id, of which an update writes only those with a changed id.

A version is a manifest: for each bucket, the version that wrote it last and its rows. Data of a version is under
data/version=N/bucket=B; its manifest, under manifest/version=N, is written last, so an update that is cut off leaves the
version before it, and one that runs again writes over what it left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tagweave.sources.scratch import written

BUCKETS = 64
KEY = "item_id"


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def latest(spark: SparkSession, folder: str) -> int:
    """The number of the last whole version, -1 without any."""
    fs, there = _fs(spark, f"{folder}/manifest")
    if not fs.exists(there):
        return -1
    names = [str(s.getPath().getName()) for s in fs.listStatus(there)]
    done = [int(n.removeprefix("version=")) for n in names if n.startswith("version=") and fs.exists(_fs(spark, f"{folder}/manifest/{n}/_SUCCESS")[1])]
    return max(done, default=-1)


def _manifest(spark: SparkSession, folder: str, version: int) -> dict[int, tuple[int, int]]:
    """bucket -> (version, rows): a row for each bucket."""
    rows = spark.read.schema("bucket int, written int, n long").parquet(f"{folder}/manifest/version={version}").collect()
    return {r["bucket"]: (r["written"], r["n"]) for r in rows}


def _commit(spark: SparkSession, folder: str, version: int, manifest: dict[int, tuple[int, int]]) -> int:
    rows = [(b, *v) for b, v in sorted(manifest.items())]
    spark.createDataFrame(rows, "bucket int, written int, n long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={version}")
    return version


def _with_bucket(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("bucket", IntegerType())])


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int")


def _write(df: DataFrame, folder: str, version: int, buckets: int) -> dict[int, tuple[int, int]]:
    """Write df as a version's data, each bucket sorted by id, and count its rows."""
    path = f"{folder}/data/version={version}"
    dealt = df.withColumn("bucket", _bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket", KEY)
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)
    there = df.sparkSession.read.schema(_with_bucket(df.schema)).parquet(path)
    return {r["bucket"]: (version, r["count"]) for r in there.groupBy("bucket").count().collect()}


def create(df: DataFrame, folder: str, buckets: int = BUCKETS) -> int:
    """df (with item_id, not null) as version 0 of the table under folder."""
    manifest = _write(df, folder, 0, buckets)
    return _commit(df.sparkSession, folder, 0, {b: manifest.get(b, (0, 0)) for b in range(buckets)})


def read(spark: SparkSession, folder: str, schema: StructType, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a version (the last one, if not given), or of some buckets of it."""
    version = latest(spark, folder) if version is None else version
    if version < 0:
        return spark.createDataFrame([], schema)
    by: dict[int, list[int]] = {}
    for b, (v, n) in _manifest(spark, folder, version).items():
        if n and (buckets is None or b in buckets):
            by.setdefault(v, []).append(b)
    out = None
    for v, own in by.items():
        part = spark.read.schema(_with_bucket(schema)).option("basePath", f"{folder}/data/version={v}").parquet(*[f"{folder}/data/version={v}/bucket={b}" for b in own]).drop("bucket")
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], schema) if out is None else out


def update(folder: str, new: DataFrame, gone: DataFrame) -> int:
    """A version in which the rows of new take the place of those with their ids, and those of gone (item_id) are left out.

    Only buckets that hold such an id are read and written; the manifest names the others where they are. Without a change
    there is no new version. What comes to the driver is a number for each bucket.
    """
    spark = new.sparkSession
    now = latest(spark, folder)
    manifest = _manifest(spark, folder, now)
    new = written(new, "new")
    ids = written(new.select(KEY).unionAll(gone.select(KEY)).distinct(), "ids")
    touched = [r[0] for r in ids.select(_bucket(len(manifest)).alias("b")).distinct().collect()]
    if not touched:
        return now
    kept = read(spark, folder, new.schema, now, touched).join(ids, KEY, "left_anti")
    found = _write(kept.select(new.columns).unionByName(new), folder, now + 1, len(manifest))
    return _commit(spark, folder, now + 1, manifest | {b: found.get(b, (now + 1, 0)) for b in touched})
