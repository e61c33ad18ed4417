"""Versions of bucketed tables: small updates, cut-off ones, nothing to do."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tagweave.operators import catalog
from tagweave.sources import versions


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(folder, version):
    return sorted(p.name for p in Path(folder.removeprefix("file://"), "data", f"version={version}").glob("bucket=*"))


def test_an_update_writes_the_changed_buckets_alone(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    base = spark.range(500).select(F.col("id").cast("string").alias("item_id"), F.lit("old").alias("v"))
    assert versions.create(base, folder, 32) == 0
    assert len(files(folder, 0)) == 32 and rows(versions.read(spark, folder, base.schema)) == rows(base)
    new = spark.createDataFrame([("7", "new"), ("900", "new")], base.schema)
    gone = spark.createDataFrame([("8",), ("none",)], "item_id string")
    assert versions.update(folder, new, gone) == 1
    assert len(files(folder, 1)) <= 4
    want = rows(base.where("item_id not in ('7', '8')").unionAll(new))
    assert rows(versions.read(spark, folder, base.schema)) == want
    assert rows(versions.read(spark, folder, base.schema, 0)) == rows(base)
    assert versions.update(folder, new.where("false"), gone.where("false")) == 1
    assert versions.update(folder, new.where("false"), base.select("item_id")) == 2
    assert rows(versions.read(spark, folder, base.schema)) == [("900", "new")]


def test_an_update_that_is_cut_off_leaves_the_version_before_it(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/t"
    base = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "item_id string, v int")
    versions.create(base, folder, 4)
    new, none = spark.createDataFrame([("a", 9)], base.schema), spark.createDataFrame([], "item_id string")
    with monkeypatch.context() as m:
        m.setattr(versions, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            versions.update(folder, new, none)
    assert versions.latest(spark, folder) == 0 and rows(versions.read(spark, folder, base.schema)) == rows(base)
    assert versions.update(folder, new, none) == 1
    assert rows(versions.read(spark, folder, base.schema)) == [("a", 9), ("b", 2), ("b", 3)]


def test_nothing_to_do_writes_nothing(spark, tmp_path):
    table = spark.createDataFrame([("1", "x")], "item_id string, name string")
    empty = {n: table.where("false") for n in ("new_t", "gone")}
    folder = f"file://{tmp_path}/t"
    versions.create(table, folder, 2)
    idle = catalog.changes(table.where("false"), table.where("false"), table.where("false"))
    assert catalog.write_update(empty | {"changed": idle}, {"t": folder}) == {"t": 0}


def test_catalog_rows_come_whole(spark):
    known = spark.createDataFrame([("1", "one", 5), ("2", "two", None)], "item_id string, name string, price int")
    listing = spark.createDataFrame([("3", 1, 0, "three"), ("1", 1, 1, "other"), ("2", 2, 0, "two")], "item_id string, page int, pos int, name string")
    stats = spark.createDataFrame([("1", 4, "2020"), ("2", 1, "2021")], "item_id string, wish int, checked_at string")
    fetched = spark.createDataFrame([("3", 200, 7, "now"), ("1", 404, None, None)], "item_id string, status int, wish int, checked_at string")
    v = spark.createDataFrame([("1", "t", 0.5)], "item_id string, tag string, conf double")
    scores = spark.createDataFrame([("3", "t", 0.7)], "item_id string, tag string, score double")
    vocab = spark.createDataFrame([("t",)], "tag string")
    done = catalog.run_update(known, v, v, stats, listing, scores, fetched, vocab)
    assert rows(done["catalog"]) == [("2", "two", None), ("3", "three", None)]
    assert rows(done["new_catalog"]) == [("3", "three", None)] and rows(done["gone"]) == [("1",)] and rows(done["new_stats"]) == [("3", 7, "now")]
