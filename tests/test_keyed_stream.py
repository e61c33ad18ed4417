"""Keyed state in the stream: restart, late rows, expiry, ties and nulls, end state as by a batch."""

import pytest

from tagweave.streaming import ingest

SCHEMA = "item_id string, at long, wish long"
HOUR = 3_600_000_000


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def update(spark, folder, **args):
    return ingest.keyed_update(spark, str(folder / "in"), SCHEMA, str(folder / "out"), str(folder / "cp"), ["at"], **args)


def rows_of(spark, folder):
    return {r.item_id: r.wish for r in ingest.snapshot(spark, SCHEMA, str(folder / "out"), ["at"]).collect()}


def test_restart_goes_on_with_its_state(spark, tmp_path):
    arrive(spark, tmp_path, [("a", 5 * HOUR, 1), ("b", HOUR, 1), ("b", 2 * HOUR, 2), (None, HOUR, 7)])
    first = update(spark, tmp_path)
    arrive(spark, tmp_path, [("a", 4 * HOUR, 9), ("b", 3 * HOUR, 3), ("a", 5 * HOUR, 1)])
    second = update(spark, tmp_path)
    assert second > first and update(spark, tmp_path) == second
    assert rows_of(spark, tmp_path) == {"a": 1, "b": 3, None: 7}
    parts = spark.read.parquet(str(tmp_path / "out"))
    # An older record of `a`, and one that it has already, changed nothing after the restart and were not written.
    assert sorted((r.item_id, r.wish) for r in parts.where(f"batch > {first}").collect()) == [("b", 3)]
    assert spark.conf.get(ingest.STORE) != ingest.ROCKSDB


def test_late_rows_are_dropped_and_state_expires(spark, tmp_path):
    arrive(spark, tmp_path, [("old", HOUR, 1), ("new", 100 * HOUR, 1)])
    update(spark, tmp_path, late="10 hours")
    arrive(spark, tmp_path, [("fresh", 101 * HOUR, 1)])
    update(spark, tmp_path, late="10 hours")
    arrive(spark, tmp_path, [("late", 2 * HOUR, 5), ("old", 102 * HOUR, 6), ("new", 95 * HOUR, 8)])
    update(spark, tmp_path, late="10 hours")
    # `late` is behind the watermark (90 hours); `old` had expired and comes back with a newer record; `new` is in time but older.
    assert rows_of(spark, tmp_path) == {"old": 6, "new": 1, "fresh": 1}


def test_ties_and_repeated_rows(spark, tmp_path):
    for rows in ([("a", HOUR, 2), ("a", HOUR, 3)], [("a", HOUR, 1), ("a", HOUR, 3), ("n", None, 4)]):
        arrive(spark, tmp_path, rows)
    update(spark, tmp_path, late="10 hours")
    assert rows_of(spark, tmp_path) == {"a": 3, "n": 4}


@pytest.mark.parametrize("files", [1, 4])
def test_same_end_as_a_batch(spark, tmp_path, files):
    rows = [(f"i{k * 7919 % 31}", (k * 104_729 % 997) * 60_000_000, k) for k in range(400)]
    for k in range(0, 400, 100):
        arrive(spark, tmp_path, rows[k : k + 100])
    update(spark, tmp_path, files_per_batch=files)
    want = {r.item_id: r.wish for r in ingest.newest(spark.createDataFrame(rows, SCHEMA), ["at"]).collect()}
    assert rows_of(spark, tmp_path) == want


def test_empty_source(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    update(spark, tmp_path)
    assert rows_of(spark, tmp_path) == {}
