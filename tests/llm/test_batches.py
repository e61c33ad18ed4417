"""What the pipeline's stages send to Python workers at a time."""

import pyarrow as pa
import pytest

from tests.conftest import SF

STAGES = ["toxicity", "minhash", "decontamination", "mixing", "token_frames"]


def largest(spark) -> tuple[int, int]:
    """(bytes of the largest Arrow batch, rows) of 3,000 texts of 5,000 characters each in one partition."""

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "n"])

    got = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('a word ', 714) as text").mapInArrow(size, "bytes long, n long").collect()
    return max(r["bytes"] for r in got), sum(r["n"] for r in got)


@pytest.fixture
def unset(spark):
    from tagweave.llm.shared import BATCH_SETTING

    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.unset(BATCH_SETTING)
    yield BATCH_SETTING
    spark.conf.unset(BATCH_SETTING) if before is None else spark.conf.set(BATCH_SETTING, before)


@pytest.mark.parametrize("name", STAGES)
def test_stage_bounds_its_batches(spark, unset, name):
    import corpus_pipeline
    from tagweave.llm.shared import BATCH_BYTES

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    most, n = largest(spark)
    assert n == 3000
    assert most <= BATCH_BYTES + 10_000


def test_a_bound_that_is_set_stays(spark, unset):
    from tagweave.llm.shared import bounded_batches

    spark.conf.set(unset, "500000")
    bounded_batches(spark)
    assert spark.conf.get(unset) == "500000"


def test_room_of_sources_needs_no_python_rows(spark):
    from tagweave.llm import mixing

    table = spark.createDataFrame([("a", 900, 1100.0), ("b", 400, 200.0)], "source string, source_size long, target double")
    plan = mixing.taken_blocks(table.coalesce(1), slots=16)
    assert "ExistingRDD" not in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == round(1100 * 29 / 900 + 200 * 13 / 400)
