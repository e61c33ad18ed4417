"""Every query with SQL returns what the SQL returns."""

import pytest

from tagweave.plans import catalog_queries  # noqa: F401
from tagweave.plans.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    same(QUERIES[name](spark, SF).toPandas(), ORACLES[name], SF)


@pytest.mark.parametrize("name", ["g1_images_max", "g2_images_mean", "g3_images_best", "g4_images_cons2", "j3_missing_answers", "s5_item_json", "u1_new_items", "v6_hybrid_search", "v8_rank_fusion", "w5_recent_page", "x3_vocab_diff"])
def test_query_on_more_rows(spark, name):
    """Those in which ties and rounding show on larger tables alone."""
    larger = SF.replace("0.001", "0.01")
    same(QUERIES[name](spark, larger).toPandas(), ORACLES[name], larger)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
