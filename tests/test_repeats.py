"""Queries over tables in which rows repeat what others say."""

from pathlib import Path

from tagweave.plans import catalog_queries  # noqa: F401
from tagweave.plans.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle import TABLES, same


def with_table(spark, folder: Path, name: str, make) -> str:
    """A folder with the given tables, of which one is make(it)."""
    for t in TABLES:
        if t != name:
            (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    make(spark.read.parquet(f"{SF}/{name}.parquet")).toPandas().to_parquet(folder / f"{name}.parquet", index=False)
    return str(folder)


def test_robots_keeps_repeated_urls(spark, tmp_path):
    """A URL that stands on several pages comes out as often, as the SQL has it."""
    d = with_table(spark, tmp_path, "pages", lambda df: df.unionAll(df.where("page_id % 2 = 0").selectExpr("page_id + 1000 AS page_id", "url", "html")))
    same(QUERIES["p11_robots"](spark, d).toPandas(), ORACLES["p11_robots"], d)
