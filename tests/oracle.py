"""Compare a Spark result with DuckDB's for the same tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) or type(v).__module__ == "numpy" and not hasattr(v, "__len__") else list(v) if hasattr(v, "tolist") else v
    return sorted(repr([None if v is None or v is pd.NA or isinstance(v, float) and v != v else plain(v) for v in r]) for r in frame.values.tolist())


def duck(sql: str, sf_dir: str) -> pd.DataFrame:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c.sql(sql).df()


def same(spark_frame: pd.DataFrame, sql: str, sf_dir: str) -> None:
    want = duck(sql, sf_dir)
    assert sorted(spark_frame.columns) == sorted(want.columns)
    assert rows(spark_frame) == rows(want)
