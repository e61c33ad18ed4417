"""Columns of the given tables may have any name, those of helpers and results of the operators included."""

import pytest

TEXT = "He said that the old house by the river was sold. She did not know who had bought it. Nobody told them the price."
ROWS = [(1, TEXT, "a", len(TEXT)), (2, TEXT, "b", len(TEXT)), (3, "Some other text stands here, and it has a few words.", None, 52), (4, None, "a", 0)]
HELPERS = "row key id of hash text_key text_key_ size size_ pieces pieces_ source_ found_id found_id_ found_key long_ short_ item_id at epoch".split()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the old house by the river was sold yesterday at noon")], "item_id long, text string")


@pytest.mark.parametrize("name", ["identify", "contaminated", "keep_clean", "mix_documents"])
def test_any_column_passes(spark, bench, name):
    from pyspark.sql import functions as F

    from tagweave.llm import decontaminate, language, mixing

    run, results, n = {
        "identify": (lambda d: language.identify(d, language.train(d.selectExpr("text", "'en' as lang")), d.columns), language.RESULTS, 4),
        "contaminated": (lambda d: decontaminate.contaminated(d, bench), decontaminate.RESULTS, 4),
        "keep_clean": (lambda d: decontaminate.keep_clean(d, bench), [], 2),
        "mix_documents": (mixing.mix_documents, [], None),
    }[name]
    extra = sorted({*HELPERS, *decontaminate.RESULTS, *language.RESULTS})
    d = spark.createDataFrame(ROWS, "doc_id long, text string, source string, n_chars long")
    d = d.select("*", *[F.concat(F.lit(x), F.col("doc_id").cast("string")).alias(x) for x in extra])
    out = run(d)
    assert sorted(out.columns) == sorted({*d.columns, *results})
    got = out.collect()
    assert got and (n is None or len(got) == n)
    for row in got:
        for x in set(extra) - set(results):
            assert row[x] == f"{x}{row.doc_id}", x
