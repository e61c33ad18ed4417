"""Long lines, and lines against the rules one by one."""

import time

import pytest

ROWS = [
    ("Home | News | About us today.", True), ("a | b", True), ("One | two is fine here.", False), ("» next page.", True), ("We use cookies here.", True),
    ("He said so.\t\r", False), ("He said \"so.\")", False), ("No end", True), ("A  |  B\x0b|\x0bC.", True), ("x::y::z.", False),
]


def test_rules(spark):
    from tagweave.llm import quality

    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ROWS)], "doc_id long, text string")
    assert [r.n_lines_removed for r in quality.clean_lines(d).orderBy("doc_id").collect()] == [int(x) for _, x in ROWS]


@pytest.mark.parametrize("line", ["x" * 1_000_000 + ".", " " * 1_000_000, " | " + "y " * 500_000, ". " * 500_000 + "z", " >" * 500_000])
def test_long_lines_take_linear_time(spark, line):
    from tagweave.llm import quality

    d = spark.createDataFrame([(1, line)], "doc_id long, text string")
    began = time.time()
    assert len(quality.clean_lines(d).collect()) == 1
    assert time.time() - began < 20
