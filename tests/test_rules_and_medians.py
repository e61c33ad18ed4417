"""Prefix rules of a large site and medians by counting."""

import random
import statistics

from pyspark.sql import functions as F

from tagweave.operators import catalog, evaluate
from tagweave.operators.medians import medians


def test_many_rules_of_one_site(spark):
    """A hundred thousand rules and two hundred thousand paths of one site: a row for each path and length at most."""
    rules = spark.range(100_000).select(F.lit("a").alias("site"), F.concat(F.lit("/p/"), F.col("id").cast("string"), F.lit("/")).alias("prefix"))
    urls = spark.range(200_000).select(F.lit("a").alias("site"), F.concat(F.lit("https://a.example/p/"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, "/x").otherwise("")).alias("url"))
    assert catalog.robots_filter(urls, rules).count() == 200_000 - 50_000


def test_rules_against_all_pairs(spark):
    r = random.Random(4)
    word = lambda n: "/" + "".join(r.choice("ab/") for _ in range(r.randrange(n)))
    rules = {(r.choice("xy"), word(4)) for _ in range(12)}
    urls = [(r.choice("xyz"), f"https://h.example{word(7)}") for _ in range(300)] + [("z", "https://h.example/cart/1"), ("z", "no url"), ("x", None), (None, "https://h.example/cart")]
    got = catalog.robots_filter(spark.createDataFrame(urls, "site string, url string"), spark.createDataFrame(list(rules), "site string, prefix string"))
    def stays(site, url):
        path = (url or "").removeprefix("https://h.example") if (url or "").startswith("http") else ""
        mine = [p for s, p in rules if s == site] or list(catalog.DEFAULT_DISALLOW)
        return not any(path.startswith(p) for p in mine)
    key = lambda x: (x[0] or "", x[1] or "")
    assert sorted(map(tuple, got.collect()), key=key) == sorted([u for u in urls if stays(*u)], key=key)


def test_medians(spark):
    r = random.Random(6)
    sets = {
        "odd": [r.random() for _ in range(101)], "even": [r.gauss(0, 1e6) for _ in range(64)], "ties": [1.5] * 40 + [2.5] * 39, "half": [1.0] * 10 + [3.0] * 10,
        "one": [7.0], "far": [-1.7e308, 1.7e308, 5e-324, 0.0, 1.0], "same": [0.25] * 9,
    }
    rows = [(c, x) for c, xs in sets.items() for x in xs] + [("odd", None), ("odd", float("nan")), ("none", None)]
    got = medians(spark.createDataFrame(rows, "class string, x double").cache(), "class", "x")
    assert got == {c: statistics.median(xs) for c, xs in sets.items()}


def test_verdicts_of_both_kinds(spark):
    def of(scored, other):
        rows = [(x, False) for x in scored] + [(x, True) for x in other]
        return evaluate.separability(spark.createDataFrame(rows, "score double, is_distractor boolean")).first()

    assert (of([0.9, 0.8, 0.8], [0.1, 0.2]).verdict, of([0.9, 0.8, 0.8], [0.1, 0.2]).threshold) == ("separable", 0.5)
    assert of([0.9, 0.1, 0.5], [0.4, 0.4]).verdict == "shifted"
    assert of([0.4, 0.4], [0.4, 0.4]).verdict == "not separable"
    assert of([0.4], []).median_distractor is None
