"""Automata against plain containment, long tokens, keywords."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagweave.functions.fields import normal_form, normalize_ja
from tagweave.operators import browse, entities, keywords, resolve, substrings

few = st.text(alphabet="abc", min_size=1, max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(few, max_size=8), few)
def test_automata(terms, token):
    known = [(t, (len(t), t)) for t in terms]
    least = lambda found: min(((len(t), t) for t in found), default=None)
    assert substrings.Within(known).find(token) == least(t for t in terms if t in token)
    assert substrings.Around(known).find(token) == least(t for t in terms if token in t)


def test_blocks(spark, monkeypatch):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(1, 9)))
    terms, tokens = {word() for _ in range(60)}, {word() for _ in range(200)}
    monkeypatch.setattr(substrings, "TERM_CHARS", 50)
    monkeypatch.setattr(substrings, "TOKEN_CHARS", 200)
    frame = lambda x, c: spark.createDataFrame([(w, w) for w in x], f"{c} string, form string")
    got = {r.token: r.term for r in substrings.shortest_within(frame(tokens, "token"), frame(terms, "term")).collect()}
    want = {t: min((len(x), x) for x in terms if x in t or t in x)[1] for t in tokens if any(x in t or t in x for x in terms)}
    assert got == want


def test_tokens_of_a_hundred_thousand_characters(spark):
    long = "x" * 50_000 + "bob" + "y" * 50_000
    vocab = spark.createDataFrame([("bob",), ("long_hair",), ("b" * 20_000,)], "tag string")
    syn = spark.createDataFrame([("ロング", "long_hair", 1)], "surface string, tag string, ord int")
    combos = spark.createDataFrame([("pre", "bob", "pre_bob")], "prefix string, base string, tag string")
    tokens = spark.createDataFrame([(long,), ("z" * 100_000,), ("b" * 19_000,), ("hair",)], "token string")
    got = {r.token: r.tag for r in resolve.resolve_tags(tokens, vocab, syn, combos).collect()}
    assert got == {long: "bob", "z" * 100_000: None, "b" * 19_000: "b" * 20_000, "hair": "long_hair"}
    none = spark.createDataFrame([], "surface string, canonical string")
    known = spark.createDataFrame([("Bob",), ("Shinano",)], "name string")
    assert {r.text: r.name for r in entities.resolve_avatars(tokens.select(F.col("token").alias("text")), none, known).collect()}[long] == "Bob"


def test_keywords_are_normalised(spark):
    items = spark.createDataFrame([("1", "ボブ", ["Tag"], None), ("2", "abc", None, "長い ABC"), ("3", None, [], "三つ編み")], "item_id string, name string, tags array<string>, description string")
    norm = items.select("item_id", normalize_ja(F.col("name")).alias("name"), F.when(F.col("item_id") == "1", F.array(F.lit("tag"))).alias("tags"), normalize_ja(F.col("description")).alias("description"))
    typed = ["ぼぶ", "ＢＣ", "みつあみ", "tag", "ａｂｃ", "b", "zz", "い ａ"]
    want = {"ぼぶ": "1", "ＢＣ": "2", "みつあみ": "3", "tag": "1", "ａｂｃ": "2", "b": "2", "い ａ": "2"}
    assert all(normal_form(k) == spark.range(1).select(normalize_ja(F.lit(k))).first()[0] for k in typed)
    assert {k: r.item_id for k in typed for r in browse.keyword_hit(norm, k).collect()} == want
    texts = keywords.fields(items).cache()
    requests = spark.createDataFrame([(k,) for k in [*typed, "", None, " "]], "keyword string")
    found = keywords.hits(requests, keywords.postings(texts).cache(), texts)
    assert {r.keyword: r.item_id for r in found.collect()} == want


def test_merged_entries_come_last(spark):
    """A new surface of the same normal form wins over an old one, whatever the places."""
    base = spark.createDataFrame([("ぼぶ", "old", 2_000_000)], "surface string, tag string, ord long")
    over = spark.createDataFrame([("ボブ", "new", 0)], "surface string, tag string, ord long")
    merged, _ = resolve.merge_synonyms(base, over)
    assert [r.tag for r in resolve.synonym_index(merged).collect()] == ["new"]
    empty = base.where("false")
    assert [(r.surface, r.ord) for r in resolve.merge_synonyms(empty, over)[0].collect()] == [("ボブ", 0)]
