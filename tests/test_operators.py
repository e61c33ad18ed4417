"""Small cases: empty vectors, ties, edges, files, streams."""

import json

import pytest

from tagweave.functions import fields
from tagweave.operators import browse, catalog, entities, evaluate, resolve, search, vectors
from tagweave.sources import readers
from tagweave.streaming import ingest
from pyspark.sql import functions as F


def test_empty_vector_counts_and_scores_zero(spark):
    v = spark.createDataFrame([("a", "x", 0.5), ("b", "y", 0.2)], "item_id string, tag string, conf double")
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    vocab = spark.createDataFrame([("x",), ("y",), ("z",)], "tag string")
    df = {r.tag: r.df for r in vectors.doc_freq(v, vocab).collect()}
    assert df == {"x": 1, "y": 1, "z": 0}
    w = vectors.idf(vectors.doc_freq(v, vocab), items)
    q = spark.createDataFrame([("q", "x", 1.0)], "query_id string, tag string, conf double")
    scores = search.with_first_items(search.cosine_scores(q, v, w), q, items, 3)
    got = {r.item_id: r.score for r in scores.collect()}
    assert got["a"] == pytest.approx(1) and got["b"] == 0 and got["c"] == 0
    top = [r.item_id for r in search.top_k(scores, 3).orderBy("rank").collect()]
    assert top == ["a", "b", "c"]


def test_images_without_tags_count(spark):
    tags = spark.createDataFrame([("i", 1, "x", 0.8), ("j", 1, "x", 0.3)], "item_id string, image_no int, tag string, conf double")
    images = spark.createDataFrame([("i", 1), ("i", 2), ("j", 1)], "item_id string, image_no int")
    conf = lambda how: {r.item_id: r.conf for r in vectors.aggregate_images(tags, images, how).collect()}
    assert conf("mean") == {"i": 0.4, "j": 0.3}
    assert conf("cons2") == {"j": 0.3}
    assert conf("max") == conf("best") == {"i": 0.8, "j": 0.3}


def test_prices_and_text(spark):
    df = spark.createDataFrame([("¥ 1,000 - 2,000",), ("",), (None,), ("0",)], "t string")
    assert [r[0] for r in df.select(fields.parse_price(F.col("t"))).collect()] == [1000, None, None, 0]
    df = spark.createDataFrame([("ＢＯＢ",), (" みつあみ ",), (None,)], "t string")
    assert [r[0] for r in df.select(fields.normalize_ja(F.col("t"))).collect()] == ["bob", "三ツ編ミ", ""]
    df = spark.createDataFrame([("a　\r\n b ",)], "t string")
    assert df.select(fields.strip_desc(F.col("t"))).first()[0] == "a b"


def test_resolution_stages(spark):
    vocab = spark.createDataFrame([(t,) for t in ("twintails", "braid", "twin_braids", "long_hair", "bob_cut")], "tag string")
    syn = spark.createDataFrame([("ツインテ", "twintails", 1), ("三つ編み", "braid", 2)], "surface string, tag string, ord int")
    combos = spark.createDataFrame([("ツイン", "braid", "twin_braids")], "prefix string, base string, tag string")
    tokens = spark.createDataFrame([(t,) for t in ("braid", "ツインテ", "みつあみ", "ツインみつあみ", "long hair", "bob", "zzz", " ")], "token string")
    got = {r.token: r.tag for r in resolve.resolve_tags(tokens, vocab, syn, combos).collect()}
    assert got == {"braid": "braid", "ツインテ": "twintails", "みつあみ": "braid", "ツインみつあみ": "twin_braids", "long hair": "long_hair", "bob": "bob_cut", "zzz": None, " ": None}
    requests = spark.createDataFrame([(1, ["zzz", "bob", "みつあみ", "braid"])], "request_id int, tokens array<string>")
    r = resolve.resolve_lists(requests, spark.createDataFrame(list(got.items()), "token string, tag string")).first()
    assert (r.tags, r.unresolved, r.notes) == (["bob_cut", "braid"], ["zzz"], ["bob→bob_cut", "みつあみ→braid"])


def test_entities(spark):
    meta = spark.createDataFrame([(1, "a", ["しなの対応", "hair"], "3体対応: Foo／マヌカ、vrc"), (2, "b", ["Shinano専用"], "しなの(Shinano)")], "ord long, item_id string, tags array<string>, description string")
    raw = entities.raw_names(meta)
    assert {(r.item_id, r.name) for r in raw.collect()} == {("a", "しなの"), ("a", ": Foo"), ("a", "マヌカ"), ("b", "Shinano")}
    seeds = spark.createDataFrame([("io", "イオ")], "surface string, canonical string")
    aliases = entities.mine_aliases(meta, raw, seeds)
    got = {r.item_id: r.avatars for r in entities.item_avatars(raw, aliases).collect()}
    assert got["b"] == ["しなの"]
    known = spark.createDataFrame([("しなの",), ("マヌカ",)], "name string")
    texts = spark.createDataFrame([("SHINANO",), ("マヌ",), ("",), ("?",)], "text string")
    assert {r.text: r.name for r in entities.resolve_avatars(texts, aliases, known).collect()} == {"SHINANO": "しなの", "マヌ": "マヌカ", "": None, "?": None}


def test_new_items_stop_early(spark):
    rows = spark.createDataFrame([(1, 0, "k"), (1, 1, "a"), (1, 2, "a"), (2, 0, "a"), (3, 0, "z")], "page int, pos int, item_id string")
    known = spark.createDataFrame([("k",)], "item_id string")
    assert [(r.item_id, r.pos) for r in catalog.new_items(rows, known).collect()] == [("a", 2)]


def test_separability_and_split(spark):
    files = spark.createDataFrame([("12_1.png",), ("x_1.png",), ("ab_2.jpg",)], "file string")
    assert [r.is_distractor for r in evaluate.eval_split(files).collect()] == [False, True, True]
    top = spark.createDataFrame([("1", 0.9, False), ("2", 0.8, False), ("3", 0.5, True)], "query_id string, score double, is_distractor boolean")
    r = evaluate.separability(top).first()
    assert r.verdict == "separable" and r.threshold == pytest.approx(0.65)


def test_pages_of_one_row_and_equal_scores(spark):
    one = spark.createDataFrame([("q", "a", 0.5, 3, "")], "query_id string, item_id string, score double, wish int, published_at string")
    assert browse.sort_popular(one).first().sort_key == pytest.approx(0.5)
    r = browse.page(browse.sort_similarity(one), 99).first()
    assert (r.page, r.pages, r["rank"], r.shown_from, r.shown_to) == (1, 1, 1, 1, 1)


def test_json_files(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"a": {"x": 0.5}, "b": {}}))
    v, items = readers.read_tag_vectors(spark, str(tmp_path / "v.json"))
    assert v.count() == 1 and items.count() == 2
    assert {r.item_id: r.json for r in readers.vectors_as_json(v, items).collect()} == {"a": '{"x":0.5}', "b": "{}"}
    (tmp_path / "c.json").write_text(json.dumps([{"product_id": "1", "name": "old", "has_vrchat_badge": True}, {"product_id": "1", "name": "new", "price": 5}]))
    assert [(r.name, r.price) for r in readers.read_catalog(spark, str(tmp_path / "c.json")).collect()] == [("new", 5)]
    assert readers.read_stats(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "i.json").write_text(json.dumps({"a": [{"x": 0.5}, {}]}))
    tags, images = readers.read_image_tags(spark, str(tmp_path / "i.json"))
    assert tags.count() == 1 and images.count() == 2
    meta = readers.parse_item_meta(spark.createDataFrame([("{bad",), ('{"tags":[{"name":"t"}],"description":"d"}',)], "json string")).collect()
    assert [(r.tags, r.description, r.error) for r in meta] == [([], "", True), (["t"], "d", False)]


def test_listing_pages(spark):
    html = """<ul><li class="item-card l-card" data-product-id="7" data-product-name="n" data-product-price="500">
      <a class="js-thumbnail-image" data-original="http://t/7.jpg"><img src="/badges/vrchat.png"></a>
      <div class="item-card__title"><a href="http://e/7"> T <b>x</b></a></div>
      <a class="item-card__shop-name-anchor" href="http://s"><div class="item-card__shop-name"> Shop </div></a></li>
      <li class="item-card" data-product-id="8" data-product-price="x"><a class="item-card__title-anchor--multiline">M</a></li>
      <li data-product-id="9">no card</li><li class="item-card">no id</li><li class="item-card" data-product-id="10" data-product-name="only"></li></ul>"""
    got = readers.parse_listing_pages(spark.createDataFrame([(1, html), (2, None)], "page int, html string")).orderBy("pos").collect()
    want = [("7", "Tx", "http://e/7", "http://t/7.jpg", "Shop", "http://s", 500, True), ("8", "M", "https://example.com/items/8", None, None, None, None, False), ("10", "only", "https://example.com/items/10", None, None, None, None, False)]
    assert [(r.item_id, r.name, r.url, r.thumbnail_url, r.shop_name, r.shop_url, r.price, r.has_badge) for r in got] == want


def test_robots(spark):
    text = {"h": ["User-agent: x", "Disallow: /a", "User-agent: * # all", "Disallow: /b", "Disallow:", "nothing"], "i": ["User-agent: *", "Disallow:"]}
    lines = spark.createDataFrame([(s, i, x) for s, ls in text.items() for i, x in enumerate(ls)], "site string, line_no int, line string")
    urls = spark.createDataFrame([(u.split("/")[2], u) for u in ("http://h/a/1", "http://h/b/1", "http://h/cart", "http://i/cart/2", "http://i/b", "http://j/terms")], "site string, url string")
    assert sorted(r.url for r in catalog.robots_filter(urls, catalog.robots_rules(lines)).collect()) == ["http://h/a/1", "http://h/cart", "http://i/b"]


def test_prices_of_any_form(spark):
    df = spark.createDataFrame([("¥ １，０００",), ("５００",), ("٣٤",), ("1,2,3 - 4",)], "t string")
    assert [r[0] for r in df.select(fields.parse_price(F.col("t"))).collect()] == [0, 500, 34, 4]
    df = spark.createDataFrame([('{"price":0}',), ('{"price":"0"}',), ('{"price":0.0}',), ('{"price":70,"tags":[{"name":" "},{"name":""},{}]}',), ("{bad",)], "json string")
    got = readers.parse_item_json(df).collect()
    assert [r.price for r in got] == [None, 0, None, 70, None] and got[3].tags == [" "]


def test_golden_resolutions(spark):
    from tests.golden import GOLDEN

    vocab, synonyms, combos = resolve.built_in(spark)
    tokens = spark.createDataFrame([(t,) for t, _ in GOLDEN], "token string")
    assert {r.token: r.tag for r in resolve.resolve_tags(tokens, vocab, synonyms, combos).collect()} == dict(GOLDEN)
    assert resolve.lint_dict(synonyms, combos, vocab).count() == 0


def test_overlays(spark):
    vocab, synonyms, combos = resolve.built_in(spark)
    morph = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(fields.MORPH)], "src string, dst string, ord int")
    files = ['{"synonyms": {"тестゆにーく語": "wavy_hair", "ボブ": "bob_cut"}, "morph_canon": [["クルリン", "カール"], ["ダンゴ", "団子"], ["x"]], "prefix_combos": {"半|hair_bun": "half_updo", "bad": "afro", "ツイン|braid": "twin_braids"}}', "{broken", '{"synonyms": null}']
    syn, mor, com = resolve.overlay_tables(spark.createDataFrame([(f,) for f in files], "json string"))
    merged, n = resolve.merge_synonyms(synonyms, syn)
    pairs, k = resolve.merge_morph(morph, mor)
    both, c = resolve.merge_combos(combos, com)
    assert (n.first().n, k.first().n, c.first().n) == (1, 1, 1)
    order = [(r.src, r.dst) for r in pairs.orderBy("ord").collect()]
    assert order == [*fields.MORPH, ("クルリン", "カール")]
    tokens = spark.createDataFrame([(t,) for t in ("тестゆにーく語", "くるりん", "半おだんご")], "token string")
    assert {r.token: r.tag for r in resolve.resolve_tags(tokens, vocab, merged, both, order).collect()} == {"тестゆにーく語": "wavy_hair", "くるりん": "curly_hair", "半おだんご": "half_updo"}
    assert {r.kind for r in resolve.lint_dict(merged, both, vocab, com, mor).collect()} == {"key", "pair"}
    empty = resolve.overlay_tables(readers._whole(spark, "/no/such/file.json"))
    assert [t.count() for t in empty] == [0, 0, 0]


def test_stream_keeps_the_newest(spark, tmp_path):
    schema = "item_id string, at int, wish int"
    for k, data in enumerate(([("a", 1, 1), ("b", 1, 1)], [("a", 2, 5), ("a", 0, 9)])):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = ingest.stream_update(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), ["at"])
    assert last == 1
    again = ingest.stream_update(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), ["at"])
    assert again == last
    got = {r.item_id: r.wish for r in ingest.snapshot(spark, schema, str(tmp_path / "out"), ["at"]).collect()}
    assert got == {"a": 5, "b": 1}
    ingest.compact(spark, schema, str(tmp_path / "out"), str(tmp_path / "new"), ["at"])
    assert ingest.snapshot(spark, schema, str(tmp_path / "new"), ["at"]).count() == 2
