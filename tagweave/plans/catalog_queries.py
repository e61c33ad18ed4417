"""Queries of sources, predicates, catalog upkeep, resolution, entities and evaluation, each with the SQL of its result.

Files that a reader reads are written by Spark from the given tables and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.functions import fields
from tagweave.operators import browse, catalog, entities, evaluate, keywords, pages, resolve, search, vectors
from tagweave.plans import adapters as ad
from tagweave.plans import queries as plans
from tagweave.plans import sql
from tagweave.plans.queries import query
from tagweave.sources import readers, versions
from tagweave.sources.scratch import scratch_path, written
from tagweave.streaming import ingest

#: Rows of one JSON or HTML file.
PER_FILE = 500


def _write_text(df: DataFrame, name: str) -> str:
    """One file for each row of df (value)."""
    path = scratch_path(df.sparkSession, name)
    df.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def _maps(df: DataFrame, key: str, value) -> DataFrame:
    """(value): JSON objects {key: value} of PER_FILE keys at most."""
    part = df.withColumn("file", F.pmod(F.xxhash64(key), F.lit(64)))
    return part.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, value)))).alias("value"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS name, 'https://shop.example/' || p_partkey AS url, p_size AS price, p_size % 2 = 0 AS has_vrchat_badge FROM part")
def s1_read_catalog(s, d):
    """Items as JSON arrays, in which every tenth id stands twice: the last one counts."""
    part = ad.read(s, d, "part")
    item = lambda name: F.struct(F.col("p_partkey").cast("string").alias("product_id"), name.alias("name"), F.concat(F.lit("https://shop.example/"), "p_partkey").alias("url"), F.col("p_size").alias("price"), (F.col("p_size") % 2 == 0).alias("has_vrchat_badge"))
    rows = part.where("p_partkey % 10 = 0").select("p_partkey", F.lit(0).alias("v"), item(F.lit("old")).alias("o")).unionAll(part.select("p_partkey", F.lit(1), item(F.col("p_name"))))
    files = rows.groupBy(F.expr(f"p_partkey div {PER_FILE}").alias("f")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("v", "p_partkey", "o"))), lambda x: x["o"])).alias("value"))
    return readers.read_catalog(s, _write_text(files, "catalog")).select("product_id", "name", "url", "price", "has_vrchat_badge")


@query("WITH " + sql.VECTORS + " SELECT i.item_id, tag, conf FROM items i LEFT JOIN hair_v h USING (item_id)")
def s2_read_vectors(s, d):
    """Vectors through {id: {tag: conf}} files; items with empty vectors come back with a null tag."""
    strong = ad.hair(s, d).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "conf"))).alias("v"))
    all_ = ad.items(s, d).join(strong, "item_id", "left").withColumn("v", F.coalesce("v", F.create_map().cast("map<string,double>")))
    v, items = readers.read_tag_vectors(s, _write_text(_maps(all_, "item_id", "v"), "vectors"))
    return items.join(v, "item_id", "left").select("item_id", "tag", "conf")


@query("WITH " + sql.STATS + " SELECT item_id, wish, published_at, CAST(NULL AS INTEGER) AS price, 'a,b' AS tags, '' AS \"desc\", checked_at FROM stats")
def s3_read_stats(s, d):
    """Statistics through {id: {...}} files; missing fields come back as null."""
    st = ad.stats(s, d).withColumn("o", F.struct("wish", "published_at", F.split(F.lit("a,b"), ",").alias("tags"), F.lit("").alias("desc"), "checked_at"))
    done = readers.read_stats(s, _write_text(_maps(st, "item_id", "o"), "stats"))
    return done.withColumn("tags", F.array_join("tags", ","))


@query("WITH " + sql.IMAGES + ", n AS (SELECT item_id, image_no, row_number() OVER (PARTITION BY item_id ORDER BY image_no) - 1 AS k FROM images) SELECT CAST(n.item_id AS VARCHAR) AS item_id, CAST(k AS INTEGER) AS image_no, tag, conf FROM n LEFT JOIN img i ON i.item_id = n.item_id AND i.image_no = n.image_no")
def s4_read_image_tags(s, d):
    """Vectors of images through {id: [{tag: conf}, ...]} files, images without a tag too."""
    own = ad.image_tags(s, d).groupBy("item_id", "image_no").agg(F.map_from_entries(F.collect_list(F.struct("tag", "conf"))).alias("v"))
    every = ad.images(s, d).join(own, ["item_id", "image_no"], "left").withColumn("v", F.coalesce("v", F.create_map().cast("map<string,double>")))
    lists = every.groupBy(F.col("item_id").cast("string").alias("item_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("image_no", F.map_entries("v").alias("e")))), lambda x: F.map_from_entries(x["e"])).alias("l"))
    tags, images = readers.read_image_tags(s, _write_text(_maps(lists, "item_id", "l"), "images"))
    return images.join(tags, ["item_id", "image_no"], "left").select("item_id", "image_no", "tag", "conf")


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_id, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_brand || ', ' END AS tags, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE ' ' || p_name || chr(10) || chr(10) || p_type END AS description, p_partkey % 13 = 0 AS error FROM part")
def s6_item_meta(s, d):
    """Metadata of items' JSON, every thirteenth of which is cut off."""
    j = ad.item_json(s, d).withColumn("json", F.when(F.col("item_id").cast("long") % 13 == 0, F.substring("json", 1, 20)).otherwise(F.col("json")))
    return readers.parse_item_meta(j).select("item_id", F.array_join("tags", ",").alias("tags"), "description", "error")


def _cards(s: SparkSession, d: str) -> DataFrame:
    """(page, html): parts as cards of listing pages, in the forms that cards come in."""
    c = lambda *x: F.concat(*[v if not isinstance(v, str) else F.lit(v) for v in x])
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    title = F.when(size % 3 == 0, c('<div class="item-card__title"><a href="/t/', key, '"> ', F.col("p_name"), "</a></div>")).when(size % 3 == 1, c('<a class="x item-card__title-anchor--multiline" href="/m/', key, '"><span>', F.col("p_name"), "</span></a>")).otherwise("")
    card = c(
        '<li class="item-card l-card" data-product-id="', key, '" data-product-name="', F.col("p_brand"), '" data-product-price="', F.when(size % 5 == 0, "free").otherwise(size.cast("string")), '">',
        F.when(size % 2 == 0, c('<a class="js-thumbnail-image" data-original="http://img/', key, '.jpg"><img src="/badges/vrchat.svg"></a>')).otherwise(""), title,
        '<a class="item-card__shop-name-anchor" href="http://', F.lower("p_type"), '"><div class="item-card__shop-name">', F.col("p_type"), "</div></a></li>",
    )
    return ad.read(s, d, "part").groupBy(F.expr("p_partkey div 60 + 1").alias("page")).agg(F.concat(F.lit('<ul><li class="item-card">ad</li>'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", card.alias("card")))), lambda x: x["card"]), "\n"), F.lit("</ul>")).alias("html"))


@query("""SELECT p_partkey // 60 + 1 AS page, CAST(p_partkey % 60 AS INTEGER) AS pos, CAST(p_partkey AS VARCHAR) AS item_id, CASE WHEN p_size % 3 = 2 THEN p_brand ELSE p_name END AS name,
CASE p_size % 3 WHEN 0 THEN '/t/' || p_partkey WHEN 1 THEN '/m/' || p_partkey ELSE 'https://example.com/items/' || p_partkey END AS url, CASE WHEN p_size % 2 = 0 THEN 'http://img/' || p_partkey || '.jpg' END AS thumbnail_url,
p_type AS shop_name, 'http://' || lower(p_type) AS shop_url, CASE WHEN p_size % 5 <> 0 THEN p_size END AS price, p_size % 2 = 0 AS has_badge FROM part""")
def s7_listing_pages(s, d):
    return readers.parse_listing_pages(_cards(s, d))


@query("""WITH u AS (SELECT p_partkey AS k, unnest([1, 2, 1, 3, 4, 5, 6, 7, 8]) AS i, generate_subscripts([1, 2, 1, 3, 4, 5, 6, 7, 8], 1) AS pos FROM part),
f AS (SELECT k, 'http://img/i/' || CASE WHEN i = p THEN k + 1 ELSE k END || '/' || i || '.png' AS url, min(pos) AS pos FROM u JOIN (SELECT p_partkey, p_size % 9 AS p FROM part) ON p_partkey = k WHERE i <> p GROUP BY 1, 2)
SELECT CAST(k AS VARCHAR) AS item_id, string_agg(url, ' ' ORDER BY pos) AS urls FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos) <= 6) GROUP BY k""")
def s8_image_urls(s, d):
    """Image URLs of item pages: repeated ones, and one of another item, on each."""
    part = ad.read(s, d, "part")
    url = lambda i: F.concat(F.lit("http://img/i/"), F.when(i == F.col("p_size") % 9, F.col("p_partkey") + 1).otherwise(F.col("p_partkey")).cast("string"), F.lit("/"), i.cast("string"), F.lit(".png"))
    html = F.array_join(F.transform(F.array(*map(F.lit, (1, 2, 1, 3, 4, 5, 6, 7, 8))), lambda i: F.concat(F.lit('<img data-origin="'), url(i), F.lit('" src="x">'))), " ")
    pages = part.select(F.col("p_partkey").cast("string").alias("item_id"), html.alias("html"))
    return pages.select("item_id", F.array_join(readers.image_urls(F.col("html"), F.col("item_id")), " ").alias("urls"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_id, CASE p_size % 3 WHEN 2 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS name, 'https://example.com/items/' || p_partkey AS url, CASE WHEN p_size % 2 = 0 THEN 'http://img/' || p_brand END AS thumbnail_url, CAST(NULL AS VARCHAR) AS shop_name, CAST(NULL AS VARCHAR) AS shop_url, CAST(NULL AS INTEGER) AS price, false AS has_badge FROM part")
def s9_og_rows(s, d):
    """Catalog rows of item pages' og: properties, in either order of attributes, or without them."""
    tag = lambda name, value: F.concat(F.lit(f'<meta property="og:{name}" content="'), value, F.lit('">'))
    back = F.concat(F.lit('<meta content="'), F.col("p_name"), F.lit('" property="og:title">'))
    html = F.concat(F.lit("<html><head>"), F.when(F.col("p_size") % 3 == 0, tag("title", F.col("p_name"))).when(F.col("p_size") % 3 == 1, back).otherwise(""), F.when(F.col("p_size") % 2 == 0, tag("image", F.concat(F.lit("http://img/"), "p_brand"))).otherwise(""))
    return readers.extract_og(ad.read(s, d, "part").select(F.col("p_partkey").cast("string").alias("item_id"), html.alias("html")))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'https://img.example/c/300x300_a2_g5/ab/i/' || page_id || '/x_base_resized.jpg' END AS url FROM pages")
def s10_resized_url(s, d):
    """Originals become thumbnails, whatever follows their ending; other URLs stay."""
    own = F.concat(F.lit("https://img.example/ab/i/"), F.col("page_id").cast("string"), F.lit("/x.png?v=1"))
    url = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(own)
    return ad.read(s, d, "pages").select("page_id", readers.resized_url(url).alias("url"))


@query("WITH " + sql.STATS + " SELECT item_id, wish, published_at, checked_at, 2 AS version FROM stats WHERE wish > 0 UNION ALL SELECT item_id, wish, published_at, checked_at, 1 FROM stats")
def s11_snapshots(s, d):
    """Two versions of a snapshot side by side."""
    folder, st = scratch_path(s, "snapshots"), ad.stats(s, d)
    for version, df in (("1", st), ("2", st.where("wish > 0"))):
        readers.write_snapshot(df, folder, version)
    return s.read.schema(", ".join(f"{c} {kind}" for c, kind in st.dtypes) + ", version int").parquet(folder)


@query("SELECT p_partkey, p_size % 7 = 0 OR p_size % 4 < 3 AS looks FROM part")
def p3_looks_compatible(s, d):
    part = ad.read(s, d, "part")
    name = F.concat("p_name", F.element_at(F.array(*map(F.lit, (" for vrc", " AVATARS", " 対応アバター", ""))), (F.col("p_size") % 4 + 1).cast("int")))
    return part.select("p_partkey", fields.looks_vrchat(F.when(F.col("p_size") % 7 == 0, True), name).alias("looks"))


def _items(s: SparkSession, d: str) -> DataFrame:
    """(item_id, name, tags, description) in normal form."""
    norm = fields.normalize_ja
    return ad.read(s, d, "part").select(F.col("p_partkey").cast("string").alias("item_id"), norm(F.col("p_name")).alias("name"), F.array(norm(F.col("p_brand")), norm(F.col("p_type"))).alias("tags"), norm(F.concat_ws(" ", F.lit("size"), F.col("p_size").cast("string"))).alias("description"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_id FROM part WHERE contains(p_name, 'e 1') OR contains(lower(p_brand), 'e 1') OR contains(lower(p_type), 'e 1') OR contains('size ' || p_size, 'e 1')")
def p5_keyword_hit(s, d):
    """The keyword is typed in full-width and capital letters."""
    return browse.keyword_hit(_items(s, d), "Ｅ　１").select("item_id")


_KEYWORDS = """item AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, [p_name, lower(p_brand), lower(p_type), 'size ' || p_size, translate(substr(p_brand, 7, 2), '0123456789', 'アイウエオカキクケコ')] AS texts FROM part),
kw AS (
  SELECT DISTINCT upper(substr(p_name, 2, 6)) AS keyword, trim(substr(p_name, 2, 6)) AS norm FROM part UNION SELECT DISTINCT ' ' || substr(p_name, 1, 1), lower(substr(p_name, 1, 1)) FROM part
  UNION SELECT DISTINCT translate(substr(p_brand, 7, 2), '0123456789', 'あいうえおかきくけこ'), translate(substr(p_brand, 7, 2), '0123456789', 'アイウエオカキクケコ') FROM part
  UNION SELECT DISTINCT p_partkey || 'z', p_partkey || 'z' FROM part)"""


@query("WITH " + _KEYWORDS + " SELECT keyword, count(*) AS n_items, min(item_id) AS first_item, max(item_id) AS last_item FROM kw JOIN item ON len(list_filter(texts, lambda t: contains(t, norm))) > 0 GROUP BY keyword")
def p5_keyword_requests(s, d):
    """Many keywords against all items: parts of names in capitals, single letters, kana in the other script, and ones that
    nothing contains."""
    part = ad.read(s, d, "part")
    kana = lambda to: F.translate(F.substring("p_brand", 7, 2), "0123456789", to)
    items = part.select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("name"), F.array("p_brand", "p_type", kana("アイウエオカキクケコ")).alias("tags"), F.concat_ws(" ", F.lit("size"), F.col("p_size").cast("string")).alias("description"))
    forms = F.array(F.upper(F.substring("p_name", 2, 6)), F.concat(F.lit(" "), F.substring("p_name", 1, 1)), kana("あいうえおかきくけこ"), F.concat(F.col("p_partkey").cast("string"), F.lit("z")))
    texts = written(keywords.fields(items), "texts")
    index = written(keywords.postings(texts), "postings")
    found = keywords.hits(part.select(F.explode(forms).alias("keyword")), index, texts)
    return found.groupBy("keyword").agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"), F.max("item_id").alias("last_item"))


@query("WITH " + sql.RANKING + ", kept AS (SELECT b.* FROM bm b JOIN part ON CAST(p_partkey AS VARCHAR) = b.item_id WHERE b.item_id IN (SELECT item_id FROM hair_v WHERE tag IN ('t05', 't11') AND conf >= 0.2) AND (contains(p_name, 'ring') OR contains(lower(p_type), 'ring'))) SELECT query_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM kept QUALIFY rank <= 10")
def p6_filter_results(s, d):
    """The first page of each query's whole ranking, filtered by tags and a keyword."""
    kept = written(browse.filter_results(ad.items(s, d), ad.hair(s, d), _items(s, d), True, ["t05", "t11"], " ＲＩＮＧ ").select("item_id").distinct(), "kept")
    done = pages.similar_page(*plans._filtered(s, d, kept), 1)
    return done.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank", "total")


@query("WITH " + plans._META + " SELECT item_id, bool_or(name IN ('Br11', 'イウ', 'blue bolt')) AS fits FROM named GROUP BY item_id")
def p7_compatible_with(s, d):
    lists = plans._names(s, d).groupBy("item_id").agg(F.collect_set("name").alias("avatars"))
    return lists.select("item_id", fields.compatible_with(F.col("avatars"), ["Br11", "イウ", "blue bolt"]).alias("fits"))


@query("WITH " + sql.VECTORS + " SELECT item_id, tag, CAST(substr(tag, 2) AS INTEGER) < 40 AS is_vocab FROM full_v")
def p9_vocab_tags(s, d):
    return vectors.is_vocab_tag(ad.full(s, d).select("item_id", "tag"), ad.vocab(s))


_FILES = "f AS (SELECT p_partkey AS k, CASE p_size % 5 WHEN 0 THEN p_partkey || '_' || p_size || '.png' WHEN 1 THEN 'X_' || p_partkey || '.jpg' WHEN 2 THEN p_partkey || '.webp' WHEN 3 THEN p_brand || '_1.png' ELSE p_partkey || '.v2_3.jpeg' END AS file FROM part)"


def _files(s: SparkSession, d: str) -> DataFrame:
    """(file): names of evaluation images and distractors."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size")
    name = F.when(size % 5 == 0, F.concat(k, F.lit("_"), size.cast("string"), F.lit(".png"))).when(size % 5 == 1, F.concat(F.lit("X_"), k, F.lit(".jpg"))).when(size % 5 == 2, F.concat(k, F.lit(".webp"))).when(size % 5 == 3, F.concat("p_brand", F.lit("_1.png"))).otherwise(F.concat(k, F.lit(".v2_3.jpeg")))
    return ad.read(s, d, "part").select("p_partkey", name.alias("file"))


@query("WITH " + _FILES + ", s AS (SELECT *, regexp_replace(file, '\\.[^.]*$', '') AS stem FROM f) SELECT file, split_part(stem, '_', 1) AS answer_id, split_part(split_part(file, '_', 1), '.', 1) AS cut_id, lower(stem) LIKE 'x\\_%' ESCAPE '\\' OR NOT regexp_full_match(split_part(stem, '_', 1), '[0-9]+') AS is_distractor FROM s")
def e1_eval_split(s, d):
    """Answers and distractors of evaluation files, by both rules of an answer's id."""
    files = _files(s, d)
    split = evaluate.eval_split(files)
    return split.withColumn("cut_id", evaluate.answer_id(F.col("file"), cut_dot=True)).select("file", "answer_id", "cut_id", "is_distractor")


@query("WITH " + _FILES + " SELECT DISTINCT CAST(k AS VARCHAR) AS item_id FROM f, part WHERE k = p_partkey AND p_size % 5 IN (0, 2) AND k NOT IN (SELECT vec_id FROM embeddings)")
def j3_missing_answers(s, d):
    return evaluate.missing_answers(evaluate.eval_split(_files(s, d)), ad.items(s, d))


_ROBOTS = """p AS (SELECT page_id, url, split_part(url, '/', 3) AS site, '/' || split_part(split_part(split_part(url, '://', 2), '/', 2), '?', 1) AS top FROM pages),
r AS (SELECT site, length(site) % 3 AS kind FROM p GROUP BY site)"""


@query("WITH " + _ROBOTS + " SELECT p.site, url FROM p JOIN r USING (site) WHERE NOT (kind = 0 AND (top LIKE '/en%' OR top LIKE '/f%')) AND NOT (kind = 1 AND top LIKE '/es%')")
def p11_robots(s, d):
    """URLs that their sites allow; a third of the sites state nothing for all agents."""
    urls = ad.read(s, d, "pages").select(F.substring_index(F.substring_index("url", "/", 3), "/", -1).alias("site"), "url")
    kind = F.length("site") % 3
    text = F.when(kind == 0, "User-agent: bot\nDisallow: /\nUSER-AGENT: *  # all\nDisallow: /en\nDisallow:\nDisallow: /f # x").when(kind == 1, "User-agent: *\nno colon\nDisallow : /es\nUser-agent: a\nDisallow: /").otherwise("User-agent: a\nDisallow: /en")
    lines = urls.select("site").distinct().select("site", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return catalog.robots_filter(urls, catalog.robots_rules(lines))


@query("SELECT CAST(vec_id AS VARCHAR) AS item_id FROM embeddings WHERE vec_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)")
def j1_searchable(s, d):
    return vectors.searchable(ad.items(s, d), ad.catalog(s, d))


@query("WITH " + sql.VECTORS + " SELECT DISTINCT item_id FROM hair_v WHERE conf >= 0.7 INTERSECT SELECT item_id FROM full_v WHERE conf >= 0.8")
def j6_population(s, d):
    return vectors.eval_population(ad.hair(s, d).where("conf >= 0.7"), ad.full(s, d).where("conf >= 0.8"))


_TOP = sql.RANKING + ", top AS (SELECT query_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM bm QUALIFY rank <= 10)"


@query("WITH " + _TOP + ", " + sql.STATS + ", " + plans._META + """ SELECT query_id, t.item_id, score, rank, p.p_name AS name, CASE WHEN p.p_size % 2 = 0 THEN 'https://shop.example/' || t.item_id ELSE 'https://example.com/items/' || t.item_id END AS url,
coalesce(s.wish, 0) AS wish, coalesce(s.published_at, '') AS published_at, coalesce(a.avatars, '') AS avatars
FROM top t LEFT JOIN part p ON CAST(p.p_partkey AS VARCHAR) = t.item_id LEFT JOIN stats s ON s.item_id = t.item_id LEFT JOIN (SELECT item_id, array_to_string(list_sort(list(name)), ',') AS avatars FROM named GROUP BY item_id) a ON a.item_id = t.item_id""")
def j2_enrich(s, d):
    """The ten best of each query with what the catalog, the statistics and the entities know of them."""
    part = ad.read(s, d, "part").select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("https://shop.example/"), F.col("p_partkey").cast("string"))).alias("url"))
    names = plans._names(s, d).groupBy("item_id").agg(F.collect_set("name").alias("avatars"))
    done = search.enrich(plans._best(s, d), part, ad.stats(s, d), names)
    return done.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank", "name", "url", "wish", "published_at", F.array_join("avatars", ",").alias("avatars"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS item_id, c_name AS name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def j4_augment(s, d):
    have = ad.read(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("item_id"), F.col("c_name").alias("name"))
    return catalog.augment(have, ad.read(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("item_id"), F.col("s_name").alias("name")))


_FETCHED = """fetched AS (SELECT CAST(c_custkey AS VARCHAR) AS item_id, CASE WHEN c_custkey % 17 = 0 THEN 404 WHEN c_custkey % 13 = 0 THEN 500 ELSE 200 END AS status,
  CAST(c_custkey % 7 AS INTEGER) AS wish, '2030-02-01' AS published_at, '2030-03-01' AS checked_at FROM customer)"""


def _fetched(s: SparkSession, d: str) -> DataFrame:
    """(item_id, status, wish, published_at, checked_at): what a round of requests brings."""
    k = F.col("c_custkey")
    return ad.read(s, d, "customer").select(k.cast("string").alias("item_id"), F.when(k % 17 == 0, 404).when(k % 13 == 0, 500).otherwise(200).alias("status"), (k % 7).cast("int").alias("wish"), F.lit("2030-02-01").alias("published_at"), F.lit("2030-03-01").alias("checked_at"))


@query("WITH " + sql.STATS + ", " + _FETCHED + """, s AS (SELECT item_id, wish, published_at, 5 AS price, CASE WHEN wish % 2 = 0 THEN 'old' END AS tags, 'od' AS "desc" FROM stats), f AS (SELECT item_id, status = 200 AS ok, wish, published_at, 9 AS price, 'new,er' AS tags, 'nd' AS "desc" FROM fetched WHERE wish < 5)
SELECT coalesce(s.item_id, f.item_id) AS item_id, CASE WHEN s.item_id IS NOT NULL THEN s.wish WHEN f.ok THEN f.wish ELSE 0 END AS wish, CASE WHEN s.item_id IS NOT NULL THEN s.published_at WHEN f.ok THEN f.published_at ELSE '' END AS published_at,
CASE WHEN s.item_id IS NOT NULL THEN s.price WHEN f.ok THEN f.price END AS price, CASE WHEN f.item_id IS NULL THEN s.tags WHEN f.ok THEN f.tags ELSE coalesce(s.tags, '') END AS tags, CASE WHEN f.item_id IS NULL THEN s."desc" WHEN f.ok THEN f."desc" ELSE '' END AS "desc"
FROM s FULL JOIN f ON s.item_id = f.item_id""")
def u3_fill_stats(s, d):
    st = ad.stats(s, d).select("item_id", "wish", "published_at", F.lit(5).alias("price"), F.when(F.col("wish") % 2 == 0, F.array(F.lit("old"))).alias("tags"), F.lit("od").alias("desc"))
    f = _fetched(s, d).where("wish < 5").select("item_id", (F.col("status") == 200).alias("ok"), "wish", "published_at", F.lit(9).alias("price"), F.array(F.lit("new"), F.lit("er")).alias("tags"), F.lit("nd").alias("desc"))
    return catalog.fill_stats(st, f).withColumn("tags", F.array_join("tags", ","))


_UPDATE = plans._NEW + ", " + sql.STATS + ", " + _FETCHED + """,
stale AS (SELECT item_id FROM catalog LEFT JOIN stats USING (item_id) ORDER BY coalesce(checked_at, ''), item_id LIMIT 150),
fresh_new AS (SELECT * FROM new WHERE page < (SELECT p FROM stop)),
gone AS (SELECT item_id FROM stale JOIN fetched USING (item_id) WHERE status = 404),
fresh AS (SELECT f.* FROM fetched f WHERE status = 200 AND (item_id IN (FROM stale) OR item_id IN (SELECT item_id FROM fresh_new))),
total AS (SELECT item_id FROM (SELECT item_id FROM catalog UNION SELECT item_id FROM fresh_new) WHERE item_id NOT IN (FROM gone)),
rows AS (SELECT item_id, 'old ' || item_id || ' https://shop.example/' || item_id || ' ' || item_id || '.jpg' AS what FROM catalog UNION ALL SELECT item_id, 'new ' || item_id || ' ' || pos || ' https://shop.example/' || item_id || ' ?' FROM fresh_new)"""


def _before(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The tables as they are; catalog rows have a name, a link and a thumbnail."""
    known = ad.catalog(s, d).select("item_id", F.concat(F.lit("old "), "item_id").alias("name"), F.concat(F.lit("https://shop.example/"), "item_id").alias("url"), F.concat("item_id", F.lit(".jpg")).alias("thumbnail_url"))
    old = lambda df: df.join(known, "item_id", "left_semi")
    return {"catalog": known, "hair": old(ad.hair(s, d)), "full": old(ad.full(s, d)), "stats": ad.stats(s, d)}


def _update(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The listing tells new items' names and links, not their thumbnails."""
    t = _before(s, d)
    listing = ad.listing(s, d).select("item_id", "page", "pos", F.concat_ws(" ", F.lit("new"), "item_id", F.col("pos").cast("string")).alias("name"), F.concat(F.lit("https://shop.example/"), "item_id").alias("url"))
    return catalog.run_update(t["catalog"], t["hair"], t["full"], t["stats"], listing, ad.scores(s, d), _fetched(s, d), ad.vocab(s))


@query("WITH " + _UPDATE + " SELECT 'new' AS status, count(*) AS n FROM fresh_new UNION ALL SELECT 'tagged', count(*) FROM fresh_new WHERE item_id IN (SELECT item_id FROM fetched WHERE status = 200) UNION ALL SELECT 'refreshed', count(*) FROM stale WHERE item_id IN (SELECT item_id FROM fetched WHERE status = 200) UNION ALL SELECT 'pruned', count(*) FROM gone UNION ALL SELECT 'total', count(*) FROM total")
def g10_update_report(s, d):
    """What the weekly update did, in counts."""
    return _update(s, d)["report"]


@query("WITH " + _UPDATE + ", " + sql.VECTORS + ", now AS (SELECT item_id, wish, published_at, checked_at FROM fresh UNION ALL SELECT item_id, wish, published_at, checked_at FROM stats WHERE item_id NOT IN (SELECT item_id FROM fresh)) "
    "SELECT 'catalog' AS part, item_id, what FROM rows WHERE item_id IN (FROM total) UNION ALL SELECT 'stats', item_id, concat_ws('/', wish, published_at, coalesce(checked_at, '?')) FROM now WHERE item_id NOT IN (FROM gone) "
    "UNION ALL SELECT 'hair', item_id, string_agg(tag, ',' ORDER BY tag) FROM hair_v WHERE item_id IN (FROM total) GROUP BY item_id UNION ALL SELECT 'full', item_id, string_agg(tag, ',' ORDER BY tag) FROM full_v WHERE item_id IN (FROM total) GROUP BY item_id")
def u7_weekly_update(s, d):
    """All four tables after the weekly update: written as a version of bucketed tables, of which it changes some, and read back."""
    before, done = _before(s, d), _update(s, d)
    folders = {n: scratch_path(s, n) for n in before}
    for name, df in before.items():
        versions.create(df, folders[name])
    catalog.write_update(done, folders)
    t = {n: versions.read(s, folders[n], df.schema) for n, df in before.items()}
    tags = lambda n: t[n].groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("what")).select(F.lit(n).alias("part"), "item_id", "what")
    stats = t["stats"].select(F.lit("stats"), "item_id", F.concat_ws("/", F.col("wish").cast("string"), "published_at", F.coalesce("checked_at", F.lit("?"))))
    rows = t["catalog"].select(F.lit("catalog").alias("part"), "item_id", F.concat_ws(" ", "name", "url", F.coalesce("thumbnail_url", F.lit("?"))).alias("what"))
    return rows.unionAll(stats).unionAll(tags("hair")).unionAll(tags("full"))


@query("WITH " + _UPDATE + ", half AS (SELECT unnest([0, 1]) AS half) SELECT half, (SELECT count(*) FROM fresh_new WHERE half = 0) + (SELECT count(*) FROM stale WHERE half = 0) + (SELECT count(*) FROM gone WHERE half = 0 AND item_id NOT IN (SELECT item_id FROM catalog)) > 0 AS changed FROM half")
def u6_changes(s, d):
    """Whether there is anything to write: after the update's own pages, and where all listed items are known and none is due."""
    known, listed = ad.catalog(s, d), ad.listing(s, d)
    stale = catalog.refresh_batch(known, ad.stats(s, d)).select("item_id")
    gone = stale.join(_fetched(s, d).where("status = 404"), "item_id", "left_semi")
    busy = catalog.changes(catalog.new_items(listed, known), stale, gone)
    all_known = known.unionByName(listed.select("item_id"))
    nothing = stale.where("item_id is null")
    idle = catalog.changes(catalog.new_items(listed, all_known), nothing, gone.join(known, "item_id", "left_anti"))
    return busy.select(F.lit(0).alias("half"), "changed").unionAll(idle.select(F.lit(1), "changed"))


_LABELS = "SELECT DISTINCT replace(p_name, ' ', '_') AS tag FROM part WHERE p_size % 2 = 0"


@query("SELECT tag, CAST(row_number() OVER (ORDER BY tag) - 1 AS INTEGER) AS pos FROM (" + _LABELS + " INTERSECT SELECT replace(p_name, ' ', '_') FROM part WHERE p_type IN ('PROMO', 'SMALL'))")
def x1_build_vocab(s, d):
    part = ad.read(s, d, "part").withColumn("tag", F.translate("p_name", " ", "_"))
    return vectors.build_vocab(part.where("p_type in ('PROMO', 'SMALL')").select("tag"), part.where("p_size % 2 = 0").select(F.col("tag").alias("name")))


@query("WITH v AS (SELECT replace(p_name, ' ', '_') AS tag, min(p_partkey) AS pos FROM part GROUP BY 1) SELECT tag, CAST(row_number() OVER (ORDER BY pos) - 1 AS INTEGER) AS pos FROM v WHERE tag IN (SELECT replace(p_name, ' ', '_') FROM part WHERE p_type = 'LARGE' AND p_size < 20)")
def x2_load_vocab(s, d):
    part = ad.read(s, d, "part").withColumn("tag", F.translate("p_name", " ", "_"))
    return vectors.load_vocab(part.groupBy("tag").agg(F.min("p_partkey").alias("pos")), part.where("p_type = 'LARGE' and p_size < 20").select(F.col("tag").alias("name")))


@query("WITH " + sql.RESOLVED + """, req AS (SELECT c_custkey AS request_id, p_partkey AS k, p_name, p_brand, p_type FROM customer JOIN part ON p_partkey = c_custkey),
l AS (SELECT request_id, unnest([p_name, upper(p_brand), 'zz' || p_type, p_name || ' XL', p_brand]) AS token, generate_subscripts([1, 2, 3, 4, 5], 1) AS pos FROM req),
r AS (SELECT l.*, resolved.tag FROM l LEFT JOIN resolved USING (token)), f AS (SELECT request_id, tag, min(pos) AS pos FROM r WHERE tag IS NOT NULL GROUP BY ALL)
SELECT request_id, coalesce((SELECT string_agg(tag, ',' ORDER BY pos) FROM f WHERE f.request_id = q.request_id), '') AS tags,
  coalesce((SELECT string_agg(token, ',' ORDER BY pos) FROM r WHERE r.request_id = q.request_id AND tag IS NULL), '') AS unresolved,
  coalesce((SELECT string_agg(token || '→' || tag, ',' ORDER BY pos) FROM r WHERE r.request_id = q.request_id AND tag <> token), '') AS notes FROM req q""")
def t6_resolve_lists(s, d):
    """Lists of typed forms as tags in first-seen order, what stays unresolved, and what was changed."""
    part, key = ad.read(s, d, "part"), ad.read(s, d, "customer").select(F.col("c_custkey").alias("request_id"))
    forms = F.array("p_name", F.upper("p_brand"), F.concat(F.lit("zz"), "p_type"), F.concat("p_name", F.lit(" XL")), "p_brand")
    requests = part.join(key, F.col("p_partkey") == F.col("request_id")).select("request_id", forms.alias("tokens"))
    known = resolve.resolve_tags(ad.tokens(s, d), *ad.dictionary(s, d))
    return resolve.resolve_lists(requests, known).select("request_id", *[F.array_join(c, ",").alias(c) for c in ("tags", "unresolved", "notes")])


@query("WITH " + plans._META + " SELECT DISTINCT name FROM named")
def a6_known_names(s, d):
    names = plans._names(s, d)
    return entities.known_avatars(entities.avatar_vocab(names), names)


@query("WITH " + plans._META + """, t AS (SELECT DISTINCT unnest([p_name, ' ' || upper(br) || ' ', substr(p_name, 1, 4), br || ' x', '', p_name || 'z']) AS text FROM meta),
known AS (SELECT DISTINCT name FROM named), n AS (SELECT text, trim(text) AS t, lower(trim(text)) AS low FROM t),
near AS (SELECT text, name FROM n JOIN known ON contains(lower(name), low) OR contains(low, lower(name)) WHERE low <> '' QUALIFY row_number() OVER (PARTITION BY text ORDER BY length(name), name) = 1)
SELECT n.text, CASE WHEN t <> '' THEN coalesce(a.kana, k.name, near.name) END AS name FROM n LEFT JOIN (SELECT DISTINCT low, kana FROM alias) a ON a.low = n.low LEFT JOIN known k ON k.name = n.t LEFT JOIN near ON near.text = n.text""")
def a7_resolve_entities(s, d):
    """Typed entity names: by alias, as they are, or by the shortest known name around or within them."""
    part = ad.read(s, d, "part")
    low = F.concat(F.lit("Br"), F.substring("p_brand", 7, 2))
    texts = part.select(F.explode(F.array("p_name", F.concat(F.lit(" "), F.upper(low), F.lit(" ")), F.substring("p_name", 1, 4), F.concat(low, F.lit(" x")), F.lit(""), F.concat("p_name", F.lit("z")))).alias("text"))
    names, aliases = plans._entities(s, d)
    return entities.resolve_avatars(texts, aliases, entities.known_avatars(entities.avatar_vocab(names), names))


_GRID = sql.IMAGES + """, tabs AS (
  SELECT 'max' AS config, item_id, tag, max(conf) AS conf FROM img GROUP BY ALL UNION ALL SELECT 'mean', item_id, tag, round(sum(conf) / any_value(n), 9) FROM img JOIN n_images USING (item_id) GROUP BY item_id, tag
), v AS (SELECT config, item_id, tag, CAST(round(CAST(conf AS DECIMAL(18, 9)), 4) AS DOUBLE) AS conf FROM tabs WHERE conf >= 0.05),
w AS (SELECT config, idf, 's' || t AS tag, CASE WHEN idf THEN ln(((SELECT count(*) FROM n_images) + 1) / ((SELECT count(*) FROM v WHERE v.config = c.config AND v.tag = 's' || t AND v.conf >= 0.2) + 1)) + 1 ELSE 1.0 END AS x FROM (SELECT unnest(['max', 'mean']) AS config) c, (SELECT unnest([false, true]) AS idf), range(20) r(t)),
fi AS (SELECT item_id, min(image_no) AS image_no FROM images WHERE item_id % 20 = 0 GROUP BY item_id),
q AS (SELECT img.item_id AS query_id, tag, conf FROM img JOIN fi USING (item_id, image_no)),
vn AS (SELECT config, idf, item_id, tag, conf * x / sqrt(sum(conf * x * conf * x) OVER (PARTITION BY config, idf, item_id)) AS w FROM v JOIN w USING (config, tag)),
qn AS (SELECT config, idf, query_id, tag, conf * x / sqrt(sum(conf * x * conf * x) OVER (PARTITION BY config, idf, query_id)) AS w FROM q JOIN w USING (tag)),
sc AS (SELECT config, idf, query_id, item_id, round(sum(qn.w * vn.w), 9) AS score FROM qn JOIN vn USING (config, idf, tag) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY config, idf, query_id ORDER BY score DESC, item_id) AS r FROM sc),
an AS (SELECT config, idf, f.item_id AS query_id, coalesce((SELECT r FROM rk WHERE rk.config = c.config AND rk.idf = i.idf AND rk.query_id = f.item_id AND rk.item_id = f.item_id), 1000000000) AS r FROM fi f, (SELECT unnest(['max', 'mean']) AS config) c, (SELECT unnest([false, true]) AS idf) i),
grid AS (SELECT config, idf, count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS hit5, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0 END), 6) AS hit10, CAST(row_number() OVER (ORDER BY config, idf) AS INTEGER) AS ord FROM an GROUP BY config, idf)"""


def _grid(s: SparkSession, d: str) -> DataFrame:
    """Two image aggregations with and without weights; queries are first images of items whose id is divisible by 20."""
    tags, images = written(ad.image_tags(s, d), "tags"), ad.images(s, d)
    hows, by_item = ("max", "mean"), tags.select("item_id", "tag", "conf").repartition("item_id")  # moved once for both
    tables = [vectors.aggregate_images(by_item, images, how).withColumn("config", F.lit(how)) for how in hows]
    items = images.select("item_id").distinct().withColumn("config", F.explode(F.array(*map(F.lit, hows))))
    first = images.where("item_id % 20 = 0").groupBy("item_id").agg(F.min("image_no").alias("image_no"))
    asked = tags.where("item_id % 20 = 0").join(first, ["item_id", "image_no"], "left_semi").select(F.col("item_id").alias("query_id"), "tag", "conf")
    answers = first.select(F.col("item_id").alias("query_id"), F.col("item_id").alias("answer_id"))
    vocab = s.range(20).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("tag"))
    grid = evaluate.compare(written(tables[0].unionByName(tables[1]), "vectors"), items, asked, answers, vocab)
    return grid.select("config", "idf", "n", *[F.round(c, 6).alias(c) for c in ("hit1", "hit5", "hit10")], "ord")


@query("WITH " + _GRID + " SELECT * FROM grid")
def e4_config_grid(s, d):
    return _grid(s, d)


@query("WITH " + _GRID + " SELECT * FROM grid ORDER BY hit10 DESC, hit5 DESC, hit1 DESC, ord LIMIT 1")
def e5_best_config(s, d):
    return evaluate.best_config(_grid(s, d))


@query("SELECT CAST(user_id AS VARCHAR) AS item_id, max(event_id) AS at, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def r1_stream_update(s, d):
    """Events that arrive in files, as a stream: the newest of each user, whatever the order of arrival."""
    schema = "item_id string, at long, value double"
    source, sink, checkpoint = (scratch_path(s, n) for n in ("arriving", "parts", "progress"))
    rows = ad.read(s, d, "events").select(F.col("user_id").cast("string").alias("item_id"), F.col("event_id").alias("at"), "value")
    rows.withColumn("f", F.pmod(F.xxhash64("at"), F.lit(4))).repartition(4, "f").drop("f").write.parquet(source)
    ingest.stream_update(s, source, schema, sink, checkpoint, ["at"])
    return ingest.snapshot(s, schema, sink, ["at"])


@query("SELECT CAST(user_id AS VARCHAR) AS item_id, epoch_us(max(ts)) AS at, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def r1_keyed_state(s, d):
    """As r1_stream_update, with each user's newest event as state of the stream and a watermark as wide as the events' span,
    as files come in any order."""
    schema = "item_id string, at long, event_id long, value double"
    source, sink, checkpoint = (scratch_path(s, n) for n in ("arriving", "parts", "progress"))
    events = ad.read(s, d, "events")
    rows = events.select(F.col("user_id").cast("string").alias("item_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "value")
    rows.withColumn("f", F.pmod(F.xxhash64("event_id"), F.lit(4))).repartition(4, "f").drop("f").write.parquet(source)
    span = rows.agg(F.max("at") - F.min("at")).first()[0] or 0
    ingest.keyed_update(s, source, schema, sink, checkpoint, ["at", "event_id"], late=f"{span // 1_000_000 + 1} seconds")
    return ingest.snapshot(s, schema, sink, ["at", "event_id"]).drop("event_id")


_MORE = sql.DICTIONARY + ", o AS (SELECT DISTINCT lower(p_type) || ' ' || CASE WHEN p_size < 12 THEN '|' ELSE '' END || tag AS key, 'x_' || tag AS tag FROM words WHERE p_size BETWEEN 8 AND 12), n AS (SELECT split_part(key, '|', 1) AS prefix, split_part(key, '|', 2) AS base, tag FROM o WHERE key LIKE '%|%')"


@query("WITH " + _MORE + " SELECT coalesce(c.prefix, n.prefix) AS prefix, coalesce(c.base, n.base) AS base, coalesce(n.tag, c.tag) AS tag FROM combos c FULL JOIN n ON n.prefix = c.prefix AND n.base = c.base")
def t3_merge_combos(s, d):
    """Compounds with an overlay's, some of whose keys have no separator and do not count."""
    part = ad.read(s, d, "part").withColumn("tag", F.translate("p_name", " ", "_")).where("p_size between 8 and 12")
    over = part.select(F.concat(F.lower("p_type"), F.lit(" "), F.when(F.col("p_size") < 12, "|").otherwise(""), "tag").alias("key"), F.concat(F.lit("x_"), "tag").alias("tag")).distinct()
    return resolve.merge_combos(ad.dictionary(s, d)[2], over)[0]


@query("WITH b AS (SELECT p_brand AS src, p_type AS dst, min(p_partkey) AS ord FROM part WHERE p_size < 25 GROUP BY ALL), o AS (SELECT p_brand AS src, p_type AS dst, min(p_partkey) AS ord FROM part WHERE p_size > 40 AND p_size % 2 = 0 GROUP BY ALL) SELECT * FROM b UNION ALL SELECT src, dst, ord + (SELECT max(ord) FROM b) + 1 - (SELECT min(p_partkey) FROM part WHERE p_size > 40) FROM o ANTI JOIN b USING (src, dst)")
def t3_merge_morph(s, d):
    """Replacements with an overlay's, known ones and those that are no pairs left out."""
    part = ad.read(s, d, "part").select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst"), F.col("p_partkey").alias("ord"), "p_size")
    base = part.where("p_size < 25").groupBy("src", "dst").agg(F.min("ord").alias("ord"))
    return resolve.merge_morph(base, part.where("p_size > 40").select("src", "dst", "ord", (2 - F.col("p_size") % 2).alias("parts")))[0]
