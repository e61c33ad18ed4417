"""Queries over the given tables, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions import fields
from tagweave.operators import blocks, browse, catalog, entities, evaluate, pages, resolve, search, vectors
from tagweave.plans import adapters as ad
from tagweave.plans import sql
from tagweave.sources import readers
from tagweave.sources.scratch import written

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _weights(s: SparkSession, d: str) -> DataFrame:
    return vectors.idf(vectors.doc_freq(ad.hair(s, d), ad.vocab(s)), ad.items(s, d))


def _sides(s: SparkSession, d: str, ask=ad.queries) -> tuple[DataFrame, DataFrame]:
    """(items, queries) with both sides' weights of length one, for products of blocks: the items in blocks, the queries packed;
    written once."""
    h, f, w = ad.hair(s, d), ad.full(s, d), _weights(s, d)
    items = blocks.packed("item_id", ad.items(s, d), vectors.normalize(h, w), vectors.normalize(f))
    return blocks.dealt(items, "item_id", ids=ad.items(s, d)), _asked(h, vectors.normalize(ask(h), w, "query_id"), vectors.normalize(ask(f), None, "query_id"), ask)


def _asked(h: DataFrame, base: DataFrame, full: DataFrame | None = None, ask=ad.queries) -> DataFrame:
    """Packed queries: those that have a tag of the vocabulary."""
    return written(blocks.packed("query_id", ask(h).select("query_id").distinct(), base, full), "queries")


def _best(s: SparkSession, d: str, ask=ad.queries, k: int = 10) -> DataFrame:
    """The k best items of each query by IDF-weighted cosine."""
    h, w = ad.hair(s, d), written(_weights(s, d), "weights")
    items = blocks.dealt(blocks.packed("item_id", ad.items(s, d), vectors.normalize(h, w)), "item_id", ids=ad.items(s, d))
    return blocks.best(items, _asked(h, vectors.normalize(ask(h), w, "query_id"), ask=ask), blocks.SIDES[:1], k)


def _six(df: DataFrame, by: tuple = ()) -> DataFrame:
    return df.select(*by, "query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def _top(table: str, score: str, k: int = 10) -> str:
    return f"SELECT query_id, item_id, round({score}, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, item_id) AS rank FROM {table} QUALIFY rank <= {k}"


@query("WITH " + sql.RANKING + " " + _top("bm", "score"))
def v4_hair_search(s, d):
    """Ten best items per query by IDF-weighted cosine."""
    return _six(_best(s, d))


@query("WITH " + sql.RANKING + " " + _top("fm", "score"))
def v5_full_search(s, d):
    h, f = ad.hair(s, d), ad.full(s, d)
    items = blocks.dealt(blocks.packed("item_id", ad.items(s, d), vectors.normalize(f)), "item_id", ids=ad.items(s, d))
    return _six(blocks.best(items, _asked(h, vectors.normalize(ad.queries(f), None, "query_id")), blocks.SIDES[:1]))


@query("WITH " + sql.RANKING + " " + _top("norm", "0.6 * b + 0.4 * f"))
def v6_hybrid_search(s, d):
    items, queries = _sides(s, d)
    return _six(blocks.best(items, blocks.with_bounds(items, queries), [("hybrid", "hybrid")]))


@query("WITH " + sql.RANKING + ", sweep AS (SELECT a AS alpha, query_id, item_id, round(a * b + (1 - a) * f, 9) AS x FROM norm, (SELECT unnest([CAST(0.3 AS DOUBLE), 0.4, 0.5, 0.6, 0.7]) AS a)) SELECT alpha, query_id, item_id, round(x, 6) AS score, row_number() OVER (PARTITION BY alpha, query_id ORDER BY x DESC, item_id) AS rank FROM sweep QUALIFY rank <= 10")
def v7_blend_sweep(s, d):
    """Ten best items per query and weight of the blend."""
    items, queries = _sides(s, d)
    found = blocks.best(items, blocks.with_bounds(items, queries), [(str(a), a) for a in search.SWEEP])
    return _six(found.withColumn("alpha", F.col("method").cast("double")), ("alpha",))


@query("WITH " + sql.RANKING + " " + _top("(SELECT query_id, item_id, 1 / (60 + rb) + 1 / (60 + rf) AS x FROM ranks)", "x"))
def v8_rank_fusion(s, d):
    return _six(blocks.fused_best(*_sides(s, d)))


@query("WITH " + sql.RANKING + " SELECT query_id, item_id, round(b, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, item_id) AS rank FROM norm QUALIFY rank <= 10")
def w3_minmax(s, d):
    """Normalised scores of the ten best items per query: bounds are those over all items."""
    items, queries = _sides(s, d)
    asked = blocks.with_bounds(items, queries)
    found = blocks.best(items, asked, blocks.SIDES[:1]).join(asked.select("query_id", "lo_base", "hi_base"), "query_id")
    score = (F.col("score") - F.col("lo_base")) / (F.col("hi_base") - F.col("lo_base") + 1e-9)
    return found.select("query_id", "item_id", F.round(score, 5).alias("score"), "rank")


_OWN = sql.RANKING_PARTLY + ", own AS (SELECT m.method, m.query_id, (SELECT count(*) FROM methods o WHERE o.method = m.method AND o.query_id = m.query_id AND (o.score > m.score OR (o.score = m.score AND o.item_id < m.item_id))) + 1 AS rank FROM methods m WHERE m.item_id = m.query_id)"
_HITS = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END), 6) AS hit{k}" for k in (1, 5, 10))


def _answer_ranks(s: SparkSession, d: str) -> DataFrame:
    """(method, query_id, answer_id, rank) by base, full, fusion and five blends, for queries with a part of their items' tags."""
    items, queries = _sides(s, d, ad.partial_queries)
    queries = blocks.with_bounds(items, queries)
    methods = blocks.SIDES + [(f"blend{a}", a) for a in search.SWEEP]
    answers = queries.select("query_id", F.col("query_id").alias("item_id"))
    plain = written(blocks.ranks(items, queries, answers, methods), "ranks").select("method", "query_id", "item_id", "rank")
    fused = blocks.fused_ranks(items, queries, plain.where("method in ('base', 'full')")).select(F.lit("rrf").alias("method"), "query_id", "item_id", "rank")
    wanted = answers.select("query_id", F.col("item_id").alias("answer_id"), F.explode(F.array(*[F.lit(m) for m, _ in [*methods, ("rrf", 0)]])).alias("method"))
    return evaluate.answer_rank(plain.unionAll(fused), wanted, ("method",))


@query("WITH " + _OWN + " SELECT method, query_id, rank FROM own")
def e2_answer_ranks(s, d):
    """Ranks of the answers among all items, however far down."""
    return _answer_ranks(s, d).select("method", "query_id", "rank")


@query("WITH " + _OWN + f" SELECT method, count(*) AS n, {_HITS} FROM own GROUP BY method")
def e6_method_table(s, d):
    """Hit rates of base, full, fusion and five blends."""
    return evaluate.hit_rate(_answer_ranks(s, d), ("method",)).select("method", "n", *[F.round(c, 6).alias(c) for c in ("hit1", "hit5", "hit10")])


@query("WITH " + _OWN + ", asked AS (SELECT query_id, CASE WHEN CAST(query_id AS INTEGER) % 60 = 0 THEN 'gone' ELSE CAST(CAST(query_id AS INTEGER) + 1 AS VARCHAR) END AS answer_id FROM (SELECT DISTINCT query_id FROM bm)), r AS (SELECT a.query_id, m.item_id, (SELECT count(*) FROM bm o WHERE o.query_id = a.query_id AND (o.score > m.score OR (o.score = m.score AND o.item_id < m.item_id))) + 1 AS rank FROM asked a LEFT JOIN bm m ON m.query_id = a.query_id AND m.item_id = a.answer_id)"
       f" SELECT false AS found_only, count(*) AS n, {_HITS} FROM (SELECT coalesce(CASE WHEN item_id IS NOT NULL THEN rank END, 1000000000) AS rank FROM r) UNION ALL SELECT true, count(*), {_HITS} FROM r WHERE item_id IS NOT NULL")
def e3_hit_rates(s, d):
    """Hit rates over all queries and over those whose answer is in the table: answers are the next item, some are gone."""
    items, queries = _sides(s, d, ad.partial_queries)
    n = F.col("query_id").cast("int")
    answers = queries.select("query_id", F.when(n % 60 == 0, "gone").otherwise((n + 1).cast("string")).alias("answer_id"))
    found = blocks.ranks(items, queries, answers.withColumnRenamed("answer_id", "item_id"), blocks.SIDES[:1])
    ranks = written(evaluate.answer_rank(found, answers), "ranks")
    both = [evaluate.hit_rate(ranks, found_only=f).withColumn("found_only", F.lit(f)) for f in (False, True)]
    return both[0].unionByName(both[1]).select("found_only", "n", *[F.round(c, 6).alias(c) for c in ("hit1", "hit5", "hit10")])


@query("WITH " + sql.IDF + " SELECT tag, df FROM freq")
def g6_doc_freq(s, d):
    return vectors.doc_freq(ad.hair(s, d), ad.vocab(s))


@query("WITH " + sql.IDF + " SELECT tag, round(idf, 9) AS idf FROM idf")
def v1_idf(s, d):
    return _weights(s, d).select("tag", F.round("idf", 9).alias("idf"))


@query("WITH " + sql.IDF + " (SELECT tag, round(idf, 9) AS idf, 'low' AS side FROM idf ORDER BY idf.idf, tag LIMIT 5) UNION ALL (SELECT tag, round(idf, 9), 'high' FROM idf ORDER BY idf.idf DESC, tag LIMIT 5)")
def g11_idf_extremes(s, d):
    return vectors.idf_extremes(_weights(s, d)).select("tag", F.round("idf", 9).alias("idf"), "side")


@query("WITH " + sql.RANKING + " SELECT item_id, tag, round(w, 9) AS w FROM hn")
def v2_normalize(s, d):
    return vectors.normalize(ad.hair(s, d), _weights(s, d)).select("item_id", "tag", F.round("w", 9).alias("w"))


@query("WITH " + sql.RANKING + " SELECT query_id, tag, round(w, 9) AS w FROM qn")
def v3_normalize_query(s, d):
    return vectors.normalize(ad.queries(ad.hair(s, d)), _weights(s, d), "query_id").select("query_id", "tag", F.round("w", 9).alias("w"))


@query("WITH " + sql.VECTORS + " SELECT * FROM hair_v")
def c5_to_vector(s, d):
    return ad.hair(s, d)


@query("WITH " + sql.RAW + ", b AS (SELECT item_id, min(score) < 0 OR max(score) > 1 AS outside FROM raw GROUP BY item_id) SELECT item_id, tag, round(CASE WHEN outside THEN 1 / (1 + exp(-score)) ELSE score END, 9) AS score FROM raw JOIN b USING (item_id)")
def p2_calibrate(s, d):
    return vectors.calibrate_scores(ad.raw_scores(s, d), "item_id").select("item_id", "tag", F.round("score", 9).alias("score"))


@query("WITH " + sql.SCORES + " SELECT item_id, tag, score FROM scores WHERE pos % 3 = 0")
def p1_general_scores(s, d):
    labels = s.range(64).select(F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("name"), F.expr("cast(case when id % 3 = 0 then 0 when id % 3 = 1 then 4 else 9 end as int)").alias("category"))
    return vectors.general_scores(ad.scores(s, d), labels).select("item_id", "tag", "score")


@query("WITH " + sql.SCORES + " SELECT item_id AS query_id, tag, round(score, 3) AS conf, round(score, 3) >= 0.2 AS strong FROM scores WHERE score >= 0.05 AND pos < 40")
def c6_extract_query(s, d):
    return vectors.extract_query(ad.scores(s, d).withColumnRenamed("item_id", "query_id"), ad.vocab(s))


@query("WITH " + sql.VECTORS + ", det AS (SELECT item_id AS query_id, tag, conf FROM hair_v), sel AS (SELECT item_id AS query_id, tag FROM scores WHERE pos < 40 AND pos % 2 = 0 AND score >= 0.15) SELECT query_id, tag, coalesce(conf, 1.0) AS conf FROM det FULL JOIN (SELECT *, true AS chosen FROM sel) USING (query_id, tag) WHERE chosen OR conf < 0.2")
def c7_edit_query(s, d):
    chosen = ad.scores(s, d).where("pos < 40 and pos % 2 = 0 and score >= 0.15").select(F.col("item_id").alias("query_id"), "tag")
    return vectors.edit_query(ad.hair(s, d).withColumnRenamed("item_id", "query_id"), chosen)


@query("WITH " + sql.VECTORS + " SELECT item_id, tag, conf, row_number() OVER (PARTITION BY item_id ORDER BY conf DESC, tag) AS rank FROM full_v QUALIFY rank <= 12")
def w2_top_tags(s, d):
    return vectors.top_tags(ad.full(s, d))


@query("WITH " + sql.VECTORS + " SELECT DISTINCT item_id FROM hair_v WHERE tag IN ('t03', 't17') AND conf >= 0.2")
def p4_contains_any(s, d):
    return browse.contains_any(ad.hair(s, d), ["t03", "t17"])


@query("WITH " + sql.VECTORS + " SELECT DISTINCT tag FROM full_v")
def x4_full_vocab(s, d):
    return vectors.full_vocab(ad.full(s, d))


@query("WITH " + sql.VECTORS + ", n AS (SELECT tag, count(*) FILTER (WHERE CAST(item_id AS INTEGER) % 2 = 0) AS a, count(*) FILTER (WHERE CAST(item_id AS INTEGER) % 2 = 1) AS b FROM full_v WHERE conf >= 0.4 GROUP BY tag), m AS (SELECT avg(a) AS a, avg(b) AS b FROM n) SELECT tag, CASE WHEN n.b >= m.b THEN 'added' ELSE 'removed' END AS change FROM n, m WHERE (n.a >= m.a) <> (n.b >= m.b)")
def x3_vocab_diff(s, d):
    """Tags that more items than the average tag have strongly: of items with odd ids against those with even ones."""
    n = ad.full(s, d).where("conf >= 0.4").groupBy("tag").agg(F.count_if(F.expr("cast(item_id as int) % 2 = 0")).alias("a"), F.count_if(F.expr("cast(item_id as int) % 2 = 1")).alias("b"))
    often = lambda c: n.join(n.agg(F.avg(c).alias("m")), F.col(c) >= F.col("m")).select("tag")
    return vectors.vocab_diff(often("a"), often("b"))


@query("WITH " + sql.VECTORS + " SELECT t.tag, count(DISTINCT f.item_id) AS n_items FROM (SELECT 't' || range AS tag FROM range(60, 70)) t LEFT JOIN full_v f USING (tag) GROUP BY t.tag")
def g9_tag_coverage(s, d):
    return vectors.tag_coverage(ad.full(s, d), s.range(60, 70).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("tag")))


@query("WITH " + sql.VECTORS + " SELECT item_id, tag, conf, true AS fresh FROM full_v WHERE CAST(substr(tag, 2) AS INTEGER) < 48 AND CAST(item_id AS INTEGER) % 4 <> 0 UNION ALL SELECT item_id, tag, conf, false FROM hair_v WHERE CAST(item_id AS INTEGER) % 4 = 0")
def v9_rebuild(s, d):
    fresh = ad.scores(s, d).where("cast(item_id as int) % 4 <> 0")
    wider = s.range(48).select(F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("tag"))
    return vectors.rebuild_vectors(fresh, wider, ad.hair(s, d), fresh.select("item_id").distinct())


_CUT = " SELECT item_id, tag, CAST(round(CAST(conf AS DECIMAL(18, 9)), 4) AS DOUBLE) AS conf FROM out WHERE conf >= 0.05"


def _images(how: str):
    return lambda s, d: vectors.aggregate_images(ad.image_tags(s, d), ad.images(s, d), how)


QUERIES |= {f"g{i}_images_{how}": _images(how) for i, how in enumerate(("max", "mean", "best", "cons2"), 1)}
ORACLES |= {
    "g1_images_max": "WITH " + sql.IMAGES + ", out AS (SELECT item_id, tag, max(conf) AS conf FROM img GROUP BY ALL)" + _CUT,
    "g2_images_mean": "WITH " + sql.IMAGES + ", out AS (SELECT item_id, tag, round(sum(conf) / any_value(n), 9) AS conf FROM img JOIN n_images USING (item_id) GROUP BY item_id, tag)" + _CUT,
    "g3_images_best": "WITH " + sql.IMAGES + ", t AS (SELECT item_id, image_no, round(sum(conf), 9) AS s FROM img GROUP BY ALL), b AS (SELECT item_id, image_no FROM t QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, image_no) = 1), out AS (SELECT item_id, tag, conf FROM img JOIN b USING (item_id, image_no))" + _CUT,
    "g4_images_cons2": "WITH " + sql.IMAGES + ", r AS (SELECT item_id, tag, conf, row_number() OVER (PARTITION BY item_id, tag ORDER BY conf DESC) AS r, n FROM img JOIN n_images USING (item_id)), out AS (SELECT item_id, tag, conf FROM r WHERE (n = 1 AND r = 1) OR (n > 1 AND r = 2))" + _CUT,
}


@query("WITH " + sql.IMAGES + ", multi AS (SELECT item_id FROM n_images WHERE n > 1), m AS (SELECT item_id, tag, round(max(conf), 4) AS conf FROM img WHERE item_id IN (FROM multi) GROUP BY item_id, tag), one AS (SELECT item_id, tag, round(max(conf), 4) AS conf FROM img GROUP BY item_id, tag) SELECT * FROM m WHERE conf >= 0.05 UNION ALL SELECT * FROM one WHERE item_id NOT IN (FROM multi)")
def g5_fallback(s, d):
    """Items of several images by maximum, others by their single image."""
    several = ad.images(s, d).groupBy("item_id").count().where("count > 1").select("item_id")
    tags = ad.image_tags(s, d)
    agg = vectors.aggregate_images(tags.join(several, "item_id", "left_semi"), ad.images(s, d), "max")
    single = tags.groupBy("item_id", "tag").agg(F.round(F.max("conf"), 4).alias("conf"))
    return vectors.with_fallback(agg, several, single)


_RESULTS = sql.RANKING + ", " + sql.STATS + ", res AS (SELECT query_id, item_id, score, coalesce(wish, 0) AS wish, coalesce(published_at, '') AS published_at FROM bm LEFT JOIN stats USING (item_id) WHERE item_id IN (SELECT item_id FROM hair_v WHERE tag IN ('t03', 't17') AND conf >= 0.2))"


def _filtered(s: SparkSession, d: str, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items of kept (item_id), queries), packed, with IDF-weighted tags of length one."""
    h, w = ad.hair(s, d), written(_weights(s, d), "weights")
    items = blocks.packed("item_id", kept, vectors.normalize(h.join(kept, "item_id", "left_semi"), w))
    return written(items, "items"), _asked(h, vectors.normalize(ad.queries(h), w, "query_id"))


def _listed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items that pass the tag filter, packed; queries; the items with what is known of them)."""
    kept = written(browse.contains_any(ad.hair(s, d), ["t03", "t17"]), "kept")
    items, queries = _filtered(s, d, kept)
    known = kept.join(ad.stats(s, d), "item_id", "left").select("item_id", F.coalesce("wish", F.lit(0)).alias("wish"), F.coalesce("published_at", F.lit("")).alias("published_at"))
    return items, queries, known


_NORM = "CASE WHEN max({0}) OVER q = min({0}) OVER q THEN 0.5 ELSE ({0} - min({0}) OVER q) / (max({0}) OVER q - min({0}) OVER q) END"
_PAGE = ", k AS ({0}), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sort_key DESC, item_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM k) SELECT query_id, item_id, round(sort_key, 6) AS sort_key, rank, total FROM n WHERE rank BETWEEN 11 AND 20"


@query("WITH " + _RESULTS + _PAGE.format(f"SELECT *, round(0.6 * {_NORM.format('score')} + 0.4 * {_NORM.format('ln(1 + wish)')}, 9) AS sort_key FROM res WINDOW q AS (PARTITION BY query_id)"))
def w4_popular_page(s, d):
    """Second page of the filtered list, similar and popular first."""
    items, queries, known = _listed(s, d)
    done = pages.merged_page(items, queries, pages.popularity(known), 2)
    return done.select("query_id", "item_id", F.round("sort_key", 6).alias("sort_key"), "rank", "total")


@query("WITH " + _RESULTS + ", p AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY published_at <> '', TRY_CAST(nullif(published_at, '') AS TIMESTAMP) NULLS FIRST, CAST(item_id AS BIGINT), item_id) - 1) / greatest(1, count(*) OVER (PARTITION BY query_id) - 1) AS rec FROM res)" + _PAGE.format(f"SELECT *, round(0.6 * {_NORM.format('score')} + 0.4 * rec, 9) AS sort_key FROM p WINDOW q AS (PARTITION BY query_id)"))
def w5_recent_page(s, d):
    items, queries, known = _listed(s, d)
    done = pages.merged_page(items, queries, pages.recency(known), 2)
    return done.select("query_id", "item_id", F.round("sort_key", 6).alias("sort_key"), "rank", "total")


@query("WITH " + _RESULTS + ", n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM res), c AS (SELECT *, greatest(1, CAST(ceil(total / 10) AS BIGINT)) AS pages FROM n) SELECT query_id, item_id, rank, total, pages, pages AS page, (pages - 1) * 10 + 1 AS shown_from, total AS shown_to FROM c WHERE rank > (pages - 1) * 10")
def w7_last_page(s, d):
    """A page number beyond the end shows the last page."""
    items, queries, _ = _listed(s, d)
    return pages.similar_page(items, queries, 10_000).select("query_id", "item_id", "rank", "total", "pages", "page", "shown_from", "shown_to")


@query("WITH " + sql.LISTING + ", f AS (SELECT item_id, page, pos FROM listing QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY page, pos) = 1) SELECT * FROM f ORDER BY page, pos LIMIT 500")
def w8_dedupe_listing(s, d):
    return catalog.dedupe_listing(ad.listing(s, d), 500).select("item_id", "page", "pos")


_NEW = sql.LISTING + """, seen AS (SELECT item_id, page, max(pos) AS pos FROM listing WHERE page <= 40 GROUP BY ALL),
f AS (SELECT item_id, page, pos FROM seen QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY page) = 1),
new AS (SELECT * FROM f WHERE item_id NOT IN (SELECT item_id FROM catalog)),
stop AS (SELECT min(p) AS p FROM range(1, 42) t(p) WHERE p > 40 OR p NOT IN (SELECT page FROM new))"""


@query("WITH " + _NEW + " SELECT * FROM new WHERE page < (SELECT p FROM stop)")
def u1_new_items(s, d):
    return catalog.new_items(ad.listing(s, d), ad.catalog(s, d)).select("item_id", "page", "pos")


@query("WITH " + sql.LISTING + """, f AS (SELECT item_id, page, pos FROM listing WHERE page <= 40 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY page, pos) = 1),
new AS (SELECT * FROM f WHERE CAST(item_id AS INTEGER) % 3 <> 0), have AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 3 = 0),
per AS (SELECT page, count(new.item_id) AS k FROM (SELECT DISTINCT page FROM listing WHERE page <= 40) LEFT JOIN new USING (page) GROUP BY page),
run AS (SELECT page, (SELECT n FROM have) + coalesce(sum(k) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM per)
SELECT * FROM new WHERE page IN (SELECT page FROM run WHERE reached < (SELECT n FROM have) + 200)""")
def w9_expand(s, d):
    have = ad.read(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("item_id"))
    return catalog.expand_to(have, ad.listing(s, d), more=200).select("item_id", "page", "pos")


@query("WITH " + sql.LISTING + ", " + sql.STATS + " SELECT item_id, coalesce(checked_at, '') AS checked_at FROM catalog LEFT JOIN stats USING (item_id) ORDER BY 2, 1 LIMIT 150")
def w10_refresh_batch(s, d):
    return catalog.refresh_batch(ad.catalog(s, d), ad.stats(s, d))


@query("WITH " + sql.STATS + ", fresh AS (SELECT item_id, wish + 1 AS wish, '2030-01-01' AS checked_at FROM stats WHERE CAST(item_id AS INTEGER) % 3 = 0) SELECT * FROM fresh UNION ALL SELECT item_id, wish, checked_at FROM stats WHERE item_id NOT IN (SELECT item_id FROM fresh)")
def u2_upsert_stats(s, d):
    old = ad.stats(s, d).select("item_id", "wish", "checked_at")
    return catalog.upsert(old, old.where("cast(item_id as int) % 3 = 0").select("item_id", (F.col("wish") + 1).alias("wish"), F.lit("2030-01-01").alias("checked_at")))


@query("WITH " + sql.STATS + ", " + sql.LISTING + " SELECT item_id FROM catalog UNION SELECT item_id FROM listing")
def u5_merge_catalog(s, d):
    return catalog.merge_catalog(ad.catalog(s, d), ad.listing(s, d).select("item_id").distinct())


@query("WITH " + sql.STATS + " SELECT item_id, wish FROM stats WHERE CAST(item_id AS INTEGER) % 11 <> 0")
def u4_prune(s, d):
    st = ad.stats(s, d).select("item_id", "wish")
    return catalog.prune(st, st.where("cast(item_id as int) % 11 = 0"))


@query("WITH " + sql.STATS + ", " + sql.LISTING + " SELECT item_id FROM catalog WHERE item_id NOT IN (SELECT item_id FROM stats WHERE checked_at IS NOT NULL)")
def j5_worklist(s, d):
    return catalog.worklist(ad.catalog(s, d), ad.stats(s, d), F.col("checked_at").isNotNull())


@query("WITH " + sql.STATS + " SELECT count(*) AS total, count(*) FILTER (WHERE wish > 0) AS wished, count(*) FILTER (WHERE published_at <> '') AS dated, count(*) FILTER (WHERE checked_at IS NOT NULL) AS checked FROM stats")
def g8_coverage(s, d):
    return catalog.coverage(ad.stats(s, d), {"wished": F.col("wish") > 0, "dated": F.col("published_at") != "", "checked": F.col("checked_at").isNotNull()})


@query("WITH " + sql.STATS + ", a AS (SELECT item_id, wish FROM stats WHERE CAST(item_id AS INTEGER) % 4 <> 0), b AS (SELECT item_id, CASE WHEN CAST(item_id AS INTEGER) % 6 = 0 THEN wish + 1 ELSE wish END AS wish FROM stats WHERE CAST(item_id AS INTEGER) % 5 <> 0) SELECT item_id, CASE WHEN a.wish IS NULL THEN 'added' WHEN b.wish IS NULL THEN 'removed' WHEN a.wish = b.wish THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b USING (item_id)")
def x5_diff_snapshots(s, d):
    st = ad.stats(s, d).select("item_id", "wish")
    new = st.where("cast(item_id as int) % 5 <> 0").withColumn("wish", F.expr("case when cast(item_id as int) % 6 = 0 then wish + 1 else wish end"))
    return vectors.diff_snapshots(st.where("cast(item_id as int) % 4 <> 0"), new, "item_id", ["wish"])


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_size AS wish, CAST(floor(CAST(trunc(p_retailprice) AS BIGINT)) AS BIGINT) AS price, p_brand || ', ' AS tags, trim(regexp_replace(p_name || ' ' || p_type, '\\s+', ' ', 'g')) AS \"desc\" FROM part")
def s5_item_json(s, d):
    done = readers.parse_item_json(ad.item_json(s, d))
    return done.select("item_id", "wish", "price", F.array_join("tags", ",").alias("tags"), "desc")


@query("SELECT page_id, substr(sha256(url), 1, 24) AS url_key, CASE WHEN url LIKE 'https://%' OR url LIKE 'http://%' THEN url ELSE 'https://example.com/items/' || page_id END AS safe_url FROM pages")
def p12_url_key(s, d):
    return ad.read(s, d, "pages").select("page_id", fields.url_key(F.col("url")).alias("url_key"), fields.safe_url(F.col("url"), F.col("page_id").cast("string")).alias("safe_url"))


@query("SELECT doc_id, substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 3000) AS description, lower(trim(text)) AS norm FROM documents")
def c3_descriptions(s, d):
    return ad.read(s, d, "documents").select("doc_id", fields.strip_desc(F.col("text")).alias("description"), fields.normalize_ja(F.col("text")).alias("norm"))


_META = """meta AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, 'Br' || substr(p_brand, 7, 2) AS br, p_name, p_size, translate(substr(p_brand, 7, 2), '0123456789', 'アイウエオカキクケコ') AS kana FROM part),
stated AS (SELECT DISTINCT item_id, br AS name FROM meta WHERE p_size % 2 = 0 OR p_size % 3 = 0 UNION SELECT item_id, p_name FROM meta WHERE p_size % 3 = 0 AND length(p_name) > 1),
alias AS (SELECT DISTINCT lower(br) AS low, kana FROM meta WHERE p_size % 5 = 0 AND length(kana) >= 2 AND br IN (SELECT name FROM stated)),
named AS (SELECT DISTINCT item_id, coalesce(kana, name) AS name FROM stated LEFT JOIN alias ON low = lower(name))"""


def _entities(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(item_id, name) and the aliases, over the seed names; the stated names and the aliases are written once, as both are
    read several times."""
    m = ad.meta(s, d)
    raw = written(entities.raw_names(m), "names")
    aliases = written(entities.mine_aliases(m, raw, entities.seed_names(s)), "aliases")
    return entities.canonical_names(raw, aliases), aliases


def _names(s: SparkSession, d: str) -> DataFrame:
    return _entities(s, d)[0]


@query("WITH " + _META + " SELECT item_id, array_to_string(list_sort(list(name)), ',') AS avatars FROM named GROUP BY item_id")
def a5_item_entities(s, d):
    """Names from tags and descriptions, through the mined aliases, per item."""
    return _names(s, d).groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("avatars"))


@query("WITH " + _META + " SELECT name, count(DISTINCT item_id) AS n_items FROM named GROUP BY name HAVING count(DISTINCT item_id) >= 2")
def g7_entity_vocab(s, d):
    return entities.avatar_vocab(_names(s, d))


@query("WITH " + sql.RESOLVED + " SELECT token, tag FROM resolved")
def t5_resolve_tags(s, d):
    """Each typed form's tag: exact, synonym, normal form, composed, underscored or contained."""
    return resolve.resolve_tags(ad.tokens(s, d), *ad.dictionary(s, d))


@query("WITH " + sql.DICTIONARY + " SELECT coalesce(syn.surface, o.surface) AS surface, coalesce(o.tag, syn.tag) AS tag, coalesce(syn.ord, o.ord + (SELECT max(ord) FROM syn) + 1 - (SELECT min(ord) FROM overlay)) AS ord FROM syn FULL JOIN overlay o ON o.surface = syn.surface")
def t3_merge_synonyms(s, d):
    return resolve.merge_synonyms(ad.dictionary(s, d)[1], ad.overlay(s, d))[0]


@query("WITH " + sql.DICTIONARY + " SELECT count(*) AS n FROM overlay o LEFT JOIN syn ON syn.surface = o.surface WHERE o.tag IS DISTINCT FROM syn.tag")
def t3_merge_changes(s, d):
    return resolve.merge_synonyms(ad.dictionary(s, d)[1], ad.overlay(s, d))[1]


@query("WITH " + sql.DICTIONARY + ", o AS (SELECT p_type || CASE WHEN p_size % 2 = 0 THEN '|' ELSE '' END || tag AS key, tag, p_size FROM words WHERE p_size < 6) SELECT 'combo' AS kind, prefix || '|' || base AS entry, tag FROM combos WHERE tag NOT IN (SELECT tag FROM vocab) UNION ALL SELECT 'synonym', surface, tag || '?' FROM syn WHERE ord % 2 = 0 UNION ALL SELECT 'key', key, tag FROM o WHERE key NOT LIKE '%|%' UNION ALL SELECT 'pair', p_name, NULL FROM words WHERE p_size > 45 AND p_size % 3 <> 2")
def t7_lint_dict(s, d):
    """Targets that the vocabulary lacks, keys without a separator and replacements that are no pairs."""
    vocab, synonyms, combos = ad.dictionary(s, d)
    part = ad.read(s, d, "part").withColumn("tag", F.translate("p_name", " ", "_"))
    keys = part.where("p_size < 6").select(F.concat("p_type", F.when(F.col("p_size") % 2 == 0, "|").otherwise(""), "tag").alias("key"), "tag")
    pairs = part.where("p_size > 45").select(F.col("p_name").alias("src"), (F.col("p_size") % 3).alias("parts"))
    typos = synonyms.withColumn("tag", F.when(F.col("ord") % 2 == 0, F.concat("tag", F.lit("?"))).otherwise(F.col("tag")))
    return resolve.lint_dict(typos, combos, vocab, keys, pairs)


@query("WITH " + sql.RANKING_PARTLY + """, best AS (SELECT CAST(query_id AS INTEGER) % 3 = 0 AS far, max(score) AS score FROM bm GROUP BY query_id),
sides AS (SELECT min(score) FILTER (NOT far) AS a, quantile_cont(score, 0.5) FILTER (NOT far) AS b, max(score) FILTER (NOT far) AS c, min(score) FILTER (far) AS d, quantile_cont(score, 0.5) FILTER (far) AS e, max(score) FILTER (far) AS f FROM best)
SELECT round(a, 6) AS min_scored, round(b, 6) AS median_scored, round(c, 6) AS max_scored, round(d, 6) AS min_distractor, round(e, 6) AS median_distractor, round(f, 6) AS max_distractor,
  CASE WHEN a > f THEN 'separable' WHEN b > e THEN 'shifted' ELSE 'not separable' END AS verdict, CASE WHEN a > f THEN round((a + f) / 2, 6) END AS threshold FROM sides""")
def e7_separability(s, d):
    """Best scores of the queries, every third of which counts as a distractor."""
    best = _best(s, d, ad.partial_queries, 1).select("score", (F.col("query_id").cast("int") % 3 == 0).alias("is_distractor"))
    done = evaluate.separability(best)
    return done.select(*[c if c == "verdict" else F.round(c, 6).alias(c) for c in done.columns])
