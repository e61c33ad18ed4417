"""Shared parts of the SQL that states what the queries return."""

RAW = "raw AS (SELECT CAST(vec_id AS VARCHAR) AS item_id, 't' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS tag, i - 1 AS pos, 3 * CAST(x AS DOUBLE) AS score FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))"
SCORES = RAW + ", scores AS (SELECT item_id, tag, pos, least(1.0, greatest(0.0, score)) AS score FROM raw)"
VECTORS = SCORES + """,
full_v AS (SELECT item_id, tag, round(score, 4) AS conf FROM scores WHERE score >= 0.05),
hair_v AS (SELECT f.* FROM full_v f WHERE CAST(substr(tag, 2) AS INTEGER) < 40),
items AS (SELECT CAST(vec_id AS VARCHAR) AS item_id FROM embeddings),
vocab AS (SELECT 't' || lpad(CAST(range AS VARCHAR), 2, '0') AS tag FROM range(40))"""
IDF = VECTORS + """,
freq AS (SELECT v.tag, count(h.item_id) AS df FROM vocab v LEFT JOIN hair_v h ON h.tag = v.tag AND h.conf >= 0.2 GROUP BY v.tag),
idf AS (SELECT tag, ln(((SELECT count(*) FROM items) + 1) / (df + 1)) + 1 AS idf FROM freq)"""
ASKED = "CAST({0}.item_id AS INTEGER) % 20 = 0"
PARTLY = ASKED + " AND CAST(substr({0}.tag, 2) AS INTEGER) % 3 <> 2"
_RANKING = IDF + """,
hw AS (SELECT item_id, tag, conf * idf AS x FROM hair_v JOIN idf USING (tag)),
hn AS (SELECT item_id, tag, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS w FROM hw),
qw AS (SELECT item_id AS query_id, tag, conf * idf AS x FROM hair_v h JOIN idf USING (tag) WHERE @h),
qn AS (SELECT query_id, tag, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS w FROM qw),
fn AS (SELECT item_id, tag, conf / sqrt(sum(conf * conf) OVER (PARTITION BY item_id)) AS w FROM full_v),
gn AS (SELECT item_id AS query_id, tag, conf / sqrt(sum(conf * conf) OVER (PARTITION BY item_id)) AS w FROM full_v f WHERE @f),
grid AS (SELECT q.query_id, i.item_id FROM (SELECT DISTINCT query_id FROM qn) q, items i),
base AS (SELECT query_id, item_id, coalesce(s, 0) AS score FROM grid LEFT JOIN (SELECT query_id, item_id, sum(qn.w * hn.w) AS s FROM qn JOIN hn USING (tag) GROUP BY ALL) USING (query_id, item_id)),
fsc AS (SELECT query_id, item_id, coalesce(s, 0) AS score FROM grid LEFT JOIN (SELECT query_id, item_id, sum(gn.w * fn.w) AS s FROM gn JOIN fn USING (tag) GROUP BY ALL) USING (query_id, item_id)),
bm AS (SELECT query_id, item_id, round(score, 9) AS score FROM base), fm AS (SELECT query_id, item_id, round(score, 9) AS score FROM fsc),
norm AS (
  SELECT b.query_id, b.item_id, (b.score - min(b.score) OVER q) / (max(b.score) OVER q - min(b.score) OVER q + 1e-9) AS b,
    (f.score - min(f.score) OVER q) / (max(f.score) OVER q - min(f.score) OVER q + 1e-9) AS f
  FROM bm b JOIN fm f USING (query_id, item_id) WINDOW q AS (PARTITION BY b.query_id)
),
ranks AS (
  SELECT b.query_id, b.item_id, row_number() OVER (PARTITION BY b.query_id ORDER BY b.score DESC, b.item_id) AS rb, row_number() OVER (PARTITION BY b.query_id ORDER BY f.score DESC, b.item_id) AS rf
  FROM bm b JOIN fm f USING (query_id, item_id)
),
methods AS (
  SELECT 'base' AS method, query_id, item_id, score FROM bm UNION ALL SELECT 'full', query_id, item_id, score FROM fm
  UNION ALL SELECT 'rrf', query_id, item_id, round(1 / (60 + rb) + 1 / (60 + rf), 9) FROM ranks
  UNION ALL SELECT 'blend' || a, query_id, item_id, round(a * b + (1 - a) * f, 9) FROM norm, (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7]) AS a)
)"""
RANKING, RANKING_PARTLY = (_RANKING.replace("@h", asked.format("h")).replace("@f", asked.format("f")) for asked in (ASKED, PARTLY))
STATS = """stats AS (
  SELECT CAST(user_id AS VARCHAR) AS item_id, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS INTEGER) AS wish,
    CASE WHEN user_id % 7 = 0 THEN '' ELSE strftime(min(ts), '%Y-%m-%d %H:%M:%S') END AS published_at,
    CASE WHEN user_id % 5 <> 0 THEN strftime(max(ts), '%Y-%m-%d %H:%M:%S') END AS checked_at
  FROM events GROUP BY user_id)"""
LISTING = """listing AS (
  SELECT CAST(n // 60 + 1 AS INTEGER) AS page, CAST(n % 60 AS INTEGER) AS pos, CAST(o_custkey AS VARCHAR) AS item_id
  FROM (SELECT o_custkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS n FROM orders)),
catalog AS (SELECT CAST(c_custkey AS VARCHAR) AS item_id FROM customer WHERE c_custkey % 50 <> 0)"""
IMAGES = """images AS (SELECT o_custkey AS item_id, o_orderkey AS image_no FROM orders),
n_images AS (SELECT item_id, count(DISTINCT image_no) AS n FROM images GROUP BY item_id),
img AS (SELECT o_custkey AS item_id, o_orderkey AS image_no, 's' || (l_suppkey % 20) AS tag, max(l_quantity) / 50 AS conf FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
DICTIONARY = """words AS (SELECT *, replace(p_name, ' ', '_') AS tag FROM part),
vocab AS (SELECT DISTINCT tag FROM words),
syn AS (SELECT p_brand AS surface, min(tag) AS tag, min(p_partkey) AS ord FROM words GROUP BY p_brand),
combos AS (SELECT DISTINCT lower(p_type) || ' ' AS prefix, tag AS base, lower(p_type) || '_' || tag AS tag FROM words WHERE p_size <= 10),
overlay AS (SELECT p_brand AS surface, max(tag) AS tag, max(p_partkey) AS ord FROM words WHERE p_size > 49 GROUP BY p_brand UNION ALL SELECT p_type, max(tag), max(p_partkey) FROM words WHERE p_size > 40 GROUP BY p_type)"""
RESOLVED = DICTIONARY + """,
tok AS (SELECT DISTINCT unnest([p_name, p_brand, upper(p_brand), p_type || ' ' || p_brand, ' ' || split_part(p_name, ' ', -1) || ' ', p_name || ' XL', p_type]) AS token FROM part),
n AS (SELECT token, trim(token) AS t, lower(trim(token)) AS norm, replace(lower(trim(token)), ' ', '_') AS us FROM tok),
made AS (SELECT token, coalesce(c.tag, s.tag) AS tag FROM n JOIN (SELECT DISTINCT prefix FROM combos) p ON starts_with(norm, p.prefix) JOIN syn s ON lower(s.surface) = substr(norm, length(p.prefix) + 1)
  LEFT JOIN combos c ON c.prefix = p.prefix AND c.base = s.tag QUALIFY row_number() OVER (PARTITION BY token ORDER BY length(p.prefix) DESC) = 1),
near AS (SELECT token, tag FROM n JOIN vocab ON contains(tag, us) OR contains(us, tag) QUALIFY row_number() OVER (PARTITION BY token ORDER BY length(tag), tag) = 1),
resolved AS (SELECT token, coalesce(e.tag, s.tag, i.tag, made.tag, u.tag, near.tag) AS tag FROM n LEFT JOIN vocab e ON e.tag = t LEFT JOIN syn s ON s.surface = t LEFT JOIN syn i ON lower(i.surface) = norm
  LEFT JOIN made USING (token) LEFT JOIN vocab u ON u.tag = us LEFT JOIN near USING (token))"""
