"""Queries of the training-data operators over the documents, labels, benchmark and conversations tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import alignment, decontaminate, language, mixing, near_dup, prefix_trie, privacy, quality, secret_scan, sentence_spans, token_frames, tool_calls, toxicity
from tagweave.llm.shared import durable


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def part_of_id(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed", "kept_chars"
    )


def op2_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frames.tokenised(spark, read(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(part_of_id(5) == 0, F.lit(False)))
    model = language.train(docs.where("not held_out and lang is not null"))
    return language.identify(docs.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = privacy.sanitise(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        *[privacy.count_kind(F.col("base_"), k).alias(f"n_{k}") for k in privacy.KINDS[:4]],
        F.sha2(privacy.span_string(F.col("base_")), 256).alias("base_sha256"),
        privacy.span_string(F.col("spans_")).alias("spans"),
        F.sha2("clean_text", 256).alias("clean_sha256"),
    )


#: Parameters of the one tool that as_tool_messages() calls.
TOOLS = (("ask", "prompt", "string", True, None), ("ask", "words", "integer", True, 8.0))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = spark.createDataFrame(list(TOOLS), "name string, param string, type string, required boolean, minimum double")
    return tool_calls.format_messages(tool_calls.as_tool_messages(read(spark, sf_dir, "conversations")), tools)


OP6_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, role, text,
    CASE WHEN role = 'user' THEN conv_id || '-' || turn WHEN role = 'assistant' THEN conv_id || '-' || (turn - 1) END AS call_id,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM conversations
), calls AS (SELECT * FROM m WHERE role = 'user'),
chain AS (
  SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) * 2 AS run FROM (SELECT DISTINCT conv_id, turn FROM calls)
), level AS (
  SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS INTEGER) AS level FROM chain
)
SELECT m.conv_id, m.turn, m.role, m.call_id, l.level,
  CASE WHEN m.role = 'user' THEN
         CASE WHEN m.words < 8 THEN 'invalid' WHEN EXISTS (SELECT 1 FROM m r WHERE r.role = 'assistant' AND r.call_id = m.call_id) THEN 'linked' ELSE 'no_result' END
       WHEN m.role = 'assistant' THEN
         CASE WHEN EXISTS (SELECT 1 FROM calls c WHERE c.call_id = m.call_id) THEN 'linked' ELSE 'orphan' END
       ELSE 'plain' END AS status,
  CASE WHEN m.role = 'user' THEN
         '{"arguments":{"prompt":' || CAST(to_json(m.text) AS VARCHAR) || ',"words":' || m.words || '},"id":"' || m.call_id || '","name":"ask","problems":' ||
         CASE WHEN m.words < 8 THEN '["invalid words"]' ELSE '[]' END || ',"role":"user"}'
       WHEN m.role = 'assistant' THEN '{"content":' || CAST(to_json(m.text) AS VARCHAR) || ',"id":"' || m.call_id || '","role":"assistant"}'
       ELSE '{"content":' || CAST(to_json(m.text) AS VARCHAR) || ',"role":"' || m.role || '"}' END AS json
FROM m LEFT JOIN level l ON l.conv_id = m.conv_id AND l.turn = CASE WHEN m.role = 'user' THEN m.turn WHEN m.role = 'assistant' THEN m.turn - 1 END
"""


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_counts(read(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "n_items", "item_ids", "short_item_ids")


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sentence_spans.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return done.select("doc_id", "n_sentences", "n_removed", "removed", F.sha2("clean_text", 256).alias("clean_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(toxicity.with_labels(docs.where(part_of_id(4) != 2), labels))
    scored = toxicity.score(docs.withColumn("held_out", part_of_id(4) == 2), model, ["doc_id", "held_out"])
    return scored.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """The conversations of op11: each begins with the first turns, 0 to 3 of them by its id's checksum, of the conversation
    whose id is the multiple of 20 at or below its own; its own turns after as many follow. turns: a written table."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(4)).cast("int")
    first = turns.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("first"))
    joined = turns.withColumn("base", F.expr("conv_id - conv_id % 20")).join(first, "base", "left").withColumn("h", h)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("turns", 1, 0)), own).alias("turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = durable(prefix_trie.turn_lists(read(spark, sf_dir, "conversations")), "turns")
    return prefix_trie.trie(rebuilt(turns)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: Checksums come from the table of the reflected polynomial 0xEDB88320, as there is no function for them.
OP11_SQL = r"""
WITH RECURSIVE crc_step(i, k, c) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_step WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS steps FROM crc_step WHERE k = 8),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc_table
), r AS (
  SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, pos + 3, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h
), s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, sha256(length(role) || ':' || role || text) AS turn_id, CAST(len(regexp_extract_all(text, '[^ 	-
]+')) AS BIGINT) AS words FROM r
), p AS (
  SELECT conv_id, depth, words, sha256(string_agg(turn_id, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node, count(*) OVER (PARTITION BY conv_id) AS size FROM s
  UNION ALL SELECT conv_id, 0, 0, '', (SELECT count(*) FROM s WHERE s.conv_id = c.conv_id) FROM c
), q AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM p),
n AS (SELECT node, any_value(above) AS above, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = size), '')) AS ends_sha256 FROM q GROUP BY node),
k AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.above = n.node) AS n_children FROM n),
u AS (SELECT a.node, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((k.n_convs - 1) * k.words) AS saved_tokens FROM k JOIN p a ON a.conv_id = k.conv_id AND a.depth <= k.depth GROUP BY a.node)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN u USING (node) LEFT JOIN n m ON m.node = k.above
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.aligned(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        *[secret_scan.count_kind(F.col("secrets.base"), k).alias(f"n_{k}") for k in secret_scan.KINDS[:3]],
        F.sha2(secret_scan.span_string(F.col("secrets.base")), 256).alias("base_sha256"),
        secret_scan.span_string(F.col("secrets.spans")).alias("spans"),
        F.sha2("secrets.clean_text", 256).alias("clean_sha256"),
    )


OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT row_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT row_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row_id),
l AS (
  SELECT row_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), k AS (
  SELECT row_id, ls, list_filter(ls, lambda x: regexp_matches(x, '{quality.PUNCTUATION.replace("'", "''")}')
    AND NOT regexp_matches(regexp_replace(x, '[\x09-\x0D]', ' ', 'g'), '{quality.NAVIGATION.replace("'", "''")}')
    AND NOT regexp_matches(x, '{quality.BOILERPLATE.replace("'", "''")}')) AS good FROM l
), s AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(good) AS BIGINT) AS n_lines_removed,
    CAST(length(regexp_replace(array_to_string(good, ' '), '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS kept_chars
  FROM d JOIN w USING (row_id) JOIN k USING (row_id) LEFT JOIN c USING (row_id)
)
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AND 100 * kept_chars >= {quality.MIN_KEPT_PERCENT} * word_chars AS kept
FROM s
"""

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_token_frames, op3_language_id, op4_minhash, op5_private_data, op6_tool_calls, op7_mix, op8_decontaminate, op9_sentence_spans, op10_toxicity, op11_prefix_trie, op12_token_alignment, op13_secret_scan)}
ORACLES = {"op1_quality_rules": OP1_SQL, "op6_tool_calls": OP6_SQL, "op11_prefix_trie": OP11_SQL}
