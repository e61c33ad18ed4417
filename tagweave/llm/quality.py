"""Quality rules, line first: lines that fail a rule go, then documents that lost too much text are rejected.

DataFrame functions only. Lines are what \\n separates; a line without a word is neither kept nor lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.shared import packed, unpacked

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_KEPT_PERCENT = 50
#: A line of prose ends with a sentence's end, or with a closing quote or bracket after one.
PUNCTUATION = r"[.!?:;…。！？][\"'”’»)\]]*[ \t\n\x0b\f\r]*\z"
#: Menus, breadcrumbs and table rows: two or more separators with blanks around, or a line of arrows. Each separator is
#: tried once, so long lines take linear time.
NAVIGATION = r"\s(\||»|›|>|•|·|::)\s[^\n]*\s(\||»|›|>|•|·|::)\s|^\s*(»|›|•|·|<<|>>|←|→)"
#: Phrases of page furniture rather than text.
BOILERPLATE = (
    r"(?i)(all rights reserved|privacy policy|cookie policy|we use cookies|terms of (use|service)|copyright (\(c\)|©|[0-9]{4})"
    r"|enable javascript|click here|sign (in|up) (to|for|now)|subscribe to (our|the)|log ?in to|lorem ipsum|powered by"
    r"|permission is hereby granted|licensed under|spdx-license-identifier)"
)


def words_of(text: Column) -> Column:
    """Runs of characters other than space and U+0009..U+000D."""
    return F.array_remove(F.split(text, f"[{BLANKS}]+"), "")


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words in a struct column `m`, and the lines with a
    word in `l_`; null text: empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumns({"w_": words_of(t), "l_": lines_of(t)})
    df = df.withColumn("h_", F.expr("transform(slice(w_, 1, greatest(size(w_) - 2, 0)), (x, i) -> xxhash64(x, w_[i + 1], w_[i + 2]))"))
    # Windows that are found again: sorted with their places, they stand beside an equal one.
    df = df.withColumn("p_", F.expr("case when size(array_distinct(h_)) < size(h_) then sort_array(transform(h_, (x, i) -> struct(x as h, i as i))) else array() end"))
    df = df.withColumn("q_", F.expr("sort_array(transform(filter(p_, (e, k) -> (k > 0 and e.h = p_[k - 1].h) or (k + 1 < size(p_) and e.h = p_[k + 1].h)), e -> e.i))"))
    return df.withColumn(
        "m",
        F.struct(
            F.size("w_").cast("long").alias("n_words"),
            F.length(F.array_join("w_", "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long").alias("n_dup_lines"),
            F.expr("aggregate(transform(q_, (p, k) -> if(k + 1 = size(q_), 3, least(3, q_[k + 1] - p))), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
        ),
    ).drop("w_", "h_", "p_", "q_")


def line_fails(line: Column) -> Column:
    """True if the line is not prose: no sentence's end, or a menu, or page furniture."""
    return ~line.rlike(PUNCTUATION) | line.rlike(NAVIGATION) | line.rlike(BOILERPLATE)


#: Columns that measures() finds, and those that clean_lines() adds.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULTS = ["clean_text", *MEASURES, "n_lines", "n_lines_removed", "kept_chars", "base_failed", "kept"]


def clean_lines(docs: DataFrame, text: str = "text", min_kept_percent: int = MIN_KEPT_PERCENT) -> DataFrame:
    """docs with the measures, n_lines, n_lines_removed, kept_chars, clean_text, base_failed and kept.

    base_failed: under 50 words, or more than half of the words in repeated 3-word windows. kept: not base_failed, and
    the lines that stay hold at least min_kept_percent of the text's characters other than blanks. A null or empty text
    has no words and fails. Repeated rows are judged alike; an empty table gives no rows; lines and texts may have any
    length. Columns with the names of results are replaced, all others pass, whatever their names.
    """
    df = measures(packed(docs, text)).withColumn("v_", F.transform("l_", lambda x: F.struct(x.alias("line"), line_fails(x).alias("bad"))))
    df = df.withColumns({"g_": F.expr("filter(v_, v -> not v.bad).line"), "b_": F.expr("filter(v_, v -> v.bad).line")})
    df = df.withColumn("clean_text", F.array_join("g_", "\n"))
    failed = (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("m.n_words"))
    lost = F.length(F.translate(F.array_join("b_", ""), BLANKS, ""))
    df = df.withColumns({x: F.col(f"m.{x}") for x in MEASURES}).withColumns({
        "n_lines": F.size("l_").cast("long"),
        "n_lines_removed": F.size("b_").cast("long"),
        "kept_chars": (F.col("m.word_chars") - lost).cast("long"),
        "base_failed": failed,
    })
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("kept_chars") >= min_kept_percent * F.col("word_chars")))
    return unpacked(df, RESULTS)
