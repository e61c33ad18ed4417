"""Column functions for prices, descriptions, names, links and text forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DESCRIPTION_CAP = 3000
#: What a name says of compatibility.
NAME_SIGNALS = r"(?i)VRC|VRChat|アバター対応|対応アバター|avatars?"
#: Replacements of the normal form, in order.
MORPH = [
    ("ミツアミ", "三ツ編ミ"), ("三ツアミ", "三ツ編ミ"), ("ミツ編ミ", "三ツ編ミ"),
    ("三ツ網", "三ツ編ミ"), ("3ツ編ミ", "三ツ編ミ"),
    ("アミコミ", "編ミ込ミ"), ("編ミコミ", "編ミ込ミ"), ("アミ込ミ", "編ミ込ミ"),
    ("ダンゴ", "団子"),
    ("ヘアー", "ヘア"),
    ("オンマユ", "オン眉"), ("マユウエ", "眉上"),
]


#: Decimal digits of other scripts than ASCII's.
DIGITS = [c for c in map(chr, range(128, 0x10000)) if unicodedata.category(c) == "Nd"]


def parse_price(text: Column) -> Column:
    """The least of the numbers in a text, in any script's digits, commas in them left out; null without one."""
    plain = F.translate(text, "".join(DIGITS), "".join(str(unicodedata.decimal(c)) for c in DIGITS))
    numbers = F.transform(F.regexp_extract_all(plain, F.lit(r"[0-9][0-9,]*"), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").try_cast("bigint"))
    return F.array_min(numbers)


def tag_names(tags: Column) -> Column:
    """Names of an array of structs, missing and empty ones left out."""
    return F.filter(F.transform(tags, lambda t: t["name"]), lambda n: n.isNotNull() & (n != ""))


def strip_desc(text: Column, cap: int = DESCRIPTION_CAP) -> Column:
    """Runs of Unicode white space as one blank, none at the ends, the first cap characters."""
    return F.substring(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " ")), 1, cap)


def looks_vrchat(badge: Column, name: Column) -> Column:
    return F.coalesce(badge, F.lit(False)) | F.coalesce(name, F.lit("")).rlike(NAME_SIGNALS)


def safe_url(url: Column, item_id: Column, base: str = "https://example.com/items/") -> Column:
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit(base), item_id))


def url_key(url: Column) -> Column:
    """The first 24 hex digits of the SHA-256."""
    return F.substring(F.sha2(url, 256), 1, 24)


def compatible_with(avatars: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(avatars, F.array(*map(F.lit, wanted))), F.lit(False))


_HIRA = "".join(map(chr, range(0x3041, 0x3097)))
_KATA = "".join(chr(ord(c) + 0x60) for c in _HIRA)


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC").str.lower().str.strip()


def normalize_ja(text: Column, morph: list[tuple[str, str]] = MORPH) -> Column:
    """NFKC, lower case, no blanks around, hiragana as katakana, then the replacements in order. Null: empty.

    NFKC has no function in Spark; it runs over Arrow batches, and the rest in the JVM.
    """
    out = F.translate(_composed(F.coalesce(text, F.lit(""))), _HIRA, _KATA)
    for a, b in morph:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normal_form(text: str, morph: list[tuple[str, str]] = MORPH) -> str:
    """normalize_ja() of one string: what a user typed."""
    out = unicodedata.normalize("NFKC", text or "").lower().strip().translate(str.maketrans(_HIRA, _KATA))
    for a, b in morph:
        out = out.replace(a, b)
    return out
