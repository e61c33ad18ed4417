"""Secrets in texts: patterns, and Shannon entropy in windows that slide over strings without blanks.

Strings of one character class are gone over with a window; its character counts change by one character out and one in, and
the entropy with them. A window that is as mixed as random characters of its class marks a secret, unless an allow-list says
what the string is.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tagweave.llm.shared import column, release, slices

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run is found at its first character
_WORDS = ("passw", "secret", "token", "api")
#: Shortest string that is looked at.
SHORTEST = 20


class CharacterClass(NamedTuple):
    """Strings of these characters, windows of that length; bits of entropy from which a window counts, and how many letters,
    digits, capitals and small letters it has at least."""

    characters: str
    window: int
    bits: float
    letters: int
    digits: int
    capitals: int = 0
    small: int = 0


#: Random windows have about 3.4, 3.8 and 4.25 bits; prose without blanks has no digits, numbers have no letters.
CLASSES = (
    CharacterClass("0-9a-fA-F", 20, 3.0, 3, 3),
    CharacterClass("0-9a-z", 20, 3.5, 4, 3),
    CharacterClass("0-9A-Z", 20, 3.5, 4, 3),
    CharacterClass("0-9A-Za-z+/_=-", 24, 4.0, 6, 2, 3, 3),
)
#: What a string is if it matches: no secret. Matched against the string between blanks that holds the candidate.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # identifiers
    r"(?i)^\W*(?:sha|md5|blake)[0-9a-z]*[-:=]",  # checksums
    r"(?i)://|^www\.|;base64,",  # links and embedded files
    r"(?i)example|placeholder|x{8}|0{12}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}",  # times
)
#: Characters that a chunk between blanks is looked at from a candidate, to tell what it is.
AROUND = 200
#: Successive characters of the alphabet or digits that make a string a list of them.
ASCENDING = 10
_SCALE = 1 << 32


class Scanner:
    """The patterns and tables of one set of parameters."""

    def __init__(self, classes=CLASSES, allowed=ALLOWED, values=()):
        self.classes = [(c, re.compile(f"[{c.characters}]{{{c.window},}}"), self._terms(c.window), (c.window * float(np.log2(c.window)) - c.bits * c.window) * _SCALE) for c in classes]
        self.allowed = [re.compile(p) for p in allowed]
        self.values = frozenset(values)
        self.table = np.zeros(128, bool)
        self.table[[i for i in range(128) if re.match(r"[A-Za-z0-9+/_=-]", chr(i))]] = True

    @staticmethod
    def _terms(window: int) -> list[int]:
        """n * log2(n) for the counts of a window, as whole numbers: adding and taking away leaves no rest."""
        return [0, *(round(n * float(np.log2(n)) * _SCALE) for n in range(1, window + 1))]

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the plain patterns, leftmost first, kinds on their own."""
        out = []
        low = text.lower()
        if any(w in low for w in _WORDS):
            out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        return sorted(out)

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Strings of letters, digits and +/_=- that are long enough."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        inside = np.zeros(len(points) + 2, np.int8)
        inside[1:-1] = (points < 128) & self.table[np.minimum(points, 127)]
        edges = np.flatnonzero(np.diff(inside))
        start, end = edges[0::2], edges[1::2]
        far = end - start >= SHORTEST
        return list(zip(start[far].tolist(), end[far].tolist()))

    def marked(self, run: str) -> list[list[int]]:
        """Stretches of a string whose windows are as mixed as random ones, of any class, in order and apart."""
        found = []
        for c, at, terms, most in self.classes:
            for m in at.finditer(run):
                found += dense_windows(m.group(), c, terms, most, m.start())
        out: list[list[int]] = []
        for lo, hi in sorted(found):
            if out and lo <= out[-1][1]:
                out[-1][1] = max(hi, out[-1][1])
            else:
                out.append([lo, hi])
        return out

    def suppressed(self, text: str, lo: int, hi: int) -> bool:
        """Whether the allow-list knows text[lo:hi] by itself or by what stands around it."""
        run = text[lo:hi]
        if run in self.values or _ascending(run) >= ASCENDING:
            return True
        before, after = text[max(0, lo - AROUND) : lo].split(), text[hi : hi + AROUND].split()
        head = before[-1] if before and not text[lo - 1].isspace() else ""
        tail = after[0] if after and not text[hi].isspace() else ""
        return any(p.search(head + run + tail) for p in self.allowed)

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans: those that entropy adds stand apart from base ones. Most of a string marked: all of it."""
        base = self.base(text)
        added = []
        for lo, hi in self.runs(text):
            spans = self.marked(text[lo:hi])
            if not spans or self.suppressed(text, lo, hi):
                continue
            if 2 * sum(b - a for a, b in spans) >= hi - lo:
                spans = [[0, hi - lo]]
            added += [(lo + a, 3, lo + b) for a, b in spans]
        return base, sorted(base + [s for s in added if not _meets(base, s)])


def _meets(spans: list, span: tuple) -> bool:
    return any(lo < span[2] and span[0] < hi for lo, _, hi in spans)


def _ascending(run: str) -> int:
    """Length of the longest stretch in which each character follows the one before it in code."""
    best = now = 1
    for a, b in zip(run, run[1:]):
        now = now + 1 if ord(b) == ord(a) + 1 else 1
        best = max(best, now)
    return best


def dense_windows(run: str, c: CharacterClass, terms: list[int], most: float, at: int = 0) -> list[tuple[int, int]]:
    """(from, to), moved by `at`, of merged windows of a class' string with enough entropy and kinds of characters.

    Entropy of a window of w characters is log2(w) - sum(n * log2(n)) / w; the sum of each window follows from the last one's
    by the character that leaves and the one that comes in.
    """
    w, counts, total, out = c.window, [0] * 128, 0, []
    codes = run.encode("ascii")
    digits = capitals = small = 0
    for i, x in enumerate(codes):
        n = counts[x]
        total += terms[n + 1] - terms[n] if n < w else 0
        counts[x] = n + 1
        if 48 <= x <= 57:
            digits += 1
        elif 65 <= x <= 90:
            capitals += 1
        elif 97 <= x <= 122:
            small += 1
        if i >= w:
            y = codes[i - w]
            n = counts[y]
            total += terms[n - 1] - terms[n] if n <= w else 0
            counts[y] = n - 1
            if 48 <= y <= 57:
                digits -= 1
            elif 65 <= y <= 90:
                capitals -= 1
            elif 97 <= y <= 122:
                small -= 1
        if i >= w - 1 and total <= most and digits >= c.digits and capitals + small >= c.letters and capitals >= c.capitals and small >= c.small:
            lo = at + i - w + 1
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], at + i + 1)
            else:
                out.append((lo, at + i + 1))
    return out


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping ones, as [SECRET]."""
    out, upto = [], 0
    for lo, _, hi in spans:
        if lo >= upto:
            out += [text[upto:lo], "[SECRET]"]
        upto = max(upto, hi)
    return "".join([*out, text[upto:]])


_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, text: str = "text", classes=CLASSES, allowed=ALLOWED, values=()) -> DataFrame:
    """The rows of docs and one column `secrets`: base and spans (start, kind, end; code points, end exclusive, kind a place in
    KINDS) and clean_text, the text with all spans as [SECRET].

    values: strings that are no secrets, besides those that the patterns `allowed` match. A null text has no spans and an
    empty clean text; texts have any length, as work grows with it alone; repeated rows have a row each; an empty table gives
    no rows; other columns pass, one named `secrets` gives way.
    """
    others = [c for c in docs.columns if c != "secrets"]
    rows = docs.select(F.struct(*others).alias("row_"), F.col(text).alias("text_"))
    spans = ArrayType(StructType([StructField(n, IntegerType()) for n in ("start", "kind", "end")]))
    schema = StructType([rows.schema["row_"], StructField("base_", spans), StructField("spans_", spans), StructField("clean_", StringType())])

    def over(batches):
        scanner = Scanner(classes, allowed, values)
        for batch in batches:
            for lo, hi, texts in slices(batch, name="text_"):
                found = [scanner.scan(t) for t in texts]
                as_spans = lambda all_: pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in s] for s in all_], _ARROW)
                clean = pa.array([redacted(t, f[1]) for t, f in zip(texts, found)], pa.string())
                yield pa.RecordBatch.from_arrays([column(batch.slice(lo, hi - lo), "row_"), as_spans([f[0] for f in found]), as_spans([f[1] for f in found]), clean], ["row_", "base_", "spans_", "clean_"])
        release()

    done = rows.mapInArrow(over, schema)
    return done.select("row_.*", F.struct(F.col("base_").alias("base"), F.col("spans_").alias("spans"), F.col("clean_").alias("clean_text")).alias("secrets"))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def span_string(spans: Column) -> Column:
    """kind:start:end of spans in order, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
