"""Substring matches of many tokens with many terms, in time linear in both.

Terms are dealt into blocks. A block's automaton of its terms (Aho and Corasick) finds the shortest term within a token, its
suffix automaton the shortest term around a token; either reads a token once, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of terms in a block's automata, and of tokens that go to a block at once.
TERM_CHARS, TOKEN_CHARS = 100_000, 2_000_000
Key = tuple[int, str]


class Within:
    """The least key of a term within a text: an automaton of the terms, whose states know the least key that ends there."""

    def __init__(self, terms: Iterable[tuple[str, Key]]):
        self.next: list[dict[str, int]] = [{}]
        self.best: list[Key | None] = [None]
        for form, key in terms:
            state = 0
            for c in form:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.best.append(None)
                state = self.next[state][c]
            self.best[state] = min(filter(None, (self.best[state], key)))
        self.back = [0] * len(self.next)
        queue = list(self.next[0].values())
        for state in queue:
            for c, to in self.next[state].items():
                self.back[to] = self._step(self.back[state], c)
                queue.append(to)
            below = self.best[self.back[state]]
            if below is not None:
                self.best[state] = min(filter(None, (self.best[state], below)))

    def _step(self, state: int, c: str) -> int:
        while state and c not in self.next[state]:
            state = self.back[state]
        return self.next[state].get(c, 0)

    def find(self, text: str) -> Key | None:
        state, out = 0, None
        for c in text:
            state = self._step(state, c)
            key = self.best[state]
            if key is not None and (out is None or key < out):
                out = key
        return out


class Around:
    """The least key of a term that a text lies in: a suffix automaton of the terms. Terms come with rising keys, so the first
    one that reaches a state is the least of all that do."""

    def __init__(self, terms: Iterable[tuple[str, Key]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.best = [-1], [0], [None]
        for form, key in sorted(terms, key=lambda x: x[1]):
            state = 0
            for c in form:
                state = self._extend(state, c)
                up = state
                while up > 0 and self.best[up] is None:
                    self.best[up] = key
                    up = self.link[up]

    def _state(self, length: int, link: int, follow: dict[str, int], best: Key | None) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.best.append(best)
        return len(self.next) - 1

    def _split(self, p: int, c: str, q: int) -> int:
        """The state of p's text with c after it, which q is unless it stands for longer texts, too."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.best[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: str) -> int:
        there = self.next[last].get(c)
        if there is not None:
            return self._split(last, c, there)
        new = self._state(self.length[last] + 1, 0, {}, None)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def find(self, text: str) -> Key | None:
        state = 0
        for c in text:
            state = self.next[state].get(c, -1)
            if state < 0:
                return None
        return self.best[state]


def shortest_within(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(token, term): the shortest term that contains the token or that it contains, ties by name; both in column `form`.

    tokens (token, form) meet every block of terms (term, form), in blocks of their own; a block's tokens go through its
    automata one after the other. Memory of a task grows with TERM_CHARS, or the longest term, and TOKEN_CHARS, or the longest
    token. Empty forms match nothing.
    """
    tokens, terms = (df.select(key, "form").where("form <> ''").distinct() for df, key in ((tokens, "token"), (terms, "term")))
    chars = lambda df: int(df.agg(F.sum(F.length("form"))).first()[0] or 0)
    n_terms, n_tokens = max(1, -(-chars(terms) // TERM_CHARS)), max(1, -(-chars(tokens) // TOKEN_CHARS))
    left = tokens.withColumn("o", F.pmod(F.xxhash64("token"), F.lit(n_tokens))).withColumn("e", F.explode(F.expr(f"sequence(0L, {n_terms - 1}L)")))
    right = terms.withColumn("e_", F.pmod(F.xxhash64("term"), F.lit(n_terms))).withColumn("o_", F.explode(F.expr(f"sequence(0L, {n_tokens - 1}L)")))

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[str, int, str]] = []
        if left.num_rows and right.num_rows:
            known = [(f, (len(t), t)) for t, f in zip(right.column("term").to_pylist(), right.column("form").to_pylist())]
            within, around = Within(known), Around(known)
            for token, form in zip(left.column("token").to_pylist(), left.column("form").to_pylist()):
                keys = [k for k in (within.find(form), around.find(form)) if k is not None]
                if keys:
                    out.append((token, *min(keys)))
        return pa.table({"token": [x[0] for x in out], "size": [x[1] for x in out], "term": [x[2] for x in out]}, schema=pa.schema([("token", pa.string()), ("size", pa.int32()), ("term", pa.string())]))

    found = left.groupBy("o", "e").cogroup(right.groupBy("o_", "e_")).applyInArrow(match, "token string, size int, term string")
    return found.groupBy("token").agg(F.min(F.struct("size", "term")).alias("m")).select("token", F.col("m.term").alias("term"))
