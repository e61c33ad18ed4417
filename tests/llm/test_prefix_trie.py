"""The burst trie against nested dictionaries."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tagweave.llm import prefix_trie, queries
from tests.oracle import same

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def words(text):
    return len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)])


def plain(lists):
    """{(conv_id, depth): row} of {conv_id: [(role, text)]}"""
    nodes = {}
    for c in sorted(lists):
        for d in range(len(lists[c]) + 1):
            nodes.setdefault(tuple(lists[c][:d]), []).append(c)
    kids = {p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p] for p in nodes}

    def under(p):
        leaves, saved = (0, 0) if kids[p] else (1, 0)
        for q in kids[p]:
            a, b = under(q)
            leaves, saved = leaves + a, saved + b
        return leaves, saved + (len(nodes[p]) - 1) * (words(p[-1][1]) if p else 0)

    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in members if len(lists[c]) == len(p))
        out.append((members[0], len(p), nodes[p[:-1]][0] if p else None, len(members), len(kids[p]), *under(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(cols).collect()), key=repr)


@pytest.mark.parametrize("limit", [1, 7, 40, 100_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_dictionaries(spark, limit, seed):
    """Branching conversations, copies, ones that end within others, a long shared beginning, and ones without turns."""
    r = random.Random(seed)
    long = [("user", f"w {i}") for i in range(23)]
    lists = {-3: [], 5: []}
    for c in range(60):
        kind = r.random()
        start = long[: r.randrange(24)] if kind < 0.5 else []
        lists[c * 7 - 100] = start + [(r.choice("ua"), "x " * r.randrange(3)) for _ in range(r.randrange(5))]
    lists |= {c: lists[-100] for c in range(9000, 9090)}
    rows = [(c, i, *t) for c, ts in lists.items() for i, t in enumerate(ts)]
    r.shuffle(rows)
    turns = prefix_trie.turn_lists(spark.createDataFrame(rows, CONVERSATIONS))
    none = spark.createDataFrame([(c,) for c, ts in lists.items() if not ts], "conv_id long").withColumn("turns", F.slice(F.array(F.struct(F.lit(b"").alias("id"), F.lit(0).cast("long").alias("words"))), 1, 0))
    assert found(prefix_trie.trie(turns.unionByName(none), limit)) == plain(lists)


def rebuilt(rows):
    """Plain statement of the query's conversations."""
    by = {}
    for c, turn, role, text in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        by.setdefault(c, []).append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in by}
    return {c: by.get(c - c % 20, [])[: h[c]] + by[c][h[c] :] for c in by}


def test_query_on_edges(spark, tmp_path):
    rows = [(0, 2, "user", "b"), (0, None, "user", "a  a"), (0, 3, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 5, "", "one two"), (27, 1, "user", "alone"), (20, 0, "a", ""), (21, 0, "a", ""), (None, 0, "user", "none")]
    rows += [(40, i, "user", "w" * 50_000 + f" {i}") for i in range(9)]
    spark.createDataFrame(rows, CONVERSATIONS).withColumn("path", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    assert found(queries.op11_prefix_trie(spark, str(tmp_path))) == plain(rebuilt(rows))


def test_empty(spark):
    assert prefix_trie.trie(prefix_trie.turn_lists(spark.createDataFrame([], CONVERSATIONS))).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    same(queries.op11_prefix_trie(spark, f"/root/testdata/{sf}").toPandas(), queries.ORACLES["op11_prefix_trie"], f"/root/testdata/{sf}")
