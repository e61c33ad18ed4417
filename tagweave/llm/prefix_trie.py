"""Conversations as a prefix trie, built as a burst trie over tables.

A conversation is the list of its turns' ids. Trie heads are prefixes; under each lies a container with the rest of every
conversation that begins so. A container with too many turns bursts: its conversations go to the containers of their next turn
ids. What is left is small: each container is sorted and swept into nodes in one pass. Nodes that burst add up what lies under
them.

A prefix has an id of 128 bits of its own, a sum over its turns' hashes mixed with their places, so that a conversation's list
of prefix ids sorts and bursts as its list of turns does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.shared import column, discard, durable, release
from tagweave.llm.text_arrays import mix, signed

#: Turns in a container from which it bursts; one conversation alone never does.
LIMIT = 2_000
#: Conversation ids of one node that are written out together are those that agree in all but so many last bits.
CHUNK_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
NODES = (
    "hi long, lo long, parent_hi long, parent_lo long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, top boolean, above array<long>, above_words array<long>"
)
_NAMES = [x.split()[0] for x in NODES.split(", ")]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of rows (conv_id, turn, role, text): id (16 bytes of a SHA-256 of role and text) and words of each turn
    in the order of turn, null first, equal ones by id. Null roles and texts are empty; rows without conv_id are left out; of
    repeated rows each is a turn. A conversation's turns, 40 bytes each, must fit into a task.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    turn = F.struct("turn", key.alias("id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    listed = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(listed.alias("turns"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turns) -> (conv_id, hi, lo, path, words): path has two halves for each prefix; hi, lo are those of the last."""
    for batch in batches:
        lists = column(batch, "turns")
        size = np.asarray(lists.value_lengths()).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        turns = lists.flatten()
        ids = np.frombuffer(b"".join(turns.field("id").to_pylist()), "<u8").reshape(-1, 2)
        place = (np.arange(len(ids)) - np.repeat(at[:-1], size) + 1).astype(np.uint64)
        path = np.empty((len(ids), 2), np.int64)
        for half in (0, 1):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids[:, half] + place * _STEP[half]))])
            path[:, half] = signed(mix(total[1:] - np.repeat(total[at[:-1]], size)))
        last = np.zeros((len(size), 2), np.int64)
        last[size > 0] = path[at[1:][size > 0] - 1]
        pair = pa.array((2 * at).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [column(batch, "conv_id"), pa.array(last[:, 0]), pa.array(last[:, 1]), pa.ListArray.from_arrays(pair, pa.array(path.ravel())), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), turns.field("words"))],
            ["conv_id", "hi", "lo", "path", "words"],
        )


class _Ends:
    """Equal conversations, of which parts arrive in the order of their ids."""

    def __init__(self, key: tuple, first: pa.RecordBatch | int, ids: list[int]):
        self.key, self.first, self.n = key, first, 0
        self.sha = hashlib.sha256()
        self.add(ids)

    def add(self, ids: list[int]) -> None:
        said = ",".join(map(str, ids)).encode()
        self.sha.update(b"," + said if self.n else said)
        self.n += len(ids)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted parts of equal conversations -> one row of each: conv_id (least), n, path, words, sha."""

    def out(rows: list[pa.RecordBatch], groups: list[_Ends]) -> Iterator[pa.RecordBatch]:
        if groups:
            first = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([column(first, "conv_id"), pa.array([g.n for g in groups], pa.int64()), column(first, "path"), column(first, "words"), pa.array([g.sha.hexdigest() for g in groups])], ["conv_id", "n", "path", "words", "sha"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, done, own = [], [], []
        for i, key in enumerate(zip(column(batch, "hi").to_pylist(), column(batch, "lo").to_pylist(), strict=True)):
            ids = column(batch, "ids")[i].as_py()
            if held is not None and held.key == key:
                held.add(ids)
                continue
            if held is not None:
                if isinstance(held.first, int):
                    own.append(held)
                else:
                    rows, done = [held.first], [held]
            held = _Ends(key, i, ids)
        if own:
            rows.append(batch.take(pa.array([g.first for g in own])))
        if held is not None and isinstance(held.first, int):
            held.first = batch.slice(held.first, 1)
        yield from out(rows, done + own)
    if held is not None:
        yield from out([held.first], [held])
    release()


def distinct_conversations(turns: DataFrame) -> DataFrame:
    """A written row for each distinct list of turns: conv_id (the least that has it), n (how many have it), path, words, sha
    (of their ids in order). Ids are joined in parts before the parts of one list meet in a task."""
    rows = turns.mapInArrow(_paths, "conv_id long, hi long, lo long, path array<long>, words array<long>")
    parts = rows.groupBy("hi", "lo", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"), F.min(F.struct("conv_id", "path", "words")).alias("m"))
    parts = parts.select("hi", "lo", "chunk", "ids", "m.conv_id", "m.path", "m.words")
    met = parts.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "chunk")
    return durable(met.mapInArrow(_distinct, "conv_id long, n long, path array<long>, words array<long>, sha string"), "conversations")


def _prefixes(rows: DataFrame, lo: int, hi: int) -> DataFrame:
    """(conv_id, hi, lo, weight): the prefixes of lo to hi turns, weighted with the turns from there on."""
    size = F.size("words")
    at = rows.where(size >= lo).select("conv_id", "path", size.alias("size"), F.explode(F.sequence(F.lit(lo), F.least(size, F.lit(hi)))).alias("j"))
    return at.select("conv_id", F.element_at("path", 2 * F.col("j") - 1).alias("hi"), F.element_at("path", 2 * F.col("j")).alias("lo"), (F.col("size") - F.col("j") + 1).alias("weight"))


def head_depths(rows: DataFrame, limit: int = LIMIT) -> DataFrame | None:
    """(conv_id, depth): how many turns the head of a conversation's container has; one more than its turns if it ends at a
    node that burst. None if nothing bursts.

    Each round looks at twice as many turns of the conversations whose containers are still too large, so rounds grow with the
    logarithm of the depth that they reach. A prefix that bursts has more than `limit` turns under it, so there are few.
    """
    whole = rows.agg(F.count("*").alias("n"), F.sum(F.size("words") + 1).alias("size")).first()
    if whole["n"] < 2 or whole["size"] <= limit:
        return None
    open_, out, lo, step = rows, None, 1, 1
    while True:
        hi = lo + step - 1
        large = durable(_prefixes(open_, lo, hi).groupBy("hi", "lo").agg(F.count("*").alias("n"), F.sum("weight").alias("size")).where(f"n > 1 and size > {limit}").select("hi", "lo"), "burst")
        found = _prefixes(open_, lo, hi).join(large, ["hi", "lo"]).groupBy("conv_id").agg(F.count("*").alias("deep"))
        size = F.size("words")
        state = open_.select("conv_id", size.alias("size")).join(found, "conv_id", "left").select("conv_id", "size", F.coalesce("deep", F.lit(0)).alias("deep"))
        state = durable(state.select("conv_id", (F.lit(lo) + F.col("deep")).alias("depth"), ((F.col("deep") == step) & (F.col("size") > hi)).alias("open")), "state")
        discard(large)
        closed = state.where("not open").select("conv_id", F.col("depth").cast("int").alias("depth"))
        out = closed if out is None else out.unionAll(closed)
        if state.where("open").isEmpty():
            return out
        open_ = rows.join(state.where("open").select("conv_id"), "conv_id", "left_semi")
        lo, step = hi + 1, 2 * step


def sweep(conv: np.ndarray, n: np.ndarray, sizes: np.ndarray, path: np.ndarray, words: np.ndarray, head: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes of whole containers whose rows are sorted by container and path.

    conv, n: least id and number of each row's equal conversations; sizes: its turns; path (prefix ids, two halves) and words
    of all turns of all rows; head: depth of its container's head. A row makes the nodes that the row before it does not pass
    through, so nodes come in preorder, and what lies under one is a run of rows and a run of nodes.
    """
    rows = len(conv)
    at = np.concatenate([[0], np.cumsum(sizes)])
    base = np.zeros(rows, np.int64)  # first node depth of each row
    same = np.zeros(rows, bool)  # in the container of the row before
    for r in range(rows):
        base[r] = head[r]
        if r and head[r] == head[r - 1] and (head[r] == 0 or min(sizes[r], sizes[r - 1]) >= head[r] and (path[at[r] + head[r] - 1] == path[at[r - 1] + head[r] - 1]).all()):
            same[r] = True
            m = min(sizes[r], sizes[r - 1])
            apart = np.flatnonzero((path[at[r] : at[r] + m] != path[at[r - 1] : at[r - 1] + m]).any(axis=1))
            base[r] = (apart[0] if len(apart) else m) + 1
    made = sizes - base + 1
    first = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(rows), made)
    depth = np.arange(len(row)) - np.repeat(first[:-1], made) + np.repeat(base, made)
    parent = np.arange(-1, len(row) - 1)
    last_row = np.empty(len(row), np.int64)
    now = np.empty(int(sizes.max(initial=0)) + 2, np.int64)  # the open node of each depth
    for r in range(rows):
        lo, hi = first[r], first[r + 1]
        if r:
            from_ = base[r] if same[r] else head[r - 1]
            last_row[now[from_ : sizes[r - 1] + 1]] = r - 1
        now[base[r] : sizes[r] + 1] = np.arange(lo, hi)
        parent[lo] = now[base[r] - 1] if same[r] else -1
    if rows:
        last_row[now[head[-1] : sizes[-1] + 1]] = rows - 1
    total = np.concatenate([[0], np.cumsum(n)])
    n_convs = total[last_row + 1] - total[row]
    least = np.minimum.reduceat(np.append(conv, np.iinfo(np.int64).max), np.column_stack([row, last_row + 1]).ravel())[::2] if rows else conv
    children = np.bincount(parent[parent >= 0], minlength=len(row))
    under = first[last_row + 1]  # one after the last node of the subtree
    leaves = np.concatenate([[0], np.cumsum(children == 0)])
    token = np.where(depth > 0, words[np.minimum(at[row] + np.maximum(depth, 1) - 1, max(0, len(words) - 1))] if len(words) else 0, 0)
    saved = np.concatenate([[0], np.cumsum((n_convs - 1) * token)])
    here = np.arange(len(row))
    return {
        "row": row, "depth": depth, "parent": parent, "conv_id": least, "n_convs": n_convs, "n_children": children,
        "n_leaves": leaves[under] - leaves[here], "saved_tokens": saved[under] - saved[here], "end": depth == sizes[row],
    }


def _swept(rows: pa.RecordBatch) -> pa.RecordBatch:
    of = lambda c: column(rows, c).to_numpy(zero_copy_only=False).astype(np.int64)
    conv, n, head = of("conv_id"), of("n"), of("depth")
    lists = column(rows, "words")
    sizes = np.asarray(lists.value_lengths()).astype(np.int64)
    words, path = (column(rows, c).flatten().to_numpy().astype(np.int64) for c in ("words", "path"))
    path = path.reshape(-1, 2)
    got = sweep(conv, n, sizes, path, words, head)
    row, depth, parent = got["row"], got["depth"], got["parent"]
    at = np.concatenate([[0], np.cumsum(sizes)])
    ids = lambda d: np.where((d > 0)[:, None], path[np.clip(at[row] + d - 1, 0, max(0, len(path) - 1))] if len(path) else 0, 0)
    own, above = ids(depth), ids(depth - 1)
    root, inner = depth == 0, parent >= 0
    top = ~inner & ~root
    sha = np.where(got["end"], np.array(column(rows, "sha").to_pylist(), object)[row], NO_ENDS)
    begin, length = at[row], np.where(top, depth - 1, 0)
    take = np.repeat(begin, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    cut = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(above[:, 0], mask=root), pa.array(above[:, 1], mask=root), pa.array(depth), pa.array(got["conv_id"]), pa.array(got["conv_id"][np.maximum(parent, 0)], mask=~inner),
         *(pa.array(got[c]) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), pa.array(sha, pa.string()), pa.array(top),
         pa.ListArray.from_arrays(pa.array(2 * cut), pa.array(path[take].ravel())), pa.ListArray.from_arrays(pa.array(cut), pa.array(words[take]))],
        _NAMES,
    )


def _sweeps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by container and path -> nodes. What may go on in the next batch, the last container, waits for it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([column(batch, c).to_numpy() for c in ("head_hi", "head_lo")])
        if held:
            last = tuple(column(held[-1], c)[held[-1].num_rows - 1].as_py() for c in ("head_hi", "head_lo"))
            if tuple(key[0]) != last:
                yield _swept(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
        cut = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key != key[-1]).any() else 0
        if cut:
            yield _swept(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _swept(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
    release()


def trie(turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(conv_id, turns) -> a row for each node, from the root (depth 0): hi, lo (its id), depth, conv_id (least member),
    parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Members of a node are the conversations that begin with it; saved_tokens adds up, over its subtree, the words of each
    node's last turn for every member but one; ends_sha256 is the SHA-256 of the ids that end there, in order, comma-joined.
    turns must not be null; conversations without turns end at the root; without conversations there are no nodes. A container
    is worked on by one task: `limit` turns, or one conversation. Equal conversations are one row of it, whatever their number.
    """
    rows = distinct_conversations(turns)
    depths = head_depths(rows, limit)
    result = ["hi", "lo", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    with_depth = rows.withColumn("depth", F.lit(0)) if depths is None else durable(rows.join(depths, "conv_id"), "placed")
    head = lambda half: F.when(F.col("depth") > 0, F.element_at("path", 2 * F.greatest("depth", F.lit(1)) - half)).otherwise(0).alias(("head_lo", "head_hi")[half])
    ended = F.col("depth") > F.size("words")
    held = with_depth.where(~ended).select("conv_id", "n", "path", "words", "sha", "depth", head(1), head(0))
    nodes = held.repartition("head_hi", "head_lo").sortWithinPartitions("head_hi", "head_lo", "path").mapInArrow(_sweeps, NODES)
    if depths is None:
        return nodes.select(result)
    nodes = durable(nodes, "nodes")
    none = F.lit(None).cast("string")
    tops = nodes.where("top").select("depth", "conv_id", "n_convs", "n_leaves", "saved_tokens", F.col("above").alias("path"), F.col("above_words").alias("words"), F.lit(1).alias("child"), none.alias("sha"))
    zero = F.lit(0).cast("long")
    stopped = with_depth.where(ended).select(F.col("depth").cast("long").alias("depth"), "conv_id", F.col("n").alias("n_convs"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "path", "words", F.lit(0).alias("child"), "sha")
    burst, parts = _burst_nodes(tops.unionAll(stopped))
    own = _own_savings(burst, parts)
    kids = burst.where("depth > 0").groupBy(F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo")).agg(F.count("*").alias("kids"))
    burst = burst.join(own, ["hi", "lo"], "left").join(kids, ["hi", "lo"], "left").select(
        "hi", "lo", "parent_hi", "parent_lo", "depth", "conv_id", "n_convs", (F.col("child") + F.coalesce("kids", zero)).alias("n_children"), "n_leaves",
        (F.col("saved_tokens") + F.coalesce("own", zero)).alias("saved_tokens"), F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    burst = durable(burst, "burst_nodes")
    above = burst.select(F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("conv_id").alias("parent_conv_id"))
    open_ends = burst.unionByName(nodes.where("top").select(burst.columns)).join(above, ["parent_hi", "parent_lo"], "left")
    return nodes.where("not top").select(result).unionByName(open_ends.select(result))


def _burst_nodes(under: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that burst, from the tops of containers and the conversations that end at such nodes: each adds to all
    prefixes above it. Also returns what was added up, a row for each of the parts."""
    under = durable(under, "under")
    j = F.col("j")
    part = lambda i, half: F.when(i > 0, F.element_at("path", (2 * F.greatest(i, F.lit(1)) - half).cast("int"))).otherwise(0)
    each = under.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("depth") - 1)).alias("j")).select(
        part(j, 1).alias("hi"), part(j, 0).alias("lo"), F.when(j > 0, part(j - 1, 1)).alias("parent_hi"), F.when(j > 0, part(j - 1, 0)).alias("parent_lo"), j.alias("depth"),
        F.when(j > 0, F.element_at("words", F.greatest(j, F.lit(1)).cast("int"))).otherwise(0).alias("words"), "conv_id", "n_convs", "n_leaves", "saved_tokens",
        F.when(j == F.col("depth") - 1, F.col("child")).otherwise(0).alias("child"), F.when(j == F.col("depth") - 1, F.col("sha")).alias("sha"),
    )
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved_tokens", "child")]
    found = each.groupBy("hi", "lo").agg(F.min("conv_id").alias("conv_id"), *sums, *[F.max(c).alias(c) for c in ("parent_hi", "parent_lo", "depth", "words", "sha")])
    return durable(found, "burst_parts"), under


def _own_savings(burst: DataFrame, under: DataFrame) -> DataFrame:
    """(hi, lo, own): what the nodes that burst save themselves, over all of them at or under each. One conversation of a node
    tells the prefixes above it."""
    j = F.col("j")
    node = burst.select("conv_id", F.col("depth").alias("d"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    lists = under.select("conv_id", "path").join(node, "conv_id")
    each = lists.select("path", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d"))).alias("j"))
    half = lambda h: F.when(j > 0, F.element_at("path", (2 * F.greatest(j, F.lit(1)) - h).cast("int"))).otherwise(0)
    return each.select(half(1).alias("hi"), half(0).alias("lo"), "own").groupBy("hi", "lo").agg(F.sum("own").alias("own"))
