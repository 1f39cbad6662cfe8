"""A trie of all prefixes of conversations, as double arrays over shards of the sorted turn sequences.

Turn sequences are range-partitioned in lexicographic order, so a subtree is a contiguous
interval and no prefix, however common, is one task's. Each task cuts its rows into shards of bounded
size, packs a shard's trie into BASE and CHECK arrays over dense turn ids, and walks all its
rows through them. Only nodes on the paths of a shard's first and last sequence can reach
into other shards: these few are merged globally, all others are settled in their shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.llm.common import Workspace, one_array, partitions

#: Bytes of a turn's digest.
TURN = 16
#: Turns and rows of a shard (one conversation may be longer), and ids in one piece of a digest's input.
MOST_TURNS, MOST_ROWS, PIECE = 1 << 20, 1 << 17, 4096
EMPTY = hashlib.sha256(b"").hexdigest()
#: Kinds of rows that a shard gives: settled; settled but for its parent's id; part of a node; ids of a node's ends.
SETTLED, ORPHAN, PART, ENDS = range(4)
FIELDS = "kind byte, shard string, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends_sha256 string, ids string"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
TYPES = {"byte": pa.int8(), "string": pa.string(), "binary": pa.binary(), "long": pa.int64()}
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# --- double arrays ----------------------------------------------------------------------------------------


def pack(parents: np.ndarray, codes: np.ndarray, n_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and CHECK of a trie whose node i + 1 is the child of ``parents[i]`` by ``codes[i]``; node 0, the root, has slot 0.

    Children of one parent are adjacent. The child of the node at slot s by code c lies at ``BASE[s] + c`` and
    has s in CHECK. Nodes with several children are fitted first, largest first; single children fill what is left.
    """
    edges = len(parents)
    starts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]])) if edges else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, edges))
    base = np.zeros(n_nodes, np.int64)
    used = np.zeros(max(64, 2 * n_nodes), bool)
    used[0], low = True, 1
    many = np.flatnonzero(lengths > 1)
    for g in many[np.argsort(-lengths[many], kind="stable")]:
        own = np.sort(codes[starts[g] : starts[g] + lengths[g]])
        gaps, width = own - own[0], 256
        while True:
            if low + width + gaps[-1] >= len(used):
                used = np.concatenate([used, np.zeros(len(used) + width + int(gaps[-1]), bool)])
            free = low + np.flatnonzero(~used[low : low + width])
            fits = free[~used[free[:, None] + gaps[None, :]].any(axis=1)] if len(free) else free
            if len(fits):
                break
            low, width = low + width, min(2 * width, 1 << 14)
        used[fits[0] + gaps] = True
        base[parents[starts[g]]] = fits[0] - own[0]
    one = starts[lengths == 1]
    free = np.flatnonzero(~used[1:]) + 1
    if len(free) < len(one):
        free = np.concatenate([free, len(used) + np.arange(len(one) - len(free))])
    base[parents[one]] = free[: len(one)] - codes[one]
    slot = np.zeros(n_nodes, np.int64)
    slot[1:] = base[parents] + codes
    size = int(slot.max()) + 1
    BASE, CHECK = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    BASE[slot] = base
    CHECK[slot[1:]] = slot[parents]
    return BASE, CHECK


def step(BASE: np.ndarray, CHECK: np.ndarray, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The states after reading ``codes``, -1 where there is no such child."""
    to = BASE[states] + codes
    inside = (to >= 0) & (to < len(CHECK))
    return np.where(inside & (CHECK[np.where(inside, to, 0)] == states), to, -1)


def dense_ids(digests: bytes) -> np.ndarray:
    """Numbers from 0 of 16-byte digests that lie end to end."""
    pairs = np.frombuffer(digests, np.uint64).reshape(-1, 2) if digests else np.zeros((0, 2), np.uint64)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (pairs[order[1:]] != pairs[order[:-1]]).any(axis=1)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def build(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE, CHECK and the code of each id, from sorted sequences of ids.

    Codes are numbered as the trie's levels first meet them, so siblings have near codes and fit closely.
    """
    parents, labels, node, n = [], [], np.zeros(len(start), np.int64), 1
    same = np.zeros(len(start), bool)
    same[1:] = True
    for d in range(int(length.max(initial=0))):
        at = np.flatnonzero(length > d)
        own = ids[start[at] + d]
        # A row shares its node with the row before if both agree so far; that row then is the one before among these, too.
        shared = np.zeros(len(at), bool)
        shared[1:] = same[at[1:]] & (at[1:] == at[:-1] + 1) & (own[1:] == own[:-1])
        parents.append(node[at][~shared])
        labels.append(own[~shared])
        same = np.zeros(len(start), bool)
        same[at] = shared
        node[at] = n - 1 + np.cumsum(~shared)
        n += int((~shared).sum())
    if n == 1:
        return np.zeros(1, np.int64), np.full(1, -1, np.int64), np.zeros(0, np.int64)
    labels, parents = np.concatenate(labels), np.concatenate(parents)
    code = np.full(int(ids.max()) + 1, -1, np.int64)
    distinct, first = np.unique(labels, return_index=True)
    code[distinct[np.argsort(first)]] = np.arange(len(distinct))
    return *pack(parents, code[labels], n), code


# --- one shard --------------------------------------------------------------------------------------------


def prefix_keys(sequence: bytes) -> list[bytes]:
    """Keys of all prefixes of a sequence, the root's first."""
    out = [hashlib.blake2b(b"", digest_size=TURN).digest()]
    for i in range(0, len(sequence), TURN):
        out.append(hashlib.blake2b(out[-1] + sequence[i : i + TURN], digest_size=TURN).digest())
    return out


def shard_nodes(table: pa.Table, name: str) -> pa.RecordBatch:
    """Rows of ``FIELDS`` for the nodes of one shard: ``seq``, ``chars`` and ``conv_id``, sorted by sequence and id."""
    seq, chars, conv = one_array(table.column("seq")), one_array(table.column("chars")), one_array(table.column("conv_id")).to_numpy()
    length = chars.value_lengths().to_numpy().astype(np.int64)
    start = np.cumsum(length) - length
    sizes = chars.flatten().to_numpy()
    ids = dense_ids(b"".join(seq.to_pylist()))
    BASE, CHECK, code = build(ids, start, length)
    codes, size, rows = code[ids], len(CHECK), len(conv)

    n = np.zeros(size, np.int64)
    least = np.full(size, np.iinfo(np.int64).max)
    depth, last = np.zeros(size, np.int64), np.zeros(size, np.int64)
    state, levels = np.zeros(rows, np.int64), [np.zeros(1, np.int64)]
    n[0], least[0] = rows, conv.min()
    for d in range(int(length.max(initial=0))):
        at = np.flatnonzero(length > d)
        to = step(BASE, CHECK, state[at], codes[start[at] + d])
        if (to < 0).any():
            raise AssertionError("a packed sequence is not found again")
        state[at] = to
        nodes = to[np.concatenate([[True], to[1:] != to[:-1]])]
        np.add.at(n, to, 1)
        np.minimum.at(least, to, conv[at])
        depth[nodes], last[to] = d + 1, sizes[start[at] + d]
        levels.append(nodes)

    edge, paths = np.zeros(size, bool), {}
    edge[0] = True
    for row in {0, rows - 1}:
        keys, s = prefix_keys(seq[row].as_py()), 0
        paths[0] = (keys[0], None)
        for d in range(length[row]):
            s = int(BASE[s] + codes[start[row] + d])
            edge[s], paths[s] = True, (keys[d + 1], keys[d])

    children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for nodes in reversed(levels):
        # What lies on the two paths may go on elsewhere: it neither counts for its parent nor is a leaf yet.
        inner = nodes[~edge[nodes]]
        leaves[inner] += children[inner] == 0
        saved[inner] += (n[inner] - 1) * last[inner]
        up = CHECK[inner]
        np.add.at(children, up, 1)
        np.add.at(leaves, up, leaves[inner])
        np.add.at(saved, up, saved[inner])

    digest, pieces = {}, []
    cut = np.flatnonzero(np.concatenate([[True], state[1:] != state[:-1], [True]]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        s, own = int(state[a]), conv[a:b].tolist()
        if edge[s]:
            pieces += [(paths[s][0], own[i], ",".join(map(str, own[i : i + PIECE]))) for i in range(0, len(own), PIECE)]
        else:
            digest[s] = hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()

    nodes = np.concatenate(levels)
    parent = CHECK[nodes]
    on_edge = edge[nodes]
    orphan = ~on_edge & edge[np.maximum(parent, 0)]
    kind = np.where(on_edge, PART, np.where(orphan, ORPHAN, SETTLED))
    key = [paths[s][0] if e else None for s, e in zip(nodes.tolist(), on_edge.tolist(), strict=True)]
    up = [paths[s][1] if e else paths[p][0] if o else None for s, p, e, o in zip(nodes.tolist(), parent.tolist(), on_edge.tolist(), orphan.tolist(), strict=True)]
    columns = {
        "kind": kind.astype(np.int8), "shard": [name] * len(nodes), "key": key, "parent_key": up, "conv_id": least[nodes], "depth": depth[nodes],
        "parent_conv_id": pa.array(least[np.maximum(parent, 0)], mask=kind != SETTLED), "n_convs": n[nodes], "n_children": children[nodes], "n_leaves": leaves[nodes],
        "saved_tokens": saved[nodes], "chars": last[nodes], "ends_sha256": [digest.get(s, EMPTY) for s in nodes.tolist()], "ids": [None] * len(nodes),
    }
    whole = _fields(columns)
    if not pieces:
        return whole
    ends = {c: [None] * len(pieces) for c in NAMES} | {"kind": [ENDS] * len(pieces), "key": [k for k, _, _ in pieces], "conv_id": [i for _, i, _ in pieces], "ids": [x for _, _, x in pieces]}
    return pa.Table.from_batches([whole, _fields(ends)]).combine_chunks().to_batches()[0]


def _fields(columns: dict) -> pa.RecordBatch:
    kinds = [TYPES[f.split()[1]] for f in FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip((columns[c] for c in NAMES), kinds, strict=True)], NAMES)


def _shards(most_turns: int, most_rows: int):
    """Kernel over sorted rows: cuts them into shards and gives the nodes of each."""

    def run(batches):
        held, turns, rows, done = [], 0, 0, 0
        task = TaskContext.get().partitionId()

        def close():
            return shard_nodes(pa.Table.from_batches(held), f"{task}-{done}")

        for batch in batches:
            at = 0
            running = np.cumsum(batch.column("chars").value_lengths().to_numpy())
            while at < batch.num_rows:
                before = int(running[at - 1]) if at else 0
                stop = int(np.searchsorted(running, before + most_turns - turns, side="right"))
                stop = min(max(stop, at if held else at + 1), at + most_rows - rows)
                if stop > at:
                    held.append(batch.slice(at, stop - at))
                    turns, rows, at = turns + int(running[stop - 1]) - before, rows + stop - at, stop
                if at < batch.num_rows:
                    yield close()
                    held, turns, rows, done = [], 0, 0, done + 1
        if held:
            yield close()

    return run


# --- merging ----------------------------------------------------------------------------------------------


def _digests(batches):
    """SHA-256 of the ids of each key, whose pieces come in order; only one piece is held."""
    at = state = None
    for batch in batches:
        keys, shas = [], []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key != at:
                if at is not None:
                    keys.append(at)
                    shas.append(state.hexdigest())
                at, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], ["key", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def _climb(batches):
    """Subtree sums of the merged nodes, deepest first in one task."""
    rows = {}
    for b in batches:
        for r in b.to_pylist():
            rows[r["key"]] = r
    for r in sorted(rows.values(), key=lambda r: -r["depth"]):
        r["n_leaves"] += r["n_children"] == 0
        r["saved_tokens"] += (r["n_convs"] - 1) * r["chars"]
        up = rows.get(r["parent_key"])
        r["parent_conv_id"] = up and up["conv_id"]
        if up:
            for c, x in (("n_children", 1), ("n_leaves", r["n_leaves"]), ("saved_tokens", r["saved_tokens"])):
                up[c] += x
    names = ["key", *RESULT[:-1]]
    out = list(rows.values())
    for i in range(0, len(out), 10_000):
        some = out[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in some], pa.binary() if c == "key" else pa.int64()) for c in names], names)


def trie_nodes(sequences: DataFrame, most_turns: int = MOST_TURNS, most_rows: int = MOST_ROWS) -> DataFrame:
    """The trie's nodes from ``(conv_id, seq, chars)``: 16 bytes and one length for each turn, one row for each id.

    Nodes on the edges of shards are merged in one task: two paths for each 2^20 turns or each partition. A node's digest is a
    hash over all ids in order, which no cluster can divide: where the ids of a node lie in several shards, one task reads them, 4096 a row.
    """
    spark = sequences.sparkSession
    ws = Workspace(spark, "trie")
    parts = partitions(spark)
    stored = ws.table(sequences, "sequences")
    nodes = ws.table(
        stored.repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(_shards(most_turns, most_rows), FIELDS), "nodes"
    )
    shared = nodes.where(F.col("kind") == PART)
    added = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = shared.groupBy("key").agg(F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.min("conv_id").alias("conv_id"), *added)
    longs = ", ".join(f"{c} long" for c in RESULT[:-1])
    climbed = ws.table(merged.repartition(1).mapInArrow(_climb, f"key binary, {longs}"), "merged")
    ends = nodes.where(F.col("kind") == ENDS).select("key", "conv_id", "ids").repartition(parts, "key").sortWithinPartitions("key", "conv_id").mapInArrow(_digests, "key binary, ends_sha256 string")
    upper = climbed.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    # Each shard holds the nodes of its own two paths, so no node's many children meet in one task.
    known = shared.select("shard", F.col("key").alias("parent_key")).join(climbed.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent")), "parent_key")
    orphans = nodes.where(F.col("kind") == ORPHAN).join(known, ["shard", "parent_key"]).withColumn("parent_conv_id", F.col("parent"))
    return nodes.where(F.col("kind") == SETTLED).select(RESULT).union(orphans.select(RESULT)).union(upper.select(RESULT))


# --- conversations ----------------------------------------------------------------------------------------


def turn_sequences(df: DataFrame, group: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(group, conv_id, turns)``: the digest (hex) and the code points of each turn in order.

    Turns are in order of turn (null first), then role, then the text's first 64 code points, then its digest. Null roles and texts are
    empty. Repeated rows are repeated turns. Rows of a null id are left out. A conversation is one row, without its texts.
    ``group`` keeps conversations together that are joined later.
    """
    role, text = F.coalesce(F.col(f"`{role_col}`"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(2 * TURN))
    rows = df.where(F.col(f"`{conv_col}`").isNotNull()).select(
        group.alias("group"), F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.struct(F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), F.substring(text, 1, 64).alias("head"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).alias("t"),
    )
    grouped = rows.repartition(partitions(df.sparkSession), "group").groupBy("group", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return grouped.select("group", "conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def branched(df: DataFrame, span: int = 100, most: int = 6) -> DataFrame:
    """``(conv_id, seq, chars)`` of conversations rebuilt as branches.

    Conversation c takes the first h turns of conversation c - c % ``span`` (all if fewer, none if absent) and then its own turns
    after its first h, where h is the CRC-32 of c in decimal, modulo ``most``; % keeps the sign of c.
    """
    id_ = F.col("conv_id").cast("long")
    own = turn_sequences(df.select("conv_id", "turn", "role", "text"), id_ - id_ % span)
    heads = own.where("conv_id = group").select("group", F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    turns = F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    rebuilt = own.join(heads, "group", "left").select("conv_id", turns.alias("turns"))
    return rebuilt.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("seq"), F.col("turns.chars").alias("chars"))


def conversation_trie(df: DataFrame) -> DataFrame:
    """The nodes of the trie of all branched conversations, one row each.

    ``conv_id`` is a node's smallest member, ``parent_conv_id`` its parent's (the root's is null). ``n_leaves`` counts the childless nodes of its
    subtree and ``saved_tokens`` sums (members - 1) x code points of the last text over it; ``ends_sha256`` is the digest of the members
    that end at the node. Nulls, ties and repeated rows are handled as in :func:`turn_sequences`; other columns are ignored. An empty
    table has no nodes, not even a root. Turns are told apart by 128-bit hashes.
    """
    return trie_nodes(branched(df))
