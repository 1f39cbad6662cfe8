"""Connected components, and links inside groups of unbounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.llm.common import Rows, Workspace, groups_of_batches, one_array, partitions


def spread_join(rows: DataFrame, table: DataFrame, key: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``table(*key, n, ...)``, which tells how many of the ``total`` rows hold each key.

    A key of more than 1 / (4 * partitions) of all rows is spread over several tasks, and its
    row of ``table`` goes to each of them. There are at most 4 * partitions such keys, so
    their list can be broadcast at any size of the data.
    """
    most = max(1, total // (4 * partitions(rows.sparkSession)))
    copies = F.ceil(F.col("n") / most).cast("int")
    hot = table.where(F.col("n") > most).select(*key, copies.alias("_copies"))
    salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), "_copies").cast("int"), F.lit(0))
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_copies")
    copied = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return salted.join(copied.hint("merge"), [*key, "_salt"]).drop("_salt")


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """``(node, component)`` of each node of ``edges(src, dst)``; component: its smallest node.

    Alternates large-star and small-star steps until every edge is a star, which takes a
    number of rounds that grows with the logarithm of the longest path. Only edges move; each
    round is written to the shared folder and the last but one is deleted. The edges of
    a node that very many edges meet are spread over tasks.
    """

    def summary(df):
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = ws.table(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    seen = summary(now)
    while seen[0]:
        both = now.union(now.select("v", "u")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = spread_join(both, least, ["a"], 2 * seen[0]).where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        new = ws.table(small, "edges")
        before, seen = seen, summary(new)
        ws.drop(now)
        now = new
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def local_links(ids: np.ndarray, near, first: int = 0) -> np.ndarray:
    """For each row the row from whose links a breadth-first search reached it, or itself.

    ``near(i, rest)`` tells which of the rows ``rest`` link with row ``i``. Rows that
    were reached are compared with unreached rows only, so a group of copies costs
    its size, not its square.
    """
    parent = np.full(len(ids), -1)
    rest = np.arange(len(ids))
    order = [first, *(i for i in range(len(ids)) if i != first)]
    for start in order:
        if parent[start] >= 0:
            continue
        parent[start] = start
        rest = rest[rest != start]
        queue = [start]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            found = rest[hit]
            parent[found] = i
            queue += found.tolist()
            rest = rest[~hit]
        if not len(rest):
            break
    return np.where(parent < 0, np.arange(len(ids)), parent)


def _with_payload(light: DataFrame, payloads: DataFrame | None) -> DataFrame:
    """Rows with the payload of their id; joined by merging, as either side may be of any size."""
    return light if payloads is None else light.join(payloads.hint("merge"), "id")


def star_links(members: DataFrame, payloads: DataFrame | None, ws: Workspace, kernel, block_weight: int, named: bool = False) -> DataFrame:
    """Links ``(g, src, dst)`` of the rows of each group with its pivot, and of rows that share a block.

    ``members(g long, id long, weight long)`` is a written table, ids distinct in a group;
    ``payloads(id, payload)`` holds each id once, or is None where members carry a payload.
    ``kernel(payloads) -> near`` prepares the ``near`` of :func:`local_links`.

    A group is dealt over blocks of at most about ``block_weight`` (and of a share of all
    weight, so that a large group is spread over all tasks), each with a copy of the
    group's pivot: the id ``g`` if groups are ``named`` by a member, else the smallest id. Each block is linked in one breadth-first search from
    the pivot. Links between rows of different blocks that the pivot does not reach are
    left to :func:`cross_links`.
    """
    parts = partitions(ws.spark)
    total, weight = members.agg(F.count("*"), F.sum("weight")).first()
    block = max(1, min(block_weight, (weight or 0) // (2 * parts)))
    sizes = members.groupBy("g").agg((F.first("g") if named else F.min("id")).alias("pivot"), F.count("*").alias("n"), F.sum("weight").alias("w")).where("n > 1")
    sizes = sizes.select("g", "pivot", "n", F.greatest(F.lit(1), F.ceil(F.col("w") / block)).cast("int").alias("blocks"))
    own = F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = spread_join(members, sizes, ["g"], total).withColumn(
        "block", F.explode(F.when(F.col("id") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own))
    )
    keep = ["g", "block", "id", *(c for c in members.columns if c == "payload")]

    def link(batches):
        out = Rows(["g", "src", "dst"])
        for t in groups_of_batches(batches, ["g", "block"]):
            ids = t.column("id").to_numpy()
            if len(ids) > 1:
                first = np.flatnonzero(ids == t.column("g")[0].as_py()) if named else ()
                parent = local_links(ids, kernel(one_array(t.column("payload"))), int(first[0]) if len(first) else 0)
                at = np.flatnonzero(parent != np.arange(len(ids)))
                yield from out.add(t.column("g").to_numpy()[at], ids[at], ids[parent[at]])
        yield from out.flush()

    ready = _with_payload(dealt.select(*keep), payloads).repartition(parts, "g", "block").sortWithinPartitions("g", "block", "id")
    return ws.table(ready.mapInArrow(link, "g long, src long, dst long"), "stars")


def tiles(members: DataFrame, block_weight: int) -> DataFrame:
    """Rows of groups that hold several labels, dealt over tiles of two blocks, and not more.

    ``members(g, id, label, weight)``: rows of one label need no comparison. Of each group all rows
    but those of its heaviest label (the loose ones) are dealt over parts, and all rows over
    blocks; tile ``(g, part, block)`` meets every loose row of the part (``left``) with every
    row of the block (``right``). Each tile weighs about twice ``block_weight`` at most.
    """
    total = members.count()
    by_label = members.groupBy("g", "label").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    sizes = by_label.groupBy("g").agg(F.max(F.struct("w", "label")).alias("main"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")

    def count(w):
        return F.greatest(F.lit(1), F.ceil(w / block_weight)).cast("int")

    sizes = sizes.select("g", "n", F.col("main.label").alias("main"), count(F.col("w") - F.col("main.w")).alias("parts"), count(F.col("w")).alias("blocks"))
    part, block = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    loose = F.col("label") != F.col("main")
    across = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(q.alias("part"), F.col("_block").alias("block")))
    along = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.col("_part").alias("part"), j.alias("block")))
    dealt = spread_join(members, sizes, ["g"], total).withColumn("_part", part).withColumn("_block", block).withColumn("_loose", loose)
    dealt = dealt.withColumn("_tile", F.explode(F.when(F.col("_loose"), F.array_distinct(F.concat(across, along))).otherwise(across)))
    left = F.col("_loose") & (F.col("_tile.part") == F.col("_part"))
    return dealt.select(*members.columns, F.col("_tile.part").alias("part"), F.col("_tile.block").alias("block"), left.alias("left"), (F.col("_tile.block") == F.col("_block")).alias("right"))


def cross_links(members: DataFrame, payloads: DataFrame | None, ws: Workspace, kernel, block_weight: int) -> DataFrame:
    """Links ``(src, dst)`` between rows of one group but different labels: all that connect labels.

    ``members`` and ``payloads`` as for :func:`star_links`, with a ``label`` (long) of each row;
    rows are compared in the :func:`tiles` of their group, only with rows of labels that
    nothing in the tile connected with theirs yet.
    """
    keep = ["g", "part", "block", "id", "label", "left", "right", *(c for c in members.columns if c == "payload")]

    def cross(batches):
        out = Rows(["src", "dst"])
        for t in groups_of_batches(batches, ["g", "part", "block"]):
            ids, left, right = (t.column(c).to_numpy(zero_copy_only=False) for c in ("id", "left", "right"))
            _, label = np.unique(t.column("label").to_numpy(), return_inverse=True)
            if not left.any() or not label.any():
                continue
            near, others = kernel(one_array(t.column("payload"))), np.flatnonzero(right)
            for i in np.flatnonzero(left).tolist():
                rest = others[label[others] != label[i]]
                if not len(rest):
                    continue
                hit = rest[near(i, rest)]
                new, at = np.unique(label[hit], return_index=True)
                yield from out.add(np.repeat(ids[i], len(at)), ids[hit[at]])
                if len(new):
                    label[np.isin(label, new)] = label[i]
        yield from out.flush()

    ready = _with_payload(tiles(members, block_weight).select(*keep), payloads)
    ready = ready.repartition(partitions(ws.spark), "g", "part", "block").sortWithinPartitions("g", "part", "block", "id")
    return ws.table(ready.mapInArrow(cross, "src long, dst long"), "crossed")
