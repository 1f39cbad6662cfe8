"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Rotations learned on a bounded sample turn each vector into balanced binary codes.
The codes are cut into 16-bit substrings, each a key of one hash table; vectors that
share a key and differ in few bits of the first codes are candidates, and only they are
compared by cosine, on the original vectors. Components of the links found are all that the last
step, which counts links, looks at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.llm.common import Rows, Workspace, groups_of_batches, one_array, partitions, small_batches
from scanforge.llm.links import connected_components, cross_links, spread_join, star_links, tiles
from scanforge.llm.shingles import mix64

#: Bits of a table's key, and of the part of the code by which candidates of a table are told.
BITS, CODE = 16, 256
#: Pairs of codes that are compared in the time that a row of a table takes.
COMPARED = 10


@dataclass
class Plan:
    """How vectors of one dimension are coded: the mean; the projection to the keys of ``tables``
    tables of ``bits`` bits each; the projection to the code; bits of it in which candidates may differ."""

    mean: np.ndarray
    keys: np.ndarray
    tables: int
    bits: int
    code: np.ndarray
    hamming: int


def unit_rows(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of components: the rows with such a vector, and the vectors scaled to length 1.

    Rows that are null or zero, or hold a null or a non-finite component, are left out.
    """
    lengths = np.asarray(pa.compute.list_value_length(column).fill_null(0))
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = {}
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        x = values[starts[rows][:, None] + np.arange(dim)]
        most = np.abs(x).max(axis=1)
        good = np.isfinite(most) & (most > 0)
        x = x[good] / most[good, None]
        out[dim] = rows[good], x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return out


def fit_itq(x: np.ndarray, rotations: int, most_bits: int = 64, rounds: int = 20, seed: int = 17, skip: int = 0, most_rows: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """The mean and, side by side, ``rotations`` learned projections to at most ``most_bits`` bits.

    The first ``skip`` principal components are left out. Rotations are learned on the first
    ``most_rows`` vectors. Each starts from another random rotation of the principal components and
    alternates between codes and the rotation nearest to them (a Procrustes problem).
    """
    mean = x.mean(axis=0)
    centred = x - mean
    _, _, axes = np.linalg.svd(centred.T @ centred)
    axes = axes[skip : skip + most_bits].T
    v = centred[:most_rows] @ axes
    rng, out = np.random.default_rng(seed), []
    for _ in range(rotations):
        r, _ = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))
        for _ in range(rounds):
            codes = np.where(v @ r >= 0, 1.0, -1.0)
            a, _, b = np.linalg.svd(v.T @ codes)
            r = a @ b
        out.append(axes @ r)
    return mean, np.concatenate(out, axis=1)


def _codes(payload: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(payload.to_pylist()), np.uint64).reshape(len(payload), CODE // 64)


def _hamming(most: int):
    def kernel(payload: pa.Array):
        codes = _codes(payload)
        return lambda i, rest: np.bitwise_count(codes[rest] ^ codes[i]).sum(axis=1) <= most

    return kernel


def _cosine(threshold: float):
    def kernel(payload: pa.Array):
        """``payload(v, label_key)``."""
        dim, x = np.zeros(len(payload), np.int64), {}
        for d, (at, unit) in unit_rows(payload.field("v")).items():
            dim[at] = d
            x[d] = np.zeros((len(payload), d))
            x[d][at] = unit
        label = payload.field("label_key").to_numpy()

        def near(i, rest):
            out = (dim[rest] == dim[i]) & (label[rest] == label[i])
            if dim[i]:
                out[out] = x[dim[i]][rest[out]] @ x[dim[i]][i] >= threshold
            return out & bool(dim[i])

        return near

    return kernel


def _pairs_at(x: np.ndarray, threshold: float, most: int = 1000, seed: int = 29) -> tuple[np.ndarray, np.ndarray]:
    """Sampled vectors, and others at just the threshold from them: half in the direction in which
    two vectors of the sample differ, half in any direction."""
    rng = np.random.default_rng(seed)
    u = x[rng.integers(0, len(x), most)]
    w = rng.normal(size=u.shape)
    half = most // 2
    w[:half] = x[rng.integers(0, len(x), half)] - x[rng.integers(0, len(x), half)]
    w -= (w * u).sum(axis=1, keepdims=True) * u
    length = np.sqrt((w * w).sum(axis=1, keepdims=True))
    good = length[:, 0] > 1e-9
    u, w = u[good], w[good] / length[good]
    return u, threshold * u + np.sqrt(max(0.0, 1 - threshold**2)) * w


def _other_pairs(x: np.ndarray, label: np.ndarray, threshold: float, most: int = 4000, seed: int = 31) -> tuple[np.ndarray, np.ndarray]:
    """Sampled pairs of one label that do not link."""
    order = np.random.default_rng(seed).permutation(len(x))
    order = order[np.argsort(label[order], kind="stable")]
    a, b = (np.concatenate([order[k:] if first else order[:-k] for k in (1, 2, 3)]) for first in (True, False))
    apart = np.flatnonzero((label[a] == label[b]) & ((x[a] * x[b]).sum(axis=1) < threshold))
    apart = np.random.default_rng(seed).permutation(apart)
    return x[a[apart][:most]], x[b[apart][:most]]


def _plan(x: np.ndarray, label: np.ndarray, rows_a_label: float, tables: int, threshold: float, slack: int, found: float = 0.97, most_tables: int = 96) -> Plan:
    """How to code and look up the vectors of one dimension, from a sample of them.

    Pairs at just the threshold, made from the sample, must share a table with probability ``found``:
    in ``tables`` tables of 16 bits, or in up to ``most_tables`` of fewer (of under 8 only if nothing else does). Pairs of one label that
    do not link tell which choice compares least. What vectors of a label have in
    common lies in the first principal components; codes may leave out 4 or 16 of these.
    """
    u, v = _pairs_at(x, threshold)
    a, b = _other_pairs(x, label, threshold)
    mean, dim, best = x.mean(axis=0), x.shape[1], None
    skips = [k for k in (0, 4, 16) if k <= dim // 4]

    def differ(projection, one, two):
        return ((one - mean) @ projection >= 0) != ((two - mean) @ projection >= 0)

    def rotations(bits, skip):
        return -(-bits // min(64, dim - skip))

    for skip in skips:
        projection = fit_itq(x, rotations(CODE, skip), skip=skip)[1][:, :CODE]
        hamming = int(np.ceil(np.quantile(differ(projection, u, v).sum(axis=1), 0.999))) + slack if len(u) else CODE
        close = (differ(projection, a, b).sum(axis=1) <= hamming).mean() if len(a) else 0.0
        if best is None or close < best[0]:
            best = close, projection, hamming
    _, code, hamming = best
    choice = None
    for skip, most in ((0, tables), *((k, max(tables, most_tables)) for k in skips)):
        projection = fit_itq(x, rotations(most * BITS, skip), skip=skip)[1][:, : most * BITS]
        at, apart = (differ(projection, *p).reshape(-1, most, BITS) for p in ((u, v), (a, b)))
        for bits in (16, 14, 12, 10, 8, 6, 4, 2, 0):
            if bits < 8 and choice:
                break
            share = np.logical_or.accumulate(~at[:, :, :bits].any(axis=2), axis=1).mean(axis=0) if len(u) else np.ones(most)
            enough = np.flatnonzero(share >= found)
            if len(enough):
                # A key of no bits compares all vectors of a label, in one table.
                count = max(tables, int(enough[0]) + 1) if bits else 1
                both = (~apart[:, :count, :bits].any(axis=2)).sum(axis=1).mean() if len(a) else 0.0
                cost = count + both * rows_a_label / COMPARED
                if choice is None or cost < choice[0]:
                    choice = cost, projection[:, : count * BITS], count, bits
        if choice and choice[0] < 2 * tables:
            break
    return Plan(mean, choice[1], choice[2], choice[3], code, hamming)


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    tables: int = 24,
    slack: int = 3,
    sample_rows: int = 8192,
    block_rows: int = 2048,
) -> DataFrame:
    """One row per row of ``df``: id, ``n_links``, ``component_id``, ``kept``, ``n_copies``.

    Vectors link when their labels are equal and not null, their numbers of components
    are equal, and their cosine is ``threshold`` or more. ``n_links`` counts the other
    rows that a row links with; ``component_id`` is the smallest id reachable by links.
    Vectors that are null, zero, or hold null or non-finite components link with
    nothing, like those of a null label: each is a component of its own. Equal vectors
    of one label are compared once and counted as often as they occur; repeated rows
    are copies like any others. A null id stays null. Other columns are ignored. An
    empty table gives an empty result.

    The rotations are fitted on at most ``sample_rows`` vectors (by a hash of the
    vector); every vector is indexed. Pairs at just the threshold are made from the sample, and
    where ``tables`` tables find fewer than 0.97 of them, there are more tables, or keys of
    fewer bits, until they do; closer pairs are found more surely. Vectors that share a key
    are candidates if their codes of 256 bits differ in no more bits than in 0.999 of those pairs, and ``slack`` more.

    First each vector is compared by cosine with the candidate from which a search over its
    tables reached it. Then candidates of different components are, in the tables that hold
    them. Links are counted within the components found, all pairs of a component, in
    blocks of ``block_rows``: within a group of near copies that work is quadratic, as every row must
    tell how many it links with; copies of one vector are a single row of it.
    """
    spark = df.sparkSession
    small_batches(spark, 4096)
    ws = Workspace(spark, "itq")
    vector = F.col(vector_col)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"), F.col(label_col).alias("label"))
    rows = rows.withColumn("rid", F.when(F.col("label").isNotNull() & (F.size("v") > 0), F.xxhash64("label", "v")))
    nodes = ws.table(
        rows.where("rid is not null").groupBy("rid").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")),
        "nodes",
    )
    models = _models(nodes, tables, sample_rows, threshold, slack)
    most_differ = max([m.hamming for m in models.values()], default=CODE)

    def coded(batches):
        for b in batches:
            v, rid, label = b.column("v"), b.column("rid").to_numpy(), np.asarray(b.column("label_key"))
            for dim, (at, x) in unit_rows(v).items():
                if not len(at):
                    continue
                m = models.get(dim) or _untrained(dim, tables)
                count, centred = m.tables, x - m.mean
                packed = np.packbits(centred @ m.keys >= 0, axis=1, bitorder="little")
                keys = np.ascontiguousarray(packed).view(np.uint16).astype(np.uint64) & np.uint64((1 << m.bits) - 1)
                code = np.packbits(centred @ m.code >= 0, axis=1, bitorder="little")
                g = mix64((keys << np.uint64(16)) | np.arange(count, dtype=np.uint64)) ^ mix64(label[at].astype(np.uint64) + np.uint64(dim) * np.uint64(0x9E3779B9))[:, None]
                offsets = np.arange(0, g.size + 1, count, dtype=np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": rid[at],
                        "tables": pa.ListArray.from_arrays(offsets, pa.array(mix64(g.ravel()).view(np.int64))),
                        "payload": pa.array([bytes(r) for r in code], pa.binary()),
                    }
                )

    vectors = nodes.select(F.col("rid").alias("id"), F.struct("v", F.xxhash64("label").alias("label_key")).alias("payload"))
    codes = ws.table(nodes.select("rid", "v", F.xxhash64("label").alias("label_key")).mapInArrow(coded, "id long, tables array<long>, payload binary"), "codes")
    buckets = ws.table(codes.select(F.explode("tables").alias("g"), "id", F.lit(1).cast("long").alias("weight")), "buckets")
    payloads, close, similar = codes.select("id", "payload"), _hamming(most_differ), _cosine(threshold)

    reached = star_links(buckets, payloads, ws, close, 8 * block_rows).groupBy("src").agg(F.min("dst").alias("g"))
    first = ws.table(reached.select("g", F.col("src").alias("id")).union(reached.select("g", "g")).distinct().withColumn("weight", F.lit(1).cast("long")), "first")
    stars = star_links(first, vectors, ws, similar, block_rows, named=True).select("src", "dst")
    classes = connected_components(stars, ws).withColumnRenamed("node", "id")
    labelled = ws.table(buckets.join(classes, "id", "left").select("g", "id", F.coalesce("component", "id").alias("label"), "weight"), "labelled")
    active = ws.table(_candidates(labelled, payloads, close, partitions(spark), 8 * block_rows).distinct().join(classes, "id", "left")
                      .select("g", "id", F.coalesce("component", "id").alias("label"), F.lit(1).cast("long").alias("weight")), "active")
    links = stars.union(cross_links(active, vectors, ws, similar, block_rows))
    groups = ws.table(connected_components(links, ws), "groups")
    counts = _count_links(groups, vectors, nodes.select(F.col("rid").alias("id"), "n"), threshold, partitions(spark), block_rows)
    final = nodes.select("rid", "vec_id", "n").join(groups.select(F.col("node").alias("rid"), F.col("component").alias("root")), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    lowest = final.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    # A vector that no cosine is defined for was given a node, but its copies do not link.
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: F.coalesce(x, F.lit(0)) != 0)
    final = final.join(lowest, "root").join(counts.withColumnRenamed("id", "rid"), "rid", "left").select("rid", "n", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    result = rows.withColumn("rid", F.when(finite, F.col("rid"))).select("vec_id", "rid").join(final, "rid", "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select(
        F.col("vec_id").alias(id_col),
        F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
        F.coalesce("n", F.lit(1)).cast("long").alias("n_copies"),
    )


def _candidates(labelled: DataFrame, payloads: DataFrame, close, parts: int, block_rows: int) -> DataFrame:
    """``(g, id)`` of the rows of a table that are close to a row of another label in it."""

    def mark(batches):
        out = Rows(["g", "id"])
        for t in groups_of_batches(batches, ["g", "part", "block"]):
            ids, label, left, right = (t.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "left", "right"))
            near, others, found = close(one_array(t.column("payload"))), np.flatnonzero(right), np.zeros(len(ids), bool)
            for i in np.flatnonzero(left).tolist():
                rest = others[label[others] != label[i]]
                hit = rest[near(i, rest)]
                found[hit] = True
                found[i] |= len(hit) > 0
            at = np.flatnonzero(found)
            if len(at):
                yield from out.add(t.column("g").to_numpy()[at], ids[at])
        yield from out.flush()

    ready = tiles(labelled, block_rows).drop("weight").join(payloads.hint("merge"), "id")
    columns = ["g", "part", "block", "id", "label", "left", "right", "payload"]
    return ready.select(*columns).repartition(parts, "g", "part", "block").sortWithinPartitions("g", "part", "block", "id").mapInArrow(mark, "g long, id long")


def _count_links(groups: DataFrame, vectors: DataFrame, copies: DataFrame, threshold: float, parts: int, block_rows: int) -> DataFrame:
    """``(id, links)``: rows of other vectors that each vector of a component links with."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
    dealt = spread_join(groups, sizes, ["component"], groups.count()).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", F.col("node").alias("id"))
    ready = dealt.join(copies.hint("merge"), "id").join(vectors.hint("merge"), "id")

    def count(batches):
        out = Rows(["id", "links"])
        for t in groups_of_batches(batches, ["component", "a", "b"]):
            ids, n, payload = t.column("id").to_numpy(), t.column("n").to_numpy(), one_array(t.column("payload"))
            label = payload.field("label_key").to_numpy()
            first = t.column("mine").to_numpy() == t.column("a").to_numpy()[0]
            one_block = t.column("a")[0] == t.column("b")[0]
            links = np.zeros(len(ids), np.int64)
            for at, x in unit_rows(payload.field("v")).values():
                left, right = (at, at) if one_block else (at[first[at]], at[~first[at]])
                xl, xr = (x, x) if one_block else (x[first[at]], x[~first[at]])
                near = xl @ xr.T >= threshold
                near &= label[left][:, None] == label[right][None, :]
                near &= ids[left][:, None] != ids[right][None, :]
                links[left] += np.rint(near.astype(float) @ n[right]).astype(np.int64)
                if not one_block:
                    links[right] += np.rint(n[left] @ near.astype(float)).astype(np.int64)
            yield from out.add(ids, links)
        yield from out.flush()

    ready = ready.select("component", "a", "b", "mine", "id", "n", "payload").repartition(parts, "component", "a", "b").sortWithinPartitions("component", "a", "b")
    return ready.mapInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _untrained(dim: int, tables: int) -> Plan:
    """Random projections, for a dimension of which the sample holds hardly any vector."""
    rng = np.random.default_rng(dim)
    return Plan(np.zeros(dim), rng.normal(size=(dim, tables * BITS)), tables, BITS, rng.normal(size=(dim, CODE)), CODE)


def _models(nodes: DataFrame, tables: int, sample_rows: int, threshold: float, slack: int) -> dict[int, Plan]:
    """The plan of each dimension of which the sample holds 64 vectors or more."""
    sample = nodes.orderBy(F.hash("rid"), "rid").limit(sample_rows).select("v", F.xxhash64("label").alias("label")).toArrow()
    if not sample.num_rows:
        return {}
    rows_a_label = nodes.groupBy("label").count().agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0]
    label, models = sample.column("label").to_numpy(), {}
    for dim, (at, x) in unit_rows(one_array(sample.column("v"))).items():
        if len(x) >= 64:
            models[dim] = _plan(x, label[at], rows_a_label, tables, threshold, slack)
    return models
