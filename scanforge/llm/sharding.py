"""Shards of nearly equal bytes: sampled splitters, range partitioning, overfull ranges subdivided.

The range key is a hash of the text, so equal texts are neighbours. Keys are sampled by the
size of what they hold; quantiles of the sample bound many more ranges than shards, ranges
that hold more than their share are subdivided by their exact running size, and keys too heavy for a
range are dealt over ranges of their own. Shards are then filled with whole ranges, largest first.
Texts move once, when each row goes to its range.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanforge.llm.common import Workspace, as_own, own_columns, partitions

LAW = "bytes"
#: Bytes that a row takes beside its text.
ROW_BYTES = 8
#: Keys drawn for each range.
DRAWN = 16
SEED = 20_029


def splitters(keys: np.ndarray, weights: np.ndarray, ranges: int) -> np.ndarray:
    """Lower bounds of all ranges but the first: the keys at which the running weight of a sorted sample passes a quantile."""
    order = np.argsort(keys)
    keys, running = keys[order], np.cumsum(weights[order])
    if not len(keys):
        return np.zeros(0, np.int64)
    at = np.searchsorted(running, running[-1] * np.arange(1, ranges) / ranges, side="left") + 1
    return np.unique(keys[at[at < len(keys)]])


def range_splits(groups: DataFrame, ranges: int) -> tuple[np.ndarray, dict[int, int]]:
    """Splitters for the keys that fit into a range, and the pieces of each key that doesn't.

    ``groups`` holds ``(h, bytes, n)``, one row a key. A key weighs its share of all bytes and of all
    rows, as either makes a range slow. What comes to the driver is bounded: about ``DRAWN`` keys a range, one row a range, and
    at most one heavy key a range.
    """
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).first()
    if not total.n:
        return np.zeros(0, np.int64), {}
    weighed = groups.select("h", ((F.col("bytes") / total.bytes + F.col("n") / total.n) / 2).alias("w"))
    share = 1 / ranges
    heavy = {r.h: math.ceil(r.w / share) for r in weighed.where(F.col("w") > share).collect()}
    light = weighed.where(F.col("w") <= share)
    chance = F.col("w") * (ranges * DRAWN)
    drawn = light.where(F.pmod(F.xxhash64("h", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30) < chance)
    sample = drawn.select("h", F.greatest("w", F.lit(share / DRAWN)).alias("w")).toPandas()
    cuts = splitters(sample["h"].to_numpy(np.int64), sample["w"].to_numpy(float), ranges)
    ranged = light.withColumn("r", _range_of(cuts)("h"))
    overfull = [r.r for r in ranged.groupBy("r").agg(F.sum("w").alias("w")).where(F.col("w") > 1.5 * share).collect()]
    if overfull:
        running = F.sum("w").over(Window.partitionBy("r").orderBy("h"))
        pieces = ranged.where(F.col("r").isin(overfull)).withColumn("piece", F.floor(running / share))
        more = [r.h for r in pieces.groupBy("r", "piece").agg(F.min("h").alias("h")).where("piece > 0").collect()]
        cuts = np.unique(np.concatenate([cuts, np.array(more, np.int64)]))
    return cuts, heavy


def _range_of(cuts: np.ndarray):
    @F.pandas_udf("int")
    def range_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, h.to_numpy(np.int64), side="right").astype(np.int32))

    return range_of


def _unit_of(cuts: np.ndarray, heavy: dict[int, int]):
    """The unit of a row: its range, or one of its key's own pieces by a random number."""
    keys = np.array(sorted(heavy), np.int64)
    pieces = np.array([heavy[k] for k in keys.tolist()], np.int64)
    first = len(cuts) + 1 + np.concatenate([[0], np.cumsum(pieces)[:-1]]).astype(np.int64) if len(keys) else keys

    @F.pandas_udf("int")
    def unit_of(h: pd.Series, u: pd.Series) -> pd.Series:
        h, u = h.to_numpy(np.int64), u.to_numpy(float)
        unit = np.searchsorted(cuts, h, side="right")
        if len(keys):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            unit = np.where(keys[at] == h, first[at] + np.minimum(u * pieces[at], pieces[at] - 1).astype(np.int64), unit)
        return pd.Series(unit.astype(np.int32))

    return unit_of


def fill_shards(units: list[tuple[int, int, int]], keys: dict[int, int], shards: int) -> list[tuple[int, int, int]]:
    """``(unit, shard, first slot)`` from ``(unit, rows, bytes)``, largest first into the emptiest shard.

    ``keys`` names the units of one heavy key: they stay together where all of them fit a shard's share.
    """
    share = sum(b for _, _, b in units) / shards
    together: dict[int, list] = {}
    for u in units:
        together.setdefault(keys.get(u[0], -1 - u[0]), []).append(u)
    items = []
    for own in together.values():
        items += [own] if sum(b for _, _, b in own) <= share else [[u] for u in own]
    items.sort(key=lambda own: (-sum(b for _, _, b in own), own[0][0]))
    heap, out = [(0, 0, s) for s in range(shards)], []
    for own in items:
        filled, rows, s = heapq.heappop(heap)
        for unit, n, b in sorted(own):
            out.append((unit, s, rows))
            filled, rows = filled + b, rows + n
        heapq.heappush(heap, (filled, rows, s))
    return out


def shard_documents(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 64) -> DataFrame:
    """``df`` with ``size``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8. Shards hold nearly equal sizes (law ``bytes``):
    they are filled with ranges of about 1 / ``ranges_per_shard`` of a shard, whole. Equal texts share a shard unless together they
    exceed one shard's share. ``slot`` counts from 0 in each shard, without gaps; ``grown_shard`` is null under this law.
    Every row is placed, repeated rows, null ids and null texts included; null and empty texts are equal. A row larger than a
    shard's share has a shard to itself. Columns of ``df`` that carry the names of results are replaced. An empty table gives no rows.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "shards")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    size = (F.octet_length(text) + ROW_BYTES).cast("long")
    ranges = shards * ranges_per_shard
    groups = ws.table(df.select(F.xxhash64(text).alias("h"), size.alias("size")).groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "keys")
    cuts, heavy = range_splits(groups, ranges)
    rows = df.select(as_own(df), F.xxhash64(text).alias("h"), size.alias("size"), F.col(f"`{id_col}`").alias("id"), F.rand(SEED).alias("u"))
    dealt = rows.withColumn("unit", _unit_of(cuts, heavy)("h", "u")).drop("u").repartition(partitions(spark), "unit")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("unit").orderBy("h", "id")) - 1)
    stored = ws.table(ranked.select("own", "size", "unit", "rank"), "ranges")
    counts = [tuple(r) for r in stored.groupBy("unit").agg(F.count("*"), F.sum("size")).collect()]
    key_of, unit = {}, len(cuts) + 1
    for i, k in enumerate(sorted(heavy)):
        key_of |= dict.fromkeys(range(unit, unit + heavy[k]), i)
        unit += heavy[k]
    # A few rows for each of the ranges.
    places = spark.createDataFrame(fill_shards(counts, key_of, shards), "unit int, shard int, first long")
    placed = stored.join(F.broadcast(places), "unit")
    results = {"size": F.col("size"), "law": F.lit(LAW), "shard": F.col("shard"), "slot": F.col("first") + F.col("rank"), "grown_shard": F.lit(None).cast("int")}
    return placed.select(*own_columns([c for c in df.columns if c not in results]), *(c.alias(name) for name, c in results.items()))
