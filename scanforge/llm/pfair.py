"""Mixing sources to target weights by Pfair scheduling of blocks.

The k-th block of a source of weight w may run from slot floor(k / w) and must have run by
slot ceil((k + 1) / w). Of the blocks that may run, the one with the earliest deadline runs;
so at every slot each source is within one block of its share. Weights are kept as whole numbers
of any size, so releases and deadlines are exact. What has run by a slot tells all that follows: the driver
steps through the schedule and keeps such states at wide distances; tasks step through the stretches between them
again and write the blocks' slots.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanforge.llm.common import Workspace, as_own, own_columns, partitions
from scanforge.llm.links import spread_join


def source_key(source_col: str) -> Column:
    """A source's name, marked, so that a null source has a name of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("null"))


def whole_weights(weights: dict[str, Fraction]) -> dict[str, int]:
    """The least whole weights of the same proportions."""
    scale = math.lcm(*(w.denominator for w in weights.values()))
    whole = {s: int(w * scale) for s, w in weights.items()}
    common = math.gcd(*whole.values())
    return {s: w // common for s, w in whole.items()}


def slots(weights: dict[str, int], ran: dict[str, int], slot: int) -> Iterator[tuple[str, int, int, int]]:
    """(source, its turn, release, deadline) of ``slot`` and all that follow, where ``ran`` turns of each source lie before it.

    Turns and slots count from the start of the schedule of these weights. It depends on nothing but its arguments.
    """
    total, ran = sum(weights.values()), dict(ran)
    waiting = [(ran[s] * total // w, s) for s, w in weights.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str]] = []
    while True:
        while waiting and waiting[0][0] <= slot:
            release, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(ran[s] + 1) * total // weights[s]), release, s))
        deadline, release, s = heapq.heappop(ready)
        yield s, ran[s], release, deadline
        ran[s] += 1
        slot += 1
        heapq.heappush(waiting, (ran[s] * total // weights[s], s))


@dataclass
class Stretch:
    """``count`` slots from ``slot`` of the schedule of some weights, which began at slot ``begin`` of all with ``first`` blocks of each source done."""

    begin: int
    first: dict[str, int]
    weights: dict[str, int]
    slot: int
    ran: dict[str, int]
    count: int

    def rows(self) -> Iterator[tuple[str, int, int, int, int]]:
        """(source, block, slot, release, deadline) of each slot."""
        going = slots(self.weights, self.ran, self.slot)
        for at in range(self.slot, self.slot + self.count):
            s, turn, release, deadline = next(going)
            yield s, self.first[s] + turn, self.begin + at, self.begin + release, self.begin + deadline


def stretches(blocks: dict[str, int], weights: dict[str, Fraction], most: int = 1 << 16) -> Iterator[Stretch]:
    """The schedule of ``blocks[s]`` blocks of each source, in stretches; when a source ends, the others go on in proportion.

    A source's last blocks run in the slots of the schedule that it began with, so only the state at its end is new.
    """
    done, begin = dict.fromkeys(blocks, 0), 0
    active = {s for s in blocks if blocks[s] > 0}
    while active:
        whole = whole_weights({s: weights[s] for s in sorted(active)})
        first, ran = {s: done[s] for s in whole}, dict.fromkeys(whole, 0)
        slot, since, start = 0, 0, dict.fromkeys(whole, 0)
        for s, *_ in slots(whole, ran, 0):
            ran[s] += 1
            slot += 1
            ended = first[s] + ran[s] == blocks[s]
            if ended or slot - since == most:
                yield Stretch(begin, first, whole, since, start, slot - since)
                since, start = slot, dict(ran)
            if ended:
                break
        done |= {s: first[s] + ran[s] for s in whole}
        begin += slot
        active = {s for s in active if done[s] < blocks[s]}


def slot_table(spark, blocks: dict[str, int], weights: dict[str, Fraction], most: int = 1 << 16) -> DataFrame:
    """``(q, mix_block, slot, release, deadline)`` of all blocks; each stretch is stepped through in a task."""
    kind = "begin long, slot long, count long, q array<string>, weight array<string>, first array<long>, ran array<long>"
    plan = [(x.begin, x.slot, x.count, list(x.weights), list(map(str, x.weights.values())), [x.first[s] for s in x.weights], [x.ran[s] for s in x.weights]) for x in stretches(blocks, weights, most)]

    def step(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                named = lambda values: dict(zip(r.q, map(int, values), strict=True))  # noqa: E731, B023
                own = Stretch(r.begin, named(r.first), named(r.weight), r.slot, named(r.ran), r.count)
                yield pd.DataFrame(own.rows(), columns=["q", "mix_block", "slot", "release", "deadline"])

    return spark.createDataFrame(plan, kind).repartition(max(1, min(len(plan), partitions(spark)))).mapInPandas(step, "q string, mix_block long, slot long, release long, deadline long")


def root_weight(chars: int) -> int:
    """The weight of a source unless it is given: the square root of its characters."""
    return math.isqrt(chars) + 1


def root_weights(df: DataFrame, text_col: str = "text", source_col: str = "source") -> dict[str | None, int]:
    """The weight, by source, that :func:`mix_sources` takes by default: one row a source comes to the driver."""
    chars = F.sum(F.coalesce(F.length(f"`{text_col}`"), F.lit(0)).cast("long")).alias("chars")
    sizes = df.groupBy(source_key(source_col).alias("q")).agg(chars).collect()
    return {None if r.q == "null" else r.q[1:]: root_weight(r.chars) for r in sizes}


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: dict | None = None,
    block_chars: int = 1_000_000,
    seed: int = 7,
) -> DataFrame:
    """``df`` with ``mix_block``, ``mix_slot``, ``mix_release`` and ``mix_deadline``.

    Each source's documents stand in order of a hash of their id; the block of one is the number of
    whole ``block_chars`` characters before it, so that a source's first n blocks hold n blocks' characters
    but for one document's length. ``weights`` gives the sources' shares of blocks; by default they are as
    the square roots of the sources' characters, and sources that it leaves out weigh 1.
    Shares are exact, for any number of sources. Every row is kept: when a
    source ends, the others go on in proportion. A null source is a source of its own;
    null texts have no characters; rows of one id and source share a block, those of a null id too; columns of ``df`` that
    carry the names of results are replaced. An empty table stays empty.

    One count for each source comes to the driver, which steps once through the blocks (some microseconds each)
    and sends out a state for every 2^16 of them.
    """
    spark = df.sparkSession
    ws, parts = Workspace(spark, "pfair"), partitions(spark)
    results = ["mix_block", "mix_slot", "mix_release", "mix_deadline"]
    own = [c for c in df.columns if c not in results]
    doc = _doc_key(id_col).alias("doc")
    chars = F.coalesce(F.length(f"`{text_col}`"), F.lit(0)).cast("long").alias("chars")
    rows = df.select(as_own(df), source_key(source_col).alias("q"), doc, chars)
    light = rows.groupBy("q", "doc").agg(F.sum("chars").alias("chars"), F.count("*").alias("n")).withColumn("h", F.xxhash64("doc", F.lit(seed)))

    def running(batches):
        """Characters before each row among those of its queue in this task; rows come in order of queue."""
        task, queue, sent = TaskContext.get().partitionId(), None, 0
        for b in batches:
            q, n = b.column("q").to_numpy(zero_copy_only=False), b.column("chars").to_numpy()
            new = np.append(True, q[1:] != q[:-1])
            new[0] = q[0] != queue
            total = np.cumsum(n) - n
            first = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
            start = total - total[first] + np.where(first == 0, 0 if new[0] else sent, 0)
            queue, sent = q[-1], int(start[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("q", "doc", "chars", "n")), pa.array([task] * len(q), pa.int32()), pa.array(start)], ["q", "doc", "chars", "n", "task", "start"])

    ordered = light.repartitionByRange(parts, "q", "h", "doc").sortWithinPartitions("q", "h", "doc").select("q", "doc", "chars", "n")
    placed = ws.table(ordered.mapInArrow(running, "q string, doc string, chars long, n long, task int, start long"), "placed")
    sums = placed.groupBy("q", "task").agg(F.sum("chars").alias("chars"))
    queue = Window.partitionBy("q")
    earlier = queue.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("chars").over(queue)
    n_blocks = F.greatest(F.ceil(whole / F.lit(block_chars)), F.lit(1)).cast("long")
    base = ws.table(sums.select("q", "task", F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("base"), whole.alias("all"), n_blocks.alias("blocks")), "base")
    sizes = base.select("q", "all", "blocks").distinct().collect()
    given = {r.q: root_weight(r["all"]) if weights is None else weights.get(None if r.q == "null" else r.q[1:], 1) for r in sizes}
    share = {q: Fraction(w).limit_denominator(10**6) for q, w in given.items()}
    if any(w <= 0 for w in share.values()):
        raise ValueError("weights must be positive")
    schedule = ws.table(slot_table(spark, {r.q: r.blocks for r in sizes}, share), "slots")
    block = F.least(F.floor((F.col("start") + F.col("base")) / F.lit(block_chars)), F.col("blocks") - 1)
    dealt = placed.join(base, ["q", "task"]).select("q", "doc", F.col("n").alias("copies"), block.cast("long").alias("mix_block"))
    # Very many documents without characters may share a block.
    held = dealt.groupBy("q", "mix_block").agg(F.count("*").alias("n"))
    found = spread_join(dealt, held.join(schedule, ["q", "mix_block"]), ["q", "mix_block"], placed.count())
    units = found.select("q", "doc", F.col("copies").alias("n"), "mix_block", *(F.col(c).alias(f"mix_{c}") for c in ("slot", "release", "deadline")))
    mixed = spread_join(rows.select("own", "q", "doc"), units, ["q", "doc"], placed.agg(F.sum("n")).first()[0] or 0)
    return mixed.select(*own_columns(own), *results)


def _doc_key(id_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{id_col}`").cast("string")), F.lit("null"))


def in_mixed_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows in order of slot, range-partitioned, so that files read in order follow the mixture."""
    by = [F.col("mix_slot"), F.xxhash64(F.col(id_col)), F.col(id_col)]
    return mixed.repartitionByRange(partitions(mixed.sparkSession), *by).sortWithinPartitions(*by)
