"""What each filter of a chain removes under every order of the chain.

A document is one bit mask of the filters that it fails. With 0 for a failed filter and
infinity for a passed one, the min-plus product of the masks with the inverse permutations
(the position of each filter in each order) is the step at which an order removes a
document. Documents are counted by source and mask before anything else, so the matrices
work on at most 2 ^ filters weights a source, whatever the corpus holds.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.llm.common import WORD_BREAK, Workspace

#: The matrices grow with the factorial of the number of filters.
MOST_FILTERS = 7
NEVER = 1 << 20
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions on one text: too short, repetitive, upper case, symbols. ``words`` are the words of ``text``."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 2 * F.length(text),
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


def failure_masks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(part, id, digest, mask, n)``: how many rows of a part and id hold one text, and which of its filters it fails (bit 0 is the first)."""
    given = df.select(F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    worded = given.withColumn("words", F.filter(F.split("text", WORD_BREAK), lambda w: w != ""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_filters(F.col("text"), F.col("words")).values())]
    masked = worded.select("part", "id", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    return masked.groupBy("part", "id", "digest", "mask").agg(F.count("*").alias("n"))


def with_later_copies(masks: DataFrame, bit: int) -> DataFrame:
    """``masks`` with ``bit`` added where a smaller id has the same digest.

    The first id of each digest is found with map-side minima; the join back is by digest and id, so a
    text that a third of all rows share is spread over its ids.
    """
    first = masks.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    later = F.col("id").isNotNull() & F.col("first").isNull()
    return masks.join(first, ["digest", "id"], "left").withColumn("mask", F.col("mask") + F.when(later, 1 << bit).otherwise(0)).drop("first", "digest")


def removal_steps(filters: int) -> tuple[np.ndarray, np.ndarray]:
    """Orders (orders x filters) and the step, from 0, at which each order removes each mask (masks x orders).

    The step of a mask without failures is ``NEVER`` or more.
    """
    orders = np.array(list(permutations(range(filters))), np.int64)
    position = np.argsort(orders, axis=1)
    fails = (np.arange(1 << filters)[:, None] >> np.arange(filters)) & 1
    masked = np.where(fails == 1, 0, NEVER)
    return orders, (masked[:, None, :] + position[None, :, :]).min(axis=2)


def audit_counts(weights: np.ndarray, filters: int) -> dict[str, np.ndarray]:
    """Counts by part, order and step from ``weights``: parts x masks x (documents, good, toxic)."""
    orders, steps = removal_steps(filters)
    n_orders, parts = len(orders), len(weights)
    lost = np.zeros((parts, 3, n_orders * filters), np.int64)
    redundant = np.zeros((parts, n_orders * filters), np.int64)
    at = np.arange(n_orders) * filters
    for mask in range(1, 1 << filters):
        w = weights[:, mask, :]
        lost[:, :, at + steps[mask]] += w[:, :, None]
        again = ((mask >> orders) & 1 == 1) & (np.arange(filters) > steps[mask][:, None])
        redundant[:, again.ravel()] += w[:, :1]
    lost = lost.reshape(parts, 3, n_orders, filters)
    removed = lost[:, 0]
    alone = weights[:, 1 << np.arange(filters), 0]
    by_filter = np.stack([removed[:, orders == f].sum(axis=1) for f in range(filters)], axis=1)
    return {
        "kept": weights[:, :, 0].sum(axis=1)[:, None, None] - removed.cumsum(axis=2),
        "removed": removed,
        "redundant": redundant.reshape(parts, n_orders, filters),
        "unique_fails": alone[:, orders],
        "good_lost": lost[:, 1],
        "toxic_lost": lost[:, 2],
        "shapley": by_filter[:, orders],
    }


def audit_orders(patterns: DataFrame, letters: str) -> DataFrame:
    """``(part, filter_order, step)`` and the counts, from ``(part, mask, n, good, toxic)`` in any number of rows a mask."""
    k = len(letters)
    if not 1 <= k <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {k}")
    orders = ["".join(p) for p in permutations(letters)]
    weights = patterns.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    by_part = weights.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("weights"))

    def count(batches):
        labels, step = pa.array(np.repeat(orders, k)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                some = batch.slice(at, 32)
                entries = some.column("weights")
                row = np.repeat(np.arange(some.num_rows), entries.value_lengths().to_numpy())
                values = entries.flatten()
                w = np.zeros((some.num_rows, 1 << k, 3), np.int64)
                for i, c in enumerate(("n", "good", "toxic")):
                    w[row, values.field("mask").to_numpy(), i] = values.field(c).to_numpy()
                counts = audit_counts(w, k)
                parts = some.column("part").take(pa.array(np.repeat(np.arange(some.num_rows), len(step))))
                repeated = labels.take(pa.array(np.tile(np.arange(len(step)), some.num_rows)))
                yield pa.RecordBatch.from_arrays([parts, repeated, pa.array(np.tile(step, some.num_rows)), *(pa.array(counts[c].ravel()) for c in COUNTS)], ["part", "filter_order", "step", *COUNTS])

    return by_part.mapInArrow(count, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit_filters(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Counts by part, order of the five filters and step.

    A to D look at one text (see :func:`text_filters`); E fails where any row of a smaller id has the same
    text. Null texts are empty, null parts the empty string. Every row is a document, repeated rows and
    rows that share an id included; a row of a null id never fails E and has no label. An id is good or toxic if any of
    its rows in ``labels`` says 1; null ids and values there say nothing. Other columns of either
    table are ignored. Empty tables give no rows.
    """
    ws = Workspace(df.sparkSession, "audit")
    masks = ws.table(failure_masks(df, id_col, text_col, part_col), "masks")
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        *(F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0)).alias(c) for c in ("quality", "toxic"))
    )
    rows = with_later_copies(masks, 4).join(said, "id", "left")
    flag = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    patterns = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), flag("quality").alias("good"), flag("toxic").alias("toxic"))
    return audit_orders(patterns, "ABCDE")
