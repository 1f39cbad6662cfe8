"""Token-id output: best-fit-decreasing packing into fixed-length sequences.

Documents are tokenised where they lie and packed within their task, a bounded buffer at a
time, so ids are never shuffled. Overlong documents are cut into full sequences and a rest;
rests and short documents go, longest first, to the open sequence that they fill best, which
a segment tree over free capacities finds in logarithmic time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.llm.common import small_batches
from scanforge.llm.tokens import encoder


class CapacityTree:
    """Open sequences by free capacity; finds the one with the least that is enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.filled = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, free: int, by: int) -> None:
        at = free + self.leaves
        while at:
            self.filled[at] += by
            at >>= 1

    def put(self, free: int, sequence: int) -> None:
        self.open[free].append(sequence)
        self._change(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (free, sequence) of the best fit, or None."""
        at, filled = need + self.leaves, self.filled
        if not filled[at]:
            while at > 1 and not (at & 1 == 0 and filled[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if filled[2 * at] else 2 * at + 1
        free = at - self.leaves
        self._change(free, -1)
        return free, self.open[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``lengths`` (each at most ``capacity``) by sequence, in order of placement."""
    tree, sequences = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        got = tree.take(lengths[i])
        if got is None:
            sequences.append([i])
            left, at = capacity - lengths[i], len(sequences) - 1
        else:
            left, at = got[0] - lengths[i], got[1]
            sequences[at].append(i)
        if left:
            tree.put(left, at)
    return sequences


SCHEMA = (
    "sequence_id long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, n_tokens int, ids binary, positions binary"
)


def pack_documents(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    pad_id: int = 0,
    buffer_tokens: int = 4_000_000,
) -> DataFrame:
    """One row per packed sequence.

    A document is its token ids and ``end_id``; a null or empty text is ``end_id`` alone. Each
    of its ids lies in exactly one piece; only a document longer than ``capacity`` is cut.
    ``doc_ids`` and ``starts`` name the pieces in order (``starts``: ids of the document before
    the piece), ``cu_seqlens`` holds the cumulative segment lengths from 0, ``ids`` is a row
    of the id matrix (``capacity`` unsigned 32-bit little-endian ids, ``pad_id`` at the end) and ``positions``
    counts from 0 again in each segment (unsigned 16-bit). ``sequence_id`` is unique:
    the task's number times 2**33 plus a count. Rows are packed as they come, repeated rows
    and rows of a null id too; other columns are ignored; an empty table gives no sequence.
    """
    if not 0 < capacity <= 65536:
        raise ValueError("capacity must be from 1 to 65536")
    small_batches(df.sparkSession)

    def pack(batches):
        encode, number = encoder(tokenizer_path), TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4").tobytes()
        buffer: list[tuple[int | None, int, bytes]] = []
        held = 0

        def rows(groups):
            nonlocal number
            columns = [[] for _ in range(7)]
            for pieces in groups:
                lengths = [len(x[2]) // 4 for x in pieces]
                n = sum(lengths)
                positions = np.concatenate([*(np.arange(k, dtype="<u2") for k in lengths), np.zeros(capacity - n, "<u2")])
                ids = b"".join(x[2] for x in pieces) + np.full(capacity - n, pad_id, "<u4").tobytes()
                row = (number, [x[0] for x in pieces], [x[1] for x in pieces], [0, *np.cumsum(lengths).tolist()], n, ids, positions.tobytes())
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
                number += 1
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary())
            names = ["sequence_id", "doc_ids", "starts", "cu_seqlens", "n_tokens", "ids", "positions"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def flush():
            groups = best_fit_decreasing([len(x[2]) // 4 for x in buffer], capacity)
            for start in range(0, len(groups), 256):
                yield rows([[buffer[i] for i in g] for g in groups[start : start + 256]])
            buffer.clear()

        for b in batches:
            full = []
            for doc, ids in zip(b.column("id").to_pylist(), encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                ids += end
                step = 4 * capacity
                for at in range(0, len(ids), step):
                    piece = (doc, at // 4, ids[at : at + step])
                    if len(piece[2]) == step:
                        full.append([piece])
                    else:
                        buffer.append(piece)
                        held += len(piece[2]) // 4
            if full:
                yield rows(full)
            if held >= buffer_tokens:
                yield from flush()
                held = 0
        yield from flush()

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(pack, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """The id matrix, cumulative segment lengths and positions as Parquet, rows in order of sequence within each file."""
    packed.sortWithinPartitions("sequence_id").write.mode("overwrite").parquet(path)
