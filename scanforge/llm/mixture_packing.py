"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Every window gives each queue a quantum of tokens, its share of the window; what is less than
a token is carried to the next window as a deficit. So the tokens that a queue has sent by
window w are the whole part of w quanta, and the place of every token follows from its place
in its queue: no task waits for another, and deficits carry across windows and partitions
alike. When a queue is empty, the others share its quantum in proportion.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanforge.llm.common import Workspace, small_batches
from scanforge.llm.pfair import source_key
from scanforge.llm.tokens import encoder


#: Numbers that a task holds at once to place slices of windows.
CELLS = 1 << 21


@dataclass
class RoundRobin:
    """Tokens sent by queue and window.

    All queues follow one clock. In a window it goes on by the window's tokens over the weights of all queues that are not
    empty, and a queue has sent its weight times the clock until it is empty. So three numbers a queue tell all.
    """

    totals: np.ndarray  # tokens of each queue
    weights: np.ndarray
    ends: np.ndarray  # the clock when each queue is empty
    times: np.ndarray  # windows, from 0, at which some queue ends
    clock: np.ndarray  # the clock at these

    @classmethod
    def plan(cls, totals: np.ndarray, weights: np.ndarray, window: int) -> RoundRobin:
        ends = totals / weights
        order = np.argsort(ends, kind="stable")
        knots, first = np.unique(ends[order], return_index=True)
        active = np.cumsum(weights[order][::-1])[::-1][first]
        times = np.cumsum(np.diff(knots, prepend=0.0) * active / window)
        return cls(totals, weights, ends, np.append(0.0, times), np.append(0.0, knots))

    def before(self, queue, w: np.ndarray) -> np.ndarray:
        """Tokens that queues send in windows before ``w``."""
        clock = np.interp(w, self.times, self.clock)
        sent = np.floor(self.weights[queue] * clock).astype(np.int64)
        return np.where(clock >= self.ends[queue], self.totals[queue], np.minimum(sent, self.totals[queue]))

    def window_of(self, queue, token: np.ndarray) -> np.ndarray:
        w = np.floor(np.interp(token / self.weights[queue], self.clock, self.times)).astype(np.int64)
        while (low := self.before(queue, w) > token).any():
            w -= low
        while (high := self.before(queue, w + 1) <= token).any():
            w += high
        return w

    def starts(self, queue: np.ndarray, w: np.ndarray, cells: int = CELLS) -> np.ndarray:
        """The place among all tokens of each queue's slice of window ``w``; a few windows at a time, whatever the number of queues."""
        windows, at = np.unique(w, return_inverse=True)
        everyone, out = np.arange(len(self.totals)), np.zeros(len(w), np.int64)
        step = max(1, cells // max(1, len(everyone)))
        for i in range(0, len(windows), step):
            part = windows[i : i + step, None]
            low = self.before(everyone, part)
            size = self.before(everyone, part + 1) - low
            place = low.sum(axis=1, keepdims=True) + np.cumsum(size, axis=1) - size
            mine = np.flatnonzero((at >= i) & (at < i + step))
            out[mine] = place[at[mine] - i, queue[mine]]
        return out


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the row and ``first`` to ``first + count - 1`` for each row."""
    row = np.repeat(np.arange(len(first)), count)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def cut(plan: RoundRobin, queue: np.ndarray, start: np.ndarray, length: np.ndarray, sequence: int):
    """Pieces of documents at ``start`` in their ``queue``: row, start in the document, length, sequence, offset, window."""
    first = plan.window_of(queue, start)
    row, w = _spread(first, plan.window_of(queue, start + length - 1) - first + 1)
    low, high = np.maximum(start[row], plan.before(queue[row], w)), np.minimum((start + length)[row], plan.before(queue[row], w + 1))
    some = high > low
    row, w, low, high = row[some], w[some], low[some], high[some]
    place = plan.starts(queue[row], w) + low - plan.before(queue[row], w)
    piece, seq = _spread(place // sequence, (place + high - low - 1) // sequence - place // sequence + 1)
    begin = np.maximum(place[piece], seq * sequence)
    end = np.minimum((place + high - low)[piece], (seq + 1) * sequence)
    return row[piece], (low - start[row])[piece] + begin - place[piece], end - begin, seq, begin - seq * sequence, w[piece]


def file_place() -> tuple[Column, Column]:
    """The file of a row and its place there, where rows are read from Parquet files."""
    return F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")


def _stretches(files: pa.Array, places: np.ndarray, file: str | None, last: int | None):
    """(row, place) at which a stretch of a file starts: where a task goes on with another file, or elsewhere in the file after ``last``."""
    names = files.to_pylist()
    for i, (f, place) in enumerate(zip(names, places.tolist(), strict=True)):
        if f != file or place != last + 1:
            yield i, place
        file, last = f, place


def reads_files(df: DataFrame) -> bool:
    """Whether rows of ``df`` have a place in a file."""
    try:
        df.select(*file_place()).schema
    except AnalysisException:
        return False
    return True


def pack_mixture(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: dict[str | None, float] | None = None,
    sequence: int = 1024,
    window_sequences: int = 64,
    end_id: int = 0,
    exponent: float = 1.0,
    in_file_order: bool = False,
) -> DataFrame:
    """One row per piece of a document in a sequence of ``sequence`` tokens.

    A document is its token ids and ``end_id``; null or empty text is ``end_id`` alone. A
    window is ``window_sequences`` sequences and holds tokens of each source in proportion to
    ``weights``, to within a token for each source, until a source ends; then the others share its
    place in proportion. Sources without a weight weigh 1. Without ``weights`` sources weigh as their tokens to
    the power of ``exponent``: at 1 all end together, below 1 the smaller sources weigh more and end
    later. Every source has a queue of its own, however many there are. All sequences but the last are
    full; ``padded_length`` is ``sequence``, or the last one's length if that is a power of
    two. A null source is a source of its own. Documents of a source queue as tasks read them, or, with
    ``in_file_order``, in the order of the files that ``df`` reads and of the rows in them; rows of equal or null id are packed one by one. Other columns are ignored; an empty
    table gives no piece. Columns: id, ``source``, ``start`` (the document's ids before the
    piece), ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``window``,
    ``padded_length``, ``ids``.

    Ids are written once to the shared folder and never shuffled: what moves is one count for
    each queue in each partition, or in each stretch of a file that a task reads. One count for each source comes to
    the driver, and three numbers for each go to the tasks.
    """
    spark = df.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "mixture")
    source = source_key(source_col)

    def tokenise(batches):
        encode, sent, task = encoder(tokenizer_path), {}, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        file, last, first = None, None, 0
        for b in batches:
            ids = [x + end for x in encode([t or "" for t in b.column("text").to_pylist()])]
            start, n, firsts = [], [len(x) // 4 for x in ids], None
            starts_here = dict(_stretches(b.column("file"), b.column("place").to_numpy(), file, last)) if in_file_order else {}
            if in_file_order:
                firsts = []
            for i, (q, k) in enumerate(zip(b.column("queue").to_pylist(), n, strict=True)):
                if i in starts_here:
                    sent, first = {}, starts_here[i]
                if in_file_order:
                    firsts.append(first)
                at = sent.get(q, 0)
                start.append(at)
                sent[q] = at + k
            if in_file_order and b.num_rows:
                file, last = b.column("file")[-1].as_py(), b.column("place")[-1].as_py()
            narrow = [np.frombuffer(x, "<u4") for x in ids]
            packed = [x.astype("<u2").tobytes() if x.max() < 65536 else b"" for x in narrow]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": b.column("id"), "queue": b.column("queue"), **({"file": b.column("file"), "first": pa.array(firsts, pa.int64())} if in_file_order else {}), "task": pa.array([task] * len(ids), pa.int32()), "start": pa.array(start, pa.int64()), "n": pa.array(n, pa.int64()),
                    "narrow": pa.array(packed, pa.binary()), "wide": pa.array([b"" if p else x for p, x in zip(packed, ids, strict=True)], pa.binary()),
                }
            )

    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), source.alias("queue"), F.col(f"`{text_col}`").alias("text"), *(file_place() if in_file_order else ()))
    where = "file string, first long, " if in_file_order else ""
    tokens = ws.table(docs.mapInArrow(tokenise, f"id long, queue string, {where}task int, start long, n long, narrow binary, wide binary"), "tokens")
    stretch = ["file", "first", "task"] if in_file_order else ["task"]
    counts = tokens.groupBy("queue", *stretch).agg(F.sum("n").alias("n"))
    # Files of one writer are numbered; a longer number is a later one.
    earlier = Window.partitionBy("queue").orderBy(*([F.length("file")] if in_file_order else []), *stretch).rowsBetween(Window.unboundedPreceding, -1)
    base = ws.table(counts.select("queue", *stretch, "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "base")
    found = base.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()
    names = [r["queue"] for r in found]
    totals = np.array([r["n"] for r in found], np.int64)
    share = totals.astype(float) ** exponent if weights is None else np.array([float(weights.get(None if q == "null" else q[1:], 1)) for q in names])
    if (share <= 0).any():
        raise ValueError("weights must be positive")
    plan = RoundRobin.plan(totals, share, sequence * window_sequences)
    total = int(totals.sum())
    last, rest = divmod(max(total - 1, 0), sequence)
    last_padded = rest + 1 if (rest + 1) & rest == 0 else sequence
    numbers = spark.createDataFrame([(q, i) for i, q in enumerate(names)], "queue string, number int")

    def place(batches):
        for b in batches:
            queue = b.column("number").to_numpy().astype(np.int64)
            start, n = b.column("start").to_numpy() + b.column("base").to_numpy(), b.column("n").to_numpy()
            ids = [
                w or np.frombuffer(x, "<u2").astype("<u4").tobytes() for x, w in zip(b.column("narrow").to_pylist(), b.column("wide").to_pylist(), strict=True)
            ]
            sources = pa.array([None if q == "null" else q[1:] for q in b.column("queue").to_pylist()], pa.string())
            row, begin, length, seq, offset, window = cut(plan, queue, start, n, sequence)
            parts = [ids[r][4 * s : 4 * (s + k)] for r, s, k in zip(row.tolist(), begin.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    id_col: b.column("id").take(pa.array(row)),
                    "source": sources.take(pa.array(row)),
                    "start": begin, "length": length, "ids_crc32": pa.array([zlib.crc32(x) for x in parts], pa.int64()), "doc_tokens": n[row],
                    "sequence_id": seq, "offset": offset, "window": window,
                    "padded_length": np.where(seq == last, last_padded, sequence),
                    "ids": pa.array(parts, pa.binary()),
                }
            )

    schema = f"`{id_col}` long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, padded_length long, ids binary"
    # Written, so that Spark knows its size: a join's estimate is far too large to be broadcast, and ids would be shuffled.
    numbered = ws.table(base.drop("n").join(numbers, "queue"), "numbered")
    return tokens.join(numbered, ["queue", *stretch]).mapInArrow(place, schema)
