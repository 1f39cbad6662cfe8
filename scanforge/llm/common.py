"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch of texts; bounds a Python worker's memory when texts are long.
TEXT_BATCH_ROWS = 512

#: The bytes that separate words: space and the range from tab to carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows`` unless it is lower already; plans read it when they run, so it stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    """Tasks of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever its columns are called (case does not count)."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def as_own(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns of a row as one, ``own``, so that whatever they are called clashes with nothing."""
    return F.struct(*(F.col(f"`{c}`") for c in columns or df.columns)).alias("own")


def own_columns(columns: list[str]) -> list[Column]:
    """Columns taken out of ``own`` again."""
    return [F.col("own").getField(c).alias(c) for c in columns]


_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="spark-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return "file://" + _OWN_DIR[0]


_ROOTS: list[str] = []


def clear_workspaces(spark: SparkSession) -> None:
    """Delete all tables that operators wrote in this session; results that were not stored yet go with them."""
    while _ROOTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_ROOTS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Workspace:
    """Tables written to the shared folder, so that a lost executor costs no recomputation.

    They stay, as results read them, until :func:`clear_workspaces`.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _ROOTS.append(self.root)
        self.count = 0

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scanforge_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scanforge_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and the byte offset of each row, nulls being empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not n:
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces_of_batch(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20):
    """Slices of a batch that hold at most ``most_bytes`` of text, or one row."""
    _, offsets = text_buffer(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield batch.slice(start, stop - start)
        start = stop


def groups_of_batches(batches, keys: list[str]):
    """Tables of the rows of one group each, from batches that are sorted by ``keys``.

    Only the group at hand is held; callers bound its size before the shuffle.
    """
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            if a == b:
                continue
            key = tuple(c[a] for c in columns)
            if held and key != at:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            at = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def one_array(column) -> pa.Array:
    """A column of a table as a single array."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class Rows:
    """Gathers columns of many small results and hands them on as fewer batches."""

    def __init__(self, names: list[str], most: int = 20_000):
        self.names, self.most = names, most
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, *columns: np.ndarray):
        self.parts.append(columns)
        self.rows += len(columns[0])
        if self.rows >= self.most:
            yield from self.flush()

    def flush(self):
        if self.rows:
            yield pa.RecordBatch.from_pydict({n: np.concatenate(c) for n, c in zip(self.names, zip(*self.parts, strict=True), strict=True)})
        self.parts, self.rows = [], 0
