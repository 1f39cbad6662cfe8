"""Line dedup: range-partitioned line hashes, streamed in order, give keep bitmaps.

Each document sends one row for each distinct line key. The rows are range-partitioned by
key and document, largest document first, so that a very common line spreads over as
many partitions as it fills; each task streams its sorted rows once. A key that lies
within one task is settled there; what reaches over a task's edge is settled from one
summary for each edge.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.llm.common import Workspace, as_own, own_columns, partitions, small_batches

_BREAK = b" \t\n\x0b\x0c\r"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def line_keys(text: str | None, min_chars: int) -> dict[bytes, list[int]]:
    """Line numbers by key: the line stripped of ASCII white space, A-Z lower-cased, if long enough."""
    out: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")):
        key = line.strip(_BREAK)
        if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            out.setdefault(key, []).append(i)
    return out


def keep_bitmaps(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """``(id, keep_bitmap)``, a row for each document that loses a line.

    Lines are split at ``\\n``; null or empty text is one empty line. A line's key is the
    line without ASCII white space at its ends and with A-Z lower-cased. A key of at least
    ``min_chars`` code points found in at least ``min_docs`` documents loses all its lines
    except in the largest id that holds it. ``keep_bitmap`` is zlib-compressed, least bit
    first, a bit for each line, 1 to keep. Rows of one id are one document: a line of it
    is dropped from each row at its line number, and repeated rows count once. Rows of a
    null id lose nothing and count for nothing. Other columns are ignored. Keys are told
    apart by 128-bit hashes.
    """
    spark = df.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "lines")

    def split(batches):
        for b in batches:
            h1, h2, docs, at = [], [], [], []
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True):
                if doc is None or not text:
                    continue
                for key, lines in line_keys(text, min_chars).items():
                    h = xxhash.xxh3_128_intdigest(key)
                    h1.append(_signed(h >> 64))
                    h2.append(_signed(h & 0xFFFFFFFFFFFFFFFF))
                    docs.append(doc)
                    at.append(np.array(lines, np.int32).tobytes())
            yield pa.RecordBatch.from_pydict(
                {"h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()), "doc": pa.array(docs, pa.int64()), "lines": pa.array(at, pa.binary())}
            )

    def stream(batches):
        """Rows: kind 0, drop these lines; 1, drop them if the key's other rows say so; 2, summary.

        A key's first row here is of its largest document, unless the key began in an
        earlier task. At most ``min_docs`` rows wait.
        """
        first_key = key = top = last_doc = None
        n, waiting, any_row = 0, [], False
        kinds, h1s, h2s, docs, tops, ns, lines = ([] for _ in range(7))

        def put(kind, k, doc, best, count, at):
            for column, x in zip((kinds, h1s, h2s, docs, tops, ns, lines), (kind, k[0], k[1], doc, best, count, at), strict=True):
                column.append(x)

        def out():
            b = pa.RecordBatch.from_pydict(
                {
                    "kind": pa.array(kinds, pa.int8()), "h1": pa.array(h1s, pa.int64()), "h2": pa.array(h2s, pa.int64()), "doc": pa.array(docs, pa.int64()),
                    "top": pa.array(tops, pa.int64()), "n": pa.array(ns, pa.int64()), "lines": pa.array(lines, pa.binary()),
                }
            )
            for column in (kinds, h1s, h2s, docs, tops, ns, lines):
                column.clear()
            return b

        def close(last: bool):
            """The key at hand ends here, or at least its rows in this task do."""
            if key is None:
                return
            if key == first_key or last:
                for doc, at in waiting:
                    put(1, key, doc, None, None, at)
                put(2, key, None, top, n, None)

        for b in batches:
            any_row = True
            for a1, a2, doc, at in zip(*(b.column(c).to_pylist() for c in ("h1", "h2", "doc", "lines")), strict=True):
                if (a1, a2) != key:
                    close(False)
                    if first_key is None:
                        first_key = (a1, a2)
                    key, top, n, waiting, last_doc = (a1, a2), doc, 0, [], None
                if doc != last_doc:
                    n, last_doc = n + 1, doc
                if key == first_key:
                    put(1, key, doc, None, None, at)
                elif n < min_docs:
                    waiting.append((doc, at))
                else:
                    for d, x in waiting:
                        if d != top:
                            put(0, key, d, None, None, x)
                    waiting = []
                    if doc != top:
                        put(0, key, doc, None, None, at)
            yield out()
        if any_row:
            close(True)
            yield out()

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text")).mapInArrow(split, "h1 long, h2 long, doc long, lines binary")
    parts = partitions(spark)
    streamed = ws.table(
        rows.repartitionByRange(parts, F.col("h1"), F.col("h2"), F.col("doc").desc())
        .sortWithinPartitions(F.col("h1"), F.col("h2"), F.col("doc").desc())
        .mapInArrow(stream, "kind byte, h1 long, h2 long, doc long, top long, n long, lines binary"),
        "streamed",
    )
    edges = streamed.where("kind = 2").groupBy("h1", "h2").agg(F.max("top").alias("best"), F.sum("n").alias("docs")).where(F.col("docs") >= min_docs)
    # At most two summaries for each of ``parts`` partitions, however large the corpus is.
    late = streamed.where("kind = 1").join(F.broadcast(edges), ["h1", "h2"]).where("doc <> best").select("doc", "lines")
    dropped = streamed.where("kind = 0").select("doc", "lines").union(late)
    packed = dropped.groupBy("doc").agg(F.array_join(F.collect_list(F.hex("lines")), "").alias("lines"))

    def bitmaps(batches):
        for b in batches:
            maps = []
            for x in b.column("lines").to_pylist():
                at = np.frombuffer(bytes.fromhex(x), np.int32)
                keep = np.ones((int(at.max()) // 8 + 1) * 8, bool)
                keep[at] = False
                maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_pydict({"doc": b.column("doc"), "keep_bitmap": pa.array(maps, pa.binary())})

    return packed.mapInArrow(bitmaps, "doc long, keep_bitmap binary").withColumnRenamed("doc", id_col)


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with ``n_lines``, ``n_dropped`` and ``kept_text``; lines past a bitmap's end stay.

    Null or empty text is one empty line. Rows of a null id, or of one without a bitmap, keep all
    lines; rows of one id share its bitmap, and repeated rows get equal results. Columns of ``df``
    that carry the names of results are replaced; other names clash with nothing. An empty
    table stays empty.
    """
    small_batches(df.sparkSession)
    # By sorting at any size, as a broadcast of the bitmaps would end with the corpus's growth.
    found = bitmaps.select(F.col(id_col).alias("doc"), F.col("keep_bitmap").alias("keep")).hint("merge")
    joined = df.select(as_own(df), F.col(f"`{id_col}`").cast("long").alias("doc")).join(found, "doc", "left").select("own", "keep")
    results = (("n_lines", "long"), ("n_dropped", "long"), ("kept_text", "string"))
    out = joined.select("own").schema
    for name, kind in results:
        out = out.add(name, kind)

    def apply(batches):
        for b in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, bits in zip(b.column("own").field(text_col).to_pylist(), b.column("keep").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                left = lines
                if bits is not None:
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), bitorder="little").tolist()
                    left = [x for x, k in zip(lines, keep, strict=False) if k] + lines[len(keep) :]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                kept.append("\n".join(left))
            yield pa.RecordBatch.from_arrays(
                [b.column("own"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["own", "n_lines", "n_dropped", "kept_text"]
            )

    names = [name for name, _ in results]
    return joined.mapInArrow(apply, out).select(*own_columns([c for c in df.columns if c not in names]), *names)
