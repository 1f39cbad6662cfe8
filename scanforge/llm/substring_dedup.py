"""Substring dedup by level-wise doubling of repeated word windows.

Windows of ``window`` words are found at three lengths, each twice the one before. At the
first, every window is stood for by its anchor: the window of a quarter of the words,
inside it, whose hash is smallest. Equal windows have equal anchors at equal places. First only
anchors' hashes are shuffled, about one for eight words, in ranges, so that a frequent one
is spread over tasks. Anchors that occur once end there. Those that are repeated go back to their
documents and are extended: where the window of twice the length is repeated too, the whole
windows are compared.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.llm.common import Workspace, one_array, partitions, pieces_of_batch, small_batches, text_buffer
from scanforge.llm.links import spread_join
from scanforge.llm.shingles import mix64, window_hashes, windows_in_texts, word_hashes, words


#: Bytes before the window hashes of an anchor's row, and bytes of a hash.
HEAD, HASH = 11, 6

def _anchors(h: np.ndarray, bounds: np.ndarray, window: int):
    """Anchor place of each window start, and the window starts, over all texts of a piece."""
    base = window // 4
    fits = np.flatnonzero(windows_in_texts(bounds, window))
    if not len(fits):
        return fits, fits, np.zeros(0, np.uint64)
    short = window_hashes(h, base)
    view = np.lib.stride_tricks.sliding_window_view(short, window - base + 1)
    return fits, fits + view.argmin(axis=1)[fits], short


def _runs(doc: np.ndarray, at: np.ndarray, window: int):
    """Per document, in order, the word ranges that windows at ``at`` cover, as packed int32 pairs."""
    if not len(doc):
        return doc, []
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + window)
    first = np.flatnonzero(new)
    starts, stops = at[first], at[np.append(first[1:], len(doc)) - 1] + window
    pairs = np.stack([starts, stops], axis=1).astype(np.int32)
    owners = doc[first]
    cut = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
    return owners[cut], [p.tobytes() for p in np.split(pairs, cut[1:])]


def _repeated(key: np.ndarray) -> np.ndarray:
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[inverse] > 1


def _later(doc: np.ndarray, place: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """True for each window that is not the first, by document and place, of those of equal keys."""
    order = np.lexsort((place, doc, *keys))
    same = np.zeros(len(order), bool)
    same[1:] = True
    for k in keys:
        same[1:] &= k[order][1:] == k[order][:-1]
    lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    out = np.zeros(len(order), bool)
    out[order] = (doc[order] > doc[lead]) | (place[order] > place[lead])
    return out


def _window_bytes(hashes: np.ndarray) -> np.ndarray:
    return hashes[:, None].view(np.uint8).reshape(-1, 8)[:, :HASH]


def repeated_anchors(docs: DataFrame, window: int, ws: Workspace) -> DataFrame:
    """A written table ``(key, doc)`` of the anchors of ``docs(doc, text)`` that occur more than once.

    Rows are sorted in ranges of key and document, and compared with their neighbours. What lies at
    the edge of a range is taken for repeated, which the next level puts right.
    """

    def scan(batches):
        for batch in batches:
            for b in pieces_of_batch(batch, "text"):
                data, offsets = text_buffer(b.column("text"))
                starts, ends, bounds = words(data, offsets)
                _, anchor, short = _anchors(word_hashes(data, starts, ends), bounds, window)
                place = np.unique(anchor)
                key, doc = short[place].view(np.int64), b.column("doc").to_numpy()[np.repeat(np.arange(b.num_rows), np.diff(bounds))[place]]
                # Two rows tell of an anchor that one document holds several times.
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                third = np.zeros(len(key), bool)
                third[2:] = (key[2:] == key[:-2]) & (doc[2:] == doc[:-2])
                yield pa.RecordBatch.from_pydict({"key": key[~third], "doc": doc[~third]})

    def neighbours(batches):
        """Rows whose key is that of the row before or after; also of the first key and of the last.

        The last two rows of a batch wait for the next one, after the row before them.
        """
        key, doc, begin, edge = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                key, doc = np.concatenate([key, b.column("key").to_numpy()]), np.concatenate([doc, b.column("doc").to_numpy()])
            if not len(key):
                continue
            edge = key[0] if edge is None else edge
            same = np.concatenate([[False], key[1:] == key[:-1], [False]])
            keep = same[:-1] | same[1:] | (key == edge)
            stop = max(0, len(key) - 2)
            if b is None:
                keep[-1], stop = True, len(key)
            at = begin + np.flatnonzero(keep[begin:stop])
            yield pa.RecordBatch.from_pydict({"key": key[at], "doc": doc[at]})
            begin, cut = min(stop, 1), max(0, stop - 1)
            key, doc = key[cut:], doc[cut:]

    rows = docs.mapInArrow(scan, "key long, doc long")
    ordered = rows.repartitionByRange(partitions(ws.spark), "key", "doc").sortWithinPartitions("key", "doc")
    return ws.table(ordered.mapInArrow(neighbours, "key long, doc long"), "repeated")


def repeated_ranges(df: DataFrame, id_col: str, text_col: str, window: int, chunk_rows: int = 60_000) -> DataFrame:
    """``(doc, runs)``: packed word ranges of each document whose windows started earlier.

    A task settles about ``chunk_rows`` anchors at once, all rows of an anchor together. The windows
    of anchors with more rows than that (and than a quarter of a task's share) are settled one by
    one instead, by Spark's aggregation, which knows no hot keys. Texts equal to a smaller
    document's are not extended at all: all their windows started earlier.
    """
    if window < 8 or window % 4:
        raise ValueError("window must be a multiple of 4 and at least 8")
    base, reach = window // 4, window - window // 4
    spark = df.sparkSession
    ws, parts = Workspace(spark, "windows"), partitions(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    found = repeated_anchors(docs, window, ws)
    most = max(chunk_rows, found.count() // (4 * parts))
    # At most 4 keys for each task.
    hot = np.array([r[0] for r in found.groupBy("key").count().where(F.col("count") > most).select("key").collect()], np.int64)

    sums = docs.groupBy(F.md5(F.col("text").cast("binary")).alias("sum"), "doc").agg(F.first(F.xxhash64("text")).alias("h"))
    first = sums.groupBy("sum").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = spread_join(sums, first, ["sum"], docs.count()).where("doc > first").select("doc", "h")
    marks = found.select("doc", "key", F.lit(None).cast("long").alias("h")).union(copies.select("doc", F.lit(None).cast("long"), "h"))
    marks = marks.groupBy("doc").agg(F.collect_set("key").alias("keys"), F.collect_set("h").alias("copies"))
    marked = docs.join(marks.hint("merge"), "doc").select("doc", "text", "keys", F.array_contains("copies", F.xxhash64("text")).alias("copy"))

    def extend(batches):
        """Of repeated anchors: payloads of the windows they stand for (kind 0); of hot ones, each of
        their windows by itself; and runs (kind 1) of copies and of windows repeated in the same piece."""
        for batch in batches:
            for b in pieces_of_batch(batch, "text"):
                ids, copy = b.column("doc").to_numpy(), b.column("copy").to_numpy(zero_copy_only=False)
                data, offsets = text_buffer(b.column("text"))
                starts, ends, bounds = words(data, offsets)
                h = word_hashes(data, starts, ends)
                n_words = np.diff(bounds)
                whole_copy = np.flatnonzero(copy & (n_words >= window))
                at, anchor, short = _anchors(h, bounds, window)
                of = np.repeat(np.arange(len(ids)), n_words)
                known = one_array(b.column("keys"))
                n_known = np.asarray(pa.compute.list_value_length(known).fill_null(0))
                pair = mix64(known.flatten().to_numpy().view(np.uint64) ^ mix64(np.repeat(np.arange(len(ids)), n_known).astype(np.uint64)))
                alive = np.isin(mix64(short[anchor] ^ mix64(of[at].astype(np.uint64))), pair) & ~copy[of[at]]
                at, anchor = at[alive], anchor[alive]
                doc, place = ids[of[at]], at - bounds[of[at]]
                whole = window_hashes(h, window)
                later = _later(doc, place, whole[at])
                owners, packed = _runs(doc[later], place[later], window)
                owners = np.concatenate([owners, ids[whole_copy]])
                packed = packed + [np.array([0, n], np.int32).tobytes() for n in n_words[whole_copy].tolist()]
                at, anchor = at[~later], anchor[~later]
                is_hot = np.isin(short[anchor].view(np.int64), hot)
                single, back = at[is_hot], (anchor - at)[is_hot]
                low = np.zeros((len(single), 8), np.uint8)
                low[:, :HASH] = _window_bytes(whole[single])
                window_key = low.view(np.int64).ravel() | (back.astype(np.int64) << 48)
                at, anchor = at[~is_hot], anchor[~is_hot]
                # Windows of one anchor that follow each other go in one row.
                first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else at
                count = np.diff(np.append(first, len(at)))
                place_of = anchor[first]
                farthest = place_of - at[first]
                nearest = farthest - count + 1
                lengths = HEAD + HASH * count
                ends_at = np.cumsum(lengths)
                raw = np.zeros(int(ends_at[-1]) if len(first) else 0, np.uint8)
                heads = (ends_at - lengths)[:, None]
                raw[heads + np.arange(1, 5)] = (place_of - bounds[of[place_of]]).astype(">u4")[:, None].view(np.uint8).reshape(-1, 4)
                raw[heads + 5], raw[heads + 6] = nearest[:, None], farthest[:, None]
                double = window_hashes(h, 2 * base)
                for i, shift in ((7, -base), (9, 0)):
                    inside = np.clip(place_of + shift, 0, len(double) - 1)
                    raw[heads + np.arange(i, i + 2)] = (double[inside] & np.uint64(0xFFFF)).astype(np.uint16)[:, None].view(np.uint8).reshape(-1, 2)
                # Hashes of the windows that start ``nearest`` to ``farthest`` words before the anchor.
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                window_at = np.repeat(place_of - nearest, count) - k
                raw[np.repeat(heads.ravel(), count)[:, None] + HEAD + HASH * k[:, None] + np.arange(HASH)] = _window_bytes(whole[window_at])
                cut = [0, *ends_at.tolist()]
                raw = raw.tobytes()
                nothing = len(first) + len(owners)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": np.concatenate([short[place_of].view(np.int64), mix64(owners.astype(np.uint64)).view(np.int64), short[single + back].view(np.int64)]),
                        "doc": np.concatenate([ids[of[place_of]], owners, ids[of[single]]]),
                        "payload": pa.array([raw[i:j] for i, j in itertools.pairwise(cut)] + [b"\1" + p for p in packed] + [None] * len(single), pa.binary()),
                        "window_key": pa.array(np.concatenate([np.zeros(nothing, np.int64), window_key]), mask=np.arange(nothing + len(single)) < nothing),
                        "place": np.concatenate([np.zeros(nothing, np.int64), single - bounds[of[single]]]),
                    }
                )

    def settle(key, doc, raw, heads):
        """Repeated windows, as documents and places, of whole anchors."""
        index = np.flatnonzero(_repeated(key))
        key_of, heads = key[index], heads[index, None]
        place = raw[heads + np.arange(1, 5)].view(">u4").ravel().astype(np.int64)
        near, far = raw[heads[:, 0] + 5].astype(int), raw[heads[:, 0] + 6].astype(int)
        double = raw[heads + np.arange(7, 11)].view(np.uint16).astype(np.uint64)
        left_ok, right_ok = (_repeated(mix64(key_of + np.uint64(i + 1)) + double[:, i]) for i in (0, 1))
        docs, places, keys, hashes = [doc[:0]], [doc[:0]], [key[:0]], [key[:0]]
        for back in range(reach + 1):
            # A window that starts ``back`` words before its anchor holds one of the two doubled anchors.
            at = np.flatnonzero((near <= back) & (back <= far) & np.where(back <= window // 2, right_ok, left_ok))
            bits = np.zeros((len(at), 8), np.uint8)
            bits[:, :HASH] = raw[heads[at] + HEAD + HASH * (back - near[at])[:, None] + np.arange(HASH)]
            hashes.append(bits.view(np.uint64).ravel() | np.uint64(back << 48))
            keys.append(key_of[at])
            docs.append(doc[index[at]])
            places.append(place[at] - back)
        docs, places, keys, hashes = (np.concatenate(x) for x in (docs, places, keys, hashes))
        later = _later(docs, places, hashes, keys)
        return docs[later], places[later]

    def decide(batches):
        held: list[pa.Table] = []
        rows_held = 0

        def work(table: pa.Table, last: bool):
            key, doc = table.column("key").to_numpy(), table.column("doc").to_numpy()
            change = np.flatnonzero(key[1:] != key[:-1])
            # Rows of the last key wait for the rest of it.
            stop = len(key) if last else int(change[-1]) + 1 if len(change) else 0
            if stop:
                payload = one_array(table.column("payload"))
                offsets = np.frombuffer(payload.buffers()[1], np.int32)[payload.offset : payload.offset + len(payload) + 1]
                raw = np.frombuffer(payload.buffers()[2], np.uint8)
                kind = raw[offsets[:-1]][:stop]
                mine, done = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
                owners, packed = _runs(*settle(key[mine].view(np.uint64), doc[mine], raw, offsets[mine].astype(np.int64)), window)
                yield pa.RecordBatch.from_pydict(
                    {"doc": np.concatenate([owners, doc[done]]), "runs": pa.array(packed + [payload[i].as_py()[1:] for i in done.tolist()], pa.binary())}
                )
            return table.slice(stop)

        for batch in batches:
            for start in range(0, batch.num_rows, chunk_rows):
                held.append(pa.Table.from_batches([batch.slice(start, chunk_rows)]))
                rows_held += held[-1].num_rows
                if rows_held >= chunk_rows:
                    rest = yield from work(pa.concat_tables(held).combine_chunks(), False)
                    held, rows_held = [rest], 0
        if held:
            yield from work(pa.concat_tables(held).combine_chunks(), True)

    def pack(batches):
        for b in batches:
            owners, packed = _runs(b.column("doc").to_numpy(), b.column("place").to_numpy(), window)
            yield pa.RecordBatch.from_pydict({"doc": owners, "runs": pa.array(packed, pa.binary())})

    extended = marked.mapInArrow(extend, "key long, doc long, payload binary, window_key long, place long")
    if len(hot):
        extended = ws.table(extended, "extended")
    cold = extended.where("payload is not null").select("key", "doc", "payload").repartition(parts, "key").sortWithinPartitions("key", "doc", "payload")
    runs = cold.mapInArrow(decide, "doc long, runs binary")
    if len(hot):
        windows = extended.where("payload is null").select("key", "window_key", "doc", "place")
        firsts = windows.groupBy("key", "window_key").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
        rest = spread_join(windows, firsts, ["key", "window_key"], windows.count()).where(F.struct("doc", "place") > F.col("first"))
        runs = runs.union(rest.select("doc", "place").mapInArrow(pack, "doc long, runs binary"))
    return runs.groupBy("doc").agg(F.collect_list("runs").alias("runs"))


def drop_repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, chunk_rows: int = 60_000) -> DataFrame:
    """One row per row of ``df``: id, ``n_words``, ``n_removed``, ``kept_text``.

    Words are maximal runs without white space of ASCII, unchanged. A word is removed if
    one of the ``window``-word windows of its document that cover it also starts earlier:
    in a document of a smaller id, or earlier in the same one. Windows are judged on the
    input. Kept words are joined by one space. Null and empty texts have no words. Rows
    of one id are one document: equal rows get equal results, and what is removed from
    one is removed at the same places from the others. Rows of a null id keep all words
    and do not count as earlier. Other columns are ignored. An empty table gives an
    empty result.

    Windows are compared by a 64-bit hash of their anchor and a 48-bit hash of all their
    words, among those of the same anchor at the same place. ``chunk_rows`` bounds what a task
    compares at once; results do not depend on it.
    """
    small_batches(df.sparkSession)
    runs = repeated_ranges(df, id_col, text_col, window, chunk_rows)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    joined = texts.join(runs, F.col("id") == F.col("doc"), "left").select("id", "text", "runs")

    def keep(batches):
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                own = (text or "").encode("utf-8", "surrogatepass").split()
                left = own
                if runs:
                    mask = np.ones(len(own) + 1, np.int8)
                    for start, stop in np.frombuffer(b"".join(runs), np.int32).reshape(-1, 2).tolist():
                        mask[start:stop] = 0
                    left = list(itertools.compress(own, mask.tolist()))
                n_words.append(len(own))
                n_removed.append(len(own) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_pydict(
                {"id": b.column("id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string())}
            )

    return joined.mapInArrow(keep, "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)
