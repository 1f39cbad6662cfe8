"""MinHash near-dedup of documents by ProbMinHash over weighted word shingles.

Elements arrive at random registers as Poisson processes whose rates are their
weights; a register keeps the element that arrives first, so two signatures agree in
a register with a probability that is the probability Jaccard similarity of the two
weighted sets. Documents that agree in a band of registers are candidates, and the
exact probability Jaccard similarity decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.llm.common import Workspace, free_name, pieces_of_batch, small_batches, text_buffer
from scanforge.llm.links import connected_components, cross_links, spread_join, star_links
from scanforge.llm.shingles import mix64, window_hashes, windows_in_texts, word_hashes, words


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: shingle hashes, sorted in each text, and how often each occurs; the
    first of each text; each text's number of words; two 64-bit keys of its words.

    A text of fewer than ``k`` words, but at least one, has a single shingle of them all.
    """
    data, offsets = text_buffer(texts)
    starts, ends, bounds = words(data, offsets)
    h = word_hashes(data, starts, ends)
    n_words, fits = np.diff(bounds), windows_in_texts(bounds, k)
    of = np.repeat(np.arange(len(texts)), n_words)
    where = np.flatnonzero(fits)
    text, value = of[where], window_hashes(h, k)[where]
    key = np.stack([_sequence_key(h, bounds, salt) for salt in (1, 2)])
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    text, value = np.concatenate([text, short]), np.concatenate([value, key[0][short]])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(text)))
    return value[first], counts, np.searchsorted(text[first], np.arange(len(texts) + 1)), n_words, key


def _sequence_key(h: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    """A hash of the sequence of each text's words."""
    place = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix64(h + mix64((place * 4 + salt).astype(np.uint64))), out=total[1:])
    return mix64(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def signatures(value: np.ndarray, weight: np.ndarray, first: np.ndarray, registers: int) -> np.ndarray:
    """ProbMinHash signatures, a row of 32-bit elements for each set.

    Arrivals are drawn for all elements at once, twice as many each time; an element ends
    when its next arrival is later than all registers of its set are filled.
    """
    sets = len(first) - 1
    of = np.repeat(np.arange(sets), np.diff(first))
    reg = np.full(sets * registers, np.iinfo(np.uint64).max, np.uint64)
    low = mix64(value ^ np.uint64(0xA5A5A5A5)) & np.uint64(0xFFFFFFFF)
    active, time, drawn, step = np.arange(len(value)), np.zeros(len(value)), 0, 1
    while len(active):
        k = np.arange(drawn, drawn + step, dtype=np.uint64) * np.uint64(2)
        seed = value[active][:, None]
        u = (mix64(seed + mix64(k + np.uint64(1))[None, :]) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54
        t = time[active][:, None] + np.cumsum(-np.log(u) / weight[active][:, None], axis=1)
        at = of[active][:, None] * registers + (mix64(seed ^ mix64(k + np.uint64(0x51ED))[None, :]) % np.uint64(registers)).astype(np.int64)
        packed = (t.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | low[active][:, None]
        np.minimum.at(reg, at.ravel(), packed.ravel())
        latest = reg.reshape(sets, registers).max(axis=1) >> np.uint64(32)
        latest = np.where(latest == 0xFFFFFFFF, np.inf, latest.astype(np.uint32).view(np.float32).astype(float))
        drawn, step = drawn + step, max(1, drawn + step)
        time[active] = t[:, -1]
        active = active[t[:, -1] <= latest[of[active]]]
    return (reg & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(sets, registers)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.shape[1] // bands
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(signature), bands)).copy()
    for i in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i] + np.uint64(1))
    return key


def probability_jaccard(value, weight, first, i: int, rest: np.ndarray) -> np.ndarray:
    """The exact similarity of set ``i`` with each set of ``rest``.

    The sum over common elements of 1 / sum_j max(x_j / x_i, y_j / y_i). With common
    elements in order of x / y, the inner sum splits into sums over a prefix and a suffix.
    """
    a, wa = value[first[i] : first[i + 1]], weight[first[i] : first[i + 1]].astype(float)
    lengths = first[rest + 1] - first[rest]
    if not len(a) or not len(rest):
        return np.zeros(len(rest))
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1]) + np.repeat(first[rest] - (ends - lengths), lengths)
    of = np.repeat(np.arange(len(rest)), lengths)
    place = np.minimum(np.searchsorted(a, value[at]), len(a) - 1)
    common = a[place] == value[at]
    wb = weight[at].astype(float)
    total_b = np.bincount(of, wb, len(rest))
    of, x, y = of[common], wa[place[common]], wb[common]
    ratio = x / y
    order = np.lexsort((ratio, of))
    of, x, y, ratio = of[order], x[order], y[order], ratio[order]
    in_x, in_y = np.bincount(of, x, len(rest)), np.bincount(of, y, len(rest))
    start = np.searchsorted(of, np.arange(len(rest)))
    before_x = np.concatenate([[0], np.cumsum(x)])
    before_y = np.concatenate([[0], np.cumsum(y)])
    n = np.arange(len(of))
    low_x, low_y = before_x[n] - before_x[start[of]], before_y[n] - before_y[start[of]]
    inner = (wa.sum() - in_x)[of] + (in_x[of] - low_x) + ratio * ((total_b - in_y)[of] + low_y)
    return np.bincount(of, x / inner, len(rest))


def _similar(k: int, threshold: float):
    def kernel(payload: pa.Array):
        value, weight, first, _, _ = shingles(payload, k)
        value_of = value

        def near(i, rest):
            return probability_jaccard(value_of, weight, first, i, rest) >= threshold - 1e-12

        return near

    return kernel


def near_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    threshold: float = 0.8,
    bands: int = 32,
    rows: int = 5,
    block_words: int = 300_000,
) -> DataFrame:
    """One row per row of ``df``: id, ``class_id``, ``kept``, ``n_words``, ``copy_of``.

    Words are maximal runs without white space of ASCII, unchanged; a document's weighted
    set holds its ``k``-word shingles with their counts (all its words as one shingle when
    they are fewer). Documents link when the probability Jaccard similarity of their sets
    is ``threshold`` or more; on sets without repeats that is the Jaccard similarity. A
    class holds what links connect and is named by its smallest id, whose document is
    kept. ``copy_of`` is the smallest id among documents of the same words in the same order; only that one
    is compared, so copies cost nothing. Texts that are null or have no word link with
    nothing. Rows of one id are one document with several texts: they share a class. A
    null id gives a null class and is kept. Other columns are ignored.

    With 32 bands of 5 registers, a pair at the threshold shares a band with probability
    1 - 3e-6. First each document is compared with the smallest id that shares a band with
    it, and with others that do so in the same block of about ``block_words`` words. Then only
    bands that still hold documents of different classes are looked at: there, each document
    outside the class of most words is compared with those that share its band's smallest
    id. So copies cost their number, and every pair that shares a band is compared or
    already in one class.
    """
    spark = df.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "probminhash")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def sign(batches):
        for batch in batches:
            for b in pieces_of_batch(batch, "text"):
                value, weight, first, n_words, key = shingles(b.column("text"), k)
                keys = band_keys(signatures(value, weight, first, bands * rows), bands)
                some = n_words > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": b.column("id"),
                        "n_words": n_words.astype(np.int64),
                        "k1": key[0].view(np.int64),
                        "k2": key[1].view(np.int64),
                        "bands": pa.ListArray.from_arrays(offsets, pa.array(keys[some].ravel().view(np.int64))),
                    }
                )

    signed = ws.table(docs.mapInArrow(sign, "id long, n_words long, k1 long, k2 long, bands array<long>"), "signed")
    nodes = ws.table(
        signed.where("n_words > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("node"), F.first("bands").alias("bands"), F.first("n_words").alias("n_words")), "nodes"
    )
    buckets = nodes.select("node", "n_words", F.explode("bands").alias("band"))
    lowest = buckets.groupBy("band").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    shared = ws.table(spread_join(buckets, lowest, ["band"], nodes.count() * bands).select("band", "low", "node", "n_words"), "shared")
    candidates = shared.groupBy("node").agg(F.min("low").alias("g"), F.first("n_words").alias("weight"))
    # By sorting at any size, as a broadcast of the candidates would end with the corpus's growth.
    texts = ws.table(docs.join(candidates.select(F.col("node").alias("id")).hint("merge"), "id").where("text is not null").select("id", F.col("text").alias("payload")), "texts")
    first = candidates.select("g", F.col("node").alias("id"), "weight")
    pivots = first.where("g < id").select("g").distinct().join(candidates.select(F.col("node").alias("g"), "weight"), "g").select("g", F.col("g").alias("id"), "weight")
    similar = _similar(k, threshold)
    stars = star_links(ws.table(first.where("g < id").union(pivots), "first"), texts, ws, similar, block_words, named=True).select("src", "dst")
    classes = connected_components(stars, ws)
    labelled = shared.join(classes, "node", "left").select("band", "low", F.col("node").alias("id"), F.coalesce("component", "node").alias("label"), F.col("n_words").alias("weight"))
    open_bands = labelled.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("z")).where("a < z").select("band", "n")
    rest = spread_join(labelled, open_bands, ["band"], shared.count()).select(F.col("low").alias("g"), "id", "label", "weight").distinct()
    edges = stars.union(cross_links(ws.table(rest, "open"), texts, ws, similar, block_words))
    classes = connected_components(edges, ws)
    reps = nodes.select("k1", "k2", "node")
    same_id = signed.where("n_words > 0 and id is not null").select("id", "k1", "k2").join(reps, ["k1", "k2"])
    # An id of several texts is several nodes: what it ties together is one class.
    ties = same_id.groupBy("id").agg(F.min("node").alias("low"), F.count_distinct("node").alias("n")).where("n > 1")
    if ties.take(1):
        tied = same_id.join(ties.select("id", "low"), "id").select(F.col("node").alias("src"), F.col("low").alias("dst"))
        classes = connected_components(edges.union(tied), ws)
    named = reps.join(classes, "node", "left").select("k1", "k2", "node", F.coalesce("component", "node").alias("class_id"))
    out = signed.select("id", "n_words", F.when(F.col("n_words") > 0, F.col("k1")).alias("k1"), "k2").join(named, ["k1", "k2"], "left")
    class_id = F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id"))
    return out.select(
        F.col("id").alias(id_col), class_id.alias("class_id"), F.coalesce(F.col("id") == class_id, F.lit(True)).alias("kept"), "n_words", F.when(F.col("id").isNotNull(), F.coalesce("node", "id")).alias("copy_of")
    )


def drop_near_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with one document of each class of :func:`near_documents`, columns unchanged.

    The class's smallest id stays. Rows of an id that stays all stay, repeated or not.
    """
    gone = free_name(df, "dropped")
    found = near_documents(df, id_col, text_col, **options).where("not kept").select(F.col(id_col).alias(gone)).distinct().hint("merge")
    return df.join(found, F.col(id_col) == F.col(gone), "left_anti")
