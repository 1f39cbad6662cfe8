"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts are summed in each task and then by Spark; the matrix of log-probabilities, one row
for each of a fixed number of buckets and one column for each language of at most a set
number, is broadcast and gathered in numpy batch by batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.llm.common import Workspace, as_own, own_columns, pieces_of_batch, small_batches
from scanforge.llm.shingles import mix64

UNKNOWN = "und"


def features(texts: list[str | None], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the first of each text, and whether each text has a letter.

    Texts are lower-cased; whatever is not a letter counts as a space, and n-grams of
    spaces alone are left out.
    """
    lower = [(t or "").lower() for t in texts]
    lengths = np.fromiter(map(len, lower), np.int64, len(lower))
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    known, index = np.unique(points, return_inverse=True)
    letter = np.fromiter((chr(c).isalpha() for c in known.tolist()), bool, len(known))[index] if len(points) else np.zeros(0, bool)
    points = np.where(letter, points, 32).astype(np.uint64)
    stops = np.cumsum(lengths)
    of = np.repeat(np.arange(len(lower)), lengths)
    has_letter = np.bincount(of, letter, len(lower)) > 0
    found, owner = [], []
    for n in orders:
        if len(points) < n:
            continue
        m = len(points) - n + 1
        code, some = np.zeros(m, np.uint64), np.zeros(m, bool)
        for i in range(n):
            code = code * np.uint64(0x110000) + points[i : i + m]
            some |= letter[i : i + m]
        some &= of[:m] == of[n - 1 :]
        found.append((mix64(code[some] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64))
        owner.append(of[:m][some])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(lower) + 1, np.int64), has_letter
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(lower) + 1)), has_letter


def train(
    df: DataFrame, text_col: str = "text", label_col: str = "lang", orders=(1, 2, 3), bits: int = 15, smoothing: float = 0.1, most_labels: int = 256
) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
    """Models ``(labels, matrix, log priors)``, each of at most ``most_labels`` labels in order, from all
    rows with a text and a label.

    A matrix has 2**bits rows and a column for each label; only counts come to the driver,
    those of one model at a time.
    """
    small_batches(df.sparkSession)
    ws, size = Workspace(df.sparkSession, "langid"), 1 << bits

    def count(batches):
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def out():
            for name, counts in total.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({"label": [name] * (len(at) + 1), "bucket": np.append(at, -1), "n": np.append(counts[at], docs[name])})
            total.clear()
            docs.clear()

        for batch in batches:
            for b in pieces_of_batch(batch, "text"):
                buckets, first, _ = features(b.column("text").to_pylist(), orders, bits)
                label, index = np.unique(np.array(b.column("label").to_pylist(), object).astype(str), return_inverse=True)
                of = np.repeat(index, np.diff(first))
                for i, name in enumerate(label.tolist()):
                    total[name] = total.get(name, 0) + np.bincount(buckets[of == i], minlength=size)
                    docs[name] = docs.get(name, 0) + int((index == i).sum())
                if len(total) > most_labels:
                    yield from out()
        yield from out()

    rows = df.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label")).where("text is not null and label is not null")
    counts = ws.table(rows.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")), "counts")
    docs = {r.label: r.n for r in counts.where("bucket < 0").collect()}
    labels, models = sorted(docs), []
    for start in range(0, len(labels), most_labels):
        own = labels[start : start + most_labels]
        got = counts.where(F.col("label").isin(own) & (F.col("bucket") >= 0)).toArrow()
        place = {x: i for i, x in enumerate(own)}
        matrix = np.full((size, len(own)), smoothing)
        matrix[got.column("bucket").to_numpy(), [place[x] for x in got.column("label").to_pylist()]] += got.column("n").to_numpy()
        models.append((own, np.log(matrix / matrix.sum(axis=0)).astype(np.float32), np.log(np.array([docs[x] for x in own]) / sum(docs.values()))))
    return models


def predict(df: DataFrame, models: list[tuple[list[str], np.ndarray, np.ndarray]], text_col: str = "text", orders=(1, 2, 3), bits: int = 15) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, the posterior probability of the prediction.

    Texts that are null or have no letter get ``und`` and 0, and so does every text when
    there is no label. Of equally likely labels the first in order is predicted.
    Repeated rows get equal results; other columns pass through, and those that carry the names
    of results are replaced. Models are gone through one after the other, each with the best
    and the total of those before, so that labels beyond one model's are compared with all others.
    """
    spark = df.sparkSession
    small_batches(spark)
    own = [c for c in df.columns if c not in ("lang_pred", "score")]
    rows = df.select(as_own(df), F.lit(UNKNOWN).alias("pred"), F.lit(-np.inf).alias("best"), F.lit(-np.inf).alias("total"))

    def scorer(shared):
        def score(batches):
            labels, matrix, priors = shared.value
            names = np.array(labels, object)
            for batch in batches:
                texts = pa.RecordBatch.from_arrays([batch.column("own").field(text_col)], ["text"])
                start = 0
                for b in pieces_of_batch(texts, "text"):
                    part = batch.slice(start, b.num_rows)
                    start += b.num_rows
                    buckets, first, has_letter = features(b.column("text").to_pylist(), orders, bits)
                    sums = np.zeros((b.num_rows, len(labels)))
                    some = np.flatnonzero(np.diff(first))
                    for j in range(len(labels) if len(some) else 0):
                        sums[some, j] = np.add.reduceat(matrix[buckets, j].astype(float), first[some])
                    sums += priors
                    at, most = sums.argmax(axis=1), sums.max(axis=1)
                    pred, best, total = (part.column(c).to_numpy(zero_copy_only=False) for c in ("pred", "best", "total"))
                    better = has_letter & (most > best)
                    total = np.where(has_letter, np.logaddexp(total, most + np.log(np.exp(sums - most[:, None]).sum(axis=1))), total)
                    columns = [pa.array(np.where(better, names[at], pred).tolist(), pa.string()), pa.array(np.where(better, most, best)), pa.array(total)]
                    yield pa.RecordBatch.from_arrays([part.column("own"), *columns], ["own", "pred", "best", "total"])

        return score

    for model in models:
        rows = rows.mapInArrow(scorer(spark.sparkContext.broadcast(model)), rows.schema)
    posterior = F.when(F.col("pred") == UNKNOWN, 0.0).otherwise(F.least(F.lit(1.0), F.exp(F.col("best") - F.col("total"))))
    return rows.select(*own_columns(own), F.col("pred").alias("lang_pred"), posterior.alias("score"))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 3, held_out: int = 1, most_labels: int = 256) -> DataFrame:
    """Id, ``held_out``, ``lang_pred`` and ``score`` of each row.

    The model learns from the rows whose CRC-32 of the id as text leaves another remainder
    than ``held_out``; a null id has none and is learned from. Labels, ids and other columns
    are no inputs of a prediction.
    """
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
    is_out = F.coalesce(fold == held_out, F.lit(False))
    models = train(df.where(~is_out), text_col, label_col, most_labels=most_labels)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), is_out.alias("held_out"))
    return predict(rows, models).select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")
