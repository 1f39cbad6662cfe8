import itertools
import math
import pathlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanforge.llm import links, shingles
from scanforge.llm.common import Workspace, shared_dir
from scanforge.llm.itq_dedup import fit_itq, near_vectors, unit_rows
from scanforge.llm.line_dedup import apply_bitmaps, keep_bitmaps
from scanforge.llm.probminhash import drop_near_documents, near_documents, probability_jaccard, signatures
from scanforge.llm.probminhash import shingles as shingle_sets
from scanforge.llm.substring_dedup import drop_repeated_windows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def components(nodes, edges):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- words and links --------------------------------------------------------------------


def test_words_and_windows_match_plain_python():
    texts = ["a b  c\td\n e", "", " x ", "é ü y z", "a b c d e"]
    data, offsets = (lambda a: (np.frombuffer(b"".join(x.encode() for x in a), np.uint8), np.cumsum([0] + [len(x.encode()) for x in a])))(texts)
    starts, ends, bounds = shingles.words(data, offsets)
    own = [t.encode().split() for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in own]
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == [w for ws in own for w in ws]
    h = shingles.word_hashes(data, starts, ends)
    flat = [w for ws in own for w in ws]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    g, fits = shingles.window_hashes(h, 3), shingles.windows_in_texts(bounds, 3)
    assert fits.sum() == sum(max(0, len(w) - 2) for w in own)
    assert g[0] == g[len(flat) - 5] and g[0] != g[1]


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300)]
    got = {r.node: r.component for r in links.connected_components(spark.createDataFrame(edges, "src long, dst long"), Workspace(spark, "t")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == components({x for e in real for x in e}, real)
    assert links.connected_components(spark.createDataFrame([], "src long, dst long"), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("weight", [10, 1000])
def test_star_and_cross_links_lose_nothing(spark, weight):
    """Groups dealt over small blocks, with rows that their pivots do not reach."""
    rng = random.Random(2)
    rows = [(1, i, 1, str(rng.randrange(60))) for i in range(120)] + [(2, 500 + i, 1, str(i * 3)) for i in range(5)]

    def kernel(payload):
        x = np.array([int(p) for p in payload.to_pylist()])
        return lambda i, rest: np.abs(x[rest] - x[i]) <= 1

    ws = Workspace(spark, "t")
    df = ws.table(spark.createDataFrame(rows, "g long, id long, weight long, payload string"))
    stars = links.star_links(df, None, ws, kernel, weight).select("src", "dst")
    label = links.connected_components(stars, ws).withColumnRenamed("node", "id")
    labelled = df.join(label, "id", "left").select("g", "id", F.coalesce("component", "id").alias("label"), "weight", "payload")
    crossed = links.cross_links(ws.table(labelled), None, ws, kernel, weight)
    got = [(r.src, r.dst) for r in stars.union(crossed).collect()]
    value = {r[1]: int(r[3]) for r in rows}
    assert all(abs(value[a] - value[b]) <= 1 for a, b in got)
    want = [(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and abs(int(a[3]) - int(b[3])) <= 1]
    ids = [r[1] for r in rows]
    assert components(ids, got) == components(ids, want)


def test_spread_join_keeps_all_rows_of_a_hot_key(spark):
    rows = spark.createDataFrame([(1, i) for i in range(500)] + [(k, k) for k in range(2, 60)], "k long, x long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("low"))
    got = links.spread_join(rows, table, ["k"], 558)
    assert sorted((r.k, r.x, r.n, r.low) for r in got.collect()) == sorted([(1, i, 500, 0) for i in range(500)] + [(k, k, 1, k) for k in range(2, 60)])


# --- embeddings ---------------------------------------------------------------------------


def brute_vectors(rows, threshold=0.93):
    links_, pairs = {}, []
    ok = [(i, k, np.array(v, float), lab) for k, (i, v, lab) in enumerate(rows) if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for a, b in itertools.combinations(ok, 2):
        if a[3] == b[3] and len(a[2]) == len(b[2]) and a[2] @ b[2] / math.sqrt((a[2] @ a[2]) * (b[2] @ b[2])) >= threshold:
            pairs.append((a[1], b[1]))
            for x in (a, b):
                links_[x[1]] = links_.get(x[1], 0) + 1
    return links_, pairs


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 32))
    near = base[rng.integers(0, 20, 250)] + rng.normal(size=(250, 32)) * rng.uniform(0.01, 0.25, (250, 1))
    x = np.concatenate([base, near, near[:10]]).astype(np.float32)
    rows = [(int(i), [float(v) for v in x[i]], int(i) % 2 if i < 150 else 0) for i in range(len(x))]
    rows += [(1000, None, 0), (1001, [0.0] * 32, 0), (1002, [float("nan")] * 32, 0), (1003, [None, 1.0], 0), (1004, rows[3][1], None), (1005, rows[3][1][:7], 1), (1006, rows[3][1][:7], 1), (1007, [], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n string")
    got = {r.vec_id: r for r in near_vectors(df, block_rows=40).collect()}
    want, pairs = brute_vectors(rows)
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got.values())
    total = sum(want.values())
    assert all(got[rows[k][0]].n_links <= want.get(k, 0) for k in range(len(rows)))
    assert found >= 0.97 * total and total > 500
    if found == total:
        label = components(range(len(rows)), pairs)
        assert all(got[rows[k][0]].component_id == rows[label[k]][0] for k in range(len(rows)))
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in (1000, 1001, 1002, 1003, 1004, 1007))
    assert got[1005].n_links == got[1006].n_links == 1 and got[1006].component_id == 1005


def test_near_vectors_with_a_strong_common_mean(spark):
    rng = np.random.default_rng(8)

    def unit(a):
        return a / np.linalg.norm(a, axis=-1, keepdims=True)

    mean = unit(rng.normal(size=64))
    x = unit(np.sqrt(0.7) * mean + np.sqrt(0.3) * unit(rng.normal(size=(1500, 64))))
    y = unit(x[:300] + rng.uniform(0.25, 0.36, (300, 1)) * unit(rng.normal(size=(300, 64))))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, y]))]
    want, pairs = brute_vectors(rows)
    assert 250 < len(pairs) < 400
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert 0.95 * sum(want.values()) <= sum(r.n_links for r in got) <= sum(want.values())


def written(spark, operator, name):
    """A table that the last run of an operator left in the shared folder."""
    root = shared_dir(spark).removeprefix("file://")
    run = max(pathlib.Path(root).glob(f"{operator}-*"), key=lambda p: p.stat().st_mtime)
    return spark.read.parquet(f"file://{next(run.glob(f'*-{name}'))}")


def test_tables_decide_what_is_compared(spark):
    """Vectors of four labels at a cosine of 0.7 within a label, and 60 pairs at 0.93 to 0.94."""
    rng = np.random.default_rng(12)

    def unit(a):
        return a / np.linalg.norm(a, axis=-1, keepdims=True)

    label = np.arange(6000) % 4
    x = unit(np.sqrt(0.7) * unit(rng.normal(size=(4, 64)))[label] + np.sqrt(0.3) * unit(rng.normal(size=(6000, 64))))
    w = rng.normal(size=(60, 64))
    u = x[:60]
    w = unit(w - (w * u).sum(axis=1, keepdims=True) * u)
    cosine = rng.uniform(0.9302, 0.94, (60, 1))
    x, label = np.concatenate([x, cosine * u + np.sqrt(1 - cosine**2) * w]), np.append(label, label[:60])
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))]
    links_ = sum(r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert 0.95 * 120 <= links_ <= 120
    compared = sum(r["count"] ** 2 for name in ("first", "active") for r in written(spark, "itq", name).groupBy("g").count().collect())
    assert compared < 0.05 * 4 * 1500**2 / 2


def test_near_vectors_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_vectors(empty).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0], 3), (1, [1.0, 2.0], 3), (None, [1.0, 2.0], 3)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id is None, r.n_links, r.component_id) for r in near_vectors(same).collect()) == [(False, 2, 1), (False, 2, 1), (True, 2, 1)]


def test_itq_codes_are_balanced_and_keep_angles():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 64))
    _, x = unit_rows(pa.array(x.tolist(), pa.list_(pa.float64())))[64]
    mean, projection = fit_itq(x, 2)
    bits = (x - mean) @ projection >= 0
    assert projection.shape == (64, 128) and np.abs(bits.mean(axis=0) - 0.5).max() < 0.1


# --- ProbMinHash ------------------------------------------------------------------------------


def exact_jp(x: dict, y: dict) -> float:
    out = 0.0
    for i in x.keys() & y.keys():
        out += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys())
    return out


def bag(text, k=5):
    w = text.encode().split()
    out = {}
    for s in [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else []):
        out[s] = out.get(s, 0) + 1
    return out


def test_probability_jaccard_and_its_estimate():
    rng = random.Random(7)
    a = prose(rng, 300)
    w = a.split()
    texts = [a, " ".join(w[:150] + ["changed"] + w[150:]), " ".join(w + w[:200]), prose(rng, 300), "one two", "", " ".join(w[:60] * 3)]
    value, weight, first, n, _ = shingle_sets(pa.array(texts), 5)
    assert n.tolist() == [len(t.split()) for t in texts]
    sig = signatures(value, weight, first, 2048)
    for i in (0, 2, 4, 6):
        got = probability_jaccard(value, weight, first, i, np.arange(len(texts)))
        want = [exact_jp(bag(texts[i]), bag(t)) for t in texts]
        assert got == pytest.approx(want)
        for j in range(5):
            if j != i:
                assert (sig[i] == sig[j]).mean() == pytest.approx(want[j], abs=0.05)


def brute_classes(rows, threshold=0.8):
    bags = [bag(t or "") for _, t in rows]
    edges = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if bags[i] and bags[j] and exact_jp(bags[i], bags[j]) >= threshold]
    label = components(range(len(rows)), edges)
    return [rows[label[i]][0] for i in range(len(rows))]


@pytest.mark.parametrize("block", [300_000, 300])
def test_near_documents_against_brute_force(spark, block):
    rng = random.Random(8)
    rows = []
    for g in range(12):
        w = prose(rng, rng.randrange(30, 160)).split()
        for _ in range(rng.randrange(1, 9)):
            v = list(w)
            for _ in range(rng.randrange(0, 4)):
                v[rng.randrange(len(v))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(v)))
        w = v
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "a b", "a  b", "a b c", " \n ", "a b"])]
    got = {r.doc_id: r for r in near_documents(docs(spark, rows), block_words=block).collect()}
    want = brute_classes(rows)
    assert [got[i].class_id for i, _ in rows] == want
    assert all(r.kept == (r.class_id == r.doc_id) for r in got.values())
    if block > 300:
        return
    kept = drop_near_documents(docs(spark, rows), block_words=block)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in want})


def test_near_documents_odd_rows(spark):
    assert near_documents(docs(spark, [])).collect() == []
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, long), (1, long), (None, long), (2, long + " end"), (3, "p q r s t u"), (3, "k l m n o p"), (4, "k l m n o p")]
    got = sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in near_documents(docs(spark, rows)).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (4, 3, False)]


# --- repeated windows -----------------------------------------------------------------------------


def brute_windows(rows, window=20):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w, gone = (t or "").encode().split(), set()
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if k in seen:
                gone.update(range(p, p + window))
            seen.add(k)
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


@pytest.mark.parametrize("window", [8, 20])
def test_repeated_windows_against_brute_force(spark, window):
    rng = random.Random(9)
    passages = [prose(rng, rng.randrange(15, 90)) for _ in range(8)]
    rows = []
    for i in range(80):
        parts = [prose(rng, rng.randrange(0, 60)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randrange(0, 6))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(100, None), (101, ""), (102, "z " * 200), (103, "z " * 45 + "y " + "z " * 45), (104, " ".join("ab"[i % 2] for i in range(101))), (105, " ".join(f"n{i}" for i in range(20_000))), (106, " ".join(f"n{i}" for i in range(19_000)))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in drop_repeated_windows(docs(spark, rows), window=window).collect()}
    want = brute_windows(rows, window)
    assert {k: v for k, v in got.items() if want[k] != v} == {}


def anchor_phrase(rng):
    """Five words of so small a hash that windows around them have them as their anchor."""
    own = prose(rng, 20_000).split()
    data, offsets = np.frombuffer(" ".join(own).encode(), np.uint8), np.array([0, len(" ".join(own))])
    starts, ends, _ = shingles.words(data, offsets)
    at = int(shingles.window_hashes(shingles.word_hashes(data, starts, ends), 5)[:-4].argmin())
    return " ".join(own[at : at + 5])


@pytest.mark.parametrize("chunk", [3, 40])
def test_repeated_windows_of_an_anchor_of_many_chunks(spark, chunk):
    rng = random.Random(4)
    phrase = anchor_phrase(rng)
    around = [(prose(rng, 9), prose(rng, 9)) for _ in range(40)]
    rows = [(i, f"{a} {phrase} {b}") for i, (a, b) in enumerate(around + around[::-1] + around[:7])]
    rows += [(200 + i, " ".join(f"{prose(rng, 3)} {phrase} {b}" for _, b in around[i : i + 3])) for i in range(5)]
    rows += [rows[60], rows[60], rows[70]]
    got = [(r.doc_id, (r.n_words, r.n_removed, r.kept_text)) for r in drop_repeated_windows(docs(spark, rows), chunk_rows=chunk).collect()]
    want = brute_windows(dict(rows).items())
    assert len(got) == len(rows) and sum(n for _, n, _ in want.values()) > 40 * 20
    assert [(k, v) for k, v in got if want[k] != v] == []


def test_copies_of_a_frequent_phrase_are_all_found(spark):
    """One phrase in all texts, and 50 copies of one of them far apart."""
    rng = random.Random(14)
    phrase = anchor_phrase(rng)
    texts = [f"{prose(rng, 12)} {phrase} {prose(rng, 12)}" for _ in range(3000)]
    for i in range(50):
        texts[40 + i * 59] = texts[40]
    got = {r.doc_id: r.n_removed for r in drop_repeated_windows(docs(spark, list(enumerate(texts))), chunk_rows=100).collect()}
    assert {i: n for i, n in got.items() if n} == {40 + i * 59: 29 for i in range(1, 50)}


def test_equal_rows_of_an_anchor_of_many_chunks(spark):
    text = prose(random.Random(6), 60)
    got = drop_repeated_windows(docs(spark, [(1, text)] * 30 + [(2, text)] * 3), chunk_rows=2).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0)] * 30 + [(2, 60)] * 3


def test_repeated_windows_odd_rows(spark):
    assert drop_repeated_windows(docs(spark, [])).collect() == []
    t = prose(random.Random(1), 50)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in drop_repeated_windows(docs(spark, [(1, t), (1, t), (None, t), (2, t)])).collect())
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, 50), (True, 0, 0)]
    with pytest.raises(ValueError):
        drop_repeated_windows(docs(spark, []), window=10)


# --- lines ---------------------------------------------------------------------------------------------


def brute_lines(rows):
    strip, low = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(line.strip(strip).translate(low), set()).add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        keys = [x.strip(strip).translate(low) for x in lines]
        kept = [x for x, k in zip(lines, keys, strict=True) if not (len(k) >= 20 and len(holders[k]) >= 3 and max(holders[k]) != d)]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(10)
    pool = [prose(rng, rng.randrange(3, 9)) for _ in range(25)] + ["é" * 19, "É" * 20, "short", " " + "n" * 20]
    common = "This Line Is In Nearly All Of The Documents"
    rows = []
    for i in range(150):
        lines = [rng.choice(pool) if rng.random() < 0.4 else prose(rng, 6) for _ in range(rng.randrange(0, 14))]
        if rng.random() < 0.8:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice([common, common.upper(), f" {common}\r", f"{common}\t"]))
        rows.append((i * 3, "\n".join(lines)))
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "\n".join([common] * 300))]
    df = docs(spark, rows)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in apply_bitmaps(df, keep_bitmaps(df)).collect()}
    assert {k: v for k, v in got.items() if brute_lines(rows)[k] != v} == {}


def test_lines_odd_rows(spark):
    assert keep_bitmaps(docs(spark, [])).collect() == []
    line = "a line of more than twenty characters"
    rows = [(1, line), (1, line), (None, line), (2, line), (2, line), (3, "x\n" + line)]
    df = docs(spark, rows)
    got = sorted((r.doc_id or 0, r.n_dropped) for r in apply_bitmaps(df, keep_bitmaps(df)).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (2, 1), (3, 0)]
    assert re.fullmatch("[0-9a-f]{64}", df.select(F.sha2("text", 256)).first()[0])
