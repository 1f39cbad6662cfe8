"""Prefix trie, sharding and filter audit against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scanforge.llm import filter_audit, prefix_trie, sharding
from scanforge.llm.queries import queries

CHATS = "conv_id long, turn long, role string, text string"
CLASHES = "group turns head t h seq chars kind shard key parent_key depth digest own size id u unit rank first law slot part mask n good toxic words quality removed kept step"


# --- prefix trie ------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = Counter(), Counter()
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if rebuilt[c] == node)
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def chats(seed, n=150):
    """Many branches, one conversation and one first turn that a third share, one long conversation, odd rows."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(420), n) + [-1, -130, 100, 200]:
        if c % 3 == 0:
            rows += [(c, t, "user", f"same {t}") for t in range(4)]
        else:
            rows += [(c, t, rng.choice("ua"), rng.choice(["x", "é", "中 y", ""])) for t in range(rng.randrange(1, 9))]
    rows += [(401, t, "user", f"t{t % 7}") for t in range(600)]
    rows += [(7, None, None, None), (7, None, "user", None), (9, 2, "a", "tie b"), (9, 2, "a", "tie a"), (None, 1, "user", "no id"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("limits", [(1 << 20, 1 << 17), (40, 1 << 17), (1 << 20, 3), (1, 1)])
def test_trie_equals_brute_force_whatever_the_shards(spark, limits):
    rows = chats(5)
    got = prefix_trie.trie_nodes(prefix_trie.branched(spark.createDataFrame(rows, CHATS)), *limits).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    empty = spark.createDataFrame([], CHATS)
    assert prefix_trie.conversation_trie(empty).count() == 0
    short = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 6 > 1]
    rows = [(c, 1, "user", "gone") for c in short]
    got = [tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, CHATS)).collect()]
    assert got == brute_trie(rows) and len(got) == 1 and got[0][3:7] == (len(short), 0, 1, 0)


def test_clashing_names_and_pieces(spark, monkeypatch):
    rows = chats(6, 60)
    df = spark.createDataFrame(rows, CHATS)
    more = [c for c in CLASHES.split() if c not in df.columns]
    got = prefix_trie.conversation_trie(df.select(*(F.lit("x").alias(c) for c in more), "*")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_trie(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=6), min_size=1, max_size=60), st.randoms())
def test_double_array_holds_each_sequence_once(sequences, rng):
    sequences = sorted(sequences)
    ids, length = np.array([x for s in sequences for x in s], np.int64), np.array([len(s) for s in sequences])
    BASE, CHECK, code = prefix_trie.build(ids, np.cumsum(length) - length, length)
    walk = lambda s: [0] + [x for x in _walk(BASE, CHECK, code, s)]
    found = {}
    for s in sequences:
        for d, state in enumerate(walk(s)):
            assert state >= 0 and found.setdefault(tuple(s[:d]), state) == state
    assert len(set(found.values())) == len(found) and (CHECK >= 0).sum() == len(found) - 1
    for s in sequences:
        other = [*s, rng.randrange(10)]
        assert (tuple(other) in found) == (walk(other)[-1] >= 0 and code[other[-1]] >= 0 if other[-1] < len(code) else False)


def _walk(BASE, CHECK, code, sequence):
    state = 0
    for x in sequence:
        c = code[x] if x < len(code) else -1
        state = int(prefix_trie.step(BASE, CHECK, np.array([state]), np.array([c]))[0]) if state >= 0 and c >= 0 else -1
        yield state


def test_double_array_stays_dense():
    rng = np.random.default_rng(3)
    sequences = sorted(map(tuple, rng.integers(0, 3000, (20_000, 4)).tolist()))
    ids, length = np.array(sequences, np.int64).ravel(), np.full(len(sequences), 4)
    BASE, CHECK, _ = prefix_trie.build(ids, np.cumsum(length) - length, length)
    assert (CHECK >= 0).sum() > 0.9 * len(CHECK)


# --- sharding ---------------------------------------------------------------------------------------------


def shard_rows(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    return sharding.shard_documents(df, **kw).collect()


def check_slots(got, shards):
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.size == len((r.text or "").encode()) + 8 and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


def test_shards_are_even_and_keep_copies_together(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abé", k=int(rng.paretovariate(1.1) * 30) % 4000)) for _ in range(3000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10_000 + i, texts[i % 40]) for i in range(400)] + [(None, "no id"), (None, None), (1, None), (2, "")]
    got = shard_rows(spark, rows, shards=8)
    check_slots(got, 8)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(s - mean) < 0.02 * mean for s in sizes.values())
    homes = defaultdict(set)
    for r in got:
        homes[r.text or ""].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_a_text_that_a_third_shares_is_spread(spark):
    rows = [(i, f"text {i} " + "y" * (i % 50)) for i in range(2000)] + [(i, "hot " * 10) for i in range(2000, 3000)] + [(5, "again")] * 900
    got = shard_rows(spark, rows, shards=6)
    check_slots(got, 6)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 6
    assert all(abs(s - mean) < 0.05 * mean for s in sizes.values())
    assert len({r.shard for r in got if r.text.startswith("hot")}) > 1


def test_shards_of_few_rows_and_clashing_names(spark):
    assert shard_rows(spark, []) == []
    got = shard_rows(spark, [(1, "x" * 1000), (2, "a"), (3, "b")], shards=24)
    check_slots(got, 24)
    assert len({r.shard for r in got}) == 3
    df = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    more = [c for c in CLASHES.split()]
    got = sharding.shard_documents(df.select(*(F.lit("x").alias(c) for c in more), "*"), shards=4).collect()
    check_slots(got, 4)
    assert len(got) == 30 and all(r.unit == "x" and r.rank == "x" for r in got)


def test_overfull_ranges_are_subdivided(spark):
    """A sample that misses the crowded part of the key space is mended by exact running weights."""
    groups = spark.range(20_000).selectExpr("id * id as h", "10L as bytes", "1L as n")
    cuts, heavy = sharding.range_splits(groups, 50)
    assert heavy == {}
    counts = np.bincount(np.searchsorted(cuts, np.arange(20_000, dtype=np.int64) ** 2, side="right"))
    assert counts.max() <= 1.5 * 400
    lean = np.sort(np.random.default_rng(1).integers(0, 10**9, 64))
    assert len(sharding.splitters(lean, np.ones(64), 8)) == 7


# --- filter audit -----------------------------------------------------------------------------------------


def fails(rows):
    """The letters that each row fails."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, _ in rows:
        t = t or ""
        w = t.encode().split()
        x = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t))
        out.append(x + "D" * any(c in "#$%&*|" for c in t) + "E" * (d is not None and d > least[t]))
    return out


def brute_audit(rows, labels):
    good, toxic = ({r[0] for r in labels if r[i] == 1 and r[0] is not None} for i in (1, 2))
    out, bad = {}, fails(rows)
    parts = {s or "" for _, _, s in rows}
    for part in parts:
        own = [(d, f) for (d, _, s), f in zip(rows, bad, strict=True) if (s or "") == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for i, letter in enumerate(order, 1):
                gone = [(d, f) for d, f in left if letter in f]
                again = sum(letter in f for _, f in own) - len(gone)
                left = [(d, f) for d, f in left if letter not in f]
                shapley[letter] += len(gone)
                out[part, order, i] = [len(left), len(gone), again, sum(f == letter for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), letter]
        for key, x in out.items():
            if key[0] == part:
                x[6] = shapley[x[6]]
    return out


def audit_rows(seed=2, n=120):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["one", "Two", "3", "é", "W%s" % rng.randrange(300)]) for _ in range(rng.choice([3, 150, 250, 400]))) for _ in range(30)] + ["", None, "# x", "  \x1c\x85", "AB\tc\x0bD" * 300]
    rows = [(rng.randrange(60), rng.choice(texts), rng.choice(["a", "a", "b", None, ""])) for _ in range(n)]
    return rows + [(None, texts[0], "a"), (None, texts[0], "n"), rows[0], rows[0], (900, texts[0], "alone"), (1, "word " * 30_000, "long")]


LABELS = [(i, i % 2, int(i % 7 == 0)) for i in range(50)] + [(3, 0, 1), (4, None, None), (None, 1, 1), (900, 1, None)]


def test_audit_equals_brute_force(spark):
    rows = audit_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = brute_audit(rows, LABELS)
    for frame, other in ((df, labels), (df.select(*(F.lit("x").alias(c) for c in CLASHES.split()), "*"), labels.select("*", *(F.lit(1).alias(c) for c in ("id", "n", "mask"))))):
        got = {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in filter_audit.audit_filters(frame, other).collect()}
        assert got == want


def test_audit_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(df, labels).count() == 0
    one = filter_audit.audit_filters(df.union(spark.createDataFrame([(1, None, None)], df.schema)), labels).collect()
    assert len(one) == 600 and sum(r.removed for r in one) == 120 and {r.shapley for r in one} == {0, 120}


@pytest.mark.parametrize("k", [1, 2, 4, 6])
def test_min_plus_steps_equal_walking_the_orders(k):
    orders, steps = filter_audit.removal_steps(k)
    for mask in range(1 << k):
        for o, s in zip(orders.tolist(), steps[mask].tolist(), strict=True):
            at = next((i for i, f in enumerate(o) if mask >> f & 1), None)
            assert s == at if at is not None else s >= filter_audit.NEVER
    with pytest.raises(ValueError):
        filter_audit.audit_orders(None, "ABCDEFGH")


def test_queries_read_whole_tables(spark):
    sf, known = "/root/testdata/sf0.001", queries()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert known["op12_splitter_sharding"](spark, sf).count() == docs.count()
    chats_ = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in known["op11_prefix_trie"](spark, sf).collect()), key=str) == brute_trie(chats_)
    crc = {r.doc_id: (r.size, r.text_crc32) for r in known["op12_splitter_sharding"](spark, sf).collect()}
    assert crc == {r.doc_id: (len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect()}
