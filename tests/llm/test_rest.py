import collections
import functools
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scanforge.llm import chat, langid, mixture_packing, pfair, weak_quality
from scanforge.llm.bfd_packing import CapacityTree, best_fit_decreasing, pack_documents
from scanforge.llm.common import Workspace
from scanforge.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "é", "a b", "x  y", "<|endoftext|> z", "word " * 3000, "中文", "tab\tand\nline"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)


def some_docs(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 400))), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(n)]
    return docs(spark, rows + [(1000 + i, t, None, "odd") for i, t in enumerate(ODD)] + [rows[0], (None, "no id", None, None)])


@functools.cache
def plain_tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(path, text):
    return [*plain_tokenizer(path).encode(text or "", add_special_tokens=False).ids, 0]


# --- tokens and packing -----------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBc é\n\t'sß1.,-_<|>　 \x1c\x85中"), max_size=40), max_size=8))
def test_encoder_equals_tokenizers(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = test_encoder_equals_tokenizers.__dict__
    enc, plain = own.setdefault("enc", Encoder(path, most_cached=50)), own.setdefault("plain", Tokenizer.from_file(path))
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert enc(texts) == want


def test_added_tokens_are_read_as_tokenizers_does(tokenizer_path):
    texts = ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>\n", "<|endoftext |>"]
    got = [np.frombuffer(x, "<u4").tolist() for x in Encoder(tokenizer_path)(texts)]
    assert got == [ids_of(tokenizer_path, t)[:-1] for t in texts] and len(got[0]) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_decreasing(lengths):
    got = best_fit_decreasing(lengths, 50)
    assert sorted(i for g in got for i in g) == list(range(len(lengths)))
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free[free.index(min(fits))] -= n
        else:
            free.append(50 - n)
    assert sorted(50 - sum(lengths[i] for i in g) for g in got) == sorted(free)


def test_capacity_tree_takes_the_least_that_is_enough():
    tree = CapacityTree(10)
    for free, s in ((3, 0), (7, 1), (10, 2)):
        tree.put(free, s)
    assert tree.take(4) == (7, 1) and tree.take(4) == (10, 2) and tree.take(4) is None and tree.take(3) == (3, 0)


@pytest.mark.parametrize("buffer", [4_000_000, 2_000])
def test_bfd_packing_is_lossless(spark, tokenizer_path, buffer):
    df = some_docs(spark)
    got = pack_documents(df, tokenizer_path, capacity=256, buffer_tokens=buffer).collect()
    pieces = {}
    for r in got:
        ids, pos = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(pos) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert pos[a:b].tolist() == list(range(b - a))
            pieces.setdefault(d, []).append((s, ids[a:b].tolist()))
    assert len({r.sequence_id for r in got}) == len(got)
    for r in df.where("doc_id > 0").collect():
        assert sum((p for _, p in sorted(pieces[r.doc_id])), []) == ids_of(tokenizer_path, r.text)
    total = sum(len(p) for own in pieces.values() for _, p in own)
    assert total == sum(r.n_tokens for r in got)
    assert buffer < 10_000 or total / (256 * len(got)) > 0.9
    assert pack_documents(docs(spark, []), tokenizer_path).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3000), st.floats(0.05, 5)), min_size=1, max_size=6))
def test_round_robin_holds_proportions(sources):
    totals, weights = np.array([n for n, _ in sources]), np.array([w for _, w in sources])
    plan = mixture_packing.RoundRobin.plan(totals, weights, 100)
    for q, n in enumerate(totals):
        at = np.arange(n)
        w = plan.window_of(q, at)
        assert (np.diff(w) >= 0).all() and (plan.before(q, w) <= at).all() and (at < plan.before(q, w + 1)).all()
    last = int(np.ceil(plan.times[-1])) + 1
    sent = np.stack([plan.before(q, np.arange(last + 1)) for q in range(len(totals))])
    assert (sent[:, -1] == totals).all()
    first_end = plan.times[1]
    for w in range(int(first_end)):
        assert np.abs(sent[:, w] - w * 100 * weights / weights.sum()).max() < 1 + 1e-6
    assert np.abs(sent.sum(axis=0)[: int(plan.times[-1])] - 100 * np.arange(int(plan.times[-1]))).max(initial=0) <= len(totals)


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 3, None: 2}])
def test_mixture_packing_is_lossless_and_gapless(spark, tokenizer_path, weights):
    df = some_docs(spark)
    got = mixture_packing.pack_mixture(df, tokenizer_path, weights=weights, sequence=64, window_sequences=8).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length > 0 and r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    fill = []
    for s in sorted(by):
        at = 0
        for offset, length in sorted(by[s]):
            assert offset == at
            at += length
        fill.append(at)
    assert sorted(by) == list(range(len(by))) and all(n == 64 for n in fill[:-1]) and fill[-1] <= 64
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    for r in df.where("doc_id > 0").collect():
        own = sorted(pieces[r.doc_id])
        want = ids_of(tokenizer_path, r.text)
        assert sum((p for _, p, _ in own), []) == want and own[0][2] == len(want)
    assert mixture_packing.pack_mixture(docs(spark, []), tokenizer_path).collect() == []
    if weights is None:
        tokens = {}
        for r in got:
            tokens.setdefault(r.window, {}).setdefault(r.source, []).append(r.length)
        total = {}
        for r in got:
            total[r.source] = total.get(r.source, 0) + r.length
        n = sum(total.values())
        for w in range(max(tokens)):
            for s, k in total.items():
                assert abs(sum(tokens[w].get(s, [0])) - 512 * k / n) <= 2


# --- mixing ------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 10**9)), min_size=1, max_size=6), st.sampled_from([1, 7, 1000]))
def test_schedule_keeps_every_source_within_a_block(sources, most):
    blocks = {f"s{i}": n for i, (n, _) in enumerate(sources)}
    weights = {f"s{i}": Fraction(w, 7) for i, (_, w) in enumerate(sources)}
    ran, active, slot, began, begin = dict.fromkeys(blocks, 0), set(blocks), 0, 0, {}
    for x in pfair.stretches(blocks, weights, most):
        if x.slot == 0:
            active, began, begin = {s for s in blocks if ran[s] < blocks[s]}, slot, dict(ran)
        assert set(x.weights) == active and 0 < x.count <= most
        whole = sum(weights[s] for s in active)
        for s, block, at, release, deadline in x.rows():
            assert block == ran[s] and at == slot and release <= at < deadline
            ran[s] += 1
            slot += 1
            assert all(abs(ran[y] - begin[y] - weights[y] / whole * (slot - began)) < 1 for y in active)
    assert ran == blocks and slot == sum(blocks.values())


def test_a_long_schedule_stays_within_a_block_of_the_exact_shares():
    """Four sources of 30 to 50 thousand blocks and a tiny one, by roots of their characters."""
    blocks = {"a": 50_000, "b": 40_000, "c": 30_000, "d": 30_000, "e": 1}
    weights = {s: Fraction(pfair.root_weight(n * 1_000_000 - 17)) for s, n in blocks.items()}
    ran, worst, begin, began, slot = dict.fromkeys(blocks, 0), 0.0, {}, 0, 0
    for x in pfair.stretches(blocks, weights):
        if x.slot == 0:
            begin, began = dict(ran), slot
        for s, *_ in x.rows():
            ran[s] += 1
            slot += 1
            if slot % 101 == 0:
                worst = max(worst, *(abs(ran[y] - begin[y] - x.weights[y] / sum(x.weights.values()) * (slot - began)) for y in x.weights))
    assert ran == blocks and worst < 1 + 1e-6


def test_mixing_keeps_all_rows(spark):
    df = some_docs(spark).withColumn("mix_slot", F.lit("clash"))
    got = Workspace(spark, "mixed").table(pfair.mix_sources(df, block_chars=500))
    assert got.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "mix_block", "mix_slot", "mix_release", "mix_deadline"]
    key = lambda r: (r.doc_id or -1, r.text or "")
    assert sorted(map(key, got.collect())) == sorted(map(key, df.collect()))
    assert got.where("mix_slot < mix_release or mix_slot >= mix_deadline").count() == 0
    assert got.groupBy("mix_slot").agg(F.count_distinct("source").alias("n")).where("n > 1").count() == 0
    ordered = [r.mix_slot for r in pfair.in_mixed_order(got).collect()]
    assert ordered == sorted(ordered)
    assert pfair.mix_sources(docs(spark, [])).collect() == []


def test_mixed_characters_follow_the_weights(spark):
    """Documents of very different length: each source is within a block and a document of its share."""
    rng = random.Random(11)
    rows = [(i, "x" * rng.choice([10, 50, 2000]), "en", "a") for i in range(300)] + [(1000 + i, "y" * 3000, "en", "b") for i in range(40)]
    got = pfair.mix_sources(docs(spark, rows).repartition(5), weights={"a": 1, "b": 3}, block_chars=2000).orderBy("mix_slot").collect()
    n_blocks = -(-120_000 // 2000)
    sent = {"a": 0, "b": 0}
    slots = max(r.mix_slot for r in got if r.source == "b")
    for slot in range(slots):
        for r in got:
            if r.mix_slot == slot:
                sent[r.source] += len(r.text)
        assert abs(sent["b"] - 0.75 * 2000 * (slot + 1)) <= 2000 + 3000 and abs(sent["a"] - 0.25 * 2000 * (slot + 1)) <= 2000 + 2000
    assert slots >= n_blocks


def test_any_number_of_sources_keep_their_own_shares(spark):
    """400 sources beside two large ones, with weights of their own; very many texts without characters."""
    rows = [(i, "x" * 50, "en", f"s{i % 400}") for i in range(800)] + [(5000 + i, "y" * 60, "en", "ab"[i % 2]) for i in range(500)] + [(9000 + i, None, "en", "a") for i in range(600)]
    weights = {f"s{k}": 1 + k % 3 for k in range(400)} | {"a": 300, "b": 150}
    got = Workspace(spark, "mixed").table(pfair.mix_sources(docs(spark, rows).repartition(4), weights=weights, block_chars=50)).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows] and all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    blocks = {}
    for r in got:
        blocks.setdefault(r.source, {})[r.mix_block] = (r.mix_slot, r.mix_release, r.mix_deadline)
    chars = {s: sum(len(t or "") for _, t, _, x in rows if x == s) for s in blocks}
    whole = next(pfair.stretches({s: -(-n // 50) for s, n in chars.items()}, {s: Fraction(w) for s, w in weights.items()}))
    assert whole.weights == dict(sorted(weights.items())) and len(blocks) == 402
    for s, block, *times in whole.rows():
        # No document may start in a block.
        assert blocks[s].get(block, tuple(times)) == tuple(times)


def test_any_number_of_sources_queue_one_by_one(spark, tokenizer_path):
    """300 sources with weights of their own: each holds its share of every full window, in a gapless order."""
    rng = random.Random(13)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(60)), "en", None if i % 300 == 7 else f"s{i % 300}") for i in range(900)]
    weights = {s: 1 + i % 3 for i, s in enumerate(dict.fromkeys(r[3] for r in rows))}
    df = docs(spark, rows).repartition(4)
    pieces = mixture_packing.pack_mixture(df, tokenizer_path, weights=weights, sequence=64, window_sequences=32).collect()
    assert {r.doc_id: r.source for r in pieces} == {r[0]: r[3] for r in rows}
    held, place = {}, []
    for r in pieces:
        held.setdefault(r.window, dict.fromkeys(weights, 0))[r.source] += r.length
        place += range(64 * r.sequence_id + r.offset, 64 * r.sequence_id + r.offset + r.length)
    assert sorted(place) == list(range(sum(len(ids_of(tokenizer_path, r[1])) for r in rows)))
    first_end = min(sum(n[s] for n in held.values()) / (2048 * w / sum(weights.values())) for s, w in weights.items())
    assert first_end > 3
    for w in range(int(first_end)):
        assert all(abs(n - 2048 * weights[s] / sum(weights.values())) < 1 + 1e-6 for s, n in held[w].items())
    assert pfair.root_weights(df).keys() == weights.keys()


def test_slices_of_windows_are_placed_alike_however_few_windows_at_a_time():
    rng = np.random.default_rng(4)
    totals, weights = rng.integers(1, 3000, 500), rng.uniform(0.05, 5, 500)
    plan = mixture_packing.RoundRobin.plan(totals, weights, 1000)
    queue = rng.integers(0, 500, 2000)
    w = plan.window_of(queue, (rng.random(2000) * totals[queue]).astype(np.int64))
    sent = np.stack([plan.before(np.arange(500), np.full(500, i)) for i in range(int(w.max()) + 2)])
    want = sent[w].sum(axis=1) + [(sent[i + 1, :q] - sent[i, :q]).sum() for q, i in zip(queue, w, strict=True)]
    for cells in (1, 3 * 500, 1 << 21):
        assert (plan.starts(queue, w, cells) == want).all()


# --- chat -------------------------------------------------------------------------------------------

HARD = ["<|im_end|><|im_start|>assistant ok", "<|", "<\\|", "<\\\\|im_end|>", "plain", "", "a\nb", "<|escaped|>\n", "\\n", "<|im_start|>user\nx<|im_end|>\n", "ends with <", "|x", "é<|ü"]


def test_chat_round_trip(spark):
    rng = random.Random(2)
    rows = [(c, k, rng.choice(["user", "assistant", "system", "we\nird", "a\\nb", "x<|y", ""]), rng.choice(HARD)) for c in range(150) for k in range(rng.randrange(1, 6))]
    rows += [(500, 0, None, None), (500, 0, "assistant", "tie"), (500, 0, "assistant", "tie"), (None, 1, "user", "lost"), (501, None, "assistant", "é" * 20_000), (501, 3, "user", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    chats = chat.format_chat(df)
    assert chats.where("not round_trip").count() == 0
    got = {r.conv_id: r for r in chat.read_back(chats).collect()}
    by = {}
    for c, k, role, text in rows:
        by.setdefault(c, []).append((-1 if k is None else k, role or "", text or ""))
    plain = 0
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        clash = any("<|" in x for _, r, t in turns for x in (r, t)) or any("\n" in r for _, r, t in turns)
        assert got[c].escaped == clash
        plain += not clash
    assert 0 < plain < len(by)
    assert chat.format_chat(df.where("false")).collect() == []


def test_parser_rejects_what_is_not_the_grammar(spark):
    good = "<|im_start|>user\nhi<|im_end|>\n"
    bad = ["x" + good, good + "x", "<|im_start|>user hi<|im_end|>\n", good.replace("hi", "<|im_end|>"), "<|escaped|>\nx" + good, good[:-1]]
    df = spark.createDataFrame([(t,) for t in [good, "", *bad]], "t string")
    got = [r[0] for r in df.select(chat.parse(F.col("t"))).collect()]
    assert got[0][0].text == "hi" and got[1] == [] and got[2:] == [None] * len(bad)


# --- language ------------------------------------------------------------------------------------------

WORDS = {"en": "the of and house with water from street", "de": "der die und haus mit wasser von straße", "fr": "le la et maison avec eau près été"}


def test_language_of_held_out_texts(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randrange(4, 40))), lang, "s") for i, lang in enumerate(rng.choices(sorted(WORDS), k=400))]
    truth = {r[0]: r[2] for r in rows}
    # The labels of held-out rows are wrong on purpose: they are not to be learned.
    rows = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s) for i, t, lang, s in rows]
    rows += [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "12 34 !", "de", "s"), (1003, "house " * 30_000, None, "s"), (1003, "house", None, "s"), (None, "maison avec eau", None, "s")]
    got = langid.identify(docs(spark, rows).withColumn("score", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 80 and sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in got)
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "en", "fr"]
    nothing = langid.identify(docs(spark, [(1, "some text", None, "s")])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
    assert langid.identify(docs(spark, [])).collect() == []


def test_labels_beyond_one_model_are_all_compared(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS[lang].split(), k=9)), lang, "s") for i, lang in enumerate(rng.choices(sorted(WORDS), k=150))]
    df = docs(spark, rows)
    got, one = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(df, most_labels=n).collect()} for n in (1, 256))
    assert got == one


def test_language_counts_equal_plain_python():
    texts = ["Été, la-bas", "", "x"]
    found, first, has = langid.features(texts, (1, 2, 3), 12)
    assert has.tolist() == [True, False, True]
    want = 0
    for t in texts:
        t = "".join(c if c.isalpha() else " " for c in t.lower())
        want += sum(t[i : i + n].strip() != "" for n in (1, 2, 3) for i in range(len(t) - n + 1))
    assert len(found) == want == first[-1]


# --- quality ------------------------------------------------------------------------------------------------


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_measures_and_verdicts(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzé"
    word = lambda: "".join(rng.choices(letters, k=rng.randrange(2, 9)))
    clean = lambda n: "".join(word() + rng.choice([" "] * 8 + [".\n", ", "]) for _ in range(n))
    rows = [(i, clean(rng.randrange(25, 200)), "en", "s") for i in range(150)]
    junk = [(200 + i, " ".join(word() + rng.choice(["***", "$$$", "%%%"]) for _ in range(120)), "en", "s") for i in range(25)]
    loops = [(300 + i, clean(30) + (clean(9) + "\n") * rng.randrange(2, 9), "en", "s") for i in range(20)]
    odd = [(400 + i, t, None, None) for i, t in enumerate([*ODD, "x " * 500, "A\tb\x0bc\x0cd\re f g h " * 4, "\n\n", clean(6000)])]
    df = docs(spark, rows + junk + loops + odd + [rows[0], (None, rows[1][1], "en", "s")]).withColumn("kept", F.lit("clash"))
    got = weak_quality.quality(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(r.text)
        assert not (r.base_failed and r.kept) and 0 <= r.p_good <= 1
    by = {r.doc_id: r for r in got}
    assert all(by[r[0]].kept for r in rows) and not any(by[r[0]].kept for r in junk)
    assert weak_quality.quality(docs(spark, [])).collect() == []


def test_accuracies_are_recovered():
    rng = np.random.default_rng(1)
    counts = {}
    accuracy = [(0.97, 0.9), (0.98, 0.7), (0.95, 0.6), (0.99, 0.8)]
    for good in (rng.random(20_000) < 0.85):
        votes = tuple(None if rng.random() < 0.2 else int((rng.random() < a) if good else (rng.random() >= b)) for a, b in accuracy)
        counts[votes] = counts.get(votes, 0) + 1
    prior, found = weak_quality.fit_accuracies(sorted(counts.items(), key=str), 4, 200)
    assert prior == pytest.approx(0.85, abs=0.03)
    assert [x for f in found for x in f] == pytest.approx([x for a in accuracy for x in a], abs=0.06)
    assert weak_quality.fit_accuracies([], 4)[0] == 0.8


def test_verdicts_against_plain_python(spark):
    """The same model in numpy, over documents instead of patterns."""
    docs_ = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = weak_quality.quality(docs_.select("doc_id", "text")).collect()
    rows, names = [], []
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n, chars = len(w), sum(map(len, w))
        if r.base_failed:
            continue
        low = lambda x, good, bad: 1 if x <= good else 0 if x > bad else np.nan
        high = lambda x, good, bad: 1 if x >= good else 0 if x < bad else np.nan
        ended = sum(x.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?:;…。！？\"'”’)]" for x in lines)
        mean = chars / n
        rows.append([
            low(r.n_symbols / n, 0.05, 0.1), low(r.n_repeat_words / n, 0.02, 0.1), low(r.n_dup_lines / len(lines), 0.05, 0.2) if len(lines) >= 4 else np.nan,
            1 if 4.2 <= mean <= 6.5 else 0 if mean < 3 or mean > 8 else np.nan, high(ended / len(lines), 0.9, 0.6),
            low(len(re.findall("[A-ZÀ-ÖØ-Þ]", r.text)) / chars, 0.1, 0.3), low(len(re.findall("[0-9]", r.text)) / chars, 0.05, 0.1),
            high(len(set(w)) / n, 0.4, 0.25) if 50 <= n <= 2000 else np.nan,
        ])
        names.append(r.doc_id)
    v = np.array(rows)
    seen, yes = ~np.isnan(v), np.nan_to_num(v)
    prior, good, bad = 0.8, np.full(8, 0.97), np.full(8, 0.2)

    def posterior():
        each = np.where(yes == 1, np.log(good / (1 - bad)), np.log((1 - good) / bad)) * seen
        return 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + each.sum(axis=1), -500, 500)))

    for _ in range(100):
        p = posterior()[:, None]
        good, bad = ((p * yes * seen).sum(0) + 1.94) / ((p * seen).sum(0) + 2), (((1 - p) * (1 - yes) * seen).sum(0) + 0.4) / (((1 - p) * seen).sum(0) + 2)
        bad = np.maximum(bad, 1 - good)
        prior = (p.sum() + 1.6) / (len(v) + 2)
    want = dict(zip(names, posterior(), strict=True))
    assert all(r.p_good == pytest.approx(want[r.doc_id], abs=1e-6) and r.kept == (want[r.doc_id] >= 0.5) for r in got if not r.base_failed)
    one_bad = [i for i, row in zip(names, v, strict=True) if (row == 0).sum() == 1]
    kept = {r.doc_id for r in got if r.kept}
    assert 0 < sum(i in kept for i in one_bad) < len(one_bad)
    # No bad vote raises the odds.
    odds = weak_quality.fit_accuracies(sorted(collections.Counter(tuple(None if np.isnan(x) else int(x) for x in row) for row in v).items(), key=str), 8)[1]
    assert all(b >= 1 - g - 1e-12 and np.isclose(g, x) and np.isclose(b, y) for (g, b), x, y in zip(odds, good, bad, strict=True))
    assert (good < 1).all() and (good < 0.9999).sum() >= 6 and ((bad > 0.0001) & (bad < 0.9999)).all()


# --- clashing names -----------------------------------------------------------------------------------------

INNER = "own text doc id q n h keep pred best total label key key_bits narrow wide task start base queue source_id block chars blocks bands band low node sum first copies payload runs slot epoch turn firsts weight _text _w _h _h2 _h4 _h8 _g _lines _s _at _k _past _salt _copies _dropped _id _keep _q _blocks _conv _sorted _turns _plain _loss".split()
RESULTS = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed p_good kept n_lines n_dropped kept_text n_removed class_id copy_of mix_block mix_slot mix_release mix_deadline lang_pred score held_out keep_bitmap sequence_id doc_tokens offset window padded_length ids formatted escaped round_trip n_turns loss_spans n_links component_id n_copies".split()


def operators():
    import corpus_pipeline as P
    from scanforge.llm import itq_dedup, line_dedup, probminhash, substring_dedup
    from scanforge.llm.queries import TOKENIZER

    return {
        "quality": weak_quality.quality, "bitmaps": lambda d: line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d)), "near": probminhash.near_documents, "drop_near": probminhash.drop_near_documents,
        "windows": substring_dedup.drop_repeated_windows, "identify": langid.identify, "predict": lambda d: langid.predict(d, langid.train(d)),
        "bfd": lambda d: pack_documents(d, TOKENIZER), "mixture": lambda d: mixture_packing.pack_mixture(d, TOKENIZER),
        "chat": lambda d: chat.format_chat(d.drop("turn", "role", "conv_id").withColumnRenamed("doc_id", "conv_id").withColumnRenamed("n_chars", "turn").withColumnRenamed("lang", "role")),
        "vectors": lambda d: itq_dedup.near_vectors(d.withColumn("embedding", F.array(F.lit(1.0), F.col("doc_id").cast("double"))).withColumn("vec_id", F.col("doc_id")), label_col="source"),
        **{name: (lambda f: lambda d: f(d.sparkSession, d, ""))(f) for name, f in P.STAGES},
    }


@pytest.mark.parametrize("name", ["quality", "bitmaps", "near", "drop_near", "windows", "identify", "predict", "bfd", "mixture", "chat", "vectors", "quality_rules", "line_dedup", "near_dedup", "mix", "pack"])
def test_clashing_names_change_nothing(spark, name):
    rng = random.Random(6)
    rows = [(i, "\n".join(" ".join(f"word{rng.randrange(90)}" for _ in range(9)) + "." for _ in range(5)), "en", "s") for i in range(6)]
    df = docs(spark, rows + [(7, rows[2][1], "en", None), (8, None, None, "s")])
    more = [c for c in dict.fromkeys(INNER + RESULTS) if c not in df.columns]
    clash = df.select("*", *(F.lit("x").alias(c) for c in more))
    run = operators()[name]
    plain, got = run(df), run(clash)
    assert set(plain.columns) <= set(got.columns)
    rows_of = lambda d: sorted(map(str, d.select(plain.columns).collect()))
    assert rows_of(got) == rows_of(plain)


def brute_lines(rows):
    strip, low = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(line.strip(strip).translate(low), set()).add(d)
    out = {}
    for d, t in rows:
        pairs = [(x, x.strip(strip).translate(low)) for x in (t or "").split("\n")]
        out[d] = "\n".join(x for x, k in pairs if not (len(k) >= 20 and len(holders[k]) >= 3 and max(holders[k]) != d))
    return out


# --- pipeline -----------------------------------------------------------------------------------------------


def test_pipeline_stages_and_whole(spark, tokenizer_path):
    import corpus_pipeline as P
    from scanforge.llm.probminhash import near_documents

    sf = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    kept = P.quality_rules(spark, docs_, sf)
    assert kept.columns == docs_.columns
    good = {r.doc_id for r in weak_quality.quality(docs_).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good
    lines = P.line_dedup(spark, kept, sf)
    want = brute_lines([(r.doc_id, r.text) for r in kept.collect()])
    rows = lines.collect()
    assert lines.columns == docs_.columns and {r.doc_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows)
    near = P.near_dedup(spark, lines, sf)
    classes = {r.doc_id: r.class_id for r in near_documents(lines).collect()}
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(classes.values()))
    mixed = P.mix(spark, near, sf)
    assert mixed.columns == docs_.columns
    final = {r.doc_id: r.text for r in mixed.collect()}
    got = P.run(spark, sf).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert set(pieces) == set(final)
    for d, own in pieces.items():
        ids = np.array(ids_of(tokenizer_path, final[d]), "<u4")
        at = 0
        for start, length, crc in sorted(own):
            assert start == at and zlib.crc32(ids[start : start + length].tobytes()) == crc
            at += length
        assert at == len(ids)


def test_pipeline_windows_hold_the_mixture(spark):
    import corpus_pipeline as P

    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(1000))
    sources = {"a": 300, "b": 30, None: 30}
    rows = [(i, text(), "en", s) for i, s in enumerate(s for s, n in sources.items() for _ in range(n))]
    df = docs(spark, rows).repartition(5)
    mixed = Workspace(spark, "mixed").table(P.mix(spark, df, ""), "mix")
    pieces = P.pack(spark, mixed, "").collect()
    weights = {s: sum(len(t) for _, t, _, x in rows if x == s) ** 0.5 for s in sources}
    shares = {}
    for r in pieces:
        shares.setdefault(r.window, dict.fromkeys(sources, 0))[r.source] += r.length
    assert len(shares) > 3
    for s, w in weights.items():
        for window in (0, 1):
            assert shares[window][s] / sum(shares[window].values()) == pytest.approx(w / sum(weights.values()), abs=0.002)
    slots = {r.doc_id: r.mix_slot for r in pfair.mix_sources(df).collect()}
    assert len(set(slots.values())) > 3
    for s in sources:
        own = [slots[r.doc_id] for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)) if r.source == s]
        assert own == sorted(own)


def test_pieces_follow_the_files_of_the_mix_stage(spark):
    """Each source is packed in the order of the mixture's files, however tasks read them; another order gives another result."""
    import corpus_pipeline as P

    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(40)), "en", s) for i, s in enumerate("aab" * 60)]
    df = docs(spark, rows).repartition(5)
    ws = Workspace(spark, "order")
    mixed = ws.table(P.mix(spark, df, ""), "mix")
    backwards = ws.table(mixed.repartitionByRange(6, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")), "back")

    def order(table):
        pieces = sorted(P.pack(spark, table, "").collect(), key=lambda r: (r.sequence_id, r.offset))
        return {s: list(dict.fromkeys(r.doc_id for r in pieces if r.source == s)) for s in "ab"}

    slots = {r.doc_id: r.mix_slot for r in pfair.mix_sources(df).collect()}
    got = order(mixed)
    in_files = mixed.select("doc_id", "source", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()
    assert got == {s: [r.doc_id for r in in_files if r.source == s] for s in "ab"}
    assert all([slots[d] for d in own] == sorted(slots[d] for d in own) for own in got.values())
    back = order(backwards)
    assert back == {s: sorted(got[s], reverse=True) for s in "ab"} and back != got
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "2k")
        assert order(mixed) == got
    finally:
        spark.conf.set(key, before)
