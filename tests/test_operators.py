import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanforge.functions import scalar
from scanforge.operators import aggregates, dictionary, features, joins, reshape, sets, smooth, solve, windows


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_asof_ties_and_duplicates(spark):
    left = spark.createDataFrame([(1, i, t) for i, t in enumerate([0.5, 1.5, 3.0, 1.2, 1.9, 2.0, None])], "g int, i int, t double")
    right = spark.createDataFrame([(1, 1.0, 0), (1, 2.0, 1), (1, 4.0, 2)], "g int, k double, o int")
    got = {r.i: r.o for r in joins.asof_nearest(left, right, "t", "k", ["g"], "o", ["o"]).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 0, 4: 1, 5: 1, 6: None}
    twice = spark.createDataFrame([(1, 1.0, 0), (1, 1.0, 1), (1, 2.0, 2), (1, 2.0, 3)], "g int, k double, o int")
    got = {r.i: r.o for r in joins.asof_nearest(left, twice, "t", "k", ["g"], "o", ["o"]).collect()}
    assert (got[3], got[4], got[5]) == (1, 2, 3)


def test_asof_against_brute_force(spark):
    rng = random.Random(3)
    left = [(rng.randrange(4), i, float(rng.randrange(50))) for i in range(120)]
    right = [(rng.randrange(5), float(rng.randrange(50)), i) for i in range(60)]
    out = joins.asof_nearest(spark.createDataFrame(left, "g int, i int, t double"), spark.createDataFrame(right, "g int, k double, o int"), "t", "k", ["g"], "o", ["k"], tolerance=6)
    for r in out.collect():
        near = [k for g, k, _ in right if g == r.g and abs(k - r.t) <= 6]
        best = min(near, key=lambda k: (abs(k - r.t), k), default=None)
        assert r.k == best


def test_band_join_against_brute_force(spark):
    rng = random.Random(4)
    points = [(i, rng.uniform(-20, 20)) for i in range(200)] + [(999, None)]
    ranges = [(i, a, a + rng.uniform(0, 9)) for i in range(60) for a in [rng.uniform(-20, 20)]] + [(998, 1.0, None), (997, 5.0, 1.0)]
    out = joins.band_join(spark.createDataFrame(points, "p int, t double"), spark.createDataFrame(ranges, "r int, lo double, hi double"), "t", "lo", "hi", 4.0)
    want = sorted((p, r) for p, t in points for r, lo, hi in ranges if t is not None and hi is not None and lo <= t <= hi)
    assert sorted((r.p, r.r) for r in out.collect()) == want


def test_band_join_plan_has_no_nested_loop(spark):
    a, b = spark.range(1000).selectExpr("double(id) t"), spark.range(1000).selectExpr("id r", "double(id) lo", "id + 2D hi")
    plan = joins.band_join(a, b, "t", "lo", "hi", 4.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlap_labels(spark):
    df = spark.createDataFrame([(0.0, 10.0, 2.0, 3.0), (0.0, 1.0, 2.0, 3.0), (0.0, 2.5, 2.0, 3.0), (None, None, 2.0, 3.0)], "a double, b double, c double, d double")
    kept = [r[0] for r in df.select(joins.overlap_label("a", "b", "c", "d")).collect()]
    assert kept == ["full_overlap", "partial_overlap", "no_overlap", "no_overlap"]
    right = [r[0] for r in df.select(joins.overlap_label("a", "b", "c", "d", "corrected")).collect()]
    assert right == ["full_overlap", "no_overlap", "partial_overlap", "no_overlap"]


def test_windows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert rows(windows.keep_unique(df, ["k"])) == [("b", 3)]
    series = spark.createDataFrame([(0.0, 2.0), (1.0, 4.0), (3.0, 0.0)], "t double, v double")
    assert [r[2] for r in rows(windows.half_gaps(series, "t", "w"), "t")] == [0.5, 1.5, 1.0]
    big = spark.range(500).selectExpr("id % 37 as x", "1 as one", "id")
    total = windows.running_sum(big, "one", "s", F.col("x"), F.col("id"))
    assert sorted(r.s for r in total.collect()) == list(range(1, 501))


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],), ([],)], "a array<double>")
    assert [r[0] for r in df.select(reshape.pad_both(F.col("a"), 6)).collect()] == [[-1, 1, 2, 3, -1, -1], [1, 2, 3, 4, 5, 6], [-1] * 6]
    assert df.select(reshape.pad_both(F.col("a"), 3)).collect()[1][0] == [2, 3, 4]
    z = spark.createDataFrame([([0.0, 0.0, 3.0],), ([2.0, 2.0],)], "a array<double>").select(reshape.z_score(F.col("a"))).collect()
    assert z[0][0] == pytest.approx([-(0.5**0.5), -(0.5**0.5), 2**0.5]) and z[1][0] == [0, 0]
    assert df.select(reshape.clip_range(F.col("a"), F.lit(-2), F.lit(1))).collect()[1][0] == [1, 2]


def test_scalars(spark):
    df = spark.createDataFrame([("_AM(ox)C(ac)K_", 0.5), ("_CC_", 1.5), ("_K_", 2.5)], "s string, x double")
    got = df.select(*scalar.marker_counts(F.col("s")), scalar.round_even(F.col("x")).alias("r"), scalar.bare_sequence(F.col("s")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 0.0, "AMCK"), (0, 0, 2, 2.0, "CC"), (0, 0, 0, 2.0, "K")]
    assert df.select(scalar.decoy_sequence(F.lit("ABCDK"))).first()[0] == "DCBAK"


def test_dictionary_columns_sum_to_one_and_containment(spark):
    peaks = spark.createDataFrame([(0, 0, 10.0, 9.0, 12.0, 4.0), (0, 1, 12.5, 12.4, 12.6, 6.0)], "scan_idx long, apex_mzidx long, apex_mz double, start_mz double, end_mz double, peak_intensity_sum double")
    ref = spark.createDataFrame([(0, 7, [10.0, 11.5], [0.7, 0.2]), (0, 8, [50.0], [1.0]), (0, 9, [10.1, 12.5], [0.5, 0.4])], "scan_idx long, id long, IsoMZ array<double>, IsoAbundance array<double>")
    matches = dictionary.match_isotopes(ref, peaks)
    assert [r.matched for r in matches.where("id = 7").orderBy("pos").collect()] == [True, False]
    d = dictionary.build_dictionary(matches, 0.4)
    assert {r.id: round(r.s, 9) for r in d.groupBy("id").agg(F.sum("abundance").alias("s")).collect()} == {7: 1.0, 9: 1.0}
    act = {r.id: r.activation for r in solve.threshold_activation(d, dictionary.observations(peaks)).collect()}
    assert act == {7: pytest.approx(2.8), 9: pytest.approx(0.5 * 4 + 0.4 * 6)}


def test_lasso_and_threshold_agree_on_orthogonal_columns(spark):
    d = spark.createDataFrame([(0, 1.0, 1, 1.0), (0, 2.0, 2, 1.0)], "scan_idx long, apex_mz double, id long, abundance double")
    y = spark.createDataFrame([(0, 1.0, 3.0), (0, 2.0, 5.0), (0, 3.0, 1.0)], "scan_idx long, apex_mz double, intensity double")
    assert {r.id: round(r.activation, 6) for r in solve.lasso_activation(d, y).collect()} == {1: 3.0, 2: 5.0}
    assert {r.id: round(r.activation, 6) for r in solve.lasso_activation(d, y, preprocessing="sqrt").collect()} == {1: 3.0, 2: 5.0}


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(0, i, i + 1) for i in range(20)] + [(1, 5, 9)], "scan_idx long, a long, b long")
    got = dictionary.components(pairs).collect()
    assert {r.component for r in got if r.scan_idx == 0} == {0} and {r.component for r in got if r.scan_idx == 1} == {5}


def test_grouped_split_is_disjoint_and_exact(spark):
    df = spark.range(200).selectExpr("id % 50 as k", "id")
    got = features.grouped_split(df, "k").collect()
    by = {}
    for r in got:
        by.setdefault(r.k, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values()) and len(got) == 200
    n = [next(iter(s)) for s in by.values()]
    assert (n.count("train"), n.count("val"), n.count("test")) == (30, 10, 10)


def test_gaussian_smoothing_of_short_series_is_identity(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 1.0, 7.0), (2, 0, 0.0, 100.0), (2, 1, 1.0, 100.0), (2, 2, 2.0, 100.0)], "id long, scan_idx long, starttime double, activation double")
    got = {(r.id, r.scan_idx): r.activation for r in smooth.gaussian_smooth(df, 1000.0).collect()}
    assert got[1, 0] == 5 and got[1, 1] == 7 and got[2, 0] == 99


def test_sets_and_aggregates(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "k string") for s in ("xyz", "yzw"))
    assert rows(sets.venn({"a": a, "b": b}, "k")) == [(0, 1, 1), (1, 0, 1), (1, 1, 2)]
    e = spark.createDataFrame([], "k string")
    assert rows(sets.venn({"a": e, "b": e}, "k")) == []
    labels = spark.createDataFrame([(1,), (0,), (0,), (0,), (None,)], "q int")
    w = aggregates.class_weights(labels, "q").first()
    assert (w.pos, w.neg, w.weight_1) == (1, 3, 2.0)


def test_nearest_scan_against_brute_force(spark):
    rng = random.Random(5)
    scans = sorted(rng.choice([rng.uniform(0, 5), rng.uniform(40, 42), float(rng.randrange(9))]) for _ in range(60))
    scans = [(i, x) for i, x in enumerate(dict.fromkeys(scans))]
    times = [rng.uniform(-3, 50) for _ in range(150)] + [x for _, x in scans] + [(a + b) / 2 for (_, a), (_, b) in zip(scans, scans[1:], strict=False)]
    df = spark.createDataFrame([(i, x, None if i % 9 == 0 else x + 1) for i, x in enumerate(times)], "i int, a double, b double")
    header = spark.createDataFrame(scans, "scan_idx long, starttime double")
    near = lambda x: None if x is None else min(scans, key=lambda s: (abs(s[1] - x), s[1]))[0]
    got = joins.nearest_scan(df, header, ["a", "b"]).collect()
    assert len(got) == len(times)
    for r in got:
        for x, s in ((r.a, r.a_scan), (r.b, r.b_scan)):
            assert s == near(x) or abs(abs(dict(scans)[s] - x) - abs(dict(scans)[near(x)] - x)) < 1e-12


def test_gaussian_pieces_equal_the_whole(spark):
    rng = np.random.default_rng(2)
    t = np.sort(rng.uniform(0, 400, 300))
    v = rng.uniform(0, 1e5, 300)
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, v, strict=True))], "id long, scan_idx long, starttime double, activation double")
    w = np.exp(-((t[None, :] - t[:, None]) ** 2) / 2)
    want = np.rint(v[None, :] * w / w.sum(axis=1, keepdims=True)).sum(axis=1)
    got = {r.scan_idx: r.activation for r in smooth.gaussian_smooth(df, 1.0, piece=50.0).collect()}
    assert [got[i] for i in range(300)] == pytest.approx(want.tolist(), abs=2)


def test_correlation_with_a_shared_row_at_zero(spark):
    rng = np.random.default_rng(4)
    n, ids = 12, range(9)
    m = np.where(rng.random((9, n)) < 0.3, rng.random((9, n)), 0.0)
    m[:, 0] = rng.random(9) * np.where(np.arange(9) < 4, 8, 1)
    rows_ = [(0, float(k), i, float(m[i, k])) for i in ids for k in range(n) if m[i, k] > 0]
    d = spark.createDataFrame(rows_, "scan_idx long, apex_mz double, id long, abundance double")
    sizes = spark.createDataFrame([(0, n)], "scan_idx long, n long")
    for threshold in (0.2, 0.9):
        got = {(r.a, r.b): r for r in dictionary.feature_correlation(d, sizes, threshold).collect()}
        r = np.corrcoef(m)
        assert got.keys() == {(a, b) for a in ids for b in ids if a < b and r[a, b] >= threshold}
        for (a, b), row in got.items():
            assert row.r == pytest.approx(r[a, b]) and row.jaccard == pytest.approx(((m[a] > 0) & (m[b] > 0)).sum() / ((m[a] > 0) | (m[b] > 0)).sum())


def test_balanced_sample_and_held_out_alpha(spark):
    df = spark.range(4000).selectExpr("id", "if(id % 10 = 0, 1, 0) as y")
    n = {r.y: r["count"] for r in features.balanced_sample(df, "y", 3).groupBy("y").count().collect()}
    assert n[1] == 400 and 300 < n[0] < 500
    rng = np.random.default_rng(0)
    m = rng.random((40, 2))
    y = m @ np.array([2.0, 1.0])
    d = spark.createDataFrame([(7, float(k), i, float(m[k, i])) for k in range(40) for i in range(2)], "scan_idx long, apex_mz double, id long, abundance double")
    o = spark.createDataFrame([(7, float(k), float(y[k])) for k in range(40)], "scan_idx long, apex_mz double, intensity double")
    got = solve.cross_validated_alpha(d, o, [0.0, 50.0], 5).orderBy("alpha").collect()
    assert [r.best for r in got] == [True, False] and got[0].error < 1e-6 < got[1].error


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from scanforge import session

    nothing = SimpleNamespace(get=lambda *a: None)
    far = SimpleNamespace(master="spark://host:7077", getConf=lambda: nothing, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        session.shared_folder(SimpleNamespace(sparkContext=far, conf=nothing))
    assert session.shared_folder(spark).startswith("file:")
