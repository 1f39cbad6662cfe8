import numpy as np
import pytest
from pyspark.sql import functions as F

from scanforge.functions import network as N
from scanforge.operators import features
from scanforge.operators.network import Network, Plateau, _rows, fit_network, gradient_sums, mean_loss, score_network

SHAPES = [
    N.Shape(7, 2, ((3, 3), (4, 2)), 2, (5, 3), "logistic", 0.1),
    N.Shape(6, 1, ((3, 4),), 0, (), "squared"),
    N.Shape(1, 1, (), 3, (4,), "logistic"),
    N.Shape(5, 1, ((2, 3), (2, 3), (2, 1)), 1, (3,), "squared", 0.2, 0.4),
]


@pytest.mark.parametrize("shape", SHAPES)
def test_gradients_match_finite_differences(shape):
    rng = np.random.default_rng(1)
    raw = rng.normal(size=(9, shape.channels * shape.length))
    raw[:, shape.length - 2 :][:, :2] = shape.fill if shape.length > 2 else raw[:, shape.length - 2 :][:, :2]
    raw[3] = shape.fill
    x, mask = N.encode_arrays(shape, raw)
    extra, y, w = rng.normal(size=(9, shape.extra)), (rng.random(9) > 0.5).astype(float), rng.random(9) + 0.5
    flat = shape.start(3, 0.2) + rng.normal(0, 0.1, shape.size())

    def total(p):
        drop = np.random.default_rng(5)
        return N.loss_and_gradient(shape, p, x, mask, extra, y, w, drop)[0] + shape.penalty(p)[0]

    slope = N.loss_and_gradient(shape, flat, x, mask, extra, y, w, np.random.default_rng(5))[1] + shape.penalty(flat)[1]
    for i in range(shape.size()):
        step = np.zeros(shape.size())
        step[i] = 1e-6
        assert slope[i] == pytest.approx((total(flat + step) - total(flat - step)) / 2e-6, abs=2e-4)


def test_masked_places_do_not_matter():
    shape = N.Shape(8, 1, ((3, 3), (3, 3)), 0, (4,))
    flat = shape.start(1)
    short, long = N.Shape(5, 1, shape.convs, 0, shape.dense), np.array([[1.0, 2, 3, 4, 5, -1, -1, np.nan]])
    a = N.predict(shape, flat, *N.encode_arrays(shape, long), np.zeros((1, 0)))
    b = N.predict(short, flat, *N.encode_arrays(short, long[:, :5]), np.zeros((1, 0)))
    assert a == pytest.approx(b)
    x, mask = N.encode_residues(N.Shape(4, len(N.RESIDUE_CODES)), ["_(ac)AM(ox)K_", ""])
    assert mask.sum(axis=1).tolist() == [3, 0] and x[0].sum() == 5 and x[0, 0, N.RESIDUE_CODES.index("a")] == 1 and x[0, 1, N.RESIDUE_CODES.index("o")] == 1
    with pytest.raises(ValueError):
        N.encode_residues(N.Shape(2, len(N.RESIDUE_CODES)), ["AAA"])


def test_plateau_lowers_the_rate_and_stops():
    p, seen = Plateau(0.1, 2, 5, 0.1, 0.001), []
    for loss in [1.0, 0.5, 0.6, 0.6, 0.6, 0.6, 0.6]:
        seen.append((*p.see(loss), round(p.rate, 6)))
    assert seen == [(True, False, 0.1), (True, False, 0.1), (False, False, 0.1), (False, False, 0.01), (False, False, 0.01), (False, False, 0.001), (False, True, 0.001)]


def test_sums_over_partitions_equal_one_batch(spark, monkeypatch):
    from scanforge.operators import network

    rng = np.random.default_rng(2)
    shape = N.Shape(5, 1, ((3, 3),), 1, (4,))
    raw, extra, y = rng.normal(size=(60, 5)), rng.normal(size=(60, 1)), rng.integers(0, 2, 60).astype(float)
    df = spark.createDataFrame([(a.tolist(), b.tolist(), float(c)) for a, b, c in zip(raw, extra, y, strict=True)], "s array<double>, m array<double>, y double").repartition(9)
    net = Network(shape, shape.start(4))
    want = N.loss_and_gradient(shape, net.weights, *N.encode_arrays(shape, raw), extra, y, np.ones(60))
    for fan in (32, 2):
        monkeypatch.setattr(network, "FAN_IN", fan)
        rows = _rows(df, "array", "s", "m", "y", None)
        n, loss, g = gradient_sums(rows, net, block=7)
        assert n == 60 and loss == pytest.approx(want[0]) and np.allclose(g, want[1])
    assert mean_loss(rows, net) == pytest.approx(want[0] / 60)


def peaks_of_ids(spark, n_ids=120, length=24, seed=0):
    """For each candidate one smooth peak and three jagged ones of equal sum, anywhere in the series."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n_ids):
        for k in range(4):
            v = np.full(length, -1.0)
            v[: length - 4] = rng.random(length - 4) * 0.2
            at = rng.integers(2, length - 10)
            bump = np.array([1.0, 2, 4, 2, 1]) if k == 0 else rng.permutation([4.0, 1, 1, 2, 2])
            if k and list(bump) == [1, 2, 4, 2, 1]:
                bump = bump[[2, 0, 1, 3, 4]]
            v[at : at + 5] += bump
            rows.append((i, k, v.tolist(), k == 0))
    return spark.createDataFrame(rows, "id long, apex_scan long, sequence array<double>, matched boolean").repartition(4)


def test_convolutions_beat_the_logistic_model_on_planted_peaks(spark, tmp_path):
    df = peaks_of_ids(spark)
    train, val, test = (df.where(c) for c in ("id % 4 < 2", "id % 4 = 2", "id % 4 = 3"))
    shape = N.Shape(24, 1, ((8, 5), (8, 3)), 0, (8,))
    net = fit_network(train, val, Network(shape, shape.start(1, -1.0)), epochs=18, batches=2, rate=0.02)
    assert min(h["val_loss"] for h in net.history) < 0.6 * net.history[0]["val_loss"]
    top = lambda scored: features.id_accuracy(scored.withColumn("y_true", F.col("matched").cast("int")), 1, score="pred_score").first().accuracy
    ours = top(score_network(net, test))
    plain = top(features.score_peaks(features.fit_scorer(train.union(val), folds=2, grid=[0.01]), test))
    assert ours > 0.8 and ours > plain + 0.2
    net.save(spark, str(tmp_path / "net"))
    again = score_network(Network.load(spark, str(tmp_path / "net")), test.union(spark.createDataFrame([(9, 9, None, None)], test.schema)))
    assert {(r.id, r.apex_scan, r.pred_score) for r in again.where("sequence is not null").collect()} == {(r.id, r.apex_scan, r.pred_score) for r in score_network(net, test).collect()}
    assert again.where("sequence is null").first().pred_score is None


def test_two_inputs_beat_each_alone(spark):
    """The label is whether the peak's shape and the further value agree."""
    rng, rows = np.random.default_rng(3), []
    for i in range(600):
        smooth, near = rng.random() < 0.5, rng.random() < 0.5
        v = rng.random(12) * 0.2
        at = rng.integers(0, 7)
        v[at : at + 5] += [1.0, 2, 3, 2, 1] if smooth else [3.0, 0, 3, 0, 3]
        rows.append((i, v.tolist(), [1.0 if near else -1.0, float(rng.normal())], float(smooth == near)))
    df = spark.createDataFrame(rows, "i long, sequence array<double>, meta array<double>, matched double").repartition(4)
    train, val, test = (df.where(c) for c in ("i % 3 = 0", "i % 3 = 1", "i % 3 = 2"))

    def accuracy(shape, extra):
        net = fit_network(train, val, Network(shape, shape.start(2)), extra=extra, epochs=16, batches=2, rate=0.03)
        return score_network(net, test, extra=extra).select(F.avg(((F.col("pred_score") > 0.5) == (F.col("matched") > 0.5)).cast("int"))).first()[0]

    both = accuracy(N.Shape(12, 1, ((8, 5),), 2, (16, 8)), "meta")
    assert both > 0.9
    assert both > accuracy(N.Shape(12, 1, ((8, 5),), 0, (16, 8)), None) + 0.2
    assert both > accuracy(N.Shape(12, 1, (), 2, (16, 8)), "meta") + 0.2


def test_halving_chooses_what_a_full_search_does_with_fewer_epochs(spark):
    from scanforge.operators.search import SPACE, draw_trials, successive_halving

    df = peaks_of_ids(spark, 150, seed=2)
    train, val = df.where("id % 3 < 2"), df.where("id % 3 = 2")
    space = {"conv1_filters": [8], "conv1_kernel": [1, 5], "dense1": [8], "rate": [1e-6, 1e-5, 3e-5, 1e-4, 3e-4, 0.02]}
    base = N.Shape(24, 1, ((4, 3),), 0, (8,))
    args = {"space": space, "trials": 12, "batch": 32, "bias": -1.0, "most_rows": 5000}
    best, net, log = successive_halving(train, val, base, epochs=4, eta=3, rungs=3, **args)
    full, _, every = successive_halving(train, val, base, epochs=52, rungs=1, **args)
    assert best == full and best["conv1_kernel"] == 5 and best["rate"] == 0.02
    assert log.epochs.sum() < 0.5 * every.epochs.sum() and log.groupby("rung").size().tolist() == [12, 4, 1]
    assert net.shape.convs == ((best["conv1_filters"], 5),)
    tuned = fit_network(train, val, net, epochs=2, batches=2, rate=0.01)
    assert mean_loss(_rows(val, "array", "sequence", None, "matched", None), tuned) <= log[log.rung == 2].val_loss.min() + 0.02
    many = draw_trials(SPACE, 40, 1)
    assert len({str(m) for m in many}) == 40 and many == draw_trials(SPACE, 40, 1) and all(m[k] in v for m in many for k, v in SPACE.items())
    assert len(draw_trials(space, 99)) == 12


def peptides(spark, n, law, seed):
    rng, weight = np.random.default_rng(seed), dict(zip("ACDEFGHIKLMNPQRSTVWY", np.random.default_rng(0).normal(0, 2, 20), strict=True))
    rows = []
    for _ in range(n):
        s = "".join(rng.choice(list(weight), rng.integers(6, 16)))
        rows.append((f"_{s}_", float(law(np.mean([weight[c] for c in s])))))
    return spark.createDataFrame(rows, "s string, t double").repartition(3)


def test_transfer_keeps_frozen_layers_and_lowers_the_error(spark):
    from scanforge.plans import prediction as P

    first, second = (lambda x: 40 + 20 * x), (lambda x: 55 + 45 * np.tanh(1.2 * x))
    model = P.fit_time_network(peptides(spark, 900, first, 1), peptides(spark, 200, first, 2), "s", "t", length=16, convs=((12, 3),), dense=(12,), epochs=14, batches=3, rate=0.02)
    mae = lambda m, df: m.predict(df, "s").select(F.avg(F.abs(F.col("predicted_RT") - F.col("t")))).first()[0]
    test = peptides(spark, 200, second, 5)
    train, val = peptides(spark, 150, second, 3), peptides(spark, 60, second, 4)
    assert mae(model, peptides(spark, 200, first, 6)) < 4
    moved = P.transfer_times(model, train, val, "s", "t", epochs=10, batches=2, rate=0.01)
    for (name, _), a, b in zip(model.network.shape.layers(), model.network.shape.unpack(model.network.weights), moved.network.shape.unpack(moved.network.weights), strict=True):
        assert np.array_equal(a, b) == name.startswith("conv")
    before = mae(model, test)
    assert mae(moved, test) < 0.7 * before
    curve = P.update_times(model, train, val, "s", "t")
    assert np.array_equal(curve.network.weights, model.network.weights) and mae(curve, test) < 0.5 * before
    both = P.update_times(model, train, val, "s", "t", "transfer", epochs=4, batches=2)
    assert mae(both, test) < 0.6 * before
    with pytest.raises(ValueError):
        P.update_times(model, train, val, "s", "t", "guess")
    with pytest.raises(ValueError):
        P.transfer_times(model, train, val, "s", "t", frozen=("lstm",))


@pytest.mark.parametrize("balance", ["none", "weight", "resample"])
def test_peak_classifier_from_table_to_scores(spark, balance):
    from scanforge.operators.classify import fit_peak_network, output_bias

    df = peaks_of_ids(spark, 60, 16, seed=4).withColumn("meta", F.array(F.col("apex_scan").cast("double") * 0))
    df = df.unionByName(df.limit(1).withColumn("matched", F.lit(None).cast("boolean"))).withColumn("sequence", F.array("sequence", "sequence"))
    net, split = fit_peak_network(df, extra="meta", convs=((4, 5),), dense=(4,), balance=balance, epochs=2, batches=1)
    assert net.shape.channels == 2 and net.shape.extra == 1 and len(net.history) == 2
    parts = {r.id: r.parts for r in split.groupBy("id").agg(F.collect_set("split").alias("parts")).collect()}
    assert all(len(p) == 1 for p in parts.values()) and {p[0] for p in parts.values()} == {"train", "val", "test"}
    scored = score_network(net, split.where("split = 'test'"), extra="meta")
    assert scored.where("pred_score > 0 and pred_score < 1").count() == scored.count() > 0
    assert output_bias(df) == pytest.approx(np.log(1 / 3), abs=0.02)
    with pytest.raises(ValueError):
        fit_peak_network(df, balance="guess")
