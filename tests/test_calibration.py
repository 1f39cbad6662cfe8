import numpy as np
import pytest
from pyspark.sql import functions as F

from scanforge.operators import calibration as C


def bspline(x, low, width, cells):
    """Design matrix of uniform cubic B-splines by the recursion."""
    knots = low + width * np.arange(-3, cells + 4)
    b = ((x[:, None] >= knots[:-1]) & (x[:, None] < knots[1:])).astype(float)
    for d in range(1, 4):
        left = (x[:, None] - knots[: -d - 1]) / (d * width) * b[:, :-1]
        right = (knots[d + 1 :] - x[:, None]) / (d * width) * b[:, 1:]
        b = left + right
    return b


def shifted(n=1500, seed=0):
    """Two runs with shifts that are not straight, noise, and gaps in the predictions."""
    rng, rows = np.random.default_rng(seed), []
    for run, law in (("a", lambda x: x + 4 * np.sin(x / 15) + 2), ("b", lambda x: 100 * (x / 100) ** 1.5)):
        x = np.concatenate([rng.uniform(0, 60, n // 2), rng.uniform(80, 100, n // 2)])
        rows += [(run, float(p), float(m), float(law(p))) for p, m in zip(x, law(x) + rng.normal(0, 0.4, len(x)), strict=True)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "run string, p double, m double, law double").repartition(5)


def mae(df, col, truth="law"):
    return df.select(F.avg(F.abs(F.col(col) - F.col(truth)))).first()[0]


def test_spline_equals_a_dense_fit_and_removes_the_shift(spark):
    rows = shifted()
    df = frame(spark, rows)
    curves = C.fit_calibration(df, "p", "m", ["run"], smooth=0.5, increasing=False, cells=20)
    got = {(r.run, r.p): r.c for r in C.apply_calibration(df, curves, "p", ["run"], "c").collect()}
    for run in "ab":
        own = np.array([r[1:] for r in rows if r[0] == run])
        x, y = own[:, 0], own[:, 1]
        low, width = x.min(), (x.max() - x.min()) / 20
        b = bspline(np.minimum(x, x.max() - 1e-9 * width), low, width, 20)
        d = np.diff(np.eye(23), 2, axis=0)
        want = b @ np.linalg.solve(b.T @ b + 0.5 * d.T @ d, b.T @ y)
        assert np.allclose([got[run, v] for v in x], want, atol=1e-4)
        ours, plain = np.abs([got[run, v] - t for v, t in zip(x, own[:, 2], strict=True)]).mean(), np.abs(want - own[:, 2]).mean()
        assert ours == pytest.approx(plain, abs=1e-5) and ours < 0.15


@pytest.mark.parametrize("method", ["spline", "monotone"])
def test_held_out_error_falls_and_curves_never_fall(spark, method):
    df, test = frame(spark, shifted()), frame(spark, shifted(600, 9))
    curves = C.fit_calibration(df, "p", "m", ["run"], method)
    out = C.apply_calibration(test, curves, "p", ["run"], "c")
    assert mae(out, "c") < 0.3 < 1.5 < mae(out, "p")
    grid = spark.range(-40, 281).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("run"), (F.col("id") / 2).alias("p"))
    at = C.apply_calibration(grid, curves, "p", ["run"], "c").orderBy("run", "p").collect()
    for run in "ab":
        values = [r.c for r in at if r.run == run]
        assert all(b >= a - 1e-9 for a, b in zip(values, values[1:], strict=False))


def test_monotone_knots_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x, cells = np.sort(rng.uniform(0, 10, 300)), 12
    y = np.sin(x) * 3 + x / 2
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "p double, m double")
    curves = C.fit_calibration(df, "p", "m", method="monotone", cells=cells)
    width = (x.max() - x.min()) / cells
    cell = np.minimum(np.floor((x - x.min()) / width), cells - 1)
    kx, ky, n = (np.array([f(cell == c) for c in np.unique(cell)]) for f in (lambda s: x[s].mean(), lambda s: y[s].mean(), lambda s: s.sum()))
    iso = [max(min((ky[a : b + 1] * n[a : b + 1]).sum() / n[a : b + 1].sum() for b in range(i, len(ky))) for a in range(i + 1)) for i in range(len(ky))]
    inner = x[(x >= kx[0]) & (x <= kx[-1])]
    got = {r.p: r.c for r in C.apply_calibration(df, curves, "p", out="c").collect()}
    assert np.allclose([got[v] for v in inner], np.interp(inner, kx, iso), atol=1e-9)


def test_odd_runs(spark):
    rows = [("one", 5.0, 7.0, 0.0), ("same", 3.0, 4.0, 0.0), ("same", 3.0, 6.0, 0.0), (None, 1.0, 1.0, 0.0), (None, 2.0, 3.0, 0.0), ("a", None, 1.0, 0.0), ("a", float("nan"), 1.0, 0.0), ("two", 1.0, 3.0, 0.0), ("two", 5.0, 7.0, 0.0)]
    df = frame(spark, rows)
    for method in ("spline", "monotone"):
        curves = C.fit_calibration(df, "p", "m", ["run"], method)
        got = {(r.run, r.p): r.c for r in C.apply_calibration(df.where("p is null or not isnan(p)"), curves, "p", ["run"], "c").collect()}
        assert got["one", 5.0] == pytest.approx(7) and got["same", 3.0] == pytest.approx(5) and got["a", None] is None
        assert got[None, 1.0] == pytest.approx(1, abs=1e-3) and got["two", 5.0] == pytest.approx(7, abs=1e-3)
        far = C.apply_calibration(spark.createDataFrame([("one", 9.0), ("none", 1.0)], "run string, p double"), curves, "p", ["run"], "c").collect()
        assert {r.run: r.c for r in far} == {"one": pytest.approx(11), "none": None}
    assert C.fit_calibration(df.limit(0), "p", "m", ["run"]).count() == 0
    with pytest.raises(ValueError):
        C.fit_calibration(df, "p", "m", method="cubic")
