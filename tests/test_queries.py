import math

import duckdb
import numpy as np
import pytest

from scanforge.plans import more_queries as queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(rows):
    def one(x):
        return "NaN" if isinstance(x, float) and math.isnan(x) else round(x, 5) if isinstance(x, float) else x

    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(columns).collect()]
    if name not in queries.SQL:
        assert got
        return
    want = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({queries.SQL[name]})").fetchall()
    assert plain(got) == plain(want)


# --- queries without SQL, against plain Python ----------------------------------------------------


def hourly():
    c = duckdb.connect()
    rows = c.sql(f"SELECT user_id, floor(epoch_us(ts) / 36e8)::BIGINT, sum(value) FROM '{DIR}/events.parquet' GROUP BY ALL").fetchall()
    grid = sorted({h for _, h, _ in rows})
    series = {}
    for u, h, v in rows:
        series.setdefault(u, dict.fromkeys(grid, 0.0))[h] = v
    centre = dict(c.sql(f"SELECT user_id, avg(epoch_us(ts) / 6e7) FROM '{DIR}/events.parquet' GROUP BY 1").fetchall())
    return grid, {u: np.array([s[h] for h in grid]) for u, s in series.items()}, centre


def plain_peaks(y):
    """Maxima, plateaus by their middle, with prominence and the interpolated places where they fall to their higher base."""
    out, i = [], 1
    while i < len(y) - 1:
        j = i
        while j < len(y) - 1 and y[j + 1] == y[i]:
            j += 1
        if y[i - 1] < y[i] and j < len(y) - 1 and y[j + 1] < y[i]:
            p, bases = (i + j) // 2, []
            for step in (-1, 1):
                k, least = p, p
                while 0 <= k + step < len(y) and y[k + step] <= y[p]:
                    k += step
                    least = k if y[k] < y[least] else least
                bases.append(least)
            level, ends = max(y[bases[0]], y[bases[1]]), []
            for step, base in zip((-1, 1), bases, strict=True):
                k = p
                while k != base and y[k] > level:
                    k += step
                ends.append(k - step * (level - y[k]) / (y[k - step] - y[k]) if y[k] < level else float(k))
            out.append((p, y[p] - level, *ends))
        i = j + 1
    return out


def test_elution_peaks_against_plain_python(spark):
    grid, series, centre = hourly()
    want = {}
    for u, y in series.items():
        found = [(p, a, z) for p, _, a, z in plain_peaks(y) if z - a >= 2]
        gaps = [abs(grid[p] * 60.0 - centre[u]) for p, *_ in found]
        for (p, a, z), gap in zip(found, gaps, strict=True):
            s, e = round(a), round(z)
            k = range(max(s - 1, 0), e)
            area = sum((grid[i + 1] - grid[i]) * 60.0 * (y[i] + y[i + 1]) / 2 for i in k)
            want[u, grid[p]] = (grid[s], grid[e], area, gap == min(gaps))
    got = queries.QUERIES["elution_peaks"](spark, DIR).collect()
    assert {(r.id, r.apex_scan) for r in got} == set(want) and want
    for r in got:
        s, e, area, closest = want[r.id, r.apex_scan]
        assert (r.start_scan, r.end_scan, r.closest_to_search_center) == (s, e, closest) and r.peak_intensity_auc == pytest.approx(area)


def test_repaired_minima_against_plain_python(spark):
    grid, series, _ = hourly()
    want = {}
    for u, y in series.items():
        out = y.copy()
        if (y != 0).sum() > 2 and y.sum() > 0:
            for p, prominence, a, z in plain_peaks(-y):
                if prominence >= 20 and z - a <= 3:
                    a, z = math.floor(a), math.ceil(z)
                    wa, wz = 1 / max(p - a, 1), 1 / max(z - p, 1)
                    out[p] = (out[a] * wa + out[z] * wz) / (wa + wz)
        want |= {(u, h): v for h, v in zip(grid, out, strict=True) if v != 0}
    got = {(r.id, r.scan_idx): r.activation for r in queries.QUERIES["local_minima_repair"](spark, DIR).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_lasso_activations_meet_their_conditions(spark):
    """Non-negative, and no small change of one activation lowers the objective."""
    c = duckdb.connect()
    spectra = {i: np.abs(np.array(e, float)) for i, e in c.sql(f"SELECT vec_id, embedding FROM '{DIR}/embeddings.parquet' WHERE embedding IS NOT NULL").fetchall()}
    label = dict(c.sql(f"SELECT vec_id, label FROM '{DIR}/embeddings.parquet' WHERE embedding IS NOT NULL").fetchall())
    names = sorted({x for x in label.values() if x is not None})
    d = np.array([np.mean([spectra[i] for i in spectra if label[i] == x], axis=0) for x in names]).T
    got = {}
    for r in queries.QUERIES["nnlasso_cd"](spark, DIR).collect():
        got.setdefault(r.scan_idx, {})[r.id] = (r.activation, r.alpha)
    assert got.keys() == spectra.keys()
    for i, own in got.items():
        a = np.array([own[x][0] for x in names])
        slope = d.T @ (d @ a - spectra[i]) + own[names[0]][1]
        assert (a >= 0).all() and (slope > -0.02).all() and np.abs(slope[a > 1e-4]).max(initial=0) < 0.02
