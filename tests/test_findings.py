"""Queries and operators on inputs that once gave wrong results or did not spread."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from scanforge.functions import kernels
from scanforge.operators import aggregates, joins, metrics, solve
from scanforge.plans import model_queries, more_queries
from scanforge.sources import files

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = more_queries.QUERIES | model_queries.QUERIES, more_queries.SQL | model_queries.SQL


def tables(spark, tmp_path, **made):
    """A folder with the given DataFrames as tables."""
    for name, df in made.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def both(spark, name, path, names):
    """Rows of a query and of its SQL, in one order."""
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in names:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, path)
    columns = sorted(df.columns)
    want = c.sql("SELECT " + ", ".join(f'"{x}"' for x in columns) + f" FROM ({SQL[name]})").fetchall()
    return sorted((tuple(r) for r in df.select(columns).collect()), key=str), sorted(want, key=str)


def test_line_items_that_share_all_keys_are_all_counted(spark, tmp_path):
    items = spark.read.parquet(f"{DIR}/lineitem.parquet")
    again = items.where("l_linenumber <= 2")
    path = tables(spark, tmp_path, lineitem=items.unionByName(again).unionByName(again.withColumn("l_extendedprice", F.lit(None).cast("double"))), part=spark.read.parquet(f"{DIR}/part.parquet"))
    got, want = both(spark, "predictions_within_tolerance", path, ["lineitem", "part"])
    assert got == want and got


def test_lasso_of_columns_nearly_alike_ends_at_its_minimum():
    rng = np.random.default_rng(0)
    for _ in range(50):
        d = 1 + 0.01 * rng.random((64, 10))
        y = np.abs(rng.normal(size=64))
        a = kernels.nonnegative_lasso(d.T @ d, d.T @ y, 0.01)
        slope = d.T @ (d @ a - y) + 0.01
        assert (a >= 0).all() and slope.min() > -1e-5 and np.abs(slope[a > 0]).max() < 1e-5


def test_systems_of_scans_take_one_shuffle(spark):
    d = spark.createDataFrame([(0, 1.0, 5, 1.0), (0, 2.0, 5, 0.5), (0, 2.0, 6, 1.0), (1, 9.0, 7, 1.0)], "scan_idx long, apex_mz double, id long, abundance double")
    y = spark.createDataFrame([(0, 1.0, 2.0), (0, 3.0, 1.0), (1, 9.0, None)], "scan_idx long, apex_mz double, intensity double")
    out = solve.lasso_activation(d, y)
    assert {(r.scan_idx, r.id): round(r.activation, 6) for r in out.collect()} == {(0, 5): 1.6, (0, 6): 0.0, (1, 7): 0.0}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_quantiles_of_a_table_are_ranked_over_ranges(spark):
    """As Spark's own percentile, whose one task would hold every value; ties, nulls, one row and none included."""
    for n in (0, 1, 2, 997):
        df = spark.range(n).select(F.when(F.col("id") % 10 != 3, F.round((F.col("id") * 7919 % 1009) / 7, 1)).alias("o"), (F.col("id") * 0.5).alias("p"))
        made = aggregates.describe(df, "o")
        want = df.agg(*(F.percentile("o", q).alias("q") for q in (0.25, 0.5, 0.75)), F.max("o")).first()
        assert tuple(made.first())[4:] == tuple(want) and made.columns == ["count", "mean", "std", "min", "o_q25", "o_q50", "o_q75", "max"]
        delta = F.col("o") - F.col("p")
        want = df.agg(2 * F.percentile(F.abs(delta), 0.95), F.percentile(delta, 0.975) - F.percentile(delta, 0.025)).first()
        got = [metrics.time_metrics(df, "o", "p", mode=m) for m in ("abs", "real")]
        assert [x.first()["width"] for x in got] == list(want)
        assert all("percentile" not in x._jdf.queryExecution().executedPlan().toString() for x in (made, *got))


def test_pairs_of_keys_are_counted_in_one_shuffle(spark, tmp_path):
    items = spark.read.parquet(f"{DIR}/lineitem.parquet").where("l_orderkey < 300")
    more = items.where("l_linenumber <= 2").withColumn("l_partkey", F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey")))
    lost = items.limit(20).withColumn("l_orderkey", F.lit(None).cast("long"))
    path = tables(spark, tmp_path, lineitem=items.unionByName(more).unionByName(more).unionByName(lost))
    got, want = both(spark, "self_pair_join", path, ["lineitem"])
    assert got == want and max(r[-1] for r in got) > 1
    rows = joins.pairs_within(spark.read.parquet(f"{path}/lineitem.parquet"), ["l_orderkey"], "l_partkey", [])
    assert rows.count() == sum(r[-1] for r in got)
    plan = QUERIES["self_pair_join"](spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_isotope_patterns_are_not_broadcast(spark):
    rows = spark.createDataFrame([(1, "AMCK", 2), (2, "AMCK", 2), (3, None, 1), (4, "GK", 1)], "row int, seq string, charge int")
    found = files.isotope_patterns(rows, "seq", "charge")
    got = {r.row: r.IsoMZ for r in found.collect()}
    assert got[1] == got[2] and got[3] is None and got[4][0] < got[1][0]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_nearest_joins_keep_all_tasks_of_a_shuffle(spark):
    left = spark.range(40).select((F.col("id") % 8).alias("g"), "id", F.col("id").cast("double").alias("t"))
    right = left.select("g", F.col("id").alias("o"), (F.col("t") + 3).alias("k"))
    found = joins.asof_nearest(left, right, "t", "k", ["g"], "o", ["o"])
    want = {i: min(range(i % 8, 40, 8), key=lambda o: (abs(i - o - 3), o)) for i in range(40)}
    assert {r.id: r.o for r in found.collect()} == want
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_ranges_lead_the_band_join(spark):
    """Matches of a range follow each other, so its columns come in runs; columns stay in their order."""
    points = spark.createDataFrame([(i, i * 0.01) for i in range(300)], "p int, t double").hint("merge")
    ranges = spark.createDataFrame([(i, 0.3 * i, 0.3 * i + 1) for i in range(8)], "r int, lo double, hi double").hint("merge")
    out = joins.band_join(points, ranges, "t", "lo", "hi", 10.0)
    got = [r.r for r in out.collect()]
    assert out.columns == ["p", "t", "r", "lo", "hi"] and len(set(got)) == 8
    assert sum(a != b for a, b in zip(got, got[1:], strict=False)) == 7
