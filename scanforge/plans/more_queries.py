"""More operators as queries on the driver's tables: comparison, peaks, scoring, reports, sources and sinks."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.functions import scalar
from scanforge.operators import aggregates as A
from scanforge.operators import compare, dictionary, features, joins, peaks, report, reshape, smooth, solve, windows
from scanforge.plans import prediction
from scanforge.plans.queries import ORDER_WINDOWS, QUERIES, SERIES, SPECTRA, SQL, TYPES, long_spectra, order_days, query, series, t
from scanforge.session import scratch
from scanforge.sources import files

__all__ = ["QUERIES", "SQL"]

# --- comparison with measurements ---------------------------------------------------------

#: Parts stand for candidates and line items for measurements; a fifth of the parts are decoys.
REFERENCE = "(SELECT p_partkey AS id, p_brand AS seq, p_size AS charge, CASE WHEN p_partkey % 5 = 0 THEN '+' END AS reverse, (p_partkey % 40) * 60.0 AS lo, (p_partkey % 40) * 60.0 + 900 AS hi FROM part WHERE p_size > 10 QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) = 1)"
MEASURED = "(SELECT p_brand AS seq, p_size AS charge, l_quantity AS start, l_quantity + 300.0 + l_tax * 1000 AS finish, l_quantity + 100.0 AS time, l_extendedprice AS intensity, l_orderkey, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45)"
SUMS = "(SELECT l_partkey AS id, sum(CASE WHEN l_discount > 0.07 AND l_quantity < 12 THEN l_quantity ELSE 0 END) AS s FROM lineitem GROUP BY 1)"


def _comparison(spark, sf) -> compare.Comparison:
    p, items = t(spark, sf, "part"), t(spark, sf, "lineitem")
    left = (F.col("p_partkey") % 40) * 60.0
    reference = windows.top_n(p.where("p_size > 10"), ["p_brand", "p_size"], 1, F.col("p_partkey")).select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("Modified sequence"), F.col("p_size").alias("Charge"), F.when(F.col("p_partkey") % 5 == 0, "+").alias("Reverse"),
        left.alias("RT_search_left"), (left + 900).alias("RT_search_right"),
    )
    q = F.col("l_quantity").cast("double")
    measured = items.where("l_quantity > 45").join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("Modified sequence"), F.col("p_size").alias("Charge"), q.alias("Calibrated retention time start"), (q + 300.0 + F.col("l_tax") * 1000).alias("Calibrated retention time finish"),
        (q + 100.0).alias("Calibrated retention time"), F.col("l_extendedprice").alias("Intensity"),
    )
    sums = items.groupBy(F.col("l_partkey").alias("id")).agg(F.sum(F.when((F.col("l_discount") > 0.07) & (q < 12), q).otherwise(0.0)).alias("SumActivationRaw"))
    return compare.Comparison(reference, measured, [sums])


@query(f"SELECT id, s AS total FROM {SUMS} WHERE s > 0")
def comparison_active(spark, sf):
    """Candidates of positive activity."""
    return _comparison(spark, sf).active().select("id", F.col("SumActivationRaw").alias("total"))


@query(
    f"""SELECT r.id, m.seq, m.charge, s.s AS total, round(m.intensity, 2) AS intensity, m.time, m.start, m.finish FROM
    (SELECT seq, charge, sum(intensity) AS intensity, median(time) AS time, min(start) AS start, max(finish) AS finish FROM {MEASURED} GROUP BY ALL) m JOIN {REFERENCE} r USING (seq, charge) JOIN {SUMS} s ON s.id = r.id WHERE s.s > 0"""
)
def comparison_with_intensity(spark, sf):
    """Measured keys, summed, with their candidate and its activity."""
    c = _comparison(spark, sf).with_intensity()
    times = {"Calibrated retention time": "time", "Calibrated retention time start": "start", "Calibrated retention time finish": "finish"}
    return c.select("id", F.col("Modified sequence").alias("seq"), F.col("Charge").alias("charge"), F.col("SumActivationRaw").alias("total"), F.round("Intensity", 2).alias("intensity"), *(F.col(k).alias(v) for k, v in times.items()))


@query(
    f"""SELECT r.id, count(*) AS n FROM {MEASURED} m JOIN {REFERENCE} r USING (seq, charge) JOIN {SUMS} s ON s.id = r.id WHERE s.s > 0 AND ((r.lo <= m.start AND r.hi >= m.finish) OR r.hi < m.start OR r.lo > m.finish) GROUP BY 1"""
)
def comparison_by_overlap(spark, sf):
    """Measured rows whose times overlap, repeated ones preserved."""
    c = _comparison(spark, sf).with_intensity(by_overlap=["full_overlap", "partial_overlap"], repeated="preserve")
    return c.groupBy("id").agg(F.count("*").alias("n"))


@query(
    f"""SELECT reference, experiment, active, count(*) AS n FROM (SELECT max(r) AS reference, max(e) AS experiment, max(a) AS active FROM (
    SELECT seq || charge AS k, 1 AS r, 0 AS e, 0 AS a FROM {REFERENCE} UNION ALL SELECT seq || charge, 0, 1, 0 FROM {MEASURED} UNION ALL SELECT seq || charge, 0, 0, 1 FROM {REFERENCE} JOIN {SUMS} USING (id) WHERE s > 0) GROUP BY k) GROUP BY ALL"""
)
def comparison_overlap(spark, sf):
    """Keys of candidates, measurements and active candidates."""
    return _comparison(spark, sf).overlap()


@query(f"SELECT CASE WHEN reverse IS NULL THEN 0 ELSE 1 END AS decoy, count(*) AS n, round(avg(s), 6) AS mean FROM {REFERENCE} JOIN {SUMS} USING (id) WHERE s > 0 GROUP BY 1")
def comparison_target_decoy(spark, sf):
    return _comparison(spark, sf).target_decoy().withColumn("mean", F.round("mean", 6))


@query(
    f"""SELECT count(*) AS n, round(corr(y, x), 6) AS pearson, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 5) AS intercept FROM (SELECT log10(s.s) AS y, log10(m.intensity) AS x FROM
    (SELECT seq, charge, sum(intensity) AS intensity FROM {MEASURED} GROUP BY ALL) m JOIN {REFERENCE} r USING (seq, charge) JOIN {SUMS} s ON s.id = r.id WHERE s.s > 0)"""
)
def intensity_against_activation(spark, sf):
    r = _comparison(spark, sf).intensity_fit()
    return r.select("n", F.round("pearson", 6).alias("pearson"), F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query("SELECT o_custkey, a.n, b.n AS n_decoy FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b USING (o_custkey)")
def inner_suffix_join(spark, sf):
    """Two measures of the same keys, keys of both only."""
    n = lambda s: t(spark, sf, "orders").where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return joins.join_suffixed(n("F"), n("O"), ["o_custkey"], "_decoy", how="inner")


@query(
    """SELECT a.l_partkey, a.l_suppkey, a.n, b.n AS n_returned FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) a
    LEFT JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) b USING (l_partkey, l_suppkey)"""
)
def multi_key_left_join(spark, sf):
    n = lambda df: df.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    items = t(spark, sf, "lineitem")
    return joins.join_suffixed(n(items), n(items.where("l_returnflag = 'R'")), ["l_partkey", "l_suppkey"], "_returned")


# --- times ---------------------------------------------------------------------------------

DAYS = "(SELECT DISTINCT epoch_us(l_shipdate) / 864e8 AS s FROM lineitem WHERE l_quantity > 49)"
NEAREST = f"""(SELECT o_orderkey, d, CASE WHEN bs IS NULL OR (fs IS NOT NULL AND fs - d < d - bs) THEN fs ELSE bs END AS near FROM (SELECT o_orderkey, d, s AS bs FROM {ORDER_WINDOWS} ASOF LEFT JOIN {DAYS} ON d >= s)
    JOIN (SELECT o_orderkey, s AS fs FROM {ORDER_WINDOWS} ASOF LEFT JOIN {DAYS} ON d < s) USING (o_orderkey))"""


def _days(spark, sf) -> DataFrame:
    d = t(spark, sf, "lineitem").where("l_quantity > 49").select((F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 864e8).alias("starttime")).distinct()
    return d.select("starttime", F.col("starttime").cast("long").alias("scan_idx"))


@query(f"SELECT o_orderkey, near::BIGINT AS scan FROM {NEAREST}")
def nearest_scan_of_time(spark, sf):
    """The shipping day nearest to each order."""
    return joins.nearest_scan(order_days(spark, sf), _days(spark, sf), ["d"]).select("o_orderkey", F.col("d_scan").alias("scan"))


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, abs(l_extendedprice / l_quantity - p_retailprice) AS gap FROM lineitem JOIN part ON p_partkey = l_partkey) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY gap, l_orderkey, l_linenumber) = 1")
def closest_prediction(spark, sf):
    """For each part the line item whose unit price is nearest to the list price."""
    measured = t(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    predicted = t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("predicted_RT"))
    found = prediction.match_predictions(measured, predicted, ["l_partkey"], "price", ["l_partkey"], "closest", ["l_orderkey", "l_linenumber"])
    return found.select("l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT l_partkey, count(*) AS n, round(sum(l_extendedprice), 2) AS intensity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE abs(l_quantity - p_size) <= 5 GROUP BY 1")
def predictions_within_tolerance(spark, sf):
    """Measurements within a tolerance of their prediction, summed."""
    measured = t(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("time"), F.col("l_extendedprice").alias("Intensity"), F.lit(1).alias("one"))
    predicted = t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("predicted_RT"))
    near = prediction.match_predictions(measured, predicted, ["l_partkey"], "time", ["l_partkey"], 5.0, ["l_orderkey", "l_linenumber"], ("Intensity", "one"))
    return near.select("l_partkey", F.col("one").alias("n"), F.round("Intensity", 2).alias("intensity"))


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k BETWEEN 11 AND 60")
def row_slice(spark, sf):
    """Rows 10 to 59 by falling price."""
    return windows.rows_between(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 10, 60, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) - value AS change FROM events")
def path_change(spark, sf):
    """What a metric falls by along a path."""
    return windows.path_change(t(spark, sf, "events"), ["user_id"], "event_id", "value").select("event_id", "change")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def positional_projection(spark, sf):
    o = t(spark, sf, "orders")
    return reshape.columns_at(o, [o.columns.index("o_orderkey"), o.columns.index("o_totalprice")])


@query(f"SELECT user_id AS id, hour AS scan_idx, starttime, v AS activation FROM (SELECT user_id, floor(epoch_us(ts) / 36e8)::BIGINT AS hour, floor(epoch_us(ts) / 36e8) * 60 AS starttime, round(sum(value), 6) AS v FROM events GROUP BY ALL) WHERE user_id = 7 AND starttime BETWEEN (SELECT avg(t) - 20000 FROM {SERIES} WHERE id = 7) - 100 AND (SELECT avg(t) + 20000 FROM {SERIES} WHERE id = 7) + 100")
def activation_window(spark, sf):
    """One user's profile about the mean time."""
    act, _, centres = _hourly(spark, sf)
    ranges = centres.select("id", (F.col("RT_search_center") - 20000).alias("RT_search_left"), (F.col("RT_search_center") + 20000).alias("RT_search_right"))
    return report.activation_window(act.withColumn("activation", F.round("activation", 6)), ranges, 7, 100.0).select("id", "scan_idx", "starttime", "activation")


@query("SELECT pos::DOUBLE AS mz, abs(x) AS intensity FROM " + SPECTRA + " WHERE scan_idx = 3 AND pos > 10 AND pos < 30")
def pattern_window(spark, sf):
    """A spectrum's points within a range."""
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("scan_idx"), F.transform("embedding", lambda v, i: i.cast("double")).alias("mzarray"), F.transform("embedding", lambda v: F.abs(v).cast("double")).alias("intarray"))
    return report.pattern_window(e, 3, 10, 30).select(F.col("mzarray").alias("mz"), F.col("intarray").alias("intensity"))


# --- series and peaks -------------------------------------------------------------------------


def _hourly(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = series(spark, sf).withColumn("scan_idx", F.floor(F.col("t") / 60))
    act = s.groupBy("id", "scan_idx").agg(F.sum("v").alias("activation")).withColumn("starttime", F.col("scan_idx") * 60.0)
    return act, act.select("scan_idx", "starttime").distinct(), s.groupBy("id").agg(F.avg("t").alias("RT_search_center"))


HOURLY = f"(SELECT id, floor(t / 60)::BIGINT AS h, sum(v) AS v FROM {SERIES} GROUP BY ALL)"


@query(
    f"""WITH w AS (SELECT h, (coalesce(h - lag(h) OVER (ORDER BY h), 0) + coalesce(lead(h) OVER (ORDER BY h) - h, 0)) * 30.0 AS w FROM (SELECT DISTINCT h FROM {HOURLY}))
    SELECT id, round(sum(v), 4) AS total, round(sum(v * w), 2) AS area FROM {HOURLY} JOIN w USING (h) GROUP BY 1"""
)
def series_sums(spark, sf):
    """Sum and integral of each hourly series."""
    act, scans, _ = _hourly(spark, sf)
    return smooth.series_sums(act, scans).select("id", F.round("SumActivationRaw", 4).alias("total"), F.round("AUCActivationRaw", 2).alias("area"))


PEAKS = f"(SELECT id, event_id AS apex_scan, t - 20 AS start_time, t AS apex_time, t + 30 AS end_time FROM {SERIES} WHERE event_type = 'click')"
TIMES = f"(SELECT id, min(t) - 10 AS a, min(t) AS m, min(t) + 10 AS z FROM {SERIES} WHERE event_type = 'purchase' GROUP BY 1)"


def _clicks(spark, sf) -> tuple[DataFrame, DataFrame]:
    s = series(spark, sf)
    found = s.where("event_type = 'click'").select("id", F.col("event_id").alias("apex_scan"), (F.col("t") - 20).alias("start_time"), F.col("t").alias("apex_time"), (F.col("t") + 30).alias("end_time"))
    first = s.where("event_type = 'purchase'").groupBy("id").agg(F.min("t").alias("m"))
    return found, first.select("id", (F.col("m") - 10).alias("Calibrated retention time start"), F.col("m").alias("Calibrated retention time"), (F.col("m") + 10).alias("Calibrated retention time finish"))


@query(
    f"""SELECT id, apex_scan, round(abs(start_time - a) + abs(apex_time - m) + abs(end_time - z), 4) AS gap, m IS NOT NULL AND row_number() OVER (PARTITION BY id ORDER BY abs(start_time - a) + abs(apex_time - m) + abs(end_time - z) NULLS LAST, apex_scan) <= 2 AS matched
    FROM {PEAKS} LEFT JOIN {TIMES} USING (id)"""
)
def match_peaks(spark, sf):
    """The two peaks of each candidate nearest to its measured times."""
    return peaks.match_peaks(*_clicks(spark, sf), 2).select("id", "apex_scan", F.round("RT_diff_sum", 4).alias("gap"), "matched")


@query(
    f"""WITH s AS (SELECT DISTINCT floor(t / 60) AS h FROM {SERIES}), p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(start_time - a) + abs(apex_time - m) + abs(end_time - z) NULLS LAST, apex_scan) <= 2 AS near FROM {PEAKS} JOIN {TIMES} USING (id)),
    x AS (SELECT id, apex_scan, near, floor(start_time / 60) AS lo, floor(end_time / 60) + 1 AS hi, unnest([a, z]) AS tm, unnest([1, 2]) AS k FROM p), b AS (SELECT x.*, h AS bh FROM x ASOF LEFT JOIN s ON x.tm >= s.h * 60), f AS (SELECT b.*, h AS fh FROM b ASOF LEFT JOIN s ON b.tm < s.h * 60),
    n AS (SELECT *, CASE WHEN bh IS NULL OR (fh IS NOT NULL AND fh * 60 - tm < tm - bh * 60) THEN fh ELSE bh END AS scan FROM f), w AS (SELECT id, apex_scan, any_value(near) AS near, any_value(lo) AS lo, any_value(hi) AS hi, min(scan) FILTER (k = 1) AS c, min(scan) FILTER (k = 2) AS e FROM n GROUP BY ALL),
    j AS (SELECT *, greatest(0, least(hi, e) - greatest(lo, c)) AS i FROM w) SELECT id, apex_scan, CASE WHEN i / nullif(greatest(0, hi - lo) + greatest(0, e - c) - i, 0) < 0.3 THEN false ELSE near END AS matched FROM j"""
)
def demote_by_overlap(spark, sf):
    """Matched peaks lose the mark where their scans hardly overlap the measured ones."""
    found, times = _clicks(spark, sf)
    matched = peaks.match_peaks(found, times, 2).where("`Calibrated retention time` is not null")
    matched = matched.withColumn("start_scan", F.floor(F.col("start_time") / 60)).withColumn("end_scan", F.floor(F.col("end_time") / 60) + 1)
    _, scans, _ = _hourly(spark, sf)
    return peaks.demote_by_overlap(matched, scans, 0.3).select("id", "apex_scan", "matched")


@query("SELECT user_id AS id, event_id FROM events QUALIFY value = max(value) OVER (PARTITION BY user_id)")
def top_scored_with_ties(spark, sf):
    return features.top_scored(t(spark, sf, "events").withColumn("apex_scan", F.col("event_id")), 1, "user_id", "value").select(F.col("user_id").alias("id"), "event_id")


@query(
    """WITH e AS (SELECT user_id, value, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events), p AS (SELECT * FROM e WHERE user_id IN (SELECT user_id FROM e WHERE y = 1)),
    b AS (SELECT user_id, max(y) AS hit FROM (SELECT * FROM p QUALIFY value = max(value) OVER (PARTITION BY user_id)) GROUP BY 1) SELECT count(*) AS n_ids, round(avg(hit), 9) AS accuracy FROM b"""
)
def id_accuracy(spark, sf):
    """How often a right peak is its candidate's best."""
    e = t(spark, sf, "events").select(F.col("user_id").alias("id"), (F.col("event_type") == "purchase").alias("y_true"), F.col("value").alias("y_pred_prob"))
    return features.id_accuracy(e, 1).withColumn("accuracy", F.round("accuracy", 9))


@query("SELECT l_suppkey AS id, sum(l_quantity) > 900 AS y_pred, coalesce(max(CASE WHEN s_acctbal > 0 THEN 1 END), 0) = 1 AS y_true FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def membership_labels(spark, sf):
    """Which candidates are active, and which a list of true ones holds."""
    act = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").alias("activation"))
    truth = t(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    out = solve.identified(act, truth, 900.0)
    return out.select("id", (F.col("y_pred") == 1).alias("y_pred"), (F.col("y_true") == 1).alias("y_true"))


MATCHES = "(SELECT l_orderkey AS scan_idx, l_suppkey AS id, l_linenumber AS apex, l_quantity / 60 AS ab, l_discount > 0.03 AS matched FROM lineitem)"


def _matches(spark, sf) -> DataFrame:
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("scan_idx"), F.col("l_suppkey").alias("id"), F.col("l_linenumber").cast("double").alias("apex_mz"), (F.col("l_quantity") / 60).alias("IsoAbundance"), (F.col("l_discount") > 0.03).alias("matched"))


@query(
    f"""WITH p AS (SELECT scan_idx, id, apex, sum(ab) AS ab FROM {MATCHES} WHERE matched GROUP BY ALL), s AS (SELECT scan_idx, id, sum(ab) AS seen FROM p GROUP BY ALL HAVING sum(ab) >= 0.6)
    SELECT scan_idx, apex::DOUBLE AS apex_mz, id, round(ab, 6) AS abundance FROM p JOIN s USING (scan_idx, id) UNION ALL SELECT scan_idx, 0, id, round(1 - seen, 6) FROM s"""
)
def build_dictionary(spark, sf):
    """Columns of candidates that are matched well enough, with what no peak observed."""
    return dictionary.build_dictionary(_matches(spark, sf), 0.4).withColumn("abundance", F.round("abundance", 6))


CENTRES = f"(SELECT label AS id, pos, avg(abs(x)) AS ab FROM {SPECTRA} WHERE label IS NOT NULL GROUP BY ALL)"
WITH_UNSEEN = f"(SELECT id, pos + 1 AS pos, ab FROM {CENTRES} UNION ALL SELECT id, 0, 0.05 + id % 7 / 10 FROM (SELECT DISTINCT id FROM {CENTRES}))"


@query(f"SELECT a.id::BIGINT AS a, b.id::BIGINT AS b, round(corr(a.ab, b.ab), 6) AS r FROM {WITH_UNSEEN} a JOIN {WITH_UNSEEN} b ON a.pos = b.pos AND a.id < b.id GROUP BY ALL HAVING corr(a.ab, b.ab) >= 0.2")
def correlation_with_unseen(spark, sf):
    """Correlated candidates, the row at 0 that all of them hold included."""
    s = long_spectra(spark, sf).where("label is not null")
    seen = s.groupBy(F.col("label").cast("long").alias("id"), (F.col("pos") + 1).cast("double").alias("apex_mz")).agg(F.avg(F.abs("x")).alias("abundance"))
    rest = seen.select("id").distinct().select("id", F.lit(0.0).alias("apex_mz"), (0.05 + F.col("id") % 7 / 10).alias("abundance"))
    one = seen.unionByName(rest).withColumn("scan_idx", F.lit(0).cast("long"))
    sizes = one.groupBy("scan_idx").agg(F.count_distinct("apex_mz").alias("n"))
    return dictionary.feature_correlation(one, sizes, 0.2).select("a", "b", F.round("r", 6).alias("r"))


#: Peaks of every spectrum: a maximum, the lowest points on its two sides before a higher value, and where the sides fall
#: to a quarter of its prominence.
SPECTRUM_PEAKS = f"""(WITH s AS MATERIALIZED (SELECT scan_idx, pos, abs(x) AS y, lag(abs(x)) OVER w AS b, lead(abs(x)) OVER w AS f FROM {SPECTRA} WINDOW w AS (PARTITION BY scan_idx ORDER BY pos)),
    p AS (SELECT scan_idx, pos AS p, y AS yp, b, f FROM s WHERE y > b AND y > f),
    l AS (SELECT p.scan_idx, p, any_value(yp) AS yp, coalesce(max(s.pos) FILTER (s.pos < p AND s.y > yp), -1) + 1 AS a, coalesce(min(s.pos) FILTER (s.pos > p AND s.y > yp) - 1, max(s.pos)) AS z FROM p JOIN s USING (scan_idx) GROUP BY ALL),
    m AS (SELECT l.*, min(y) FILTER (pos <= p) AS ya, min(y) FILTER (pos >= p) AS yz FROM l JOIN s ON s.scan_idx = l.scan_idx AND pos BETWEEN a AND z GROUP BY ALL),
    h AS (SELECT *, yp - (yp - greatest(ya, yz)) * 0.75 AS h FROM m),
    e AS (SELECT h.*, max(pos) FILTER (pos < p AND y <= h) AS i, min(pos) FILTER (pos > p AND y <= h) AS j FROM h JOIN s ON s.scan_idx = h.scan_idx AND pos BETWEEN a AND z GROUP BY ALL),
    g AS (SELECT e.scan_idx, p, h, round_even(CASE WHEN u.y < h THEN i + (h - u.y) / (u.f - u.y) ELSE i END, 0) AS lo, round_even(CASE WHEN v.y < h THEN j - (h - v.y) / (v.b - v.y) ELSE j END, 0) AS hi FROM e JOIN s u ON u.scan_idx = e.scan_idx AND u.pos = i JOIN s v ON v.scan_idx = e.scan_idx AND v.pos = j)
    SELECT g.scan_idx, p, h, lo, hi, sum(y) AS total FROM g JOIN s ON s.scan_idx = g.scan_idx AND pos BETWEEN lo AND hi GROUP BY ALL)"""

SQL["spectrum_peak_picking"] = f"SELECT scan_idx, p::BIGINT AS apex_mzidx, p::DOUBLE AS apex_mz, lo::BIGINT AS start_mzidx, lo::DOUBLE AS start_mz, hi::BIGINT AS end_mzidx, hi::DOUBLE AS end_mz, (hi - lo)::DOUBLE AS peak_width, h AS peak_height, total AS peak_intensity_sum FROM {SPECTRUM_PEAKS}"
SQL["activation_pipeline"] = f"""WITH q AS MATERIALIZED (SELECT scan_idx, p::DOUBLE AS apex, lo, hi, total FROM {SPECTRUM_PEAKS}),
    c AS (SELECT p_partkey AS id, p_partkey % 500 - 3.0 AS a, p_partkey % 500 + 3.0 AS z, unnest([3, 7, 11]) AS k, unnest([0.6, 0.3, 0.1]) AS ab FROM part),
    i AS MATERIALIZED (SELECT vec_id AS scan_idx, id, k, (id * k % 61 + 1.5)::DOUBLE AS mz, ab::DOUBLE AS ab FROM embeddings JOIN c ON vec_id BETWEEN a AND z WHERE embedding IS NOT NULL),
    n AS (SELECT i.*, apex, lo, hi, total, row_number() OVER (PARTITION BY i.scan_idx, id, k ORDER BY abs(apex - mz), apex) AS r FROM i JOIN q USING (scan_idx)),
    d AS (SELECT scan_idx, id, apex, any_value(total) AS total, sum(ab) AS ab FROM n WHERE r = 1 AND mz BETWEEN lo AND hi GROUP BY ALL), s AS (SELECT scan_idx, id, sum(ab * total) AS act FROM d GROUP BY ALL HAVING sum(ab) >= 0.5)
    SELECT id, round(sum(act), 6) AS "SumActivation", count(*) AS n_scans FROM s GROUP BY 1"""

# --- sequences -------------------------------------------------------------------------------------


def _array_series(spark, sf) -> DataFrame:
    return t(spark, sf, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.lit(2).cast("long").alias("first_scan"), F.transform("embedding", lambda v: v.cast("double")).alias("values"))


ARRAYS = "(SELECT vec_id AS id, vec_id % 20 + 5 AS s, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL)"


def _digest(df: DataFrame, values: str) -> DataFrame:
    long = df.select("id", F.posexplode(values).alias("i", "y"))
    return long.groupBy("id").agg(F.round(F.sum(F.col("y") * (F.col("i") + 1)), 4).alias("weighted"), F.count("*").alias("n"))


@query(
    f"SELECT id, round(sum(y * (i + 1)), 4) AS weighted, count(*) AS n FROM (SELECT id, i, CASE WHEN i >= len(e) THEN -1 WHEN i BETWEEN s - 5 AND s + 9 THEN e[i + 1] ELSE 0 END AS y FROM (SELECT id, s, e, unnest(range(80)) AS i FROM {ARRAYS})) GROUP BY 1"
)
def peak_sequences(spark, sf):
    """Series masked outside their peak and a margin, padded to one length."""
    a = _array_series(spark, sf)
    found = a.select("id", (F.col("id") % 20 + 5).alias("start_scan"), (F.col("id") % 20 + 13).alias("end_scan"))
    return _digest(features.peak_sequences(found, a, 80, "mask", 3), "sequence")


@query(f"SELECT id, sum(y * (i + 1))::BIGINT AS weighted, count(*) AS n FROM (SELECT id, i, CASE WHEN i + 2 >= s AND i + 2 < s + 8 THEN 1 ELSE 0 END AS y FROM (SELECT id, s, unnest(range(len(e))) AS i FROM {ARRAYS})) GROUP BY 1")
def scan_labels(spark, sf):
    """Which scans of a series lie in the measured range."""
    measured = _array_series(spark, sf).select("id", (F.col("id") % 20 + 5).alias("start_scan"), (F.col("id") % 20 + 13).alias("finish_scan"))
    return _digest(features.scan_labels(_array_series(spark, sf), measured), "labels")


@query(f"SELECT id, round(sum(y * (i + 1)), 4) AS weighted, count(*) AS n FROM (SELECT id, unnest(range(2 * len(e))) AS i, unnest(list_concat(e, list_transform(e, lambda v: s::DOUBLE))) AS y FROM {ARRAYS}) GROUP BY 1")
def stacked_features(spark, sf):
    """A series and a number of its own as the channels of one feature array."""
    a = _array_series(spark, sf).withColumn("s", F.col("id") % 20 + 5)
    return _digest(features.stacked_features(a, "s", length="values").withColumn("flat", F.flatten("features")), "flat")


@query(f"SELECT id, round(sum(y * (i + 1)), 4) AS weighted, count(*) AS n FROM (SELECT id, unnest(range(len(e))) AS i, unnest(list_transform(e, lambda v: ln(abs(v) + 1))) AS y FROM {ARRAYS}) GROUP BY 1")
def log_activation(spark, sf):
    """Activations as ln(x + 1)."""
    a = _array_series(spark, sf).withColumn("values", F.transform("values", lambda v: F.abs(v)))
    return _digest(features.transform_activation(a), "values")


DENSE = "(SELECT id, lo + 0.5 AS lo, lo + 6.5 AS hi FROM (SELECT DISTINCT l_suppkey AS id, l_suppkey % 50 AS lo FROM lineitem))"


@query(
    f"""SELECT d.id, min(g.s) AS first_scan, count(*) AS n, round(sum(coalesce(a.v, 0) * (g.s + 1)), 4) AS weighted FROM {DENSE} d JOIN (SELECT DISTINCT l_quantity::BIGINT AS s FROM lineitem) g ON g.s BETWEEN d.lo AND d.hi
    LEFT JOIN (SELECT l_suppkey AS id, l_quantity::BIGINT AS s, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL) a ON a.id = d.id AND a.s = g.s GROUP BY 1"""
)
def dense_series(spark, sf):
    """Every candidate's activations over the scans of its range, zeros included."""
    items = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_quantity").cast("long").alias("scan_idx"), F.col("l_extendedprice").alias("v"))
    scans = items.select("scan_idx", F.col("scan_idx").cast("double").alias("starttime")).distinct()
    lo = F.col("id") % 50 + 0.5
    ranges = items.select("id").distinct().select("id", lo.alias("RT_search_left"), (lo + 6).alias("RT_search_right"))
    found = features.dense_series(items.groupBy("id", "scan_idx").agg(F.sum("v").alias("activation")), scans, ranges, 6.0)
    weighted = F.aggregate(F.transform("values", lambda v, i: v * (i + F.col("first_scan") + 1)), F.lit(0.0), lambda a, x: a + x)
    return found.select("id", "first_scan", F.size("values").cast("long").alias("n"), F.round(weighted, 4).alias("weighted"))


@query(
    """WITH k AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR || '|3'), c_custkey) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey AS c_custkey FROM orders)) SELECT o_orderkey, CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.7) + floor(n * 0.1) THEN 'val' WHEN r > n - floor(n * 0.2) THEN 'test' END AS split
    FROM orders JOIN k ON c_custkey = o_custkey"""
)
def grouped_split(spark, sf):
    """Orders split by customer: whole customers, in exact numbers."""
    return features.grouped_split(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 0.2, 0.1, 3).select("o_orderkey", "split")


@query("SELECT o_orderkey, ('0x' || substr(md5(o_orderkey::VARCHAR || '|5'), 1, 8))::BIGINT < 1288490188 AS chosen FROM orders")
def seeded_sample(spark, sf):
    """A repeatable sample and its complement."""
    return t(spark, sf, "orders").select("o_orderkey", scalar.deterministic_sample(F.col("o_orderkey"), 0.3, 5).alias("chosen"))


@query(
    """SELECT seq, modifications, median(p_retailprice) AS tr FROM (SELECT p_retailprice, CASE WHEN p_size < 15 THEN 'AMCK' WHEN p_size < 30 THEN 'AMK' ELSE 'GCC' END AS seq,
    CASE WHEN p_size < 15 THEN '0|Acetyl|2|Oxidation|3|Carbamidomethyl' WHEN p_size < 30 THEN '' ELSE '2|Carbamidomethyl|3|Carbamidomethyl' END AS modifications FROM part) GROUP BY ALL"""
)
def peptide_records(spark, sf):
    """Bare sequences, places of modifications, and median times."""
    seq = F.when(F.col("p_size") < 15, "_(ac)AM(ox)CK_").when(F.col("p_size") < 30, "_AMK_").otherwise("_GCC_")
    return files.peptide_records(t(spark, sf, "part").select(seq.alias("s"), "p_retailprice"), "s", "p_retailprice")


@query(f"SELECT scan_idx, p::DOUBLE AS apex_mz, round(total, 6) AS intensity FROM {SPECTRUM_PEAKS} UNION ALL SELECT DISTINCT scan_idx, 0, 0 FROM {SPECTRUM_PEAKS}")
def observations(spark, sf):
    """What was observed at each peak, and nothing at 0."""
    e = t(spark, sf, "embeddings").where("embedding is not null")
    scans = e.select(F.col("vec_id").alias("scan_idx"), F.transform("embedding", lambda v, i: i.cast("double")).alias("mzarray"), F.transform("embedding", lambda v: F.abs(v).cast("double")).alias("intarray"))
    return dictionary.observations(dictionary.scan_peaks(scans)).withColumn("intensity", F.round("intensity", 6))


@query(f"SELECT scan_idx, count(*) AS n, round(avg(total), 6) AS mean, round(stddev(total), 6) AS std FROM {SPECTRUM_PEAKS} GROUP BY 1")
def spectrum_summary(spark, sf):
    e = t(spark, sf, "embeddings").where("embedding is not null")
    scans = e.select(F.col("vec_id").alias("scan_idx"), F.transform("embedding", lambda v, i: i.cast("double")).alias("mzarray"), F.transform("embedding", lambda v: F.abs(v).cast("double")).alias("intarray"))
    return dictionary.spectrum_summary(dictionary.scan_peaks(scans)).select("scan_idx", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


# --- reports ----------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, log10(l_quantity + 1) AS x, log10(l_extendedprice + 1) AS y FROM lineitem WHERE l_quantity > 5 AND l_extendedprice > 5), f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM p)
    SELECT l_orderkey, l_linenumber, round(abs(y - (s * x + i)), 6) AS residual FROM p, f"""
)
def scatter_residuals(spark, sf):
    """Logged points over a threshold on both axes with their distance to the line."""
    points, _ = report.scatter(t(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("double")), "q", "l_extendedprice", 5, log=True)
    return points.select("l_orderkey", "l_linenumber", F.round("residual", 6).alias("residual"))


@query("SELECT l_orderkey, round(log10(CASE WHEN l_discount > 0 THEN l_discount ELSE (SELECT min(l_discount) / 10 FROM lineitem WHERE l_discount > 0 AND l_linenumber = 1) END), 6) AS log10_alpha FROM lineitem WHERE l_linenumber = 1")
def alpha_track(spark, sf):
    records = t(spark, sf, "lineitem").where("l_linenumber = 1").withColumn("best_alpha", F.col("l_discount").cast("double"))
    return report.alpha_track(records).select("l_orderkey", F.round("log10_alpha", 6).alias("log10_alpha"))


@query("SELECT count(*) AS n, round(avg(log10(o_totalprice)), 6) AS mean, round(quantile_cont(log10(o_totalprice), 0.5), 6) AS median FROM orders WHERE o_totalprice > 1")
def intensity_distribution(spark, sf):
    d = report.intensity(t(spark, sf, "orders"), "o_totalprice")
    return d.select(F.col("count").alias("n"), F.round("mean", 6).alias("mean"), F.round("log10_q50", 6).alias("median"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (SELECT p_size FROM part GROUP BY 1 ORDER BY count(*) DESC, p_size LIMIT 4)")
def peak_property_report(spark, sf):
    """Rows of the most frequent values of a property."""
    return report.peak_properties(t(spark, sf, "part"), "p_size", 4)[1].select("p_partkey", "p_size")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 0 THEN round(log2(o_totalprice), 6) END AS log2_o_totalprice FROM orders")
def log_columns(spark, sf):
    return report.log_columns(t(spark, sf, "orders"), ["o_totalprice"], "log2").select("o_orderkey", F.round("log2_o_totalprice", 6).alias("log2_o_totalprice"))


@query(
    """SELECT o_custkey, round(f, 2) AS f, round(o, 2) AS o FROM (SELECT o_custkey, sum(o_totalprice) AS f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) FULL JOIN (SELECT o_custkey, sum(o_totalprice) AS o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) USING (o_custkey)"""
)
def measures_side_by_side(spark, sf):
    """One measure of several analyses."""
    o = t(spark, sf, "orders")
    out = report.measures_side_by_side({s.lower(): o.where(F.col("o_orderstatus") == s) for s in "FO"}, "o_custkey", "o_totalprice")
    return out.select("o_custkey", F.round("f", 2).alias("f"), F.round("o", 2).alias("o"))


@query("SELECT count(*) AS n, round(avg(CASE WHEN abs(l_quantity * 1500 - l_extendedprice) <= 5000 THEN 1.0 ELSE 0 END), 9) AS share_within, round(corr(l_extendedprice, l_quantity * 1500), 6) AS pearson, round(avg(abs(l_quantity * 1500 - l_extendedprice)), 3) AS mae FROM lineitem")
def true_and_predicted(spark, sf):
    rows = t(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") * 1500.0)
    _, s = report.true_and_predicted(rows, "l_extendedprice", "p", 5000)
    return s.select("n", F.round("share_within", 9).alias("share_within"), F.round("pearson", 6).alias("pearson"), F.round("mae", 3).alias("mae"))


@query("SELECT truth, bin, n, round(n / sum(n) OVER (PARTITION BY truth), 9) AS share FROM (SELECT l_returnflag AS truth, least(floor(l_discount * 10 * 20), 19)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY ALL)")
def score_distribution(spark, sf):
    """Scores by class."""
    rows = t(spark, sf, "lineitem").withColumn("score", F.col("l_discount") * 10)
    return report.score_distribution(rows, "score", "l_returnflag").select("truth", "bin", "n", F.round("share", 9).alias("share"))


@query(
    f"""SELECT h AS scan_idx, round(v, 6) AS activation, max(score) AS score FROM (SELECT * FROM {HOURLY} WHERE id = 7) LEFT JOIN (SELECT floor(t / 60) - 3 AS a, floor(t / 60) + 3 AS z, v AS score FROM {SERIES} WHERE id = 7 AND event_type = 'click') ON h BETWEEN a AND z GROUP BY ALL"""
)
def activation_and_score(spark, sf):
    """One candidate's profile with the score of the peak that each scan lies in."""
    act, _, _ = _hourly(spark, sf)
    hour = F.floor(F.col("t") / 60)
    found = series(spark, sf).where("event_type = 'click'").select("id", (hour - 3).alias("start_scan"), (hour + 3).alias("end_scan"), F.col("v").alias("pred_score"))
    return report.activation_and_score(act, found, 7).select("scan_idx", F.round("activation", 6).alias("activation"), F.col("pred_score").alias("score"))


@query(f"SELECT pos::DOUBLE AS apex_mz, abs(x) AS intensity, id::BIGINT AS id, round(ab * act, 6) AS explained FROM {SPECTRA} s JOIN {CENTRES} c USING (pos) JOIN (SELECT id, sum(ab * abs(x)) AS act FROM {SPECTRA} JOIN {CENTRES} USING (pos) WHERE scan_idx = 3 GROUP BY 1) USING (id) WHERE scan_idx = 3")
def isotope_comparison(spark, sf):
    """What each candidate explains of one spectrum."""
    from scanforge.plans.queries import spectra_dictionary

    d, y = spectra_dictionary(spark, sf)
    out = report.isotope_comparison(d, y, solve.threshold_activation(d, y), 3)
    return out.select("apex_mz", "intensity", "id", F.round("explained", 6).alias("explained"))


# --- scalars --------------------------------------------------------------------------------------------

MARKED = r"('_(ac)' || replace(p_name, 'a', 'M(ox)') || 'C_')"


@query(rf"SELECT p_partkey, (length({MARKED}) - length(replace({MARKED}, 'M(ox)', ''))) // 5 AS n_ox, 1::BIGINT AS n_ac, length(regexp_replace(regexp_replace({MARKED}, '\(ox\)|\(ac\)|_', '', 'g'), '[^C]', '', 'g')) AS n_cys FROM part")
def marker_counts(spark, sf):
    """Modification markers of sequences."""
    seq = F.concat(F.lit("_(ac)"), F.replace("p_name", F.lit("a"), F.lit("M(ox)")), F.lit("C_"))
    found = t(spark, sf, "part").select("p_partkey", *scalar.marker_counts(seq))
    return found.select("p_partkey", *(F.col(c).cast("long").alias(c) for c in ("n_ox", "n_ac", "n_cys")))


@query("SELECT l_orderkey, l_linenumber, round(2.5 * exp(-0.01 * l_quantity * l_quantity), 9) AS g, printf('%.1f%% (%d)', 100.0 * l_quantity / 50, l_quantity::BIGINT) AS p FROM lineitem")
def gauss_and_percent(spark, sf):
    items = t(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("double"))
    return items.select("l_orderkey", "l_linenumber", F.round(scalar.gauss(F.col("q"), 2.5, 0.01), 9).alias("g"), scalar.percent(F.col("q"), F.lit(50.0)).alias("p"))


@query("SELECT p_partkey, p_brand || '.' || p_size AS stem FROM part")
def path_stem(spark, sf):
    """File names without folders and extension."""
    p = t(spark, sf, "part")
    path = F.concat(F.lit("runs/a.b/"), "p_brand", F.lit("."), F.col("p_size").cast("string"), F.lit(".mzML"))
    return p.select("p_partkey", files.path_stem(path).alias("stem"))


@query("SELECT user_id, min(k) - 1 AS place FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, max(value) OVER (PARTITION BY user_id) AS top FROM events) WHERE value = top GROUP BY 1")
def element_index(spark, sf):
    """Where in a list its greatest element is."""
    lists = t(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("l"))
    values = F.transform("l", lambda x: x["value"])
    return lists.select("user_id", reshape.index_of(values, F.array_max(values)).alias("place"))


@query("SELECT l_partkey, median(l_extendedprice) AS l_extendedprice_median FROM lineitem GROUP BY 1")
def group_median(spark, sf):
    return A.summarise(t(spark, sf, "lineitem"), ["l_partkey"], [], ["l_orderkey"], median=["l_extendedprice"])


# --- sources and sinks --------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def tsv_round_trip(spark, sf):
    """Orders written as tab-separated text, a folder for each status, and read again."""
    path = scratch(spark, "tsv")
    files.write_table(t(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"])
    return files.read_table(spark, path).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_orderstatus").cast("string").alias("o_orderstatus"), F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query("SELECT p_partkey || '>' || p_brand AS id, upper(replace(p_name, ' ', '')) AS sequence FROM part")
def fasta_round_trip(spark, sf):
    """Parts written as FASTA, with ``>`` inside headers, and read again."""
    path = scratch(spark, "fasta")
    p = t(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(">"), "p_brand").alias("id"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("s"))
    files.write_fasta(p, path, "id", "s")
    return files.read_fasta(spark, path)


@query("SELECT l_orderkey AS row, l_linenumber AS col, l_discount::DOUBLE AS value FROM lineitem WHERE l_discount <> 0")
def sparse_round_trip(spark, sf):
    path = scratch(spark, "sparse")
    files.write_sparse(t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.col("l_discount").cast("double").alias("value")), path)
    return files.read_sparse(spark, path)


@query("SELECT u.user_id AS row, c.k AS col, round(coalesce(v, 0), 6) AS value FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type AS k FROM events) c LEFT JOIN (SELECT user_id, event_type AS k, sum(value) AS v FROM events WHERE value > 150 GROUP BY ALL) e ON e.user_id = u.user_id AND e.k = c.k")
def dense_round_trip(spark, sf):
    """A dense matrix, a row for each user and a column for each type of event."""
    path, e = scratch(spark, "dense"), t(spark, sf, "events")
    cells = e.groupBy("user_id", "event_type").agg(F.sum(F.when(F.col("value") > 150, F.col("value"))).alias("v"))
    files.write_dense(cells, path, "user_id", "event_type", "v", TYPES)
    return files.read_dense(spark, path, TYPES).select("row", "col", F.round("value", 6).alias("value"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def cached_table(spark, sf):
    """A table made once, then read."""
    path = scratch(spark, "cached")
    make = lambda: t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    files.cached(spark, path, make)
    return files.cached(spark, path, lambda: make().where("false"))


def _mzml(df: DataFrame) -> DataFrame:
    """Spectra as lines of XML, a document for each task; odd ones are of level 2, the arrays are compressed in turn, and some spectra refer to groups of parameters."""

    def line(batches):
        groups = "".join(f'<referenceableParamGroup id="{name}"><cvParam name="64-bit float"/><cvParam name="{name}"/></referenceableParamGroup>' for name in ("m/z array", "intensity array"))
        levels = "".join(f'<referenceableParamGroup id="level {n}"><cvParam name="ms level" value="{n}"/></referenceableParamGroup>' for n in (1, 2))
        yield pa.RecordBatch.from_pydict({"value": [f"<mzML><referenceableParamGroupList>{groups}{levels}</referenceableParamGroupList><run><spectrumList>"]})
        for b in batches:
            out = []
            for k, values in zip(b.column("k").to_pylist(), b.column("values").to_pylist(), strict=True):
                def array(x, name, k=k):
                    raw = np.asarray(x, "<f8").tobytes()
                    kind = "zlib compression" if k % 3 == 0 else "no compression"
                    data = base64.b64encode(zlib.compress(raw) if k % 3 == 0 else raw).decode()
                    own = f'<referenceableParamGroupRef ref="{name}"/>' if k % 5 == 0 else f'<cvParam name="64-bit float"/><cvParam name="{name}"/>'
                    return f'<binaryDataArray>{own}<cvParam name="{kind}"/><binary>{data}</binary></binaryDataArray>'

                level = f'<referenceableParamGroupRef ref="level {1 + k % 2}"/>' if k % 5 == 0 else f'<cvParam name="ms level" value="{1 + k % 2}"/>'
                out.append(
                    f'<spectrum index="{k}">{level}<cvParam name="base peak m/z" value="1.0"/><cvParam name="base peak intensity" value="{max(values)}"/>'
                    f'<scanList><scan><cvParam name="scan start time" value="{k * 0.25}"/></scan></scanList><binaryDataArrayList>{array(range(len(values)), "m/z array")}{array(values, "intensity array")}</binaryDataArrayList></spectrum>'
                )
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": ["</spectrumList></run></mzML>"]})

    return df.mapInArrow(line, "value string")


@query("SELECT vec_id AS scan_idx, vec_id / 4 AS starttime, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda v: abs(v)::DOUBLE)), 4) AS total FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 2 = 0")
def mzml_scan(spark, sf):
    """Spectra of level 1 read from XML files that Spark writes."""
    path = scratch(spark, "mzml")
    e = t(spark, sf, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("k"), F.transform("embedding", lambda v: F.abs(v).cast("double")).alias("values"))
    _mzml(e).write.text(path)
    found = files.read_mzml(spark, path)
    total = F.aggregate("intarray", F.lit(0.0), lambda a, x: a + x)
    return found.select("scan_idx", "starttime", F.size("mzarray").cast("long").alias("n"), F.round(total, 4).alias("total"))
