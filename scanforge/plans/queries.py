"""Every operator as a query on the driver's tables, with SQL of the same meaning.

``events`` stand for activation series (user as candidate, minutes as time), ``embeddings``
for spectra (place as m/z, absolute value as intensity) and their labels' means for
dictionaries; ``orders`` and ``lineitem`` for reference and experiment tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanforge.functions import scalar
from scanforge.operators import aggregates as A
from scanforge.operators import compare, dictionary, joins, metrics, peaks, report, reshape, sets, smooth, solve, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.unix_micros(F.col("ts").cast("timestamp")) / 6e7
    return t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("id"), minutes.alias("t"), F.col("value").alias("v"), "event_type")


SERIES = "(SELECT event_id, user_id AS id, epoch_us(ts) / 6e7 AS t, value AS v, event_type FROM events)"


def long_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "embeddings").where("embedding is not null")
    return e.select(F.col("vec_id").alias("scan_idx"), "label", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


SPECTRA = "(SELECT vec_id AS scan_idx, label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE embedding IS NOT NULL)"
CENTROIDS = f"(SELECT label AS id, pos, avg(abs(x)) AS abundance FROM {SPECTRA} WHERE label IS NOT NULL GROUP BY ALL)"
DICT = f"(SELECT s.scan_idx, s.pos, d.id, d.abundance, s.y AS intensity FROM (SELECT scan_idx, pos, abs(x) AS y FROM {SPECTRA}) s JOIN {CENTROIDS} d USING (pos))"


def spectra_dictionary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every spectrum with the label means as its candidates: dictionary and observation."""
    s = long_spectra(spark, sf_dir)
    centres = s.where("label is not null").groupBy(F.col("label").cast("long").alias("id"), "pos").agg(F.avg(F.abs("x")).alias("abundance"))
    observed = s.select("scan_idx", F.col("pos").cast("double").alias("apex_mz"), F.abs("x").alias("intensity"))
    centres = centres.select("id", F.col("pos").cast("double").alias("apex_mz"), "abundance")
    return observed.select("scan_idx", "apex_mz").join(centres, "apex_mz").select("scan_idx", "apex_mz", "id", "abundance"), observed


ORDER_WINDOWS = "(SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) / 864e8 AS d, o_totalprice FROM orders)"


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 864e8).alias("d"), "o_totalprice")


# --- ranges and joins ---------------------------------------------------------------


@query(f"SELECT o_orderkey, d - 5 AS rt_left, d + 5 AS rt_right, d AS rt_center FROM {ORDER_WINDOWS}")
def search_range_projection(spark, sf):
    """Search ranges about a predicted time."""
    o = order_days(spark, sf).withColumnRenamed("d", "predicted_RT")
    r = scalar.search_range("pred", 5)
    return o.select("o_orderkey", r["RT_search_left"].alias("rt_left"), r["RT_search_right"].alias("rt_right"), r["RT_search_center"].alias("rt_center"))


@query(
    f"""SELECT e.event_id, w.id, w.lo, w.hi FROM {SERIES} e
    JOIN (SELECT event_id AS id, t - 20 AS lo, t + 10 AS hi FROM {SERIES} WHERE event_type = 'purchase') w ON e.t BETWEEN w.lo AND w.hi WHERE e.event_type = 'error'"""
)
def band_join_time(spark, sf):
    """Errors within the window about each purchase."""
    e = series(spark, sf)
    w = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), (F.col("t") - 20).alias("lo"), (F.col("t") + 10).alias("hi"))
    return joins.band_join(e.where("event_type = 'error'").select("event_id", "t"), w, "t", "lo", "hi", 30).select("event_id", "id", "lo", "hi")


@query(
    """SELECT p_partkey, l_orderkey, l_linenumber FROM part JOIN (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS u FROM lineitem WHERE l_quantity > 45) l
    ON u BETWEEN p_retailprice - 0.05 AND p_retailprice + 0.05"""
)
def band_join_price(spark, sf):
    """Line items whose unit price lies in a part's narrow price range."""
    p = t(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") - 0.05).alias("lo"), (F.col("p_retailprice") + 0.05).alias("hi"))
    items = t(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("u"))
    return joins.band_join(items, p, "u", "lo", "hi", 0.1).select("p_partkey", "l_orderkey", "l_linenumber")


ASOF = f"""WITH e AS (SELECT * FROM {SERIES}), l AS (SELECT id, event_id, t FROM e WHERE event_type = 'error'), r AS (SELECT id, event_id AS rid, t AS rt, v FROM e WHERE event_type = 'click'),
    b AS (SELECT l.*, r.rid AS bid, r.rt AS bt, r.v AS bv FROM l ASOF LEFT JOIN r ON l.id = r.id AND l.t >= r.rt), f AS (SELECT l.event_id, r.rid AS fid, r.rt AS ft, r.v AS fv FROM l ASOF LEFT JOIN r ON l.id = r.id AND l.t < r.rt),
    n AS (SELECT b.id, event_id, b.t, CASE WHEN ft IS NULL OR t - bt <= ft - t THEN bid ELSE fid END AS rid, CASE WHEN ft IS NULL OR t - bt <= ft - t THEN bt ELSE ft END AS rt, CASE WHEN ft IS NULL OR t - bt <= ft - t THEN bv ELSE fv END AS rv FROM b JOIN f USING (event_id))"""


def _asof(spark, sf, **options):
    e = series(spark, sf)
    right = e.where("event_type = 'click'").select("id", F.col("event_id").alias("rid"), F.col("t").alias("rt"), F.col("v").alias("rv"))
    return joins.asof_nearest(e.where("event_type = 'error'").select("id", "event_id", "t"), right, "t", "rt", ["id"], "rid", ["rid", "rt", "rv"], **options)


@query(ASOF + "SELECT id, event_id, rid, round(rt, 6) AS rt FROM n")
def asof_nearest(spark, sf):
    """The click of the same user nearest to each error."""
    return _asof(spark, sf).select("id", "event_id", "rid", F.round("rt", 6).alias("rt"))


@query(ASOF + "SELECT id, event_id, rid, coalesce(abs(t - rt) <= rv / 10, false) AS matched FROM n")
def asof_containment_flag(spark, sf):
    """Whether an error lies within the nearest click's own range."""
    near = _asof(spark, sf)
    return near.select("id", "event_id", "rid", F.coalesce(F.abs(F.col("t") - F.col("rt")) <= F.col("rv") / 10, F.lit(False)).alias("matched"))


def _two_pass_part(where: str, right: str) -> str:
    return f"""SELECT * FROM (SELECT l.id, l.event_id, r.rid, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.t - r.rt), r.rt, r.rid DESC) AS k
    FROM (SELECT id, event_id, t FROM {SERIES} WHERE event_type = 'error' AND {where}) l JOIN {right} r ON l.id = r.id AND abs(l.t - r.rt) <= 600) WHERE k = 1"""


@query(
    f"""WITH r AS (SELECT id, event_id AS rid, t AS rt FROM {SERIES} WHERE event_type = 'click'), strong AS ({_two_pass_part('v >= 50', 'r')}),
    free AS (SELECT * FROM r WHERE rid NOT IN (SELECT rid FROM strong)), weak AS ({_two_pass_part('v < 50', 'free')})
    SELECT id, event_id, rid FROM strong UNION ALL SELECT id, event_id, rid FROM weak"""
)
def asof_tolerance_two_pass(spark, sf):
    """Large errors take their nearest click first; small ones choose among the clicks that are left."""
    e = series(spark, sf)
    right = e.where("event_type = 'click'").select("id", F.col("event_id").alias("rid"), F.col("t").alias("rt"))
    left = e.where("event_type = 'error'").select("id", "event_id", "t", "v")
    return joins.asof_two_pass(left, right, "t", "rt", ["id"], ["event_id"], "rid", 600, F.col("v") >= 50).select("id", "event_id", "rid")


@query(
    """SELECT c_custkey, o_orderkey, CASE WHEN c_name IS NULL THEN 'right_only' ELSE 'both' END AS merge_flag
    FROM (SELECT * FROM customer WHERE c_acctbal > 0) c RIGHT JOIN orders ON c_custkey = o_custkey"""
)
def right_join_indicator(spark, sf):
    c = t(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    out = joins.right_join_indicator(c, t(spark, sf, "orders"), ["o_custkey"])
    return out.select(F.when(F.col("_merge") == "both", F.col("o_custkey")).alias("c_custkey"), "o_orderkey", F.col("_merge").alias("merge_flag"))


@query("SELECT c_custkey, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON o_custkey = c_custkey")
def left_join_coalesce(spark, sf):
    n = t(spark, sf, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t(spark, sf, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def natural_join(spark, sf):
    r = t(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.natural_join(t(spark, sf, "nation"), r).select("n_name", "r_name")


@query(
    """SELECT a.o_custkey, a.n, b.n AS n_exp FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b USING (o_custkey)"""
)
def suffix_join(spark, sf):
    o = t(spark, sf, "orders")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return joins.join_suffixed(n, o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n")), ["o_custkey"], "_exp")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark, sf):
    """Customers without a large order."""
    o = t(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) ON c_custkey = o_custkey")
def lateral_lookup(spark, sf):
    """Each customer's largest order."""
    best = windows.top_n(t(spark, sf, "orders"), ["o_custkey"], 1, F.desc("o_totalprice"), F.col("o_orderkey"))
    return t(spark, sf, "customer").join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query(
    """SELECT a.l_orderkey, a.l_partkey AS key_a, b.l_partkey AS key_b, count(*)::BIGINT AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
    GROUP BY ALL"""
)
def self_pair_join(spark, sf):
    pairs = joins.pair_counts(t(spark, sf, "lineitem"), ["l_orderkey"], "l_partkey")
    return pairs.select("l_orderkey", F.col("l_partkey_a").alias("key_a"), F.col("l_partkey_b").alias("key_b"), "n")


@query("SELECT row_number() OVER (ORDER BY r_regionkey, n_nationkey)::BIGINT AS task_id, r_name, n_name FROM region, nation")
def param_grid_cross(spark, sf):
    """All combinations of two small tables, numbered."""
    grid = t(spark, sf, "region").crossJoin(F.broadcast(t(spark, sf, "nation")))
    return grid.select(F.row_number().over(Window.orderBy("r_regionkey", "n_nationkey")).cast("bigint").alias("task_id"), "r_name", "n_name")


@query(f"SELECT o_orderkey, coalesce(x, d) AS d_new FROM {ORDER_WINDOWS} LEFT JOIN (SELECT l_orderkey, min(epoch_us(l_shipdate) / 864e8) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def mix_reference_coalesce(spark, sf):
    """Measured times where there are any, else predicted ones."""
    x = t(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 864e8).alias("x"))
    return order_days(spark, sf).join(x, "o_orderkey", "left").select("o_orderkey", F.coalesce("x", "d").alias("d_new"))


# --- aggregates ----------------------------------------------------------------------


@query(
    """SELECT l_partkey, first(l_suppkey ORDER BY l_orderkey, l_linenumber) AS l_suppkey, median(l_quantity) AS l_quantity_median, round(sum(l_extendedprice), 2) AS l_extendedprice_sum,
    min(l_discount) AS l_discount_min, max(l_tax) AS l_tax_max FROM lineitem GROUP BY 1"""
)
def group_sum_multi(spark, sf):
    out = A.summarise(t(spark, sf, "lineitem"), ["l_partkey"], ["l_suppkey"], ["l_orderkey", "l_linenumber"], ["l_quantity"], ["l_extendedprice"], ["l_discount"], ["l_tax"])
    return out.withColumn("l_extendedprice_sum", F.round("l_extendedprice_sum", 2))


@query("SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS decoy, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def count_mean_by_flag(spark, sf):
    out = A.target_decoy(t(spark, sf, "events"), F.when(F.col("event_type") == "error", "+"), "event_id", "value")
    return out.withColumn("mean", F.round("mean", 6))


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) = 1")
def argmin_row(spark, sf):
    return windows.argmin_rows(t(spark, sf, "lineitem"), ["l_partkey"], "l_extendedprice", "l_orderkey", "l_linenumber").select("l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT o_custkey, first(o_orderpriority ORDER BY o_orderkey) AS priority, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice <= 200000 GROUP BY 1")
def threshold_first_sum(spark, sf):
    near = t(spark, sf, "orders").where("o_totalprice <= 200000")
    return near.groupBy("o_custkey").agg(A.first_by("o_orderpriority", "o_orderkey").alias("priority"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity / 1000 AS share FROM lineitem) SELECT l_orderkey, l_linenumber, round(share, 6) AS share FROM s
    UNION ALL SELECT l_orderkey, 0, round(1 - sum(share), 6) FROM s GROUP BY 1"""
)
def residual_sentinel_union(spark, sf):
    s = t(spark, sf, "lineitem").withColumn("share", F.col("l_quantity") / 1000)
    return A.residual_rows(s, ["l_orderkey"], "l_linenumber", "share").withColumn("share", F.round("share", 6))


TRAPEZOID = f"(SELECT id, t, v, (t - lag(t) OVER w) * (v + lag(v) OVER w) / 2 AS step FROM {SERIES} WINDOW w AS (PARTITION BY id ORDER BY t))"


@query(f"SELECT id, round(coalesce(sum(step), 0), 3) AS auc FROM {TRAPEZOID} GROUP BY 1")
def trapezoid_auc(spark, sf):
    return windows.trapezoid(series(spark, sf), ["id"], "t", "v").withColumn("auc", F.round("auc", 3))


@query(f"SELECT id, floor(t / 1440)::BIGINT AS bucket, round(coalesce(sum((t - p) * (v + pv) / 2), 0), 3) AS auc FROM (SELECT *, lag(t) OVER w AS p, lag(v) OVER w AS pv FROM {SERIES} WINDOW w AS (PARTITION BY id, floor(t / 1440) ORDER BY t)) GROUP BY ALL")
def subrange_auc(spark, sf):
    """Areas within days."""
    s = series(spark, sf).withColumn("bucket", F.floor(F.col("t") / 1440))
    return windows.trapezoid(s, ["id", "bucket"], "t", "v").withColumn("auc", F.round("auc", 3))


@query(
    f"""SELECT id, round(coalesce(t - lag(t) OVER w, 0) / 2 + coalesce(lead(t) OVER w - t, 0) / 2, 6) AS weight, event_id FROM {SERIES} WINDOW w AS (PARTITION BY id ORDER BY t)"""
)
def half_gap_weights(spark, sf):
    return windows.half_gaps(series(spark, sf), "t", "weight", ["id"]).select("id", F.round("weight", 6).alias("weight"), "event_id")


@query("SELECT user_id, min(event_id) AS first, max(event_id) AS last, max(event_id) - min(event_id) + 1 AS span FROM events WHERE value > 100 GROUP BY 1")
def first_last_above_threshold(spark, sf):
    return A.first_last_above(t(spark, sf, "events"), ["user_id"], "event_id", "value", 100)


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY 1")
def value_counts_norm(spark, sf):
    return A.value_counts(t(spark, sf, "events"), "event_type").withColumn("share", F.round("share", 9))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1")
def nunique_group(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n"))


@query("SELECT user_id, event_type, floor(value)::BIGINT AS level FROM events GROUP BY ALL HAVING count(*) = 1")
def having_count_one(spark, sf):
    return t(spark, sf, "events").groupBy("user_id", "event_type", F.floor("value").alias("level")).agg(F.count("*").alias("n")).where("n = 1").drop("n")


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) = 0")
def having_zero_sum(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.sum((F.col("o_orderstatus") == "P").cast("int")).alias("n")).where("n = 0").drop("n")


@query("SELECT l_orderkey, round(sum(CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END), 2) AS total FROM lineitem GROUP BY 1")
def conditional_sum(spark, sf):
    p = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_discount").alias("pred_score"), F.col("l_extendedprice").alias("peak_intensity_auc"))
    return peaks.intensity_by_score(p, 0.05).select(F.col("id").alias("l_orderkey"), F.round("peak_intensity_auc", 2).alias("total"))


@query(
    """SELECT count(l_extendedprice) AS "count", round(avg(l_extendedprice), 4) AS mean, round(stddev(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25,
    round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, max(l_extendedprice) AS max FROM lineitem"""
)
def summary_quantiles(spark, sf):
    d = A.describe(t(spark, sf, "lineitem"), "l_extendedprice")
    return d.select("count", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", *(F.round(f"l_extendedprice_q{q}", 4).alias(f"q{q}") for q in (25, 50, 75)), "max")


@query("SELECT floor((l_extendedprice - 1000) / 5000)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_buckets(spark, sf):
    return A.histogram(t(spark, sf, "lineitem"), "l_extendedprice", 1000, 5000)


@query("SELECT p_partkey, p_type FROM part WHERE p_type IN (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 10)")
def top_values_filter(spark, sf):
    return A.top_values(t(spark, sf, "part"), "p_type", 10).select("p_partkey", "p_type")


@query(
    """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), s AS (SELECT *, sum(n) OVER (ORDER BY n DESC, p_brand) AS upto, sum(n) OVER () AS total FROM c)
    SELECT CASE WHEN upto - n >= 0.6 * total THEN 'Others' ELSE p_brand END AS p_brand, sum(n)::BIGINT AS n FROM s GROUP BY 1"""
)
def collapse_others(spark, sf):
    return report.pie(t(spark, sf, "part"), "p_brand", 0.6)


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
def set_union_lists(spark, sf):
    lists = t(spark, sf, "events").groupBy("user_id", F.floor(F.col("event_id") / 7).alias("part")).agg(F.collect_list("event_type").alias("l"))
    u = A.set_union(lists, ["user_id"], "l", "types")
    return u.select("user_id", F.array_join("types", ",").alias("types"), F.size("types").cast("long").alias("n"))


@query("SELECT n AS length, count(*) AS orders FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def list_length_distribution(spark, sf):
    lists = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("l"))
    return lists.groupBy(F.size("l").cast("long").alias("length")).agg(F.count("*").alias("orders"))


@query("SELECT round_even(p_retailprice, 0) AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def mass_collisions(spark, sf):
    return A.collisions(t(spark, sf, "part"), "p_retailprice", 0)


@query(
    """SELECT pos, neg, round(ln(pos / neg), 9) AS bias, round((pos + neg) / (2 * neg), 9) AS weight_0, round((pos + neg) / (2 * pos), 9) AS weight_1, round(pos / (pos + neg), 9) AS prior_1
    FROM (SELECT count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality = 0) AS neg FROM labels)"""
)
def class_weights(spark, sf):
    w = A.class_weights(t(spark, sf, "labels"), "quality")
    return w.select("pos", "neg", *(F.round(c, 9).alias(c) for c in ("bias", "weight_0", "weight_1", "prior_1")))


@query(
    """SELECT *, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM (
    SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn FROM labels)"""
)
def confusion_matrix(spark, sf):
    c = A.confusion(t(spark, sf, "labels"), "quality", "toxic")
    return c.select("tp", "fp", "fn", "tn", *(F.round(x, 9).alias(x) for x in ("accuracy", "precision", "recall", "f1")))


# --- windows ---------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY l_quantity = max(l_quantity) OVER (PARTITION BY l_orderkey)")
def top1_with_ties(spark, sf):
    return windows.top_with_ties(t(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3")
def topn_row_number(spark, sf):
    return windows.top_n(t(spark, sf, "events"), ["user_id"], 3, F.desc("value"), F.col("event_id")).select("user_id", "event_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 50), event_id) <= 2 AS closest FROM events")
def nsmallest_per_group(spark, sf):
    return windows.flag_n_smallest(t(spark, sf, "events"), ["user_id"], 2, "closest", F.abs(F.col("value") - 50), "event_id").select("event_id", "closest")


@query("SELECT l_orderkey, l_linenumber, round(coalesce((l_extendedprice - min(l_extendedprice) OVER w) / nullif(max(l_extendedprice) OVER w - min(l_extendedprice) OVER w, 0), 0), 9) AS scaled FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def group_minmax_scale(spark, sf):
    return windows.min_max_scale(t(spark, sf, "lineitem"), ["l_orderkey"], "l_extendedprice", "scaled").select("l_orderkey", "l_linenumber", F.round("scaled", 9).alias("scaled"))


RANKS = "(SELECT l_orderkey, l_linenumber, avg(k) OVER (PARTITION BY l_quantity) AS r FROM (SELECT *, row_number() OVER (ORDER BY l_quantity) AS k FROM lineitem))"


@query(f"SELECT l_orderkey, l_linenumber, r AS rank FROM {RANKS}")
def avg_rank(spark, sf):
    return windows.average_rank(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", "rank").select("l_orderkey", "l_linenumber", "rank")


@query(
    """SELECT count(*) AS n, round(corr(a, b), 9) AS spearman FROM (SELECT avg(x) OVER (PARTITION BY l_quantity) AS a, avg(y) OVER (PARTITION BY l_discount) AS b FROM
    (SELECT *, row_number() OVER (ORDER BY l_quantity) AS x, row_number() OVER (ORDER BY l_discount) AS y FROM lineitem))"""
)
def spearman(spark, sf):
    return metrics.spearman(t(spark, sf, "lineitem"), "l_quantity", "l_discount").withColumn("spearman", F.round("spearman", 9))


@query(
    """SELECT event_id, round(CASE WHEN n = 1 THEN 1 ELSE (1 - exp(-(n - k + 1) / n)) / (1 - exp(-1)) END, 9) AS score FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events)"""
)
def collinear_rank_score(spark, sf):
    return windows.collinear_rank(t(spark, sf, "events"), ["user_id"], "value", "score", "event_id").select("event_id", F.round("score", 9).alias("score"))


@query(f"SELECT id, event_id FROM {SERIES} WINDOW w AS (PARTITION BY id ORDER BY t) QUALIFY v > lag(v) OVER w AND v > lead(v) OVER w")
def strict_local_maxima(spark, sf):
    return windows.local_maxima(series(spark, sf), ["id"], "t", "v").select("id", "event_id")


@query(
    """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(abs(l_extendedprice - (s * l_quantity + i)), 3) AS residual FROM lineitem, f ORDER BY abs(l_extendedprice - (s * l_quantity + i)) DESC, l_orderkey, l_linenumber LIMIT 50"""
)
def global_topk_residual(spark, sf):
    r = metrics.residuals(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return metrics.extremes(r, "residual", 50, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", F.round("residual", 3).alias("residual"))


@query("SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 9) AS pearson, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def regression_line(spark, sf):
    r = metrics.regression(t(spark, sf, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice"))
    return r.select("n", F.round("pearson", 9).alias("pearson"), F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(
    """SELECT round(2 * quantile_cont(abs(l_extendedprice - l_quantity * 1500), 0.95), 4) AS width, round(corr(l_extendedprice, l_quantity * 1500), 9) AS pearson, round(avg(abs(l_extendedprice - l_quantity * 1500)), 4) AS mae FROM lineitem"""
)
def time_error_metrics(spark, sf):
    rows = t(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") * 1500)
    m = metrics.time_metrics(rows, "l_extendedprice", "p")
    return m.select(F.round("width", 4).alias("width"), F.round("pearson", 9).alias("pearson"), F.round("mae", 4).alias("mae"))


@query("SELECT o_orderkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate)) = 1")
def keep_unique_keys(spark, sf):
    o = t(spark, sf, "orders").withColumn("m", F.date_trunc("month", F.col("o_orderdate").cast("timestamp")))
    return windows.keep_unique(o, ["o_custkey", "m"]).select("o_orderkey")


# --- ranges and sets ---------------------------------------------------------------------

PAIRS = f"(SELECT o_orderkey, d - 40 AS a, d + 20 AS b, x AS c, x + 15 AS e FROM {ORDER_WINDOWS} LEFT JOIN (SELECT l_orderkey, epoch_us(l_shipdate) / 864e8 AS x FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 10) ON l_orderkey = o_orderkey)"


def range_pairs(spark, sf) -> DataFrame:
    x = t(spark, sf, "lineitem").where("l_linenumber = 1 and l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 864e8).alias("c"))
    o = order_days(spark, sf).join(x, "o_orderkey", "left")
    return o.select("o_orderkey", (F.col("d") - 40).alias("a"), (F.col("d") + 20).alias("b"), "c", (F.col("c") + 15).alias("e"))


@query(f"SELECT o_orderkey, CASE WHEN a <= c AND b >= e THEN 'full_overlap' WHEN b < c OR a > e THEN 'partial_overlap' ELSE 'no_overlap' END AS label FROM {PAIRS}")
def overlap_category(spark, sf):
    return range_pairs(spark, sf).select("o_orderkey", joins.overlap_label("a", "b", "c", "e").alias("label"))


@query(f"SELECT o_orderkey FROM {PAIRS} WHERE (a <= c AND b >= e) OR b < c OR a > e")
def overlap_filter(spark, sf):
    labelled = range_pairs(spark, sf).withColumn("RT_overlap", joins.overlap_label("a", "b", "c", "e"))
    return compare.filter_overlap(labelled).select("o_orderkey")


SETS = "(SELECT c_custkey AS k, 1 AS a, 0 AS b, 0 AS c FROM customer WHERE c_acctbal > 3000 UNION ALL SELECT o_custkey, 0, 1, 0 FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT o_custkey, 0, 0, 1 FROM orders WHERE o_orderstatus = 'P')"


def _key_sets(spark, sf) -> dict[str, DataFrame]:
    o = t(spark, sf, "orders")
    return {
        "a": t(spark, sf, "customer").where("c_acctbal > 3000").select(F.col("c_custkey").alias("k")), "b": o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")),
        "c": o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")),
    }


@query(f"SELECT a, b, count(*) AS n FROM (SELECT max(a) AS a, max(b) AS b FROM {SETS} WHERE a + b > 0 GROUP BY k) GROUP BY ALL")
def venn2_counts(spark, sf):
    s = _key_sets(spark, sf)
    return sets.venn({k: s[k] for k in ("a", "b")}, "k")


@query(f"SELECT a, b, c, count(*) AS n FROM (SELECT max(a) AS a, max(b) AS b, max(c) AS c FROM {SETS} GROUP BY k) GROUP BY ALL")
def venn3_counts(spark, sf):
    return sets.venn(_key_sets(spark, sf), "k")


@query(f"WITH p AS (SELECT o_orderkey, floor(a) AS a, floor(b) AS b, floor(c) AS c, floor(e) AS e FROM {PAIRS} WHERE c IS NOT NULL), s AS (SELECT *, greatest(0, least(b, e) - greatest(a, c)) AS i FROM p) SELECT o_orderkey, round(i / (b - a + e - c - i), 9) AS jaccard FROM s")
def interval_jaccard(spark, sf):
    p = range_pairs(spark, sf).where("c is not null")
    return p.select("o_orderkey", F.round(sets.range_jaccard(F.floor("a"), F.floor("b"), F.floor("c"), F.floor("e")), 9).alias("jaccard"))


@query(
    """WITH s AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS m FROM lineitem WHERE l_quantity > 40), z AS (SELECT g, count(*) AS n FROM s GROUP BY 1), p AS (SELECT x.g AS a, y.g AS b, count(*) AS shared FROM s x JOIN s y ON x.m = y.m AND x.g < y.g GROUP BY ALL)
    SELECT a, b, shared, u.n + v.n - shared AS either, round(shared / (u.n + v.n - shared), 9) AS jaccard FROM p JOIN z u ON u.g = a JOIN z v ON v.g = b"""
)
def support_jaccard(spark, sf):
    return sets.support_jaccard(t(spark, sf, "lineitem").where("l_quantity > 40"), "l_suppkey", "l_partkey").withColumn("jaccard", F.round("jaccard", 9))


# --- reshaping -------------------------------------------------------------------------------

TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "SELECT user_id, " + ", ".join(f"round(sum(value) FILTER (event_type = '{e}'), 4) AS \"{e}\"" for e in TYPES) + " FROM events GROUP BY 1"
)
def pivot_wide(spark, sf):
    w = reshape.to_wide(t(spark, sf, "events"), ["user_id"], "event_type", "value", TYPES)
    return w.select("user_id", *(F.round(c, 4).alias(c) for c in TYPES))


@query("SELECT l_orderkey, l_linenumber, name, value FROM lineitem UNPIVOT (value FOR name IN (l_quantity, l_discount, l_tax))")
def unpivot_long(spark, sf):
    return reshape.to_long(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "name", "value")


@query(f"SELECT scan_idx, pos::INTEGER AS pos, x, abs(x) AS y FROM {SPECTRA}")
def explode_pairs(spark, sf):
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("scan_idx"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return reshape.explode_pairs(e.withColumn("y", F.transform("x", lambda v: F.abs(v))), ["scan_idx"], ["x", "y"])


@query("SELECT event_id, 1 AS half FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 2 FROM events WHERE value > 10")
def unioned_all(spark, sf):
    e = t(spark, sf, "events")
    return e.where("event_id % 2 = 0").select("event_id", F.lit(1).alias("half")).unionByName(e.where("value > 10").select("event_id", F.lit(2).alias("half")))


def _array_sql(expression: str) -> str:
    return f"SELECT scan_idx, round(sum(y * (i + 1)), 4) AS weighted, count(*) AS n FROM (SELECT vec_id AS scan_idx, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS y FROM (SELECT vec_id, {expression} AS a FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings))) GROUP BY 1"


def _weighted(df: DataFrame, values) -> DataFrame:
    long = df.select(F.col("vec_id").alias("scan_idx"), F.posexplode(values).alias("i", "y"))
    return long.groupBy("scan_idx").agg(F.round(F.sum(F.col("y") * (F.col("i") + 1)), 4).alias("weighted"), F.count("*").alias("n"))


def _vectors(spark, sf) -> DataFrame:
    return t(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))


@query(_array_sql("list_transform(e, lambda v: (v - list_avg(e)) / list_stddev_pop(e))"))
def row_zscore(spark, sf):
    return _weighted(_vectors(spark, sf), reshape.z_score(F.col("e")))


@query(_array_sql("list_transform(e, lambda v: (v - list_min(e)) / (list_max(e) - list_min(e)))"))
def row_minmax(spark, sf):
    return _weighted(_vectors(spark, sf), reshape.min_max(F.col("e")))


@query(_array_sql("list_concat([-1.0, -1.0], list_concat(list_transform(e[11:30], lambda v, i: CASE WHEN i BETWEEN 6 AND 15 THEN v ELSE 0 END), [-1.0, -1.0, -1.0]))"))
def roi_mask_clip_pad(spark, sf):
    """Places 10 to 29, zero outside 15 to 24, padded on both sides to 25."""
    masked = reshape.mask_range(F.col("e"), F.lit(15), F.lit(24))
    return _weighted(_vectors(spark, sf), reshape.pad_both(reshape.clip_range(masked, F.lit(10), F.lit(29)), 25))


# --- spectra -----------------------------------------------------------------------------------

ACTIVATION = f"(SELECT scan_idx, id, sum(abundance * intensity) AS act FROM {DICT} GROUP BY ALL)"
FIT = f"(SELECT scan_idx, pos, any_value(intensity) AS y, sum(abundance * act) AS fit FROM {DICT} JOIN {ACTIVATION} USING (scan_idx, id) GROUP BY ALL)"


@query(f"SELECT scan_idx, id::BIGINT AS id, round(act, 6) AS activation FROM {ACTIVATION}")
def threshold_activation(spark, sf):
    d, y = spectra_dictionary(spark, sf)
    return solve.threshold_activation(d, y).withColumn("activation", F.round("activation", 6))


@query(f"SELECT scan_idx, id::BIGINT AS id, round(greatest(act - 0.7, 0), 6) AS activation FROM {ACTIVATION}")
def soft_threshold_activation(spark, sf):
    d, y = spectra_dictionary(spark, sf)
    return solve.threshold_activation(d, y, 0.7).withColumn("activation", F.round("activation", 6))


@query(
    f"""SELECT scan_idx, round(sqrt(avg((y - fit) * (y - fit))), 6) AS rmse, round(1 - sum(y * fit) / sqrt(sum(y * y) * sum(fit * fit)), 6) AS cos_dist, round(sum(fit) / sum(y), 6) AS intensity_explained FROM {FIT} GROUP BY 1"""
)
def reconstruction_metrics(spark, sf):
    d, y = spectra_dictionary(spark, sf)
    m = solve.fit_metrics(solve.reconstruct(d, solve.threshold_activation(d, y), y))
    return m.select("scan_idx", *(F.round(c, 6).alias(c) for c in ("rmse", "cos_dist", "intensity_explained")))


@query(
    f"""SELECT scan_idx, id::BIGINT AS id, round(1 - sum(l * abundance) / sqrt(sum(l * l) * sum(abundance * abundance)), 6) AS cos_dist FROM
    (SELECT d.scan_idx, d.id, abundance, y - fit + abundance * act AS l FROM {DICT} d JOIN {ACTIVATION} a USING (scan_idx, id) JOIN {FIT} f USING (scan_idx, pos)) GROUP BY ALL"""
)
def leave_one_out_cosine(spark, sf):
    d, y = spectra_dictionary(spark, sf)
    act = solve.threshold_activation(d, y)
    return solve.leave_one_out(d, act, solve.reconstruct(d, act, y)).withColumn("cos_dist", F.round("cos_dist", 6))


CORRELATION = f"(SELECT a.id AS a, b.id AS b, corr(a.abundance, b.abundance) AS r FROM {CENTROIDS} a JOIN {CENTROIDS} b ON a.pos = b.pos AND a.id < b.id GROUP BY ALL HAVING corr(a.abundance, b.abundance) >= 0.05)"


def _label_links(spark, sf) -> DataFrame:
    d, _ = spectra_dictionary(spark, sf)
    one = d.groupBy("id", "apex_mz").agg(F.first("abundance").alias("abundance")).withColumn("scan_idx", F.lit(0).cast("long"))
    sizes = one.groupBy("scan_idx").agg(F.count_distinct("apex_mz").alias("n"))
    return dictionary.feature_correlation(one, sizes, 0.05)


@query(f"SELECT a::BIGINT AS a, b::BIGINT AS b, round(r, 6) AS r FROM {CORRELATION}")
def pairwise_pearson(spark, sf):
    return _label_links(spark, sf).select("a", "b", F.round("r", 6).alias("r"))


@query(f"SELECT id::BIGINT AS id, string_agg(o::VARCHAR, ',' ORDER BY o) AS neighbours FROM (SELECT a AS id, b AS o FROM {CORRELATION} UNION ALL SELECT b, a FROM {CORRELATION}) GROUP BY 1")
def collinear_neighbours(spark, sf):
    return dictionary.neighbours(_label_links(spark, sf)).select("id", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT a, b FROM {CORRELATION} UNION ALL SELECT b, a FROM {CORRELATION}), r AS (SELECT DISTINCT a AS id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
    SELECT id::BIGINT AS id, min(c)::BIGINT AS component FROM r GROUP BY 1"""
)
def connected_components(spark, sf):
    return dictionary.components(_label_links(spark, sf)).select("id", "component")


@query(
    f"""WITH s AS (SELECT id, event_id, t, v FROM {SERIES} WHERE v <> 0), g AS (SELECT id FROM s GROUP BY 1 HAVING count(*) > 2 AND sum(v) > 0),
    w AS (SELECT a.id, a.event_id, b.v, b.t, exp(-(b.t - a.t) * (b.t - a.t) / (2 * 120.0 * 120.0)) AS k FROM s a JOIN s b ON a.id = b.id), n AS (SELECT *, sum(k) OVER (PARTITION BY event_id) AS total FROM w)
    SELECT id, event_id AS scan_idx, round(sum(round_even(v * k / total, 0)), 3) AS activation FROM n WHERE id IN (SELECT id FROM g) GROUP BY ALL"""
)
def gaussian_smooth(spark, sf):
    s = series(spark, sf).select("id", F.col("event_id").alias("scan_idx"), F.col("t").alias("starttime"), F.col("v").alias("activation"))
    return smooth.gaussian_smooth(s, 120.0).select("id", "scan_idx", F.round("activation", 3).alias("activation"))


@query()
def nnlasso_cd(spark, sf):
    """Non-negative lasso of every spectrum on the label means, alpha chosen on a path."""
    d, y = spectra_dictionary(spark, sf)
    return solve.lasso_activation(d, y, [0.01, 0.1]).select("scan_idx", "id", F.round("activation", 5).alias("activation"), "alpha")


@query()
def spectrum_peak_picking(spark, sf):
    """Peaks, plateaus included, of every embedding read as a spectrum."""
    e = t(spark, sf, "embeddings").where("embedding is not null")
    scans = e.select(F.col("vec_id").alias("scan_idx"), F.transform("embedding", lambda v, i: i.cast("double")).alias("mzarray"), F.transform("embedding", lambda v: F.abs(v).cast("double")).alias("intarray"))
    return dictionary.scan_peaks(scans)


def _hourly(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Activation of each user by the hour, the hours as scans, and a centre for each user."""
    s = series(spark, sf).withColumn("scan_idx", F.floor(F.col("t") / 60))
    act = s.groupBy("id", "scan_idx").agg(F.sum("v").alias("activation")).withColumn("starttime", F.col("scan_idx") * 60.0)
    return act, act.select("scan_idx", "starttime").distinct(), s.groupBy("id").agg(F.avg("t").alias("RT_search_center"))


@query()
def elution_peaks(spark, sf):
    """Elution peaks of hourly series with areas and the one nearest to the user's mean time."""
    act, scans, centres = _hourly(spark, sf)
    return peaks.elution_peaks(act, scans, centres)


@query()
def local_minima_repair(spark, sf):
    """Hourly series with narrow minima filled."""
    act, scans, _ = _hourly(spark, sf)
    return smooth.local_minima_smooth(act, scans, 3, 20.0)


# --- scalars ----------------------------------------------------------------------------------------


@query(
    "WITH s AS (SELECT event_id, (user_id * 2654435761) % 1000 / 1000 AS u FROM events) SELECT event_id, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.4 THEN 'val' ELSE 'train' END AS split FROM s"
)
def grouped_hash_split(spark, sf):
    return windows.hash_split(t(spark, sf, "events"), "user_id", 0.2, 0.2).select("event_id", "split")


@query("SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n_the, length(replace(text, 'tion', '')) AS rest FROM documents")
def sequence_marker_counts(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", F.regexp_count("text", F.lit("the")).cast("long").alias("n_the"), F.length(F.replace("text", F.lit("tion"), F.lit(""))).cast("long").alias("rest"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half FROM lineitem")
def rounding_half_even(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scalar.round_even(F.col("l_quantity") / 2).alias("half"))


@query(
    """SELECT o_orderkey, a AS n_by_rt, b AS n_filtered, round(b / nullif(a, 0), 9) AS filter_ratio, b <= 1 AS is_empty FROM (SELECT o_orderkey, count(l_partkey)::INTEGER AS a, count(l_partkey) FILTER (l_quantity > 25)::INTEGER AS b FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"""
)
def scan_report(spark, sf):
    items = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_partkey").alias("candidates_by_rt"), F.collect_list(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("filtered_candidates"))
    r = report.scan_report(t(spark, sf, "orders").select("o_orderkey").join(items, "o_orderkey", "left"))
    return r.select("o_orderkey", "n_by_rt", "n_filtered", F.round("filter_ratio", 9).alias("filter_ratio"), "is_empty")


@query("SELECT p_partkey, reverse(left(p_name, length(p_name) - 1)) || right(p_name, 1) AS decoy, p_name || p_size AS key FROM part")
def decoys_and_keys(spark, sf):
    p = t(spark, sf, "part")
    return p.select("p_partkey", scalar.decoy_sequence(F.col("p_name")).alias("decoy"), scalar.composite_key(F.col("p_name"), F.col("p_size")).alias("key"))


@query()
def activation_pipeline(spark, sf):
    """From spectra to quantities in one plan: peaks, candidates by time, isotope matches, dictionary, activation, sums.

    Embeddings are the spectra, one each minute; every part is a candidate whose search range
    and pattern follow from its key.
    """
    e = t(spark, sf, "embeddings").where("embedding is not null")
    scans = e.select(
        F.col("vec_id").alias("scan_idx"), (F.col("vec_id") * 1.0).alias("starttime"), F.transform("embedding", lambda v, i: i.cast("double")).alias("mzarray"),
        F.transform("embedding", lambda v: F.abs(v).cast("double")).alias("intarray"),
    )
    key = F.col("p_partkey")
    reference = t(spark, sf, "part").select(
        key.alias("id"), (key % 500 - 3.0).alias("RT_search_left"), (key % 500 + 3.0).alias("RT_search_right"),
        F.array(*((key * k % 61 + 1.5).cast("double") for k in (3, 7, 11))).alias("IsoMZ"), F.array(F.lit(0.6), F.lit(0.3), F.lit(0.1)).alias("IsoAbundance"),
    )
    found = dictionary.scan_peaks(scans)
    matches = dictionary.match_isotopes(dictionary.candidates_by_time(scans, reference, 6.0), found)
    act = solve.threshold_activation(dictionary.build_dictionary(matches, 0.5), dictionary.observations(found))
    return act.groupBy("id").agg(F.round(F.sum("activation"), 6).alias("SumActivation"), F.count("*").alias("n_scans"))
