"""Fitted models as queries on the driver's tables: calibration, path and pursuit, gradients of networks.

Order days stand for predicted times, shipping days for measured ones, return flags for runs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.functions import network as N
from scanforge.functions.kernels import ISOTOPES, RESIDUES
from scanforge.operators import calibration, joins, network, solve
from scanforge.plans.queries import DICT, QUERIES, SPECTRA, SQL, query, spectra_dictionary, t
from scanforge.sources import files

__all__ = ["QUERIES", "SQL"]

CELLS = 40
SHIPPED = "(SELECT l_returnflag AS run, l_orderkey, l_linenumber, epoch_us(o_orderdate) / 864e8 AS x, epoch_us(l_shipdate) / 864e8 + l_quantity::DOUBLE AS y FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
PLACED = f"(SELECT *, least(floor((x - low) / ((high - low) / {CELLS})), {CELLS - 1})::BIGINT AS cell, (x - low) / ((high - low) / {CELLS}) AS place FROM (SELECT *, min(x) OVER (PARTITION BY run) AS low, max(x) OVER (PARTITION BY run) AS high FROM {SHIPPED}))"


def _shipped(spark, sf) -> DataFrame:
    days = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 864e8
    both = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(F.col("l_returnflag").alias("run"), "l_orderkey", "l_linenumber", days("o_orderdate").alias("x"), (days("l_shipdate") + F.col("l_quantity").cast("double")).alias("y"))


@query(
    f"""SELECT run, cell, count(*)::DOUBLE AS n, {", ".join(f"round(sum((place - cell) ** {i}), 4) AS u{i}" for i in range(1, 7))}, {", ".join(f"round(sum(y * (place - cell) ** {i}), 2) AS t{i}" for i in range(4))} FROM {PLACED} GROUP BY ALL"""
)
def calibration_sums(spark, sf):
    """Power sums of each cell, of which a spline's equations are made."""
    s = calibration.cell_sums(_shipped(spark, sf), "x", "y", ["run"], CELLS)
    return s.select("run", "cell", "n", *(F.round(f"u{i}", 4).alias(f"u{i}") for i in range(1, 7)), *(F.round(f"t{i}", 2).alias(f"t{i}") for i in range(4)))


@query(
    f"""WITH p AS MATERIALIZED (SELECT * FROM {PLACED}), c AS (SELECT run, cell, count(*) AS n, avg(x) AS x, avg(y) AS y FROM p GROUP BY ALL),
    s AS (SELECT *, row_number() OVER w AS j, sum(n) OVER w AS cn, sum(n * y) OVER w AS cy FROM c WINDOW w AS (PARTITION BY run ORDER BY cell)),
    m AS (SELECT i.run, i.j, a.j AS a, min((b.cy - a.cy + a.n * a.y) / (b.cn - a.cn + a.n)) AS v FROM s i JOIN s a ON a.run = i.run AND a.j <= i.j JOIN s b ON b.run = i.run AND b.j >= i.j GROUP BY ALL),
    k AS MATERIALIZED (SELECT run, j, x, v, lead(x) OVER w AS x2, lead(v) OVER w AS v2, count(*) OVER (PARTITION BY run) AS m FROM (SELECT run, j, max(v) AS v FROM m GROUP BY ALL) JOIN s USING (run, j) WINDOW w AS (PARTITION BY run ORDER BY j)),
    f AS (SELECT p.run, l_orderkey, l_linenumber, p.x, coalesce(k.j, 1) AS j FROM p ASOF LEFT JOIN k ON k.run = p.run AND p.x >= k.x),
    l AS (SELECT run, max(m) AS m FROM k GROUP BY 1)
    SELECT l_orderkey, l_linenumber, round(k.v + (f.x - k.x) * (k.v2 - k.v) / (k.x2 - k.x), 5) AS calibrated FROM f JOIN l USING (run) JOIN k ON k.run = f.run AND k.j = least(f.j, l.m - 1)"""
)
def calibrated_times(spark, sf):
    """Every shipping day by the monotone curve of its run."""
    rows = _shipped(spark, sf)
    curves = calibration.fit_calibration(rows, "x", "y", ["run"], "monotone", CELLS)
    return calibration.apply_calibration(rows, curves, "x", ["run"], "calibrated").select("l_orderkey", "l_linenumber", F.round("calibrated", 5).alias("calibrated"))


@query()
def spline_times(spark, sf):
    """Every shipping day by the smoothing spline of its run, whose strength is chosen by cross-validation."""
    rows = _shipped(spark, sf)
    curves = calibration.fit_calibration(rows, "x", "y", ["run"], "spline", CELLS)
    return calibration.apply_calibration(rows, curves, "x", ["run"], "calibrated").select("l_orderkey", "l_linenumber", F.round("calibrated", 3).alias("calibrated"))


PROJECTION = f"(SELECT scan_idx, id, sum(abundance * intensity) AS c, sum(abundance * abundance) AS g FROM {DICT} GROUP BY ALL)"


@query(f"SELECT scan_idx, id::BIGINT AS id, round(c / g, 6) AS activation FROM {PROJECTION} WHERE c > 0 QUALIFY row_number() OVER (PARTITION BY scan_idx ORDER BY round(c / sqrt(g), 9) DESC, id) = 1")
def pursuit_first(spark, sf):
    """The one candidate that a pursuit takes first, with its activation."""
    d, y = spectra_dictionary(spark, sf)
    return solve.pursuit_activation(d, y, 1).select("scan_idx", "id", F.round("activation", 6).alias("activation"))


@query()
def omp_activation(spark, sf):
    """Pursuit of every spectrum with at most three candidates."""
    d, y = spectra_dictionary(spark, sf)
    return solve.pursuit_activation(d, y, 3).select("scan_idx", "id", F.round("activation", 5).alias("activation"))


@query(f"SELECT scan_idx, round(max(c), 6) AS first_alpha FROM {PROJECTION} GROUP BY 1 HAVING max(c) > 0")
def path_start(spark, sf):
    """The penalty at which the first candidate of a spectrum becomes active."""
    d, y = spectra_dictionary(spark, sf)
    return solve.lasso_path(d, y).groupBy("scan_idx").agg(F.round(F.max(F.get("alphas", F.lit(0))), 6).alias("first_alpha"))


@query()
def lasso_path(spark, sf):
    """Activations of every spectrum at three penalties, read from one path each."""
    d, y = spectra_dictionary(spark, sf)
    return solve.activation_at(solve.lasso_path(d, y), 0.0, 0.01, 0.1).withColumn("activation", F.round("activation", 5))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderpriority AS run, epoch_us(o_orderdate) / 864e8 AS d FROM orders),
    s AS (SELECT DISTINCT o_orderpriority AS run, epoch_us(l_shipdate) / 864e8 AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 48),
    b AS (SELECT o.*, s AS bs FROM o ASOF LEFT JOIN s ON s.run = o.run AND d >= s), f AS (SELECT o_orderkey, s AS fs FROM o ASOF LEFT JOIN s ON s.run = o.run AND d < s)
    SELECT o_orderkey, run, (CASE WHEN bs IS NULL OR (fs IS NOT NULL AND fs - d < d - bs) THEN fs ELSE bs END)::BIGINT AS scan FROM b JOIN f USING (o_orderkey)"""
)
def nearest_scan_of_run(spark, sf):
    """The shipping day nearest to each order, of its own run (priority)."""
    days = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 864e8
    orders = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("run"), days("o_orderdate").alias("d"))
    shipped = t(spark, sf, "lineitem").where("l_quantity > 48").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("run", days("l_shipdate").alias("starttime")).distinct()
    found = joins.nearest_scan(orders, shipped.withColumn("scan_idx", F.col("starttime").cast("long")), ["d"], by=["run"])
    return found.select("o_orderkey", "run", F.col("d_scan").alias("scan"))


STEP = 0.05
LOGITS = f"(SELECT vec_id, (label = 0)::INT AS y, embedding, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * ((i - 1) % 7 - 3) * {STEP}::DOUBLE)) + 0.1::DOUBLE AS z FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)"


@query(
    f"""WITH r AS (SELECT 1 / (1 + exp(-z)) - y AS d, ln(1 + exp(z)) - y * z AS loss, embedding FROM {LOGITS}),
    g AS (SELECT i - 1 AS place, sum(d * embedding[i]::DOUBLE) AS g FROM (SELECT d, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM r) GROUP BY 1)
    SELECT place::BIGINT AS place, round(g, 6) AS gradient FROM g UNION ALL SELECT -1, round(sum(d), 6) FROM r UNION ALL SELECT -2, round(sum(loss), 6) FROM r"""
)
def network_gradient(spark, sf):
    """Loss (place -2) and its gradient by bias (-1) and weights of one layer over all vectors, summed over partitions."""
    e = t(spark, sf, "embeddings").where("embedding is not null and label is not null")
    rows = e.select(F.array().cast("array<double>").alias("x"), F.col("embedding").cast("array<double>").alias("e"), (F.col("label") == 0).cast("double").alias("y"), F.lit(1.0).alias("w"))
    shape = N.Shape(1, 1, (), len(e.first()["embedding"]), ())
    weights = np.append((np.arange(shape.extra) % 7 - 3) * STEP, 0.1)
    net = network.Network(shape, weights)
    _, loss, g = network.gradient_sums(rows, net)
    found = [*enumerate(g[:-1].tolist()), (-1, float(g[-1])), (-2, loss)]
    return spark.createDataFrame(found, "place long, gradient double").withColumn("gradient", F.round("gradient", 6))


#: Kernel, bias and output of a network of one filter.
KERNEL, BIAS, OUT, BESIDE, SHIFT = (0.8, -1.1, 0.6), 0.02, 3.0, 0.05, -0.3


@query(
    f"""WITH e AS (SELECT vec_id, coalesce(label, 0)::DOUBLE AS beside, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL),
    h AS (SELECT vec_id, beside, list_avg(list_transform(range(1, len(x) + 1), lambda i: greatest(0.0, {KERNEL[0]} * CASE WHEN i > 1 THEN x[i - 1] ELSE 0 END + {KERNEL[1]} * x[i] + {KERNEL[2]} * CASE WHEN i < len(x) THEN x[i + 1] ELSE 0 END + {BIAS}))) AS h FROM e)
    SELECT vec_id, round(1 / (1 + exp(-({OUT} * h + {BESIDE} * beside + {SHIFT}))), 6) AS score FROM h"""
)
def network_scores(spark, sf):
    """Every vector scored by a convolution over its values beside its label."""
    e = t(spark, sf, "embeddings").where("embedding is not null").select("vec_id", "embedding", F.array(F.coalesce(F.col("label"), F.lit(0)).cast("double")).alias("beside"))
    shape = N.Shape(len(e.first()["embedding"]), 1, ((1, 3),), 1, ())
    net = network.Network(shape, np.array([*KERNEL, BIAS, OUT, BESIDE, SHIFT]))
    return network.score_network(net, e, "embedding", "beside", "score").select("vec_id", F.round("score", 6).alias("score"))


LETTERS = "ACDEFGHIKL"
ATOMS = " UNION ALL ".join(f"SELECT '{r}' AS r, {', '.join(f'{n} AS {a}' for n, a in zip(counts, 'chnos', strict=True))}" for r, counts in RESIDUES.items())
LIGHT = {e: v[0] for e, v in ISOTOPES.items()}


@query(
    f"""WITH s AS (SELECT p_partkey, translate(p_partkey::VARCHAR, '0123456789', '{LETTERS}') || 'K' AS seq, p_size % 3 + 1 AS charge FROM part),
    r AS (SELECT p_partkey, charge, unnest(string_split(seq, '')) AS r FROM s), f AS ({ATOMS}),
    n AS (SELECT p_partkey, charge, sum(c) + 2 * count(*) FILTER (r = 'C') AS nc, sum(h) + 3 * count(*) FILTER (r = 'C') + 2 + charge AS nh, sum(n) + count(*) FILTER (r = 'C') AS nn, sum(o) + count(*) FILTER (r = 'C') + 1 AS no, sum(s) AS ns FROM r JOIN f USING (r) GROUP BY p_partkey, charge)
    SELECT p_partkey, round(({" + ".join(f"n{e.lower()} * {m}::DOUBLE" for e, (m, _) in LIGHT.items())}) / charge, 6) AS mz, round({" * ".join(f"{p}::DOUBLE ** n{e.lower()}" for e, (_, p) in LIGHT.items())}, 6) AS abundance FROM n"""
)
def lightest_isotopes(spark, sf):
    """The lightest isotopologue of a peptide made of each part's number: m/z and probability."""
    rows = t(spark, sf, "part").select("p_partkey", F.concat(F.translate(F.col("p_partkey").cast("string"), "0123456789", LETTERS), F.lit("K")).alias("seq"), (F.col("p_size") % 3 + 1).alias("charge"))
    found = files.isotope_patterns(rows, "seq", "charge", 0.005)
    return found.select("p_partkey", F.round(F.get("IsoMZ", F.lit(0)), 6).alias("mz"), F.round(F.get("IsoAbundance", F.lit(0)), 6).alias("abundance"))


@query(f"SELECT scan_idx, round(avg(x * x), 6) AS error FROM {SPECTRA} GROUP BY 1")
def cross_validated_error(spark, sf):
    """Held-out error of every spectrum at a penalty under which nothing is active: its mean square, whatever the folds."""
    d, y = spectra_dictionary(spark, sf)
    return solve.cross_validated_alpha(d, y, [0.01, 1e9], 4, "lasso_lars").where("alpha = 1e9").select("scan_idx", F.round("error", 6).alias("error"))
