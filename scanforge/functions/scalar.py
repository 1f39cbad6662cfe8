"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of an overlap that count as one.
MEETING = ("full_overlap", "partial_overlap")


def marker_counts(sequence: Column) -> list[Column]:
    """Oxidations, acetyl groups and cysteines of a modified sequence."""
    return [
        F.regexp_count(sequence, F.lit(r"M\(ox\)")).alias("n_ox"), F.regexp_count(sequence, F.lit(r"\(ac\)")).alias("n_ac"), F.regexp_count(bare_sequence(sequence), F.lit("C")).alias("n_cys"),
    ]


def bare_sequence(sequence: Column) -> Column:
    """A sequence without modification markers and flanking underscores."""
    return F.regexp_replace(sequence, r"\(ox\)|\(ac\)|_", "")


def decoy_sequence(sequence: Column) -> Column:
    """The sequence reversed but for its last residue."""
    n = F.length(sequence)
    return F.concat(F.reverse(F.substring(sequence, F.lit(1), n - 1)), F.substring(sequence, n, F.lit(1)))


def composite_key(sequence: Column, charge: Column) -> Column:
    return F.concat(sequence, charge.cast("string"))


def round_even(x: Column, digits: int = 0) -> Column:
    """Rounded half to even, as ``numpy.round``; plain ``round`` rounds half up."""
    return F.rint(x) if digits == 0 else F.bround(x, digits)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def gauss(x: Column, scale: float, rate: float) -> Column:
    return scale * F.exp(-rate * x * x)


def percent(part: Column, whole: Column) -> Column:
    """``12.3% (45)``."""
    return F.format_string("%.1f%% (%d)", F.try_divide(100.0 * part, whole), part.cast("long"))


def length_or_zero(values: Column) -> Column:
    return F.when(values.isNull(), 0).otherwise(F.size(values))


def search_range(mode: str, tolerance: float) -> dict[str, Column]:
    """Search bounds and centre by ``exp`` (measured), ``pred`` (predicted) or ``mix`` (given) times."""
    if mode == "exp":
        left, right, centre = F.col("Calibrated retention time start") - tolerance, F.col("Calibrated retention time finish") + tolerance, F.col("Calibrated retention time")
    elif mode in ("pred", "mix"):
        centre = F.col("predicted_RT" if mode == "pred" else "Retention time new")
        left, right = centre - tolerance, centre + tolerance
    else:
        raise ValueError(f"unknown mode {mode}")
    return {"RT_search_left": left, "RT_search_right": right, "RT_search_center": centre}


def deterministic_sample(key: Column, fraction: float, seed: int = 0) -> Column:
    """True for about ``fraction`` of the keys, the same ones on every run; its negation is the rest."""
    return F.conv(F.substring(key_digest(key, seed), 1, 8), 16, 10).cast("long") < int(fraction * 2**32)


def key_digest(key: Column, seed: int = 0) -> Column:
    """A digest of a key's text and a seed, which puts keys in an order that has nothing to do with them."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")).cast("binary"))
