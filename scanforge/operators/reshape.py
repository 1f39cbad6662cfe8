"""Between wide, long and array forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_pairs(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each place of parallel arrays, with ``pos`` from 0."""
    zipped = F.posexplode(F.arrays_zip(*(F.col(c) for c in columns))).alias("pos", "_z")
    return df.select(*keys, zipped).select(*keys, "pos", *(F.col("_z")[c].alias(c) for c in columns))


def to_wide(df: DataFrame, index: list[str], column: str, value: str, names: list) -> DataFrame:
    """One column of sums for each of ``names``; name them, as a plan should not depend on the data."""
    return df.groupBy(*index).pivot(column, names).agg(F.sum(value))


def to_long(df: DataFrame, index: list[str], values: list[str], name: str, value: str) -> DataFrame:
    """One row for each non-null value."""
    return df.unpivot([F.col(i) for i in index], [F.col(v) for v in values], name, value).where(F.col(value).isNotNull())


def clip_range(values: Column, low: Column, high: Column) -> Column:
    """Elements from index ``low`` to ``high``, both included, counted from 0; what lies outside is left out."""
    first, last = F.greatest(low, F.lit(0)), F.least(high, F.size(values) - 1)
    return F.slice(values, (first + 1).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int"))


def mask_range(values: Column, low: Column, high: Column) -> Column:
    """Elements outside index ``low`` to ``high`` set to 0."""
    return F.transform(values, lambda v, i: F.when((i >= low) & (i <= high), v).otherwise(F.lit(0.0)))


def pad_after(values: Column, length: int, fill: float = -1.0) -> Column:
    """At least ``length`` elements, filled at the end."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(F.lit(length) - F.size(values), F.lit(0)).cast("int")))


def pad_both(values: Column, length: int, fill: float = -1.0) -> Column:
    """``length`` elements: filled on both sides, the odd one at the end, or the middle if longer."""
    n = F.size(values)
    missing = F.lit(length) - n
    left = F.floor(missing / 2).cast("int")
    wide = F.concat(F.array_repeat(F.lit(fill), F.greatest(left, F.lit(0))), values, F.array_repeat(F.lit(fill), F.greatest(missing - left, F.lit(0)).cast("int")))
    skip = F.floor((n - F.lit(length)) / 2).cast("int")
    return F.when(missing >= 0, wide).otherwise(F.slice(values, F.greatest(skip, F.lit(0)) + 1, length))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once; an expression inside a lambda is computed for each element."""
    return F.transform(F.array(value), use)[0]


def z_score(values: Column) -> Column:
    """Elements less their mean, over the population deviation (1 where that is 0)."""

    def scale(m):
        def by(sd):
            return F.transform(values, lambda x: (x - m) / sd)

        var = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(values)
        return _bound(F.when(var > 0, F.sqrt(var)).otherwise(F.lit(1.0)), by)

    return _bound(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values), scale)


def min_max(values: Column) -> Column:
    """Elements scaled to 0..1; all 0 where they are equal."""

    def scale(b):
        return F.transform(values, lambda x: F.coalesce(F.try_divide(x - b["low"], b["high"] - b["low"]), F.lit(0.0)))

    return _bound(F.struct(F.array_min(values).alias("low"), F.array_max(values).alias("high")), scale)


def columns_at(df: DataFrame, places: list[int]) -> DataFrame:
    """The columns at the given places, from 0."""
    return df.select(*(F.col(f"`{df.columns[i]}`") for i in places))


def index_of(values: Column, x: Column) -> Column:
    """The place of the first element equal to ``x``, from 0; null where there is none."""
    return F.nullif(F.array_position(values, x), F.lit(0)) - 1
