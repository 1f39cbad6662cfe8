"""Set overlap of keys and of ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def venn(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Number of distinct keys in each region: a 0/1 column for each set and ``n``."""
    tagged = [df.select(F.col(key).alias("_key"), *(F.lit(int(name == other)).alias(other) for other in sets)).where("_key is not null") for name, df in sets.items()]
    flags = reduce(DataFrame.unionByName, tagged).groupBy("_key").agg(*(F.max(name).alias(name) for name in sets))
    return flags.groupBy(*sets).agg(F.count("*").alias("n"))


def range_jaccard(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Overlap over union of half-open integer ranges; null when both are empty."""
    shared = F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))
    whole = F.greatest(F.lit(0), end_a - start_a) + F.greatest(F.lit(0), end_b - start_b) - shared
    return F.try_divide(shared.cast("double"), whole.cast("double"))


def support_jaccard(df: DataFrame, group: str, member: str) -> DataFrame:
    """For pairs of groups that share a member: shared members, all members, and their ratio."""
    own = df.where(f"`{group}` is not null and `{member}` is not null").select(group, member).distinct()
    sizes = own.groupBy(group).agg(F.count("*").alias("size"))
    a = own.select(F.col(group).alias("a"), member)
    b = own.select(F.col(group).alias("b"), member)
    shared = a.join(b, member).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = shared.join(sizes.select(F.col(group).alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col(group).alias("b"), F.col("size").alias("nb")), "b")
    whole = F.col("na") + F.col("nb") - F.col("shared")
    return out.select("a", "b", "shared", whole.alias("either"), F.try_divide(F.col("shared").cast("double"), whole.cast("double")).alias("jaccard"))
