"""Comparison of two registry snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("utxo", "address", "holder", "default_in_wallet")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One full outer join on the name: rows on one side only, and fields that differ.

    Equal rows are left out.
    """
    left = a.select("name", F.struct(*FIELDS).alias("a"))
    right = b.select("name", F.struct(*FIELDS).alias("b"))
    both = left.join(right, "name", "full_outer")
    place = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("both")
    differs = F.array_compact(
        F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in FIELDS])
    )
    fields = F.when(place == "both", differs).otherwise(F.array().cast("array<string>"))
    out = both.select("name", place.alias("place"), fields.alias("fields"), "a", "b")
    return out.where((F.col("place") != "both") | (F.size("fields") > 0))


def counts(compared: DataFrame) -> DataFrame:
    def n(condition):
        return F.count(F.when(condition, 1))

    return compared.agg(
        n(F.col("place") == "only_a").alias("missing_in_b"),
        n(F.col("place") == "only_b").alias("missing_in_a"),
        *[n(F.array_contains("fields", f)).alias(f"{f}_mismatches") for f in FIELDS],
    )


def keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names only in A, only in B, and in both."""
    left, right = a.select("name"), b.select("name")
    only = lambda x, y, place: x.join(y, "name", "left_anti").withColumn("place", F.lit(place))
    common = left.join(right, "name", "left_semi").withColumn("place", F.lit("both"))
    return only(left, right, "only_a").unionByName(only(right, left, "only_b")).unionByName(common)
