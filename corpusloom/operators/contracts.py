"""Grain contracts and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks its grain."""


def assert_unique_key(df: DataFrame, key: str, what: str = "table") -> None:
    """Raises if the key has nulls or repeats, with examples."""
    bad = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).limit(5).collect()
    if bad:
        raise ContractError(f"{what}: {key} is null or repeats: {[r[key] for r in bad]}")


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and side (left_only, right_only) of the keys that only one side has."""
    a, b = left.select(F.col(key).alias("k")).distinct().withColumn("l", F.lit(1)), right.select(F.col(key).alias("k")).distinct().withColumn("r", F.lit(1))
    both = a.join(b, "k", "outer").where("l is null or r is null")
    return both.select(F.col("k").alias(key), F.when(F.col("l").isNull(), "right_only").otherwise("left_only").alias("side"))


def assert_same_keys(left: DataFrame, right: DataFrame, key: str) -> None:
    bad = key_difference(left, right, key).limit(5).collect()
    if bad:
        raise ContractError(f"{key} differs: {[(r[key], r['side']) for r in bad]}")


def merge_one_to_one(left: DataFrame, others: Sequence[DataFrame], key: str, strict: bool = True) -> DataFrame:
    """left with the columns of each other table, one row per key; strict checks keys and their sets."""
    out = left
    if strict:
        assert_unique_key(left, key, "left")
    for i, other in enumerate(others):
        if strict:
            assert_unique_key(other, key, f"table {i}")
            assert_same_keys(left, other, key)
        out = out.join(other, key, "left")
    return out


def assert_vocabulary(labels: DataFrame, column: str, vocabulary: Sequence[str]) -> None:
    bad = labels.select(column).distinct().where(~F.col(column).isin(*vocabulary)).limit(5).collect()
    if bad:
        raise ContractError(f"unknown labels: {[r[0] for r in bad]}")


def keep_first(df: DataFrame, key: Sequence[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def match_sides(left: DataFrame, right: DataFrame, key: str, how: str = "outer") -> DataFrame:
    """Inner or outer join of two tables with one row per key, and side: both, left_only, right_only."""
    if how not in ("inner", "outer"):
        raise ValueError("how is inner or outer")
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return a.join(b, key, how).withColumn("side", side).drop("_l", "_r")


def crosswalk(df: DataFrame, key: str, exact: DataFrame, override: DataFrame, code: str, name: str) -> DataFrame:
    """df with name and status: exact where the code is in the exact table, else override where the override table has a
    name for it, no_match where that table says null, unmapped where neither knows the code. Both tables have one row per
    code."""
    a = exact.select(F.col(code).alias("_a"), F.col(name).alias("_exact"))
    b = override.select(F.col(code).alias("_b"), F.col(name).alias("_over"))
    j = df.join(a, F.col(key) == F.col("_a"), "left").join(b, F.col(key) == F.col("_b"), "left")
    status = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_over").isNotNull(), "override").when(F.col("_b").isNotNull(), "no_match").otherwise("unmapped")
    return j.withColumns({name: F.coalesce("_exact", "_over"), "status": status}).drop("_a", "_b", "_exact", "_over")
