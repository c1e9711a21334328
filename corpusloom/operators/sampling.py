"""Stratified splits and samples: allocations by largest remainder, rows by a seeded hash."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def allocation(n: int, ratios: Sequence[float]) -> list[int]:
    """n by ratio, whole numbers that add up to n: floors, then one each by largest fraction, ties in
    order."""
    raw = [n * r for r in ratios]
    out = [math.floor(x) for x in raw]
    for i in sorted(range(len(raw)), key=lambda k: -(raw[k] - out[k]))[: n - sum(out)] if n else []:
        out[i] += 1
    return out


def seeded_order(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))


def split_rows(df: DataFrame, stratum: str, key: str, ratios: Mapping[str, float], seed: int) -> DataFrame:
    """df with a split per row: per stratum, in seeded order, as many as largest remainder allots.

    Ranks and counts are made in the plan, nothing is collected."""
    held = ranked(df, stratum, key, seed)
    names = list(ratios)
    # largest remainder as expressions: the fraction's rank, ties in order
    floors = [F.floor(F.col("_n") * F.lit(ratios[s])) for s in names]
    fracs = [F.col("_n") * F.lit(ratios[s]) - f for s, f in zip(names, floors, strict=True)]
    left = F.col("_n") - sum(floors[1:], floors[0])
    sizes = []
    for i, f in enumerate(fracs):
        ahead = sum((F.when((g > f) if j > i else (g >= f), 1).otherwise(0) for j, g in enumerate(fracs) if j != i), F.lit(0))
        sizes.append(floors[i] + F.when(ahead < left, 1).otherwise(0))
    out, end = F.lit(names[-1]), sum(sizes[:-1], F.lit(0))
    for i in range(len(names) - 2, -1, -1):
        out = F.when(F.col("_r") <= end, names[i]).otherwise(out)
        end = end - sizes[i]
    return held.withColumn("split", out).drop("_n", "_r")


def _in_order(strata: Mapping) -> list:
    """Strata by name, the null one last."""
    return sorted(strata, key=lambda k: (k is None, 0 if k is None else k))


def equal_allocation(sizes: Mapping[str, int], n: int) -> dict[str, int]:
    """n shared equally among strata, capped at their sizes, the shortfall given to the first with room."""
    keys = _in_order(sizes)
    n = min(n, sum(sizes.values()))
    got = [min(c, sizes[k]) for c, k in zip(allocation(n, [1 / len(keys)] * len(keys)), keys)] if keys else []
    short = n - sum(got)
    for i, k in enumerate(keys):
        more = min(short, sizes[k] - got[i])
        got[i], short = got[i] + more, short - more
    return dict(zip(keys, got))


#: Ranges of the seeded order in which a stratum's rows are ranked, each by itself.
RANGES = 256


def ranked(df: DataFrame, stratum: str, key: str, seed: int, rank: str = "_r", size: str = "_n") -> DataFrame:
    """df with each row's rank in its stratum by seeded order, and the stratum's size. Ranges of the order are ranked by
    themselves and shifted by the rows before them, so that no task holds a stratum."""
    order = seeded_order(seed, F.col(key))
    at = df.withColumn("_o", F.coalesce(order, F.lit(""))).withColumn("_at", F.substring("_o", 1, 2))
    counts = at.groupBy(F.col(stratum).alias("_s"), F.col("_at").alias("_a")).agg(F.count(F.lit(1)).alias("_c"))
    whole = W.partitionBy("_s")  # RANGES rows of a stratum at most
    counts = counts.select("_s", "_a", (F.sum("_c").over(whole.orderBy("_a")) - F.col("_c")).alias("_b"), F.sum("_c").over(whole).alias(size))
    inner = W.partitionBy(stratum, "_at").orderBy("_o", key)
    out = at.withColumn("_k", F.row_number().over(inner)).join(counts, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_at") == F.col("_a")))
    return out.withColumn(rank, F.col("_k") + F.col("_b")).select(*[F.col(f"`{c}`") for c in df.columns], rank, size)


def take_per_stratum(df: DataFrame, stratum: str, key: str, counts: Mapping, seed: int) -> DataFrame:
    """So many rows of each stratum, in seeded order; rows whose stratum is null are a stratum of their own (None). counts has
    a number per stratum, few."""
    kind = StructType([StructField("_stratum", df.schema[stratum].dataType), StructField("_want", LongType())])
    want = df.sparkSession.createDataFrame(list(counts.items()), kind)
    held = ranked(df, stratum, key, seed).join(want, F.col(stratum).eqNullSafe(F.col("_stratum")))
    return held.where("_r <= _want").select(*[F.col(f"`{c}`") for c in df.columns])


def balanced_size(sizes: Mapping[str, int], weights: Mapping[str, float]) -> int:
    """The largest total at which no source is short of its weight."""
    total = sum(weights.values())
    return math.floor(min(sizes.get(k, 0) * total / w for k, w in weights.items() if w > 0))


def stratum_key(labels: Column) -> Column:
    """missing, the one label in lower case, or multi."""
    n = F.coalesce(F.size(labels), F.lit(0))
    return F.when(n <= 0, "missing").when(n == 1, F.lower(F.get(labels, F.lit(0)))).otherwise("multi")


def proportional_allocation(sizes: Mapping[str, int], n: int) -> dict[str, int]:
    """n shared among strata by their sizes, whole numbers by largest remainder, none above its size."""
    keys, total = _in_order(sizes), sum(sizes.values())
    return dict(zip(keys, allocation(min(n, total), [sizes[k] / total for k in keys]))) if total else {}


def strata_sizes(df: DataFrame, stratum: str) -> dict[str, int]:
    """Rows per stratum, which are few."""
    return {r[stratum]: r["n"] for r in df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).collect()}


def proportional_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """A sample of n rows in which each stratum has its share."""
    return take_per_stratum(df, stratum, key, proportional_allocation(strata_sizes(df, stratum), n), seed)


def sample_each(df: DataFrame, part: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each part, or all of a smaller one."""
    sizes = strata_sizes(df, part)
    return take_per_stratum(df, part, key, {k: min(n, v) for k, v in sizes.items()}, seed)


def balanced_split(df: DataFrame, source: str, key: str, weights: Mapping[str, float], ratios: Mapping[str, float], seed: int) -> DataFrame:
    """The largest sample in which sources have their weights, split by ratio within each source."""
    sizes, total = strata_sizes(df, source), sum(weights.values())
    n = balanced_size(sizes, weights)
    names = _in_order(weights)
    counts = dict(zip(names, allocation(n, [weights[k] / total for k in names])))
    return split_rows(take_per_stratum(df, source, key, {k: min(c, sizes.get(k, 0)) for k, c in counts.items()}, seed), source, key, ratios, seed)
