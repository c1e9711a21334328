"""Fractional attribution and compositions: a record with k labels gives 1/k to each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def explode_labels(df: DataFrame, id_col: str, labels: str, out: str = "label", keep: Sequence[str] = ()) -> DataFrame:
    """One row per record and distinct label; records without labels have none."""
    return df.select(id_col, *keep, F.explode(labels).alias(out)).where(F.col(out).isNotNull()).dropDuplicates([id_col, out])


def fractional_weights(pairs: DataFrame, id_col: str = "id", out: str = "w") -> DataFrame:
    """pairs (distinct record and label rows) with the weight 1 / labels of the record."""
    return pairs.withColumn(out, 1.0 / F.count(F.lit(1)).over(W.partitionBy(id_col)))


def fractional_share(pairs: DataFrame, by: Sequence[str], label: str = "label", id_col: str = "id", digits: int = 4) -> DataFrame:
    """by, label, fractional_count, n_pubs, share: the labels' weights of each group over its records.

    pairs hold by, id and label, distinct. The records' number is the sum of the weights, so no second
    pass over the records is needed."""
    summed = fractional_weights(pairs, id_col).groupBy(*by, label).agg(F.sum("w").alias("fractional_count"))
    total = F.round(F.sum("fractional_count").over(W.partitionBy(*by)))
    return summed.withColumn("n_pubs", total.cast("long")).withColumn("share", F.round(100 * F.col("fractional_count") / F.col("n_pubs"), digits))


def two_way_weights(axes: Sequence[tuple[DataFrame, str]], id_col: str = "id") -> DataFrame:
    """The axes' pairs joined per record, each combination with 1 / product of the axes' sizes.

    Sizes count over the whole record before the join, so a record's weights sum to 1 if it is on
    every axis."""
    out: DataFrame | None = None
    for i, (pairs, label) in enumerate(axes):
        own = pairs.select(id_col, label).distinct().withColumn(f"_k{i}", F.count(F.lit(1)).over(W.partitionBy(id_col)))
        out = own if out is None else out.join(own, id_col)
    product = F.lit(1)
    for i in range(len(axes)):
        product = product * F.col(f"_k{i}")
    return out.withColumn("w", F.lit(1.0) / product).drop(*[f"_k{i}" for i in range(len(axes))])


def two_way_from_sets(records: DataFrame, axes: dict[str, str], keep: Sequence[str] = ("id",)) -> DataFrame:
    """As two_way_weights, from one row per record with a set (array of distinct values) for each axis: nothing is
    shuffled. axes: new column -> array."""
    product = F.lit(1.0)
    for c in axes.values():
        product = product * F.size(c)
    out = records.select(*keep, *axes.values(), (F.lit(1.0) / F.nullif(product, F.lit(0.0))).alias("w"))
    for new, c in axes.items():
        out = out.select(*[x for x in out.columns if x != c], F.explode(c).alias(new))
    return out


def rank_paths(paths: DataFrame, columns: Sequence[str], id_col: str = "id", sep: str = " > ") -> DataFrame:
    """rank, path, weight, n: at each rank the records' distinct paths of so many columns, a record's paths sharing its
    weight. paths: one row per record and path. A record's paths are gathered once, for all ranks."""
    held = paths.groupBy(id_col).agg(F.collect_set(F.array(*columns)).alias("p"))
    at = lambda k: F.array_distinct(F.transform("p", lambda x: F.array_join(F.slice(x, 1, k), sep)))
    ranks = F.array(*[F.struct(F.lit(k).cast("long").alias("rank"), at(k).alias("paths")) for k in range(1, len(columns) + 1)])
    each = held.select(F.inline(ranks)).select("rank", (1.0 / F.size("paths")).alias("w"), F.explode("paths").alias("path"))
    return each.groupBy("rank", "path").agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("n"))


def group_composition(weights: DataFrame, group: str, label: str, w: str = "w") -> DataFrame:
    """group, label, weight, share of the group in per cent."""
    summed = weights.groupBy(group, label).agg(F.sum(w).alias("weight"))
    return summed.withColumn("share_pct", 100 * F.col("weight") / F.sum("weight").over(W.partitionBy(group)))


def composition_matrix(composition: DataFrame, row: str, column: str, values: Sequence[str], cell: str = "share_pct", name=lambda v: v) -> DataFrame:
    """row by column, zero where nothing is, columns in the order of values."""
    wide = composition.groupBy(row).pivot(column, list(values)).agg(F.first(cell))
    return wide.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0.0)).alias(name(v)) for v in values])


def full_weight_per_group(pairs: DataFrame, id_col: str, group: str, label: str) -> DataFrame:
    """Each record counts fully in each of its groups: 1 / labels within (record, group)."""
    own = pairs.select(id_col, group, label).distinct()
    return own.withColumn("w", 1.0 / F.count(F.lit(1)).over(W.partitionBy(id_col, group)))


def standardized_shares(cells: DataFrame, tiers: Sequence[str], weight: Column | None = None, stratum: Sequence[str] = ("stratum",), id_col: str = "id") -> DataFrame:
    """Direct standardization over common strata.

    cells: id, tier, stratum columns, label, w. Strata in which both tiers have records weigh by their
    pooled records; a label missing in a cell counts 0. Gives label and std_<tier> in per cent."""
    docs = cells.select(id_col, "tier", *stratum).distinct()
    sizes = docs.groupBy(*stratum).agg(*[F.count_if(F.col("tier") == t).alias(f"n_{i}") for i, t in enumerate(tiers)])
    # records may be in both tiers: the stratum's size counts them once
    pooled = docs.select(id_col, *stratum).distinct().groupBy(*stratum).agg(F.count(F.lit(1)).alias("n_docs"))
    common = sizes.where(" and ".join(f"n_{i} > 0" for i in range(len(tiers)))).join(pooled, list(stratum))
    common = common.withColumn("stratum_weight", F.col("n_docs") / F.sum("n_docs").over(W.partitionBy()))  # a row per stratum: few
    inside = cells.join(common.select(*stratum, "stratum_weight"), list(stratum))
    summed = inside.groupBy(*stratum, "stratum_weight", "tier", "label").agg(F.sum("w").alias("x"))
    shared = summed.withColumn("s", F.col("x") / F.sum("x").over(W.partitionBy(*stratum, "tier")))
    return shared.groupBy("label").agg(*[(100 * F.sum(F.when(F.col("tier") == t, F.col("stratum_weight") * F.col("s")).otherwise(0.0))).alias(f"std_{t}") for t in tiers])


def unique_documents(pairs: DataFrame, by: Sequence[str], id_col: str = "id", out: str = "n") -> DataFrame:
    return pairs.groupBy(*by).agg(F.count_distinct(id_col).alias(out))


def dense_grid(axes: Sequence[DataFrame], facts: DataFrame, keys: Sequence[str], fill: dict[str, float]) -> DataFrame:
    """The product of small axes with the facts' values, filled where there are none."""
    grid = axes[0]
    for a in axes[1:]:
        grid = grid.crossJoin(a)
    return grid.join(facts, list(keys), "left").fillna(fill)
