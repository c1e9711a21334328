"""Unbalanced trees: which children of a node are named, and what the rest adds up to.

A tree is a table of paths, one column a level, with two measures. Only sums by path are held
against each other, so windows see the children of one node, not the records below them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The node that holds the children of a parent that are not named.
REMAINING = "Remaining"


def _sums(paths: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return paths.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures])


def named_children(paths: DataFrame, levels: Sequence[str], first: str, second: str, threshold: float) -> DataFrame:
    """The last of levels and those above it, of each child whose share of its parent reaches threshold per
    cent by either measure; where none does, of the single largest by first, then share, then name."""
    *above, level = levels
    parent = W.partitionBy(*above)
    share = lambda m: F.coalesce(F.try_divide(F.lit(100.0) * F.col(m), F.sum(m).over(parent)), F.lit(0.0))
    scored = _sums(paths.where(F.col(level).isNotNull()), levels, (first, second)).withColumn("_score", F.greatest(share(first), share(second)))
    best = F.row_number().over(parent.orderBy(F.desc(first), F.desc("_score"), level))
    scored = scored.withColumns({"_best": best, "_most": F.max("_score").over(parent)})
    return scored.where((F.col("_score") >= threshold) | ((F.col("_most") < threshold) & (F.col("_best") == 1))).select(*levels)


def fold(paths: DataFrame, levels: Sequence[str], depth: int, named: DataFrame, measures: Sequence[str]) -> DataFrame:
    """paths with the nodes at depth that are not in named as REMAINING of their parent, ending there."""
    at = levels[: depth + 1]
    n = named.select(*[F.col(c).alias(f"_n{i}") for i, c in enumerate(at)], F.lit(True).alias("_named"))
    met = [F.col(c).eqNullSafe(F.col(f"_n{i}")) for i, c in enumerate(at)]
    found = paths.join(n, met, "left")
    known = F.coalesce("_named", F.lit(False))
    here = F.when(F.col(levels[depth]).isNull() | known, F.col(levels[depth])).otherwise(F.lit(REMAINING))
    below = {c: F.when(known, F.col(c)) for c in levels[depth + 1 :]}
    return _sums(found.withColumns({levels[depth]: here, **below}), levels, measures)


def select_tree(paths: DataFrame, levels: Sequence[str], first: str, second: str, thresholds: Sequence[float]) -> DataFrame:
    """levels, first, second of the leaves of the selected tree; sums equal those of paths.

    From the top level on, a node's children are named by its threshold and the others fold into one
    REMAINING leaf, whose deeper levels are null. A null label ends a path. No paths give no tree.
    """
    out = _sums(paths, levels, (first, second))
    for depth, threshold in enumerate(thresholds):
        out = fold(out, levels, depth, named_children(out, levels[: depth + 1], first, second, threshold).where(F.col(levels[depth]) != REMAINING), (first, second))
    return out


def rebase_tree(tree: DataFrame, benchmark: DataFrame, levels: Sequence[str], measure: str) -> DataFrame:
    """levels and measure: the paths of benchmark folded into the leaves of a selected tree. A node that the
    tree doesn't name goes to its parent's REMAINING, so each parent is the sum of its children; leaves
    that benchmark has nothing of count 0."""
    out = _sums(benchmark, levels, (measure,))
    for depth in range(len(levels)):
        named = tree.select(*levels[: depth + 1]).where(F.col(levels[depth]).isNotNull() & (F.col(levels[depth]) != REMAINING)).distinct()
        out = fold(out, levels, depth, named, (measure,))
    empty = tree.select(*levels, F.lit(0).cast(out.schema[measure].dataType).alias(measure))
    return _sums(out.unionByName(empty), levels, (measure,))


def compact_children(paths: DataFrame, levels: Sequence[str], measure: str, coverage: float, budget: int) -> DataFrame:
    """The last of levels and those above it, of each parent's fewest largest children that together reach coverage per
    cent of it; of a parent that needs more than budget of them, none."""
    *above, level = levels
    parent = W.partitionBy(*above)
    order = parent.orderBy(F.desc(measure), level)
    own = _sums(paths, levels, (measure,)).withColumns({"_t": F.sum(measure).over(parent), "_before": F.sum(measure).over(order) - F.col(measure), "_k": F.row_number().over(order)})
    needed = own.where((F.col(level).isNotNull()) & (100 * F.col("_before") < coverage * F.col("_t")))
    return needed.withColumn("_n", F.max("_k").over(parent)).where(F.col("_n") <= budget).select(*levels)


def globally_named(paths: DataFrame, levels: Sequence[str], measures: Sequence[str], threshold: float) -> DataFrame:
    """levels of the nodes that hold threshold per cent of the whole by at least one measure."""
    own = _sums(paths, levels, measures)
    total = W.partitionBy()  # a row per node
    share = [F.coalesce(F.try_divide(100 * F.col(m), F.sum(m).over(total)), F.lit(0.0)) for m in measures]
    return own.where(F.col(levels[-1]).isNotNull()).withColumn("_s", F.greatest(*share) if len(share) > 1 else share[0]).where(F.col("_s") >= threshold).select(*levels)


def compact_level(paths: DataFrame, levels: Sequence[str], depth: int, measures: Sequence[str], coverage: float, budget: int, threshold: float) -> DataFrame:
    """paths with a level's children named where their parent's are compact and they reach the global threshold; the others
    of such a parent are its REMAINING, and a parent without any ends there."""
    at = list(levels[: depth + 1])
    named = compact_children(paths, at, measures[0], coverage, budget).join(globally_named(paths, at, measures, threshold), at, "left_semi")
    folded = fold(paths, levels, depth, named, measures)
    open_ = named.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(at[:-1])]).distinct().withColumn("_open", F.lit(True))
    met = [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(at[:-1])]
    held = folded.join(open_, met, "left")
    return _sums(held.withColumns({c: F.when(F.col("_open"), F.col(c)) for c in levels[depth:]}), levels, measures)


def assignments(paths: DataFrame, tree: DataFrame, levels: Sequence[str], prefix: str = "leaf_") -> DataFrame:
    """Each path with the leaf of a selected tree that it is in, as columns with the prefix."""
    out = paths.select(*levels).distinct()
    out = out.withColumns({prefix + c: F.col(c) for c in levels})
    known = F.lit(True)
    for depth, c in enumerate(levels):
        at = levels[: depth + 1]
        named = tree.select(*[F.col(x).alias(f"_n{i}") for i, x in enumerate(at)]).where(F.col(f"_n{depth}").isNotNull() & (F.col(f"_n{depth}") != REMAINING)).distinct().withColumn(f"_named{depth}", F.lit(True))
        met = [F.col(x).eqNullSafe(F.col(f"_n{i}")) for i, x in enumerate(at)]
        out = out.join(named, met, "left").drop(*[f"_n{i}" for i in range(depth + 1)])
        here = F.coalesce(F.col(f"_named{depth}"), F.lit(False))
        out = out.withColumn(prefix + c, F.when(known & here, F.col(c)).when(known & F.col(c).isNotNull(), F.lit(REMAINING)))
        known = known & here
    return out.drop(*[f"_named{d}" for d in range(len(levels))])
