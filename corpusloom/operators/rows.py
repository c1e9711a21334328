"""Small operators on rows: filters, keys, orders, summaries, checked joins, layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.contracts import ContractError


def with_text(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is more than white space."""
    return df.where(F.coalesce(F.col(column), F.lit("")).rlike(r"\S"))


def any_label(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a label in at least one of the list columns."""
    return df.where(F.exists(F.array(*[F.coalesce(F.size(F.col(c)), F.lit(0)) for c in columns]), lambda n: n > 0))


def blanked(df: DataFrame, columns: Sequence[str], only: str = "Not Applicable") -> tuple[DataFrame, DataFrame]:
    """(df with null for lists of that one label, column and n of the cells that became null)."""
    hit = {c: F.coalesce((F.size(c) == 1) & (F.get(c, F.lit(0)) == only), F.lit(False)) for c in columns}
    counts = df.agg(*[F.count_if(h).alias(c) for c, h in hit.items()])
    audit = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])))
    return df.withColumns({c: F.when(~h, F.col(c)) for c, h in hit.items()}), audit


def numbered_rows(df: DataFrame, key: str, *order: Column, first: int = 1) -> DataFrame:
    """df with key, whole numbers from first on in the given order, which should be total.

    Rows are ranged by the order and numbered within ranges, which are shifted by what lies before them: no task holds
    the whole table. The ranged table is stored first, as ranges are sampled and must not change between reads."""
    from corpusloom.sources.files import staged

    ranged = staged(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()))
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_i0"))
    before = counts.select("_p", "_i0", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_b"))  # a row per partition
    out = ranged.join(F.broadcast(before), "_p").withColumn(key, F.col("_i") - F.col("_i0") + F.col("_b") + first)
    return out.select(*[F.col(f"`{c}`") for c in [*df.columns, *([] if key in df.columns else [key])]])


def top_by_magnitude(df: DataFrame, value: str, n: int, *ties: str) -> DataFrame:
    """The n rows of the largest absolute value, nulls never; a report of n rows."""
    return df.where(F.col(value).isNotNull()).orderBy(F.desc(F.abs(F.col(value))), *ties).limit(n)


def year_range(df: DataFrame, by: Sequence[str], year: str) -> DataFrame:
    """by, last and first year of what can be read as a number; 0 where nothing can."""
    y = F.expr(f"try_cast(`{year}` as int)")
    return df.groupBy(*by).agg(F.coalesce(F.max(y), F.lit(0)).alias("last_year"), F.coalesce(F.min(y), F.lit(0)).alias("first_year"))


def singleton_bucket(labels: Column, known: Sequence[str], kind: str = "realm") -> Column:
    """What a list of labels means for an analysis that takes exact singletons."""
    one = F.get(labels, F.lit(0))
    return (
        F.when(F.coalesce(F.size(labels), F.lit(0)) <= 0, f"Empty {kind} label").when(F.size(labels) > 1, f"Multiple {kind} labels").when(one.isin(*known), f"Exact singleton analysis {kind}")
        .otherwise(F.concat(F.lit(f"Excluded {kind}: "), one))
    )


def sum_or_null(df: DataFrame, by: Sequence[str], columns: Sequence[str], total: str) -> DataFrame:
    """by, each column's sum, and total, the sum over the columns: null only where nothing was there."""
    out = df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])
    parts = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    return out.withColumn(total, F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)))


def spread(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, n, total, mean, q1, median, q3 (linear interpolation) of a value."""
    q = lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))


def checked_lookup(df: DataFrame, dimension: DataFrame, key: str, columns: Sequence[str], what: str = "dimension") -> DataFrame:
    """df with the dimension's columns; a key that the dimension lacks, or a null in its columns, is an error, found
    before the join is used."""
    missing = df.select(key).distinct().join(dimension.dropna(subset=list(columns)).select(key), key, "left_anti").limit(5).collect()
    if missing:
        raise ContractError(f"{what} lacks {[r[0] for r in missing]}")
    return df.join(dimension.select(key, *columns), key, "left")


def enrich(base: DataFrame, others: Sequence[tuple[DataFrame, str]], key: str) -> DataFrame:
    """base with a struct-free left join of each (table, prefix): no row of base is lost, and a table with several rows of
    a key is an error."""
    for i, (other, prefix) in enumerate(others):
        twice = other.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
        if twice:
            raise ContractError(f"table {i} has several rows of {[r[0] for r in twice]}")
        base = base.join(other.select(key, *[F.col(f"`{c}`").alias(prefix + c) for c in other.columns if c != key]), key, "left")
    return base


def angular_layout(nodes: DataFrame, depth: int, turn: float = 360.0) -> DataFrame:
    """nodes (node, parent, depth from 1, position among siblings, size) with start and width: the roots share a full turn
    by size, children their parent's stretch. A hierarchy for display, so a parent's children are few."""
    roots = W.orderBy("position", "node")
    level = nodes.where("depth = 1")
    total = F.sum("size").over(W.partitionBy())
    level = level.withColumns({"width": turn * F.col("size") / total, "start": turn * (F.sum("size").over(roots) - F.col("size")) / total})
    out = level
    for d in range(2, depth + 1):
        up = level.select(F.col("node").alias("parent"), F.col("start").alias("_s"), F.col("width").alias("_w"), F.col("size").alias("_n"))
        before = F.sum("size").over(W.partitionBy("parent").orderBy("position", "node")) - F.col("size")
        level = nodes.where(F.col("depth") == d).join(up, "parent").withColumns({"width": F.col("_w") * F.col("size") / F.col("_n"), "start": F.col("_s") + F.col("_w") * before / F.col("_n")}).select(*out.columns)
        out = out.unionByName(level)
    return out
