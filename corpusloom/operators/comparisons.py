"""Comparisons: shares against a benchmark, definitions, sides of a match, masks by level, transitions, legends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from corpusloom.operators.contracts import assert_same_keys, assert_unique_key, match_sides
from corpusloom.sources.files import staged


def _whole() -> WindowSpec:
    """For tables of a row per label, region or the like."""
    return W.partitionBy()


def level_masks(df: DataFrame, levels: Sequence[tuple[str, Sequence[str]]], banned: Sequence[str]) -> DataFrame:
    """df with a column per level: whether none of its label sets, nor any of a level before, holds a placeholder."""
    no = F.array(*[F.lit(b) for b in banned])
    masks, before = {}, F.lit(True)
    for name, columns in levels:
        for c in columns:
            before = before & ~F.coalesce(F.arrays_overlap(F.transform(c, F.lower), no), F.lit(False))
        masks[name] = before
    return df.withColumns(masks)


def vocabulary_counts(df: DataFrame, column: str, vocabulary: Sequence[str], what: str = "value") -> DataFrame:
    """column, n and share_pct for each value of the vocabulary; one that doesn't occur is an error, others are left out."""
    counts = df.where(F.col(column).isin(*vocabulary)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame([(v,) for v in vocabulary], f"{column} string")
    full = grid.join(counts, column, "left")
    n = F.when(F.col("n").isNull(), F.raise_error(F.concat(F.lit(f"no record of {what} "), F.col(column))).cast("long")).otherwise(F.col("n"))
    return full.withColumn("n", n).withColumn("share_pct", 100 * F.col("n") / F.sum("n").over(_whole()))


def label_legend(df: DataFrame, labels: str, skip: Sequence[str] = ("Not Applicable",), top: int | None = None, other: str = "Other") -> DataFrame:
    """label, rank, n_documents, share_pct: labels by their numbers of records, the most frequent first, ties by name; with
    top, the others as one that ranks last. Shares are of all records."""
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    known = F.filter(F.array_distinct(F.coalesce(labels, F.array().cast("array<string>"))), lambda x: ~x.isin(*skip)) if skip else F.array_distinct(labels)
    held = df.select(known.alias("_l"))
    counts = held.select(F.explode("_l").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "label")))  # a row per label
    out = ranked.select("label", "rank", F.col("n").alias("n_documents"))
    if top is not None:
        tops = ranked.where(F.col("rank") <= top).agg(F.collect_list("label").alias("_tops"))  # top labels
        pooled = held.crossJoin(F.broadcast(tops)).where(F.exists("_l", lambda x: ~F.array_contains("_tops", x))).agg(F.count(F.lit(1)).alias("n_documents"))  # one row is broadcast
        out = out.where(F.col("rank") <= top).union(pooled.where("n_documents > 0").select(F.lit(other), F.lit(top + 1), "n_documents"))
    return out.crossJoin(total).withColumn("share_pct", 100 * F.col("n_documents") / F.col("_t")).drop("_t")


def label_codes(df: DataFrame, labels: str, legend: DataFrame, code: str = "code", skip: Sequence[str] = ("Not Applicable",)) -> DataFrame:
    """df with code: the least rank of the record's labels in the legend; labels that it pools take the rank of its last
    entry, records without a label 0. The legend is small: it goes into the plan as one row."""
    ranks = legend.agg(F.map_from_entries(F.collect_list(F.struct("label", "rank"))).alias("_ranks"), F.max("rank").alias("_last"))
    known = F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: ~x.isin(*skip)) if skip else F.col(labels)
    joined = df.crossJoin(F.broadcast(ranks))  # one row
    least = F.array_min(F.transform(known, lambda x: F.coalesce(F.try_element_at("_ranks", x), F.col("_last"))))
    return joined.withColumn(code, F.coalesce(least, F.lit(0))).drop("_ranks", "_last")


def transition_matrix(df: DataFrame, entity: str, period: str, state: str, step: int = 1) -> DataFrame:
    """from, to, n: states of entities that are known in a period and in the one step later."""
    later = df.select(F.col(entity).alias("_e"), (F.col(period) - step).alias("_p"), F.col(state).alias("to"))
    both = df.join(later, (F.col(entity) == F.col("_e")) & (F.col(period) == F.col("_p"))).where(F.col(state).isNotNull() & F.col("to").isNotNull())
    return both.groupBy(F.col(state).alias("from"), "to").agg(F.count(F.lit(1)).alias("n"))


def missing_by(df: DataFrame, period: str, state: str, entity: str) -> DataFrame:
    """period, records and entities whose state is missing there."""
    return df.where(F.col(state).isNull()).groupBy(period).agg(F.count(F.lit(1)).alias("records"), F.count_distinct(entity).alias("entities"))


def definition_shares(wide: DataFrame, key: str, definitions: Sequence[str], digits: int = 6) -> DataFrame:
    """definition, key, value, share_pct, rank: each definition's shares over the keys, the largest first, ties by key."""
    long = wide.select(key, *[F.col(d).cast("double").alias(d) for d in definitions]).unpivot([key], list(definitions), "definition", "value")
    share = F.round(100 * F.col("value") / F.sum("value").over(W.partitionBy("definition")), digits)  # a row per key
    return long.withColumn("share_pct", share).withColumn("rank", F.row_number().over(W.partitionBy("definition").orderBy(F.desc("share_pct"), key)).cast("long"))


def against_benchmark(own: DataFrame, benchmark: DataFrame, key: str, value: str, expected: str) -> DataFrame:
    """key, share, expected, gap, ratio, log2_ratio, flag over the keys that both have: shares in per cent."""
    j = own.join(benchmark, key).select(key, (100 * F.col(value) / F.sum(value).over(_whole())).alias("share"), (100 * F.col(expected) / F.sum(expected).over(_whole())).alias("expected"))
    j = j.withColumns({"gap": F.col("share") - F.col("expected"), "ratio": F.try_divide("share", "expected")})
    return j.withColumns({"log2_ratio": F.when(F.col("ratio") > 0, F.log2("ratio")), "flag": F.when(F.col("ratio") > 1, "over").otherwise("under")})


def covering_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of two tables with one row per key, which must have the same keys."""
    for side, name in ((left, "left"), (right, "right")):
        assert_unique_key(side, key, name)
    assert_same_keys(left, right, key)
    return left.join(right, key)


def share_gap(left: DataFrame, right: DataFrame, key: str, value: str, other: str) -> DataFrame:
    """key, both values, their shares in per cent and the gap; the tables must cover the same keys."""
    out = covering_join(left, right, key).withColumns({f"{c}_share": 100 * F.col(c) / F.sum(c).over(_whole()) for c in (value, other)})
    return out.withColumn("gap", F.col(f"{value}_share") - F.col(f"{other}_share"))


def outer_report(left: DataFrame, right: DataFrame, key: str, label: str, how: str = "outer") -> tuple[DataFrame, DataFrame]:
    """(match, report): the outer or inner join with side and one label column, the left one's first; and side, n and up to
    five examples of the keys that only one side has."""
    a, b = left.withColumnRenamed(label, "_la"), right.withColumnRenamed(label, "_lb")
    both = match_sides(a, b, key).withColumn(label, F.coalesce("_la", "_lb")).drop("_la", "_lb")
    report = both.where("side <> 'both'").groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set(key)), 1, 5).alias("examples"))
    return (both.where("side = 'both'") if how == "inner" else both), report


def rank_resolution(paths: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """rank, resolved, share_pct, values: how many paths have a name at each rank, and how many names there are."""
    found = paths.agg(F.count(F.lit(1)).alias("t"), *[F.count(r).alias(f"n{i}") for i, r in enumerate(ranks)], *[F.count_distinct(r).alias(f"v{i}") for i, r in enumerate(ranks)])
    rows = [F.struct(F.lit(r).alias("rank"), F.col(f"n{i}").alias("resolved"), (100 * F.col(f"n{i}") / F.col("t")).alias("share_pct"), F.col(f"v{i}").alias("values")) for i, r in enumerate(ranks)]
    return found.select(F.inline(F.array(*rows)))


def realm_summary(docs: DataFrame, weights: DataFrame, realm: str, label: str = "label", id_col: str = "id") -> DataFrame:
    """realm, label, n_label_documents, n_documents, prevalence, pooled_prevalence, fractional_share, lq, log2_lq on the
    whole grid. docs: a realm per record; weights: records' labels with w. Records without a label are left out."""
    per = weights.groupBy(id_col).agg(F.collect_list(F.struct(label, "w")).alias("_l"))
    cells = docs.join(per, id_col).select(realm, F.explode(F.concat("_l", F.array(F.struct(F.lit(None).cast("string").alias(label), F.lit(0.0).alias("w"))))).alias("x")).select(realm, f"x.{label}", "x.w")
    counts = cells.groupBy(realm, label).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    counts = staged(counts)  # the result is the grid of all realms and labels
    realms = counts.where(F.col(label).isNull()).select(F.col(realm).alias("_r"), F.col("n").alias("n_documents"))
    labels = counts.where(F.col(label).isNotNull()).select(F.col(label).alias("_l")).distinct()
    cells = counts.where(F.col(label).isNotNull())
    grid = realms.crossJoin(labels).join(cells, F.col("_r").eqNullSafe(F.col(realm)) & (F.col("_l") == F.col(label)), "left")
    full = grid.select(F.col("_r").alias(realm), F.col("_l").alias(label), F.coalesce("n", F.lit(0)).alias("n_label_documents"), "n_documents", F.coalesce("w", F.lit(0.0)).alias("w"))
    by = W.partitionBy(label)  # a row per realm
    full = full.withColumns({"prevalence": F.col("n_label_documents") / F.col("n_documents"), "pooled_prevalence": F.sum("n_label_documents").over(by) / F.sum("n_documents").over(by), "fractional_share": F.col("w") / F.col("n_documents")}).drop("w")
    return full.withColumn("lq", F.try_divide("prevalence", "pooled_prevalence")).withColumn("log2_lq", F.when(F.col("lq") > 0, F.log2("lq")).otherwise(F.lit(float("-inf"))))


def conditional_share(weights: DataFrame, by: Sequence[str], label: str, one: str, among: Sequence[str], w: str = "w") -> DataFrame:
    """by, share of one label among all, and conditional_share among some; groups without any of these are left out."""
    of = lambda test: F.sum(F.when(test, F.col(w)).otherwise(0.0))
    out = weights.groupBy(*by).agg(of(F.col(label) == one).alias("_p"), of(F.col(label).isin(*among)).alias("_q"), F.sum(w).alias("_t")).where("_q > 0")
    return out.select(*by, (F.col("_p") / F.col("_t")).alias("share"), (F.col("_p") / F.col("_q")).alias("conditional_share"))


def versioned(df: DataFrame, history: DataFrame, entity: str, period: str, offset: int, value: str, missing: str = "missing") -> DataFrame:
    """df with the value that its entity has in the history at period + offset, or missing. The history has one row per
    entity and period (columns entity, period, value)."""
    h = history.select(F.col("entity").alias("_e"), (F.col("period") - offset).alias("_p"), F.col("value").alias("_v"))
    return df.join(h, (F.col(entity) == F.col("_e")) & (F.col(period) == F.col("_p")), "left").withColumn(value, F.coalesce("_v", F.lit(missing))).drop("_e", "_p", "_v")


def common_path_weights(paths: DataFrame, benchmark: DataFrame, columns: Sequence[str], id_col: str = "id") -> DataFrame:
    """columns, weight, share_pct of the paths that the benchmark has too: what is left of each record is balanced again, so
    that each record weighs 1."""
    left = paths.select(id_col, *columns).distinct().join(benchmark.select(*columns).distinct(), list(columns), "left_semi")
    w = left.withColumn("_w", 1.0 / F.count(F.lit(1)).over(W.partitionBy(id_col)))
    return w.groupBy(*columns).agg(F.sum("_w").alias("weight")).withColumn("share_pct", 100 * F.col("weight") / F.sum("weight").over(_whole()))
