"""Geographic counts, location quotients with shrinkage, and fractional attention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.attribution import fractional_weights
from corpusloom.sources.files import staged


def geo_counts(places: DataFrame, labels: DataFrame, place: str, label: str = "label", id_col: str = "id") -> DataFrame:
    """label, place, n (distinct records), group_total (the label's distinct records with a place)."""
    pairs = places.select(id_col, place).distinct().join(labels.select(id_col, label).distinct(), id_col)
    counts = pairs.groupBy(label, place).agg(F.count(F.lit(1)).alias("n"))
    totals = pairs.groupBy(label).agg(F.count_distinct(id_col).alias("group_total"))
    return counts.join(totals, label)


def location_quotient(places: DataFrame, labels: DataFrame, place: str, label: str = "label", id_col: str = "id", min_support: int = 1, kappa: float | None = None) -> DataFrame:
    """How over-represented a label is in a place: (n / D_c) / (T_t / D).

    Only records with a place and a label count. With kappa, cells of the whole place by label grid
    also get the Empirical-Bayes value (n + kappa pi) / ((D_c + kappa) pi), pi = T_t / D."""
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    both = places.select(id_col, F.col(place).alias("p"), none(labels, label).alias("l")).unionByName(labels.select(id_col, none(places, place).alias("p"), F.col(label).alias("l")))
    return quotients(both.groupBy(id_col).agg(F.collect_set("p").alias("p"), F.collect_set("l").alias("l")), "p", "l", place, label, min_support, kappa)


def quotients(records: DataFrame, places: str, labels: str, place: str = "place", label: str = "label", min_support: int = 1, kappa: float | None = None) -> DataFrame:
    """location_quotient() of one row per record with its distinct places and labels as arrays. Cells, places' and labels'
    totals and the universe are counted in one pass over the records; the rest is about small dimensions."""
    held = records.select(F.col(places).alias("p"), F.col(labels).alias("l")).where((F.size("p") > 0) & (F.size("l") > 0))
    one = lambda p, l: F.struct(p.alias("p"), l.alias("l"))
    kinds = dict(held.dtypes)
    no_p, no_l = (F.lit(None).cast(kinds[c].removeprefix("array<").removesuffix(">")) for c in "pl")
    cells = F.flatten(F.transform("p", lambda p: F.transform("l", lambda l: one(p, l))))
    counts = held.select(F.explode(F.concat(cells, F.transform("p", lambda p: one(p, no_l)), F.transform("l", lambda l: one(no_p, l)), F.array(one(no_p, no_l)))).alias("x"))
    counts = counts.groupBy("x.p", "x.l").agg(F.count(F.lit(1)).alias("n"))
    if kappa is None:
        of = lambda test, *by: F.max(F.when(test, F.col("n"))).over(W.partitionBy(*by))
        p, l = F.col("p").isNull(), F.col("l").isNull()
        out = counts.withColumns({"support": of(l & ~p, "p"), "class_total": of(p & ~l, "l"), "universe": of(p & l)}).where("p is not null and l is not null")
    else:  # the result is the grid of all places and labels
        counts = staged(counts)
        ps = counts.where("l is null and p is not null").select("p", F.col("n").alias("support"))
        ls = counts.where("p is null and l is not null").select("l", F.col("n").alias("class_total"))
        whole = counts.where("p is null and l is null").select(F.col("n").alias("universe"))
        cells = counts.where("p is not null and l is not null").select(F.col("p").alias("_p"), F.col("l").alias("_l"), "n")
        grid = ps.crossJoin(ls).crossJoin(whole).join(cells, (F.col("p") == F.col("_p")) & (F.col("l") == F.col("_l")), "left")
        out = grid.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).drop("_p", "_l")
    out = out.select(F.col("p").alias(place), F.col("l").alias(label), "support", "class_total", "n", "universe")
    out = out.withColumns({"within_share": F.col("n") / F.col("support"), "global_share": F.col("class_total") / F.col("universe")})
    out = out.withColumn("lq", F.col("within_share") / F.col("global_share")).withColumn("log2_lq", F.when(F.col("lq") > 0, F.log2("lq")))
    if kappa is not None:
        pi = F.col("global_share")
        out = out.withColumn("lq_eb", (F.col("n") + kappa * pi) / ((F.col("support") + kappa) * pi)).withColumn("log2_lq_eb", F.log2("lq_eb"))
    return out.withColumn("sufficient", F.col("support") >= min_support)


def fractional_attention(places: DataFrame, place: str, id_col: str = "id") -> DataFrame:
    """place, attention (sum of 1 / places of each record) and its share in per cent."""
    summed = fractional_weights(places.select(id_col, place).distinct(), id_col).groupBy(place).agg(F.sum("w").alias("attention"))
    return summed.withColumn("share_pct", 100 * F.col("attention") / F.sum("attention").over(W.partitionBy()))  # a row per place


def top_k_share(attention: DataFrame, value: str, tie: str, ks: tuple[int, ...]) -> DataFrame:
    """k, cum_share of the k largest: per cent of the whole."""
    ranked = attention.select(value, F.row_number().over(W.orderBy(F.desc(value), F.asc(tie))).alias("r"))
    return ranked.agg(*[(100 * F.sum(F.when(F.col("r") <= k, F.col(value))) / F.sum(value)).alias(f"_{k}") for k in ks]).select(
        F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"_{k}").alias("cum_share")) for k in ks]))
    )
