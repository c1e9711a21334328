"""Year series: complete years, growth, rolling means and slopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def annual_counts(df: DataFrame, year: str, id_col: str, start: int, end: int) -> DataFrame:
    """year, n, cumulative, yoy_pct over the complete range of years, zero-filled."""
    counts = df.groupBy(year).agg(F.count_distinct(id_col).alias("n"))
    years = df.sparkSession.range(start, end + 1).select(F.col("id").cast("int").alias(year))
    full = years.join(counts, year, "left").fillna({"n": 0})
    by = W.orderBy(year)  # a row per year
    before = F.lag("n").over(by)
    return full.withColumn("cumulative", F.sum("n").over(by.rowsBetween(W.unboundedPreceding, 0))).withColumn("yoy_pct", F.when(before > 0, F.round(100.0 * (F.col("n") - before) / before, 2)))


def cagr(base: Column, end: Column, years: Column | int) -> Column:
    """((end / base) ^ (1 / years) - 1) * 100; null if base or years is not positive."""
    n = F.lit(years) if isinstance(years, int) else years
    return F.when((base > 0) & (n > 0), (F.pow(end / base, 1.0 / n) - 1) * 100)


def cagr_by_period(series: DataFrame, key: str, year: str, value: str, periods: Sequence[tuple[int, int]]) -> DataFrame:
    """key, start_year, end_year, base, end, cagr_pct, note."""
    p = F.inline(F.array(*[F.struct(F.lit(a).alias("start_year"), F.lit(b).alias("end_year")) for a, b in periods]))
    spread = series.select(key, year, value, p).groupBy(key, "start_year", "end_year").agg(
        F.sum(F.when(F.col(year) == F.col("start_year"), F.col(value))).alias("base"), F.sum(F.when(F.col(year) == F.col("end_year"), F.col(value))).alias("end")
    )  # one pass over the series for all periods
    spread = spread.fillna({"base": 0.0, "end": 0.0})
    grown = cagr(F.col("base"), F.col("end"), F.col("end_year") - F.col("start_year"))
    return spread.withColumn("cagr_pct", grown).withColumn("note", F.when(F.col("base") <= 0, "base is zero").otherwise(""))


def rolling_cagr(series: DataFrame, key: str, year: str, value: str, n: int) -> DataFrame:
    """On a complete grid of years: growth over the last n years."""
    before = F.lag(value, n).over(W.partitionBy(key).orderBy(year))
    return series.withColumn("rolling_cagr", cagr(before, F.col(value), n))


def centered_mean(series: DataFrame, keys: Sequence[str], year: str, value: str, half: int = 2, least: int = 3) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(year).rowsBetween(-half, half)
    return series.withColumn("rolling_mean", F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def slope_per_decade(series: DataFrame, key: str, year: str, value: str) -> DataFrame:
    return series.groupBy(key).agg(
        (F.regr_slope(F.col(value).cast("double"), F.col(year).cast("double")) * 10).alias("slope_per_decade"),
        F.min_by(value, year).alias("first_value"), F.max_by(value, year).alias("last_value"), F.min(year).alias("first_year"), F.max(year).alias("last_year"),
    )


def attention_trend(records: DataFrame, year: str, groups: str, known: Sequence[str], single_only: bool = False, over: Sequence[str] | None = None) -> DataFrame:
    """year, group, attention, share_pct, year_total on the grid of the years that have records and the groups.

    groups is a list of each record's distinct groups. A record counts once, shared equally by those of its groups
    that are among over (known, if that is not set): shares of over add up to 100 in every year. single_only takes records of
    exactly one group, of whatever group, only."""
    kept = list(known if over is None else over)
    if unknown := sorted(set(kept) - set(known)):
        raise ValueError(f"not among the known groups: {unknown}")
    held = records.where(F.size(groups) == 1) if single_only else records
    left = held.select(F.col(year).alias("year"), F.filter(groups, lambda g: g.isin(*kept)).alias("g")).where((F.size("g") > 0) & F.col("year").isNotNull())
    facts = left.select("year", F.explode("g").alias("group"), (1.0 / F.size("g")).alias("w")).groupBy("year", "group").agg(F.sum("w").alias("w"))
    # a row a year: its groups as a map, unfolded over all of them
    per = facts.groupBy("year").agg(F.sum("w").alias("year_total"), F.map_from_entries(F.collect_list(F.struct("group", "w"))).alias("m"))
    grid = per.select("year", "year_total", "m", F.explode(F.array(*[F.lit(k) for k in kept])).alias("group"))
    w = F.coalesce(F.try_element_at("m", F.col("group")), F.lit(0.0))
    return grid.select("year", "group", w.alias("attention"), (100 * w / F.col("year_total")).alias("share_pct"), "year_total")


def trend_summary(trend: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """group, start_year, end_year, start_share_pct, end_share_pct, change_pp and slope_pp_per_decade of attention_trend(); with
    described (group, described_pct) also its share and the ratios of attention to it in the first and last year, null for
    groups that it lacks."""
    out = slope_per_decade(trend, "group", "year", "share_pct").select(
        "group", F.col("first_year").alias("start_year"), F.col("last_year").alias("end_year"), F.col("first_value").alias("start_share_pct"), F.col("last_value").alias("end_share_pct"),
        (F.col("last_value") - F.col("first_value")).alias("change_pp"), F.col("slope_per_decade").alias("slope_pp_per_decade"),
    )
    if described is None:
        return out
    ratio = lambda c: F.try_divide(F.col(c), F.col("described_pct"))
    return out.join(described.select("group", "described_pct"), "group", "left").withColumns({"start_ratio": ratio("start_share_pct"), "end_ratio": ratio("end_share_pct")})
