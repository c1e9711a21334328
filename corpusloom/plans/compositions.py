"""Queries of attribution, composition, contrast and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import attribution as A
from corpusloom.operators import comparisons as M
from corpusloom.operators import temporal as T
from corpusloom.sources.tables import SQL, axes, countries, labels, publications, realms, table

R = 6
YEARS = (1995, 2001)
PERIODS = [(1995, 1998), (1998, 2001)]
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, R) for c in columns})


def _by_year(spark, sf):
    pairs = publications(spark, sf).where("direction = 'F'").join(labels(spark, sf), "id")
    return A.fractional_share(pairs, ["year"])


def fractional_label_share_by_year(spark, sf):
    return _rounded(_by_year(spark, sf), "fractional_count").withColumn("share", F.round("share", 3))


_FRAC = f"""{SQL},
x AS (SELECT pub.year, lab.id, lab.label, 1.0::DOUBLE / count(*) OVER (PARTITION BY lab.id) AS w FROM pub JOIN lab USING (id) WHERE direction = 'F'),
f AS (SELECT year, label, sum(w) AS fc FROM x GROUP BY year, label),
n AS (SELECT year, count(DISTINCT id)::BIGINT AS n_pubs FROM x GROUP BY year)"""


def annual_counts_cumulative_yoy(spark, sf):
    out = T.annual_counts(publications(spark, sf).where("direction = 'F'"), "year", "id", *YEARS)
    return out.select(F.col("year").cast("long").alias("year"), "n", "cumulative", F.round("yoy_pct", 1).alias("yoy_pct"))


def cagr_by_period(spark, sf):
    out = T.cagr_by_period(_by_year(spark, sf), "label", "year", "fractional_count", PERIODS)
    return _rounded(out.select("label", F.col("start_year").cast("long").alias("start_year"), F.col("end_year").cast("long").alias("end_year"), "base", "end", "cagr_pct", "note"), "base", "end", "cagr_pct")


def _grid(spark, sf):
    facts = _by_year(spark, sf).select("year", "label", "fractional_count")
    years = spark.range(YEARS[0], YEARS[1] + 1).select(F.col("id").alias("year"))
    return A.dense_grid([years, labels(spark, sf).select("label").distinct()], facts, ["year", "label"], {"fractional_count": 0.0})


def rolling_cagr(spark, sf):
    return _rounded(T.rolling_cagr(_grid(spark, sf), "label", "year", "fractional_count", 2), "fractional_count", "rolling_cagr")


def centered_rolling_mean(spark, sf):
    return _rounded(T.centered_mean(_grid(spark, sf), ["label"], "year", "fractional_count"), "fractional_count", "rolling_mean")


def trend_slope(spark, sf):
    out = T.slope_per_decade(_grid(spark, sf), "label", "year", "fractional_count")
    return _rounded(out.select("label", "slope_per_decade", "first_value", "last_value"), "slope_per_decade", "first_value", "last_value")


def attention_trend_grid(spark, sf):
    g = _grid(spark, sf)
    return g.withColumn("share", F.round(100 * F.coalesce(F.try_divide(F.col("fractional_count"), F.sum("fractional_count").over(A.W.partitionBy("year"))), F.lit(0.0)), R)).withColumn("fractional_count", F.round("fractional_count", R))


def _trend(spark, sf, **how):
    held = labels(spark, sf).groupBy("id").agg(F.collect_list("label").alias("groups"))
    return T.attention_trend(publications(spark, sf).join(held, "id"), "year", "groups", TYPES, **how)


def attention_trend_single_group(spark, sf):
    """Publications of one type only, shares among four types."""
    return _rounded(_trend(spark, sf, single_only=True, over=TYPES[:4]), "attention", "share_pct", "year_total")


def attention_trend_summary(spark, sf):
    """Trends of four types' shares, against the types' shares of all parts."""
    parts = table(spark, sf, "part").groupBy(F.col("p_type").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    described = parts.select("group", (100 * F.col("n") / F.sum("n").over(A.W.partitionBy())).alias("described_pct")).where(F.col("group") != "LARGE")  # a row a type
    out = T.trend_summary(_trend(spark, sf, over=TYPES[:4]), described)
    return _rounded(out, "start_share_pct", "end_share_pct", "change_pp", "slope_pp_per_decade", "described_pct", "start_ratio", "end_ratio")


_SOME = ", ".join(f"'{t}'" for t in TYPES[:4])
_TREND = f"""{SQL}, k AS (SELECT id, label, count(*) OVER (PARTITION BY id) AS k FROM lab), m AS (SELECT id, label, k, count(*) OVER (PARTITION BY id) AS j FROM k WHERE label IN ({_SOME}) AND k <= {{most}}),
t AS (SELECT year, label, sum(1.0::DOUBLE / j) AS w FROM m JOIN pub USING (id) GROUP BY ALL), tg AS (SELECT y.year, l.label AS "group", coalesce(w, 0) AS attention, sum(coalesce(w, 0)) OVER (PARTITION BY y.year) AS year_total
  FROM (SELECT DISTINCT year FROM t) y CROSS JOIN (SELECT unnest([{_SOME}]) AS label) l LEFT JOIN t ON t.year = y.year AND t.label = l.label)"""
_GRID = f"""{_FRAC}, g AS (SELECT y.year, l.label, coalesce(fc, 0.0) AS v FROM (SELECT unnest(range({YEARS[0]}, {YEARS[1] + 1}))::BIGINT AS year) y CROSS JOIN (SELECT DISTINCT label FROM lab) l LEFT JOIN f ON f.year = y.year AND f.label = l.label)"""


def _two_way(spark, sf):
    return A.two_way_from_sets(axes(spark, sf), {"place": "places", "label": "labels"}).select("id", "place.country", "place.region", "label", "w")


def two_way_attribution(spark, sf):
    return _rounded(_two_way(spark, sf).groupBy("country", "label").agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("n")), "weight")


_regional = _two_way


def group_composition(spark, sf):
    return _rounded(A.group_composition(_regional(spark, sf), "region", "label"), "weight", "share_pct")


#: The closed vocabulary of the labels.
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def composition_matrix(spark, sf):
    long = A.group_composition(_regional(spark, sf), "region", "label")
    wide = A.composition_matrix(long, "region", "label", TYPES, name=lambda v: "c_" + v.lower())
    return _rounded(wide, *[c for c in wide.columns if c != "region"])


def full_weight_legacy_composition(spark, sf):
    pairs = axes(spark, sf).select("id", F.explode(F.array_distinct(F.col("places.region"))).alias("region"), (1.0 / F.size("labels")).alias("w"), "labels")
    return _rounded(A.group_composition(pairs.select("region", "w", F.explode("labels").alias("label")), "region", "label"), "weight", "share_pct")


TIER_A = ("ASIA", "EUROPE")


def standardized_tier_contrast(spark, sf):
    cells = _regional(spark, sf).join(realms(spark, sf).select("id", "realm", "year"), "id")
    cells = cells.select("id", F.when(F.col("region").isin(*TIER_A), "a").otherwise("b").alias("tier"), F.col("realm").alias("s1"), F.when(F.col("year") <= 1998, "early").otherwise("late").alias("s2"), "label", "w")
    out = A.standardized_shares(cells, ("a", "b"), stratum=("s1", "s2"))
    return _rounded(out.withColumn("contrast", F.col("std_a") - F.col("std_b")), "std_a", "std_b", "contrast")


def complete_case_exclusions(spark, sf):
    """One country outside the valid set removes the whole publication."""
    c = countries(spark, sf).select("id", "country", (F.col("region") == "AFRICA").alias("bad"))
    marked = c.groupBy("id").agg(F.max("bad").alias("bad"), F.count(F.lit(1)).alias("k"))
    return marked.groupBy("bad").agg(F.count(F.lit(1)).alias("publications"), F.sum("k").alias("assignments"))


def versioned_dimension_join(spark, sf):
    """Classification by entity and year of the next fiscal year."""
    tier = F.when(F.col("c") % 3 == 0, "low").when(F.col("c") % 3 == 1, "middle").otherwise("high")
    history = realms(spark, sf).groupBy(F.col("nation").alias("entity"), "year").agg(F.count(F.lit(1)).alias("c")).select("entity", (F.col("year") + 1).alias("period"), tier.alias("value"))
    linked = M.versioned(realms(spark, sf), history, "nation", "year", 0, "tier")
    return linked.groupBy("year", "tier").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("nation").alias("nations"))


def income_transition_matrix(spark, sf):
    r = realms(spark, sf).groupBy("nation", "year").agg((F.count(F.lit(1)) % 3).alias("tier"))
    return M.transition_matrix(r, "nation", "year", "tier").select(F.col("from").alias("from_tier"), F.col("to").alias("to_tier"), "n")


def country_counts_metadata_check(spark, sf):
    """Records per country with its one region; a country with several would be flagged."""
    per = countries(spark, sf).groupBy("id", "country").agg(F.min("region").alias("least"), F.max("region").alias("most"))  # rows of an id are together
    return per.groupBy("country").agg(F.count("id").alias("n"), F.min("least").alias("region"), F.coalesce(F.min("least") == F.max("most"), F.lit(False)).alias("consistent"))


def label_legend_topn_other(spark, sf):
    counts = labels(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(A.W.orderBy(F.desc("n"), "label")))  # a row per label
    return ranked.groupBy(F.when(F.col("r") <= 3, F.col("label")).otherwise("Other").alias("label")).agg(F.sum("n").alias("n")).withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(A.W.partitionBy()), R))


def attention_vs_benchmark(spark, sf):
    own = A.fractional_weights(labels(spark, sf)).groupBy("label").agg(F.sum("w").alias("attention"))
    bench = table(spark, sf, "part").groupBy(F.col("p_type").alias("label")).agg(F.count(F.lit(1)).alias("described"))
    return _rounded(M.against_benchmark(own, bench, "label", "attention", "described"), "share", "expected", "gap", "ratio", "log2_ratio")


_TW = f"""{SQL}, tw AS (SELECT c.id, c.country, c.region, l.label, 1.0::DOUBLE / (c.k * l.k) AS w FROM (SELECT *, count(*) OVER (PARTITION BY id) AS k FROM ctry) c JOIN (SELECT *, count(*) OVER (PARTITION BY id) AS k FROM lab) l ON c.id = l.id)"""
_COMP = "SELECT region, label, sum(w) AS weight FROM tw GROUP BY region, label"

QUERIES = {f.__name__: f for f in (
    fractional_label_share_by_year, annual_counts_cumulative_yoy, cagr_by_period, rolling_cagr, centered_rolling_mean, trend_slope, attention_trend_grid, attention_trend_single_group, attention_trend_summary, two_way_attribution, group_composition, composition_matrix,
    full_weight_legacy_composition, standardized_tier_contrast, complete_case_exclusions, versioned_dimension_join, income_transition_matrix, country_counts_metadata_check, label_legend_topn_other, attention_vs_benchmark,
)}

ORACLES = {
    "fractional_label_share_by_year": f"WITH {_FRAC} SELECT year, label, round(fc, {R}) AS fractional_count, n_pubs, round(round(100 * fc / n_pubs, 4), 3) AS share FROM f JOIN n USING (year)",
    "annual_counts_cumulative_yoy": f"WITH {SQL}, c AS (SELECT y.year, count(pub.id)::BIGINT AS n FROM (SELECT unnest(range({YEARS[0]}, {YEARS[1] + 1}))::BIGINT AS year) y LEFT JOIN pub ON pub.year = y.year AND direction = 'F' GROUP BY y.year) SELECT year, n, (sum(n) OVER (ORDER BY year))::BIGINT AS cumulative, CASE WHEN lag(n) OVER (ORDER BY year) > 0 THEN round(round(100.0::DOUBLE * (n - lag(n) OVER (ORDER BY year)) / lag(n) OVER (ORDER BY year), 2), 1) END AS yoy_pct FROM c",
    "cagr_by_period": f"""WITH {_FRAC}, p AS (SELECT * FROM (VALUES {', '.join(f'({a}::BIGINT, {b}::BIGINT)' for a, b in PERIODS)}) t(start_year, end_year)),
x2 AS (SELECT label, start_year, end_year, coalesce(sum(fc) FILTER (year = start_year), 0.0) AS base, coalesce(sum(fc) FILTER (year = end_year), 0.0) AS e FROM f CROSS JOIN p GROUP BY ALL)
SELECT label, start_year, end_year, round(base, {R}) AS base, round(e, {R}) AS "end", CASE WHEN base > 0 THEN round((pow(e / base, 1.0::DOUBLE / (end_year - start_year)) - 1) * 100, {R}) END AS cagr_pct, CASE WHEN base <= 0 THEN 'base is zero' ELSE '' END AS note FROM x2""",
    "rolling_cagr": f"WITH {_GRID} SELECT year, label, round(v, {R}) AS fractional_count, CASE WHEN lag(v, 2) OVER w > 0 THEN round((pow(v / lag(v, 2) OVER w, 0.5) - 1) * 100, {R}) END AS rolling_cagr FROM g WINDOW w AS (PARTITION BY label ORDER BY year)",
    "centered_rolling_mean": f"WITH {_GRID} SELECT year, label, round(v, {R}) AS fractional_count, CASE WHEN count(v) OVER w >= 3 THEN round(avg(v) OVER w, {R}) END AS rolling_mean FROM g WINDOW w AS (PARTITION BY label ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "trend_slope": f"WITH {_GRID} SELECT label, round(regr_slope(v, year) * 10, {R}) AS slope_per_decade, round(min_by(v, year), {R}) AS first_value, round(max_by(v, year), {R}) AS last_value FROM g GROUP BY label",
    "attention_trend_grid": f"WITH {_GRID} SELECT year, label, round(v, {R}) AS fractional_count, round(coalesce(100 * v / nullif(sum(v) OVER (PARTITION BY year), 0), 0), {R}) AS share FROM g",
    "attention_trend_single_group": f"""WITH {_TREND.format(most=1)} SELECT year, "group", round(attention, {R}) AS attention, round(100 * attention / year_total, {R}) AS share_pct, round(year_total, {R}) AS year_total FROM tg""",
    "attention_trend_summary": f"""WITH {_TREND.format(most=99)}, s AS (SELECT year, "group", 100 * attention / year_total AS s FROM tg), d AS (SELECT p_type AS "group", 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS described_pct FROM part GROUP BY p_type),
a AS (SELECT "group", min(year) AS start_year, max(year) AS end_year, min_by(s, year) AS s0, max_by(s, year) AS s1, regr_slope(s, year) * 10 AS slope FROM s GROUP BY "group")
SELECT a."group", start_year, end_year, round(s0, {R}) AS start_share_pct, round(s1, {R}) AS end_share_pct, round(s1 - s0, {R}) AS change_pp, round(slope, {R}) AS slope_pp_per_decade, round(described_pct, {R}) AS described_pct, round(s0 / described_pct, {R}) AS start_ratio, round(s1 / described_pct, {R}) AS end_ratio
FROM a LEFT JOIN d ON a."group" = d."group" AND a."group" <> 'LARGE'""",
    "two_way_attribution": f"WITH {_TW} SELECT country, label, round(sum(w), {R}) AS weight, count(*) AS n FROM tw GROUP BY country, label",
    "composition_matrix": f"WITH {_TW}, c AS ({_COMP}), s AS (SELECT region, label, 100 * weight / sum(weight) OVER (PARTITION BY region) AS s FROM c) SELECT region, " + ", ".join(f"round(coalesce(sum(s) FILTER (label = '{t}'), 0), {R}) AS c_{t.lower()}" for t in TYPES) + " FROM s GROUP BY region",
    "group_composition": f"WITH {_TW}, c AS ({_COMP}) SELECT region, label, round(weight, {R}) AS weight, round(100 * weight / sum(weight) OVER (PARTITION BY region), {R}) AS share_pct FROM c",
    "full_weight_legacy_composition": f"WITH {SQL}, p AS (SELECT DISTINCT id, region, label FROM ctry JOIN lab USING (id)), k AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY id, region) AS w FROM p), c AS (SELECT region, label, sum(w) AS weight FROM k GROUP BY ALL) SELECT region, label, round(weight, {R}) AS weight, round(100 * weight / sum(weight) OVER (PARTITION BY region), {R}) AS share_pct FROM c",
    "standardized_tier_contrast": f"""WITH {_TW}, cells AS (SELECT tw.id, CASE WHEN region IN ('ASIA', 'EUROPE') THEN 'a' ELSE 'b' END AS tier, realm AS s1, CASE WHEN year <= 1998 THEN 'early' ELSE 'late' END AS s2, label, w FROM tw JOIN seg USING (id)),
st AS (SELECT s1, s2, count(DISTINCT id) AS n FROM cells GROUP BY s1, s2 HAVING count(DISTINCT id) FILTER (tier = 'a') > 0 AND count(DISTINCT id) FILTER (tier = 'b') > 0),
ww AS (SELECT s1, s2, n / sum(n) OVER () AS wt FROM st), sm AS (SELECT s1, s2, wt, tier, label, sum(w) AS x FROM cells JOIN ww USING (s1, s2) GROUP BY ALL),
sh AS (SELECT *, x / sum(x) OVER (PARTITION BY s1, s2, tier) AS s FROM sm),
o AS (SELECT label, 100 * sum(CASE WHEN tier = 'a' THEN wt * s ELSE 0 END) AS a, 100 * sum(CASE WHEN tier = 'b' THEN wt * s ELSE 0 END) AS b FROM sh GROUP BY label)
SELECT label, round(a, {R}) AS std_a, round(b, {R}) AS std_b, round(a - b, {R}) AS contrast FROM o""",
    "complete_case_exclusions": f"WITH {SQL}, m AS (SELECT id, bool_or(region = 'AFRICA') AS bad, count(*) AS k FROM ctry GROUP BY id) SELECT bad, count(*) AS publications, sum(k)::BIGINT AS assignments FROM m GROUP BY bad",
    "versioned_dimension_join": f"WITH {SQL}, h AS (SELECT nation, year + 1 AS fy, CASE count(*) % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'middle' ELSE 'high' END AS tier FROM seg GROUP BY nation, year) SELECT year, coalesce(tier, 'missing') AS tier, count(*) AS n, count(DISTINCT seg.nation) AS nations FROM seg LEFT JOIN h ON seg.nation = h.nation AND seg.year = h.fy GROUP BY ALL",
    "income_transition_matrix": f"WITH {SQL}, t AS (SELECT nation, year, count(*) % 3 AS tier FROM seg GROUP BY nation, year) SELECT a.tier AS from_tier, b.tier AS to_tier, count(*) AS n FROM t a JOIN t b ON a.nation = b.nation AND b.year = a.year + 1 GROUP BY ALL",
    "country_counts_metadata_check": f"WITH {SQL} SELECT country, count(DISTINCT id) AS n, min(region) AS region, count(DISTINCT region) = 1 AS consistent FROM ctry GROUP BY country",
    "label_legend_topn_other": f"WITH {SQL}, c AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS r FROM lab GROUP BY label), o AS (SELECT CASE WHEN r <= 3 THEN label ELSE 'Other' END AS label, sum(n)::BIGINT AS n FROM c GROUP BY ALL) SELECT label, n, round(100.0::DOUBLE * n / sum(n) OVER (), {R}) AS share FROM o",
    "attention_vs_benchmark": f"WITH {SQL}, a AS (SELECT label, sum(w) AS att FROM (SELECT label, 1.0::DOUBLE / count(*) OVER (PARTITION BY id) AS w FROM lab) GROUP BY label), b AS (SELECT p_type AS label, count(*) AS d FROM part GROUP BY p_type), j AS (SELECT label, 100 * att / sum(att) OVER () AS s, 100.0::DOUBLE * d / sum(d) OVER () AS e FROM a JOIN b USING (label)) SELECT label, round(s, {R}) AS share, round(e, {R}) AS expected, round(s - e, {R}) AS gap, round(s / e, {R}) AS ratio, round(log2(s / e), {R}) AS log2_ratio, CASE WHEN s / e > 1 THEN 'over' ELSE 'under' END AS flag FROM j",
}
