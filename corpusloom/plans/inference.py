"""Queries of bootstraps (whose draws have no SQL; tests hold them against plain numpy), rank comparison, rounding, rules and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import rules as U
from corpusloom.operators import attribution as A
from corpusloom.operators import resampling as B
from corpusloom.plans.compositions import _regional
from corpusloom.sources.tables import SQL, labels, realms, table
from corpusloom.streaming.ingest import window_counts

R = 6
REPLICATES, SEED = 1000, 7
PAIR = ("ASIA", "EUROPE")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, R) for c in columns})


def bootstrap_contrast(spark, sf):
    weights = _regional(spark, sf).select("id", F.col("region").alias("group"), "label", "w")
    return _rounded(B.contrast_bootstrap(weights, PAIR, REPLICATES, SEED), "contrast", "lo", "hi")


def bootstrap_standardized(spark, sf):
    cells = _regional(spark, sf).join(realms(spark, sf).select("id", "realm"), "id")
    cells = cells.select("id", F.when(F.col("region").isin(*PAIR), "a").otherwise("b").alias("tier"), "realm", "label", "w")
    return _rounded(B.standardized_bootstrap(cells, ("a", "b"), ["realm"], REPLICATES, SEED), "contrast", "lo", "hi")


def bootstrap_patterns(spark, sf):
    """Intervals of label shares by label-set patterns."""
    return _rounded(B.pattern_bootstrap(labels(spark, sf), REPLICATES, SEED), "share", "lo", "hi")


def label_patterns(spark, sf):
    return B.patterns(labels(spark, sf)).select(F.array_join("pattern", ";").alias("pattern"), "n")


SPECS = ("main", "counts", "single", "open", "early", "urgent")


def specification_sensitivity(spark, sf):
    """Fractional shares against five other specifications: full counts, single labels, open orders, early years and
    urgent orders only."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.year("o_orderdate").alias("y"), "o_orderpriority")
    w = A.fractional_weights(labels(spark, sf)).join(orders, "id")
    only = lambda test: F.sum(F.when(test, F.col("w")).otherwise(0.0))
    w = w.groupBy("label").agg(
        F.sum("w").alias("main"), F.count(F.lit(1)).cast("double").alias("counts"), F.sum(F.when(F.col("w") > 0.99, 1.0).otherwise(0.0)).alias("single"), only(F.col("o_orderstatus") == "O").alias("open"), only(F.col("y") <= 1998).alias("early"),
        only(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    share = lambda c: F.round(100 * F.col(c) / F.sum(c).over(A.W.partitionBy()), R).alias(c)  # noqa: E731  a row per label
    long = w.select("label", *map(share, SPECS)).unpivot(["label"], list(SPECS), "spec", "value")
    return _rounded(B.compare_specs(long, "spec", "label", "value", "main"), "spearman", "max_abs_change", "same_sign")


def whole_percent(spark, sf):
    counts = labels(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    shared = counts.withColumn("share", 100 * F.col("n") / F.sum("n").over(A.W.partitionBy()))  # a row per label
    return B.rounded_to_whole(shared, "share", "label").select("label", "n", "whole")


def top_label_share(spark, sf):
    counts = labels(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(B.top_share(counts, "n", "label", [10, 25]).select(F.col("k").cast("long").alias("k"), "share_pct"), "share_pct")


RULES = [
    {"group": "urgent_open", "when": [{"field": "o_orderpriority", "op": "in", "values": ["1-URGENT"]}, {"field": "o_orderstatus", "op": "not_in", "values": ["F"]}]},
    {"group": "closed", "when": [{"field": "o_orderstatus", "op": "in", "values": ["F"]}]},
    {"group": "rest", "when": [{"field": "o_orderpriority", "op": "present"}]},
]


def rule_groups(spark, sf):
    special = F.when(F.col("o_totalprice") > 300000, "large")
    group = U.assign_group(F.col("o_totalprice") >= 40000, special, RULES, F.col)
    return table(spark, sf, "orders").groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("n"))


def match_policy(spark, sf):
    """Outcomes of lines read as name matches: return flag as kind, line status as rank."""
    li = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "EXACT").when(F.col("l_returnflag") == "R", "FUZZY").when(F.col("l_linenumber") == 1, "HIGHERRANK").when(F.col("l_linenumber") == 2, "AMBIGUOUS")
    out = U.match_outcome(kind, F.col("l_linestatus"), F.lit("F"), F.col("l_quantity") * 2)
    return li.groupBy(out.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def daily_event_windows(spark, sf):
    """The stream's windowed counts, over the table as it is."""
    out = window_counts(table(spark, sf, "events"), "ts", ["event_type"], "1 day", "1 hour")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 3).alias("total"))


QUERIES = {f.__name__: f for f in (
    bootstrap_contrast, bootstrap_standardized, bootstrap_patterns, label_patterns, specification_sensitivity, whole_percent, top_label_share, rule_groups, match_policy, daily_event_windows,
)}



ORACLES = {
    "label_patterns": f"WITH {SQL}, o AS (SELECT id, string_agg(label, ';' ORDER BY label) AS pattern FROM lab GROUP BY id) SELECT pattern, count(*) AS n FROM o GROUP BY pattern",
    "specification_sensitivity": f"""WITH {SQL}, lw AS (SELECT l.label, 1.0::DOUBLE / count(*) OVER (PARTITION BY id) AS w, o_orderstatus AS st, year(o_orderdate) AS y, o_orderpriority AS pr FROM lab l JOIN orders ON id = o_orderkey),
s AS (SELECT label, sum(w) AS main, count(*)::DOUBLE AS counts, sum(CASE WHEN w > 0.99 THEN 1.0 ELSE 0.0 END)::DOUBLE AS single, sum(CASE WHEN st = 'O' THEN w ELSE 0 END) AS open, sum(CASE WHEN y <= 1998 THEN w ELSE 0 END) AS early, sum(CASE WHEN pr = '1-URGENT' THEN w ELSE 0 END) AS urgent FROM lw GROUP BY label),
sh AS (SELECT label, {", ".join(f"round(100 * {c} / sum({c}) OVER (), {R}) AS {c}" for c in SPECS)} FROM s),
l AS ({" UNION ALL ".join(f"SELECT '{c}' AS spec, label, {c} AS v, main AS b FROM sh" for c in SPECS[1:])}),
k AS (SELECT *, rank() OVER (PARTITION BY spec ORDER BY v) + (count(*) OVER (PARTITION BY spec, v) - 1) / 2 AS x, rank() OVER (PARTITION BY spec ORDER BY b) + (count(*) OVER (PARTITION BY spec, b) - 1) / 2 AS y FROM l)
SELECT spec, count(*) AS n, round(corr(x, y), {R}) AS spearman, round(max(abs(v - b)), {R}) AS max_abs_change, round(avg((sign(v) = sign(b))::INT), {R}) AS same_sign FROM k GROUP BY spec""",
    "whole_percent": f"WITH {SQL}, c AS (SELECT label, count(*) AS n FROM lab GROUP BY label), s AS (SELECT *, 100 * n / sum(n) OVER () AS sh FROM c), r AS (SELECT *, row_number() OVER (ORDER BY sh - floor(sh) DESC, label) AS r, sum(floor(sh)) OVER () AS t FROM s) SELECT label, n, (floor(sh) + CASE WHEN r <= 100 - t THEN 1 ELSE 0 END)::BIGINT AS whole FROM r",
    "top_label_share": f"WITH {SQL}, c AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS r FROM lab GROUP BY label) SELECT k::BIGINT AS k, round(100 * sum(CASE WHEN r <= k THEN n ELSE 0 END) / sum(n), {R}) AS share_pct FROM c CROSS JOIN (VALUES (10), (25)) t(k) GROUP BY k",
    "rule_groups": "SELECT CASE WHEN o_totalprice < 40000 THEN NULL WHEN o_totalprice > 300000 THEN 'large' WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN 'urgent_open' WHEN o_orderstatus = 'F' THEN 'closed' WHEN trim(o_orderpriority) <> '' THEN 'rest' ELSE 'unassigned' END AS \"group\", count(*) AS n FROM orders GROUP BY ALL",
    "match_policy": "SELECT CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'F' THEN 'accepted' ELSE 'rank_mismatch' END WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus <> 'F' THEN 'rank_mismatch' WHEN l_quantity * 2 >= 90 THEN 'accepted' ELSE 'low_confidence' END WHEN l_linenumber = 1 THEN 'higher_rank' WHEN l_linenumber = 2 THEN 'ambiguous' ELSE 'no_match' END AS outcome, count(*) AS n FROM lineitem GROUP BY ALL",
    "daily_event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL",
}
