"""Queries of masks, legends, transitions, definitions, matches and the rest of the trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import comparisons as O
from corpusloom.operators import trees as T
from corpusloom.plans import trees as P
from corpusloom.sources.tables import SQL, axes, countries, labels, publications, realms, table

R = 6


def _r(df, *columns):
    return df.withColumns({c: F.round(c, R) for c in columns})


def mask_levels(spark, sf):
    """Publications by whether their labels (level 0) and regions (level 1) hold a placeholder; what is out at level 0 is
    out at level 1."""
    d = axes(spark, sf).select("id", "labels", F.array_distinct(F.col("places.region")).alias("regions"), F.slice(F.array_sort("labels"), 1, 1).alias("predicted"))
    out = O.level_masks(d, [("l0", ["labels", "predicted"]), ("l1", ["regions"])], ["promo", "asia"])
    return out.groupBy("l0", "l1").agg(F.count(F.lit(1)).alias("n"))


def segment_counts(spark, sf):
    return _r(O.vocabulary_counts(realms(spark, sf), "realm", ["BUILDING", "FURNITURE", "MACHINERY"], "realm"), "share_pct")


def label_legend(spark, sf):
    out = O.label_legend(_labelled(spark, sf), "labels", skip=("SMALL",), top=3)
    return _r(out.withColumn("rank", F.col("rank").cast("long")), "share_pct")


def _labelled(spark, sf):
    return publications(spark, sf).join(axes(spark, sf).select("id", "labels"), "id", "left")


def label_codes(spark, sf):
    d = _labelled(spark, sf)
    out = O.label_codes(d, "labels", O.label_legend(d, "labels", skip=("SMALL",), top=3), skip=("SMALL",))
    return out.groupBy(F.col("code").cast("long").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def _tiers(spark, sf):
    """Nations' tier in each year, by their publications; none in a year of few."""
    c = realms(spark, sf).groupBy("nation", "year").agg(F.count(F.lit(1)).alias("c"))
    return c.withColumn("tier", F.when(F.col("c") % 5 == 0, F.lit(None).cast("string")).when(F.col("c") % 2 == 0, "even").otherwise("odd"))


def tier_transitions(spark, sf):
    return O.transition_matrix(_tiers(spark, sf), "nation", "year", "tier")


def missing_tiers_by_year(spark, sf):
    return O.missing_by(realms(spark, sf).join(_tiers(spark, sf), ["nation", "year"]), "year", "tier", "nation")


def definition_shares(spark, sf):
    """Regions' shares under four definitions, ranked."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    wide = li.groupBy(F.col("r_name").alias("region")).agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"))
    return O.definition_shares(wide, "region", ["quantity", "lines", "orders", "parts"]).drop("value")


def outer_report(spark, sf):
    """Supplier nations against nations of rich customers: what only one side has."""
    a = countries(spark, sf).groupBy("country").agg(F.max("region").alias("region"), F.count(F.lit(1)).alias("evidence"))
    c = table(spark, sf, "customer").where("c_acctbal > 9000").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    b = c.groupBy(F.col("n_name").alias("country")).agg(F.max("r_name").alias("region"), F.count(F.lit(1)).alias("need"))
    return O.outer_report(a, b, "country", "region")[0]


def outer_report_sides(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("l"))
    b = table(spark, sf, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderstatus").alias("l"))
    return O.outer_report(a, b, "k", "l")[1].select("side", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ";").alias("examples"))


def rank_resolution(spark, sf):
    paths = realms(spark, sf).select("cregion", F.when(F.col("cregion") != "ASIA", F.col("nation")).alias("nation"), F.when(F.col("priority") == "1-URGENT", F.col("realm")).alias("realm"))
    return _r(O.rank_resolution(paths, ["cregion", "nation", "realm"]), "share_pct")


def realm_label_summary(spark, sf):
    w = axes(spark, sf).select("id", (1.0 / F.size("labels")).alias("w"), F.explode("labels").alias("label"))
    return _r(O.realm_summary(realms(spark, sf).select("id", "realm"), w, "realm"), "prevalence", "pooled_prevalence", "fractional_share", "lq", "log2_lq")


COVERAGE, BUDGET, NAMED = 60.0, 3, 1.0


def compact_tree(spark, sf):
    """Segments named below a nation where three or fewer hold 60 % of it, if they hold 1 % of all."""
    return T.compact_level(P._paths(spark, sf), P.LEVELS, 2, ("n_orders", "n_customers"), COVERAGE, BUDGET, NAMED)


def tree_assignments(spark, sf):
    """Each path with its leaf of the selected tree."""
    return T.assignments(P._paths(spark, sf), P.tree_selection(spark, sf), P.LEVELS)


QUERIES = {f.__name__: f for f in (
    mask_levels, segment_counts, label_legend, label_codes, tier_transitions, missing_tiers_by_year, definition_shares, outer_report, outer_report_sides, rank_resolution, realm_label_summary, compact_tree, tree_assignments,
)}

_LEG = f"{SQL}, k AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS rank, count(*) AS n FROM lab WHERE label <> 'SMALL' AND id IN (SELECT id FROM pub) GROUP BY label)"
_TIER = f"{SQL}, c AS (SELECT nation, year, count(*) AS c FROM seg GROUP BY ALL), t AS (SELECT *, CASE WHEN c % 5 = 0 THEN NULL WHEN c % 2 = 0 THEN 'even' ELSE 'odd' END AS tier FROM c)"
_OUT = "a AS (SELECT country, max(region) AS ra, count(*) AS evidence FROM ctry GROUP BY country), b AS (SELECT n_name AS country, max(r_name) AS rb, count(*) AS need FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000 GROUP BY n_name)"
_PATHS = P._selection_sql().split(",\nchild0")[0]
_GRID = "SELECT {d} AS definition, region, {c}::DOUBLE AS v FROM w"
ORACLES = {
    "mask_levels": f"WITH {SQL}, a AS (SELECT id, bool_or(label = 'PROMO') AS bad FROM lab GROUP BY id), b AS (SELECT id, bool_or(region = 'ASIA') AS bad FROM ctry GROUP BY id) SELECT NOT a.bad AS l0, NOT a.bad AND NOT b.bad AS l1, count(*) AS n FROM a JOIN b USING (id) GROUP BY ALL",
    "segment_counts": f"WITH {SQL}, c AS (SELECT realm, count(*) AS n FROM seg WHERE realm IN ('BUILDING', 'FURNITURE', 'MACHINERY') GROUP BY realm) SELECT realm, n, round(100 * n / sum(n) OVER (), 6) AS share_pct FROM c",
    "label_legend": f"WITH {_LEG}, t AS (SELECT count(*) AS t FROM pub) SELECT label, rank, n AS n_documents, round(100 * n / t, 6) AS share_pct FROM k, t WHERE rank <= 3 UNION ALL SELECT 'Other', 4, count(DISTINCT lab.id), round(100 * count(DISTINCT lab.id) / any_value(t), 6) FROM lab JOIN pub USING (id) JOIN k USING (label), t WHERE k.rank > 3 HAVING count(*) > 0",
    "label_codes": f"WITH {_LEG}, c AS (SELECT pub.id, coalesce(min(CASE WHEN rank IS NOT NULL THEN least(rank, 4) END), 0) AS code FROM pub LEFT JOIN lab USING (id) LEFT JOIN k USING (label) GROUP BY pub.id) SELECT code, count(*) AS n FROM c GROUP BY code",
    "tier_transitions": f"WITH {_TIER} SELECT a.tier AS \"from\", b.tier AS \"to\", count(*) AS n FROM t a JOIN t b ON a.nation = b.nation AND b.year = a.year + 1 WHERE a.tier IS NOT NULL AND b.tier IS NOT NULL GROUP BY ALL",
    "missing_tiers_by_year": f"WITH {_TIER} SELECT year, sum(c)::BIGINT AS records, count(*) AS entities FROM t WHERE tier IS NULL GROUP BY year",
    "definition_shares": "WITH w AS (SELECT r_name AS region, sum(l_quantity) AS q, count(*) AS l, count(DISTINCT l_orderkey) AS o, count(DISTINCT l_partkey) AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name), u AS (" + " UNION ALL ".join(_GRID.format(d=f"'{d}'", c=c) for d, c in (("quantity", "q"), ("lines", "l"), ("orders", "o"), ("parts", "p"))) + "), s AS (SELECT definition, region, round(100 * v / sum(v) OVER (PARTITION BY definition), 6) AS share_pct FROM u) SELECT *, row_number() OVER (PARTITION BY definition ORDER BY share_pct DESC, region) AS rank FROM s",
    "outer_report": f"WITH {SQL}, {_OUT} SELECT country, evidence, need, CASE WHEN need IS NULL THEN 'left_only' WHEN evidence IS NULL THEN 'right_only' ELSE 'both' END AS side, coalesce(ra, rb) AS region FROM a FULL JOIN b USING (country)",
    "outer_report_sides": "WITH b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000), u AS (SELECT CASE WHEN b.k IS NULL THEN 'left_only' ELSE 'right_only' END AS side, coalesce(c_custkey, b.k) AS k FROM customer FULL JOIN b ON c_custkey = b.k WHERE b.k IS NULL OR c_custkey IS NULL) SELECT side, count(*) AS n, array_to_string(list_sort(list(k))[1:5], ';') AS examples FROM u GROUP BY side",
    "rank_resolution": f"WITH {SQL}, p AS (SELECT cregion, CASE WHEN cregion <> 'ASIA' THEN nation END AS nation, CASE WHEN priority = '1-URGENT' THEN realm END AS realm FROM seg) " + " UNION ALL ".join(f"SELECT '{c}' AS rank, count({c}) AS resolved, round(100 * count({c}) / count(*), 6) AS share_pct, count(DISTINCT {c}) AS values FROM p" for c in ("cregion", "nation", "realm")),
    "realm_label_summary": f"""WITH {SQL}, w AS (SELECT id, label, 1.0::DOUBLE / count(*) OVER (PARTITION BY id) AS w FROM lab), d AS (SELECT id, realm FROM seg WHERE id IN (SELECT id FROM lab)), s AS (SELECT realm, count(*) AS n_documents FROM d GROUP BY realm), c AS (SELECT realm, label, count(*) AS n, sum(w) AS w FROM d JOIN w USING (id) GROUP BY ALL),
      g AS (SELECT s.realm, l.label, coalesce(n, 0) AS n_label_documents, n_documents, coalesce(w, 0) AS w FROM s CROSS JOIN (SELECT DISTINCT label FROM w JOIN d USING (id)) l LEFT JOIN c ON c.realm = s.realm AND c.label = l.label),
      p AS (SELECT *, n_label_documents / n_documents AS a, sum(n_label_documents) OVER (PARTITION BY label) / sum(n_documents) OVER (PARTITION BY label) AS b FROM g)
      SELECT realm, label, n_label_documents, n_documents, round(a, 6) AS prevalence, round(b, 6) AS pooled_prevalence, round(w / n_documents, 6) AS fractional_share, round(a / b, 6) AS lq, CASE WHEN a > 0 THEN round(log2(a / b), 6) ELSE '-inf'::DOUBLE END AS log2_lq FROM p""",
    "compact_tree": f"""{_PATHS}, s AS (SELECT *, sum(n_orders) OVER (PARTITION BY region, nation) AS t, sum(n_orders) OVER (PARTITION BY region, nation ORDER BY n_orders DESC, segment) - n_orders AS before, row_number() OVER (PARTITION BY region, nation ORDER BY n_orders DESC, segment) AS k FROM p0),
      n AS (SELECT * FROM (SELECT *, max(k) OVER (PARTITION BY region, nation) AS needed FROM s WHERE 100 * before < {COVERAGE} * t) WHERE needed <= {BUDGET}),
      g AS (SELECT region, nation, segment FROM (SELECT *, 100.0 * n_orders / sum(n_orders) OVER () AS a, 100.0 * n_customers / sum(n_customers) OVER () AS b FROM p0) WHERE greatest(a, b) >= {NAMED}),
      named AS (SELECT n.region, n.nation, n.segment FROM n JOIN g USING (region, nation, segment)), o AS (SELECT DISTINCT region, nation FROM named)
      SELECT p0.region, p0.nation, CASE WHEN o.region IS NULL THEN NULL WHEN named.segment IS NULL THEN '{T.REMAINING}' ELSE p0.segment END AS segment, sum(n_orders)::BIGINT AS n_orders, sum(n_customers)::BIGINT AS n_customers
      FROM p0 LEFT JOIN named USING (region, nation, segment) LEFT JOIN o ON o.region = p0.region AND o.nation = p0.nation GROUP BY ALL""",
    "tree_assignments": f"""{P._selection_sql()}, a0 AS (SELECT DISTINCT region, nation, segment FROM p0), t AS (SELECT * FROM {P._END}), a AS (SELECT DISTINCT region FROM t WHERE region <> '{T.REMAINING}'), b AS (SELECT DISTINCT region, nation FROM t WHERE nation <> '{T.REMAINING}'), c AS (SELECT DISTINCT region, nation, segment FROM t WHERE segment <> '{T.REMAINING}')
      SELECT region, nation, segment, CASE WHEN a.region IS NULL THEN '{T.REMAINING}' ELSE a0.region END AS leaf_region, CASE WHEN a.region IS NOT NULL THEN CASE WHEN b.nation IS NULL THEN '{T.REMAINING}' ELSE a0.nation END END AS leaf_nation,
        CASE WHEN a.region IS NOT NULL AND b.nation IS NOT NULL THEN CASE WHEN c.segment IS NULL THEN '{T.REMAINING}' ELSE a0.segment END END AS leaf_segment FROM a0 LEFT JOIN a USING (region) LEFT JOIN b USING (region, nation) LEFT JOIN c USING (region, nation, segment)""",
}
