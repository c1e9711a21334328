"""Queries of geography, realms, hierarchies and gaps."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import attribution as A
from corpusloom.operators import comparisons as M
from corpusloom.operators import contracts as C
from corpusloom.operators import geo as G
from corpusloom.operators import geometry as GM
from corpusloom.operators import resampling as B
from corpusloom.sources.tables import SQL, axes, countries, labels, publications, realms, table

R = 6


def _r(df, *columns):
    return df.withColumns({c: F.round(c, R) for c in columns})


def geo_counts_nation(spark, sf):
    return G.geo_counts(countries(spark, sf), labels(spark, sf), "country")


def geo_counts_region(spark, sf):
    return G.geo_counts(countries(spark, sf), labels(spark, sf), "region")


def location_quotient(spark, sf):
    out = G.quotients(axes(spark, sf).withColumn("countries", F.col("places.country")), "countries", "labels", "country", min_support=30)
    return _r(out, "within_share", "global_share", "lq", "log2_lq")


def location_quotient_eb(spark, sf):
    out = G.quotients(axes(spark, sf).withColumn("regions", F.array_distinct(F.col("places.region"))), "regions", "labels", "region", min_support=30, kappa=30.0)
    return _r(out, "within_share", "global_share", "lq", "log2_lq", "lq_eb", "log2_lq_eb")


def geo_attention_country(spark, sf):
    return _r(G.fractional_attention(countries(spark, sf), "country"), "attention", "share_pct")


def geo_attention_region(spark, sf):
    own = A.fractional_weights(countries(spark, sf)).groupBy("region").agg(F.sum("w").alias("attention"))
    return _r(own.withColumn("share_pct", 100 * F.col("attention") / F.sum("attention").over(W.partitionBy())), "attention", "share_pct")


def topk_cumulative_attention(spark, sf):
    att = G.fractional_attention(countries(spark, sf), "country").withColumn("attention", F.round("attention", R))
    return _r(G.top_k_share(att, "attention", "country", (5, 10, 25)), "cum_share")


def realm_counts(spark, sf):
    out = realms(spark, sf).groupBy("realm").agg(F.count(F.lit(1)).alias("n"))
    return _r(out.withColumn("share_pct", 100 * F.col("n") / F.sum("n").over(W.partitionBy())), "share_pct")


def realm_driver_summary(spark, sf):
    """Prevalence, pooled prevalence, quotient and fractional share of each label in each realm."""
    w = axes(spark, sf).select("id", (1.0 / F.size("labels")).alias("w"), F.explode("labels").alias("label"))
    return _r(M.realm_summary(realms(spark, sf).select("id", "realm"), w, "realm"), "prevalence", "pooled_prevalence", "fractional_share", "lq", "log2_lq")


def realm_exclusion_audit(spark, sf):
    """Publications by what keeps them out: no label, outside the years, kept."""
    d = realms(spark, sf).join(labels(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("k")), "id", "left")
    why = F.when(F.col("k").isNull(), "no label").when(~F.col("year").between(1996, 2000), "outside years").when(F.col("k") > 1, "several labels").otherwise("single label")
    return d.groupBy(why.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def conditional_annual_share(spark, sf):
    """Per realm and year: fractional share of PROMO, and of PROMO or SMALL the part that is PROMO."""
    w = realms(spark, sf).join(A.fractional_weights(labels(spark, sf)), "id")
    return _r(M.conditional_share(w, ["realm", "year"], "label", "PROMO", ["PROMO", "SMALL"]), "share", "conditional_share")


def outer_match_gap(spark, sf):
    """Evidence per supplier nation against customers per nation, both sides kept."""
    ev = countries(spark, sf).groupBy("country").agg(F.count(F.lit(1)).alias("evidence"))
    cu = table(spark, sf, "customer").where("c_acctbal > 5000").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("country")).agg(F.count(F.lit(1)).alias("need"))
    return C.match_sides(ev, cu, "country")


def region_gap(spark, sf):
    ev = countries(spark, sf).select("id", "region").distinct().groupBy("region").agg(F.count(F.lit(1)).alias("evidence"))
    cu = realms(spark, sf).groupBy(F.col("cregion").alias("region")).agg(F.count(F.lit(1)).alias("need"))
    return _r(M.share_gap(ev, cu, "region", "evidence", "need"), "evidence_share", "need_share", "gap")


def regional_trend(spark, sf):
    """Publications per year and region, each counted once, on the whole grid."""
    d = publications(spark, sf).join(countries(spark, sf).select("id", "region").distinct(), "id").groupBy("year", "region").agg(F.count(F.lit(1)).alias("n"))
    return A.dense_grid([publications(spark, sf).select("year").distinct(), table(spark, sf, "region").select(F.col("r_name").alias("region"))], d, ["year", "region"], {"n": 0})


def pooled_dedup_region_evidence(spark, sf):
    d = countries(spark, sf).select("id", "region").distinct()
    return _r(d.groupBy("region").agg(F.count(F.lit(1)).alias("n")).withColumn("share_pct", 100 * F.col("n") / F.sum("n").over(W.partitionBy())), "share_pct")


def definition_sensitivity_rank(spark, sf):
    """Region shares under three definitions of weight, ranked within each."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    wide = li.groupBy(F.col("r_name").alias("region")).agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"), F.count_distinct("l_orderkey").alias("orders"))
    return M.definition_shares(wide, "region", ["quantity", "lines", "orders"], R).drop("value")


PATH = ("cregion", "nation", "realm", "priority")


def rank_path_attribution(spark, sf):
    """Distinct paths (region, country, label) of a publication at each rank, sharing its weight."""
    paths = axes(spark, sf).select("id", F.explode("places").alias("place"), "labels").select("id", "place.*", F.explode("labels").alias("label"))
    return _r(A.rank_paths(paths, ("region", "country", "label")), "weight")


def rank_counts(spark, sf):
    """Records under every prefix of the path, all ranks in one pass (rollup)."""
    rolled = realms(spark, sf).rollup(*PATH).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")).where("g < 15")
    rank = F.when(F.col("g") == 0, 4).when(F.col("g") == 1, 3).when(F.col("g") == 3, 2).otherwise(1).cast("long")
    return rolled.select(rank.alias("rank"), F.concat_ws(" > ", *PATH).alias("path"), "n")


def path_alignment(spark, sf):
    """Paths (region, nation) on the supplier side, the customer side, or both."""
    s = countries(spark, sf).select(F.concat_ws(" > ", "region", "country").alias("path")).distinct()
    c = realms(spark, sf).where("year >= 2000").select(F.concat_ws(" > ", "cregion", "nation").alias("path")).distinct()
    return C.match_sides(s, c, "path").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def exact_path_comparison(spark, sf):
    """Paths on both sides only; weights are balanced again over what is left of each record."""
    known = realms(spark, sf).where("year >= 1999").select(F.col("cregion").alias("region"), F.col("nation").alias("country"))
    return _r(M.common_path_weights(countries(spark, sf), known, ["region", "country"]), "weight", "share_pct")


def largest_remainder_percent(spark, sf):
    """Whole per cents of nations' customers that add up to 100 in each region."""
    n = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("raw", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy("n_regionkey")), 9))
    return B.rounded_to_whole(n, "raw", "n_name", ["n_regionkey"], out="pct").select("n_regionkey", "n_name", "pct")


_P = {k: " || ' > ' || ".join(PATH[:k]) for k in range(1, 5)}
_GEO = "SELECT l.label, c.{p}, count(*) AS n FROM (SELECT DISTINCT id, {p} FROM ctry) c JOIN lab l USING (id) GROUP BY ALL"
_LQ = """p AS (SELECT DISTINCT id, {c} FROM ctry WHERE id IN (SELECT id FROM lab)), t AS (SELECT DISTINCT id, label FROM lab WHERE id IN (SELECT id FROM ctry)),
sup AS (SELECT {c}, count(*) AS support FROM p GROUP BY ALL), tot AS (SELECT label, count(*) AS class_total FROM t GROUP BY ALL), uni AS (SELECT count(DISTINCT id) AS universe FROM t), ob AS (SELECT {c}, label, count(*) AS n FROM p JOIN t USING (id) GROUP BY ALL)"""

def dissolved_areas(spark, sf):
    """Parts as unit squares of a map, dissolved by type: area and length of border of each type."""
    p = table(spark, sf, "part")
    x, y = (F.col("p_partkey") % 64).cast("double"), F.floor(F.col("p_partkey") / 64).cast("double")
    corner = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    rings = p.select("p_type", F.lit(0).alias("ring"), F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0)).alias("points"))
    out = GM.dissolved(GM.turned(rings), "p_type")
    return out.groupBy("p_type").agg(F.sum(F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area"))).alias("area"), F.sum(F.size("points") - 1).cast("long").alias("border"))


QUERIES = {f.__name__: f for f in (
    geo_counts_nation, geo_counts_region, location_quotient, location_quotient_eb, geo_attention_country, geo_attention_region, topk_cumulative_attention, realm_counts, realm_driver_summary, realm_exclusion_audit, conditional_annual_share,
    outer_match_gap, region_gap, regional_trend, pooled_dedup_region_evidence, definition_sensitivity_rank, rank_path_attribution, rank_counts, path_alignment, exact_path_comparison, largest_remainder_percent, dissolved_areas,
)}

_ATT = "att AS (SELECT {p}, sum(w) AS a FROM (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY id) AS w FROM ctry) GROUP BY ALL)"
ORACLES = {
    "dissolved_areas": "WITH c AS (SELECT p_type, p_partkey % 64 AS x, p_partkey // 64 AS y FROM part) SELECT a.p_type, count(*)::DOUBLE AS area, (4 * count(*) - count(r.x) * 2 - count(u.x) * 2)::BIGINT AS border FROM c a LEFT JOIN c r ON r.p_type = a.p_type AND r.x = a.x + 1 AND r.y = a.y LEFT JOIN c u ON u.p_type = a.p_type AND u.x = a.x AND u.y = a.y + 1 GROUP BY a.p_type",
    **{f"geo_counts_{q}": f"WITH {SQL}, g AS ({_GEO.format(p=p)}), t AS (SELECT label, count(DISTINCT id) AS group_total FROM lab WHERE id IN (SELECT id FROM ctry) GROUP BY label) SELECT label, {p}, n, group_total FROM g JOIN t USING (label)" for q, p in (("nation", "country"), ("region", "region"))},
    "location_quotient": f"WITH {SQL}, {_LQ.format(c='country')} SELECT country, label, n, support, class_total, universe, round(n / support, {R}) AS within_share, round(class_total / universe, {R}) AS global_share, round((n / support) / (class_total / universe), {R}) AS lq, round(log2((n / support) / (class_total / universe)), {R}) AS log2_lq, support >= 30 AS sufficient FROM ob JOIN sup USING (country) JOIN tot USING (label) CROSS JOIN uni",
    "location_quotient_eb": f"WITH {SQL}, {_LQ.format(c='region')}, c AS (SELECT region, label, coalesce(n, 0) AS n, support, class_total, universe, class_total / universe AS pi FROM sup CROSS JOIN tot CROSS JOIN uni LEFT JOIN ob USING (region, label)) SELECT region, label, n, support, class_total, universe, round(n / support, {R}) AS within_share, round(pi, {R}) AS global_share, round(n / support / pi, {R}) AS lq, CASE WHEN n > 0 THEN round(log2(n / support / pi), {R}) END AS log2_lq, round((n + 30 * pi) / ((support + 30) * pi), {R}) AS lq_eb, round(log2((n + 30 * pi) / ((support + 30) * pi)), {R}) AS log2_lq_eb, support >= 30 AS sufficient FROM c",
    **{f"geo_attention_{p}": f"WITH {SQL}, {_ATT.format(p=p)} SELECT {p}, round(a, {R}) AS attention, round(100 * a / sum(a) OVER (), {R}) AS share_pct FROM att" for p in ("country", "region")},
    "topk_cumulative_attention": f"WITH {SQL}, {_ATT.format(p='country')}, r AS (SELECT round(a, {R}) AS a, row_number() OVER (ORDER BY round(a, {R}) DESC, country) AS r FROM att) SELECT k, round(100 * (SELECT sum(a) FROM r WHERE r <= k) / (SELECT sum(a) FROM r), {R}) AS cum_share FROM (VALUES (5::BIGINT), (10::BIGINT), (25::BIGINT)) v(k)",
    "realm_counts": f"WITH {SQL} SELECT realm, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), {R}) AS share_pct FROM seg GROUP BY realm",
    "realm_driver_summary": f"""WITH {SQL}, l AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY id) AS w FROM lab), d AS (SELECT id, realm FROM seg WHERE id IN (SELECT id FROM lab)), s AS (SELECT realm, count(*) AS n_documents FROM d GROUP BY realm),
c AS (SELECT realm, label, count(*) AS n, sum(w) AS w FROM d JOIN l USING (id) GROUP BY ALL), g AS (SELECT realm, label, n_documents, coalesce(n, 0) AS n, coalesce(w, 0) AS w FROM s CROSS JOIN (SELECT DISTINCT label FROM lab) LEFT JOIN c USING (realm, label)),
p AS (SELECT *, n / n_documents AS prev, sum(n) OVER (PARTITION BY label) / sum(n_documents) OVER (PARTITION BY label) AS pool FROM g)
SELECT realm, label, n_documents, n AS n_label_documents, round(prev, {R}) AS prevalence, round(pool, {R}) AS pooled_prevalence, round(w / n_documents, {R}) AS fractional_share, round(prev / pool, {R}) AS lq, CASE WHEN prev > 0 THEN round(log2(prev / pool), {R}) ELSE '-inf'::DOUBLE END AS log2_lq FROM p""",
    "realm_exclusion_audit": f"WITH {SQL}, k AS (SELECT id, count(*) AS k FROM lab GROUP BY id) SELECT CASE WHEN k IS NULL THEN 'no label' WHEN NOT year BETWEEN 1996 AND 2000 THEN 'outside years' WHEN k > 1 THEN 'several labels' ELSE 'single label' END AS bucket, count(*) AS n FROM seg LEFT JOIN k USING (id) GROUP BY ALL",
    "conditional_annual_share": f"WITH {SQL}, l AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY id) AS w FROM lab), o AS (SELECT realm, year, coalesce(sum(w) FILTER (label = 'PROMO'), 0) AS p, coalesce(sum(w) FILTER (label IN ('PROMO', 'SMALL')), 0) AS q, sum(w) AS t FROM seg JOIN l USING (id) GROUP BY ALL) SELECT realm, year, round(p / t, {R}) AS share, round(p / q, {R}) AS conditional_share FROM o WHERE q > 0",
    "outer_match_gap": f"WITH {SQL}, e AS (SELECT country, count(*) AS evidence FROM ctry GROUP BY country), c AS (SELECT n_name AS country, count(*) AS need FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 GROUP BY n_name) SELECT coalesce(e.country, c.country) AS country, evidence, need, CASE WHEN c.country IS NULL THEN 'left_only' WHEN e.country IS NULL THEN 'right_only' ELSE 'both' END AS side FROM e FULL JOIN c ON e.country = c.country",
    "region_gap": f"WITH {SQL}, e AS (SELECT region, count(DISTINCT id) AS evidence FROM ctry GROUP BY region), c AS (SELECT cregion AS region, count(*) AS need FROM seg GROUP BY ALL), s AS (SELECT region, evidence, need, 100.0::DOUBLE * evidence / sum(evidence) OVER () AS es, 100.0::DOUBLE * need / sum(need) OVER () AS ns FROM e JOIN c USING (region)) SELECT region, evidence, need, round(es, {R}) AS evidence_share, round(ns, {R}) AS need_share, round(es - ns, {R}) AS gap FROM s",
    "regional_trend": f"WITH {SQL}, d AS (SELECT year, region, count(DISTINCT id) AS n FROM pub JOIN ctry USING (id) GROUP BY ALL) SELECT year, region, coalesce(n, 0) AS n FROM (SELECT DISTINCT year FROM pub) CROSS JOIN (SELECT r_name AS region FROM region) LEFT JOIN d USING (year, region)",
    "pooled_dedup_region_evidence": f"WITH {SQL} SELECT region, count(DISTINCT id) AS n, round(100.0::DOUBLE * count(DISTINCT id) / sum(count(DISTINCT id)) OVER (), {R}) AS share_pct FROM ctry GROUP BY region",
    "definition_sensitivity_rank": f"WITH w AS (SELECT r_name AS region, sum(l_quantity) AS quantity, count(*)::DOUBLE AS lines, count(DISTINCT l_orderkey)::DOUBLE AS orders FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name), l AS (SELECT region, definition, value FROM w UNPIVOT (value FOR definition IN (quantity, lines, orders))), s AS (SELECT region, definition, round(100 * value / sum(value) OVER (PARTITION BY definition), {R}) AS share_pct FROM l) SELECT *, row_number() OVER (PARTITION BY definition ORDER BY share_pct DESC, region) AS rank FROM s",
    "rank_path_attribution": f"""WITH {SQL}, p AS (SELECT id, region AS p1, region || ' > ' || country AS p2, region || ' > ' || country || ' > ' || label AS p3 FROM ctry JOIN lab USING (id)), r AS ({" UNION ALL ".join(f"SELECT DISTINCT {k}::BIGINT AS rank, id, p{k} AS path FROM p" for k in (1, 2, 3))})
      SELECT rank, path, round(sum(w), {R}) AS weight, count(*) AS n FROM (SELECT rank, path, 1.0::DOUBLE / count(*) OVER (PARTITION BY rank, id) AS w FROM r) GROUP BY rank, path""",
    "rank_counts": f"WITH {SQL} " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS rank, {_P[k]} AS path, count(*) AS n FROM seg GROUP BY ALL" for k in range(1, 5)),
    "path_alignment": f"WITH {SQL}, s AS (SELECT DISTINCT region || ' > ' || country AS path FROM ctry), c AS (SELECT DISTINCT cregion || ' > ' || nation AS path FROM seg WHERE year >= 2000) SELECT CASE WHEN c.path IS NULL THEN 'left_only' WHEN s.path IS NULL THEN 'right_only' ELSE 'both' END AS side, count(*) AS n FROM s FULL JOIN c ON s.path = c.path GROUP BY ALL",
    "exact_path_comparison": f"WITH {SQL}, k AS (SELECT * FROM ctry WHERE (region, country) IN (SELECT (cregion, nation) FROM seg WHERE year >= 1999)), a AS (SELECT region, country, sum(w) AS weight FROM (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY id) AS w FROM k) GROUP BY ALL) SELECT region, country, round(weight, {R}) AS weight, round(100 * weight / sum(weight) OVER (), {R}) AS share_pct FROM a",
    "largest_remainder_percent": "WITH n AS (SELECT n_regionkey, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), r AS (SELECT *, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY n_regionkey) AS raw FROM n), b AS (SELECT *, floor(raw) AS base FROM r) SELECT n_regionkey, n_name, (base + CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY round(raw - base, 9) DESC, n_name) <= 100 - sum(base) OVER (PARTITION BY n_regionkey) THEN 1 ELSE 0 END)::BIGINT AS pct FROM b",
}
