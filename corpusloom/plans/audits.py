"""Queries of geography labels: standardization, path audit, audit labels, buckets, names.

A publication's geography lists come from its suppliers' nations; the order's priority and status decide what is the
matter with them, so that every outcome of the audit occurs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import labels as L
from corpusloom.operators import geo, geo_audit as G
from corpusloom.sources.tables import table

COLUMNS = {"region": "regions", "subregion": "subregions", "country": "countries"}
_DIGITS = "ABCDEFGHIJ"


def _code(name):
    return F.translate(name, "0123456789_", _DIGITS)


def _nations(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sub = F.concat("r_name", F.when(F.col("n_nationkey") % 2 == 0, " North").otherwise(" South"))
    return n.select("n_nationkey", F.col("r_name").alias("region"), sub.alias("subregion"), _code(F.col("n_name")).alias("code"), "n_name")


def hierarchy(spark, sf):
    return [tuple(r) for r in _nations(spark, sf).select("region", "subregion", "code").collect()]  # 25 nations


def _publications(spark, sf):
    """id, pr, st and the three lists, before anything is put right."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_suppkey").distinct()
    own = lines.join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(_nations(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
    held = own.groupBy("id").agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in ("region", "subregion", "code")])
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").substr(1, 1).alias("pr"), F.col("o_orderstatus").alias("st"))
    d = o.join(held, "id", "left").fillna("").select("id", "pr", "st", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("region", "subregion", "code")])
    is_ = lambda p, s=None: (F.col("pr") == p) & (F.col("st") == s if s else F.lit(True))
    one, none = (lambda v: F.array(F.lit(v))), F.array().cast("array<string>")
    regions = F.when(is_("3", "P"), none).when(is_("4", "P"), one("Not Applicable")).when(is_("4"), one("All Regions")).when(is_("5", "F"), F.slice("region", 1, 1)).when(is_("5", "O"), F.concat("region", one("NA"))).otherwise(F.col("region"))
    subs = F.when(is_("3", "F") | is_("3", "O") | is_("4", "F"), none).when(is_("4", "P"), one("n/a")).otherwise(F.col("subregion"))
    codes = F.when(is_("2", "O"), F.concat("code", one("unclear "))).when(is_("2"), one("Unclear")).when(is_("3", "F"), none).when(is_("4", "F"), one("Global")).when(is_("4", "P"), one("None")).when(is_("5", "P"), F.concat("code", one("XQZ"))).otherwise(F.col("code"))
    return d.select("id", "pr", "st", regions.alias("regions"), subs.alias("subregions"), codes.alias("countries"))


def geography_standardization(spark, sf):
    """Audit of the changed cells."""
    return G.standardize(_publications(spark, sf), COLUMNS)[1]


def geography_standardized_lists(spark, sf):
    done, _ = G.standardize(_publications(spark, sf), COLUMNS)
    return done.select("id", *[F.array_join(c, ";").alias(c) for c in COLUMNS.values()])


def _audited(spark, sf):
    return G.path_audit(_publications(spark, sf), COLUMNS, hierarchy(spark, sf))


def geography_path_audit(spark, sf):
    a = _audited(spark, sf)
    return a.select("id", "status", "primary_reason", F.array_join("reasons", ";").alias("reasons"), F.array_join("warnings", ";").alias("warnings"))


def geography_audit_summary(spark, sf):
    return G.summarize_audit(_audited(spark, sf))


def geography_audit_labels(spark, sf):
    """How many publications' labels stay and how many are to be reviewed, and the review labels by level."""
    a = G.audit_labels(_audited(spark, sf), COLUMNS)
    review = lambda c: F.count_if(F.col(c + "_audit") == F.array(F.lit(G.REVIEW))).alias(c)
    kept = F.count_if((F.col("countries") == F.col("countries_audit")) & (F.col("regions") == F.col("regions_audit"))).alias("same")
    return a.groupBy(F.when(F.col("status") == "review", "review_needed").otherwise("preserved").alias("action")).agg(F.count(F.lit(1)).alias("n"), *[review(c) for c in COLUMNS.values()], kept)


def geography_buckets(spark, sf):
    known = [c for _, _, c in hierarchy(spark, sf) if c != "NATIONBE"]
    return G.bucket_audit(_publications(spark, sf), "id", "countries", known)


def region_buckets(spark, sf):
    known = sorted({r for r, _, _ in hierarchy(spark, sf)} - {"ASIA"})
    labelled = _publications(spark, sf).withColumn("labels", F.when(F.col("st") != "O", F.array("pr", "st")))
    return G.bucket_audit(labelled, "id", "regions", known, labels="labels", names=True)


def country_names(spark, sf):
    names = {r["code"]: r["n_name"] + " (the)" for r in _nations(spark, sf).where("region <> 'EUROPE'").collect()}  # a row per nation
    p = _publications(spark, sf)
    return p.select("id", F.array_join(G.country_names(F.col("countries"), names), ";").alias("names"))


def unmapped_country_tokens(spark, sf):
    names = {r["code"]: r["n_name"] for r in _nations(spark, sf).where("region <> 'EUROPE'").collect()}
    return G.unmapped(_publications(spark, sf), "countries", names)


def taxa_country_quotients(spark, sf):
    """Location quotients of groups of items in countries, with how much of the universe each group covers."""
    groups = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("id"), F.col("p_brand").alias("group")).distinct()
    places = _publications(spark, sf).select("id", F.explode("countries").alias("country")).where(L.token(F.col("country")).startswith("NATION"))
    q = geo.location_quotient(places, groups, "country", "group")
    return q.select("country", "group", "n", "support", "class_total", F.round("lq", 6).alias("lq"), F.round(100 * F.col("class_total") / F.col("universe"), 6).alias("coverage_pct"))


QUERIES = {f.__name__: f for f in (
    geography_standardization, geography_standardized_lists, geography_path_audit, geography_audit_summary, geography_audit_labels, geography_buckets, region_buckets, country_names, unmapped_country_tokens, taxa_country_quotients,
)}

_NONE = "[]::VARCHAR[]"
_PUBS = f"""na AS (SELECT n_nationkey, r_name AS region, r_name || CASE WHEN n_nationkey % 2 = 0 THEN ' North' ELSE ' South' END AS subregion, replace(translate(n_name, '0123456789', '{_DIGITS}'), '_', '') AS code, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
held AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT region)) AS r, list_sort(list(DISTINCT subregion)) AS s, list_sort(list(DISTINCT code)) AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN na ON s_nationkey = n_nationkey GROUP BY l_orderkey),
o AS (SELECT o_orderkey AS id, substr(o_orderpriority, 1, 1) AS pr, o_orderstatus AS st, coalesce(r, {_NONE}) AS r, coalesce(s, {_NONE}) AS s, coalesce(c, {_NONE}) AS c FROM orders LEFT JOIN held ON id = o_orderkey),
pubs AS (SELECT id, pr, st,
  CASE WHEN pr = '3' AND st = 'P' THEN {_NONE} WHEN pr = '4' AND st = 'P' THEN ['Not Applicable'] WHEN pr = '4' THEN ['All Regions'] WHEN pr = '5' AND st = 'F' THEN r[1:1] WHEN pr = '5' AND st = 'O' THEN list_append(r, 'NA') ELSE r END AS regions,
  CASE WHEN (pr = '3' AND st IN ('F', 'O')) OR (pr = '4' AND st = 'F') THEN {_NONE} WHEN pr = '4' AND st = 'P' THEN ['n/a'] ELSE s END AS subregions,
  CASE WHEN pr = '2' AND st = 'O' THEN list_append(c, 'unclear ') WHEN pr = '2' THEN ['Unclear'] WHEN pr = '3' AND st = 'F' THEN {_NONE} WHEN pr = '4' AND st = 'F' THEN ['Global'] WHEN pr = '4' AND st = 'P' THEN ['None'] WHEN pr = '5' AND st = 'P' THEN list_append(c, 'XQZ') ELSE c END AS countries FROM o)"""
_IN = {level: ", ".join(f"'{t}'" for t in tokens) for level, tokens in {"na": L.NOT_APPLICABLE_TOKENS, "un": L.STATE_UNCLEAR_TOKENS, **L.GLOBAL_TOKENS}.items()}


def _token_sql(x):
    return f"upper(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"


def _kind_sql(x, level):
    return f"CASE WHEN {_token_sql(x)} IN ({_IN['na']}) THEN 'not_applicable' WHEN {_token_sql(x)} IN ({_IN['un']}) THEN 'unclear' WHEN {_token_sql(x)} IN ({_IN[level]}) THEN 'global' ELSE 'concrete' END"


def _state_sql(c, level):
    kinds = f"list_distinct(list_transform({c}, lambda x: {_kind_sql('x', level)}))"
    return f"CASE WHEN len({c}) = 0 THEN 'empty' WHEN len({kinds}) > 1 THEN 'mixed' ELSE {kinds}[1] END"


_UN = "lower(trim(x)) = 'unclear'"
_STD = f"""{_PUBS}, m1 AS (SELECT id, regions AS r0, subregions AS s0, countries AS c0, {", ".join(f"CASE WHEN len({c}) = 0 THEN ['Not Applicable'] WHEN len(list_filter({c}, lambda x: {_UN})) > 0 THEN ['Unclear'] ELSE {c} END AS {a}" for c, a in (("regions", "r1"), ("subregions", "s1"), ("countries", "c1")))} FROM pubs),
m2 AS (SELECT *, r1 = ['All Regions'] AND {_state_sql("s1", "subregion")} IN ('empty', 'not_applicable', 'unclear', 'global') AND {_state_sql("c1", "country")} IN ('empty', 'not_applicable', 'unclear', 'global') AS every FROM m1)"""
_AUD = f"""{_PUBS}, st AS (SELECT *, {_state_sql("regions", "region")} AS rs, {_state_sql("subregions", "subregion")} AS ss, {_state_sql("countries", "country")} AS cs,
  list_filter(regions, lambda x: {_kind_sql("x", "region")} = 'concrete') AS rc, list_filter(subregions, lambda x: {_kind_sql("x", "subregion")} = 'concrete') AS sc, list_transform(list_filter(countries, lambda x: {_kind_sql("x", "country")} = 'concrete'), lambda x: {_token_sql("x")}) AS cc FROM pubs),
rx AS (SELECT id, bool_or(na.region IS NULL) AS bad FROM (SELECT id, unnest(rc) AS x FROM st) LEFT JOIN (SELECT DISTINCT region FROM na) na ON na.region = x GROUP BY id),
sx AS (SELECT u.id, bool_or(n.region IS NULL) AS bad, bool_or(n.region IS NOT NULL AND NOT list_contains(rc, n.region)) AS lost, list(DISTINCT n.region) AS rs FROM (SELECT id, rc, unnest(sc) AS x FROM st) u LEFT JOIN (SELECT DISTINCT region, subregion FROM na) n ON n.subregion = x GROUP BY u.id),
cx AS (SELECT u.id, bool_or(n.code IS NULL) AS bad, bool_or(n.code IS NOT NULL AND NOT (list_contains(rc, n.region) AND list_contains(sc, n.subregion))) AS lost, list(DISTINCT n.subregion) AS subs FROM (SELECT id, rc, sc, unnest(cc) AS x FROM st) u LEFT JOIN na n ON n.code = x GROUP BY u.id),
au AS (SELECT st.*, list_filter([CASE WHEN 'mixed' IN (st.rs, ss, cs) THEN 'mixed_special_and_concrete_or_global' END,
  CASE WHEN st.rs = 'global' AND (ss IN ('concrete', 'mixed') OR cs IN ('concrete', 'mixed')) THEN 'all_regions_with_concrete_descendant' END,
  CASE WHEN st.rs = 'concrete' AND rx.bad THEN 'unknown_region_label' END, CASE WHEN st.rs = 'concrete' AND ss = 'concrete' AND sx.bad THEN 'unknown_subregion_label' END, CASE WHEN st.rs = 'concrete' AND ss = 'concrete' AND sx.lost THEN 'subregion_parent_missing' END,
  CASE WHEN st.rs = 'concrete' AND ss = 'concrete' AND cs = 'concrete' AND cx.bad THEN 'unknown_country_label' END, CASE WHEN st.rs = 'concrete' AND ss = 'concrete' AND cs = 'concrete' AND cx.lost THEN 'country_path_missing' END,
  CASE WHEN st.rs = 'concrete' AND ss <> 'concrete' AND cs = 'concrete' THEN 'country_present_subregion_non_concrete' END,
  CASE WHEN st.rs NOT IN ('global', 'concrete') AND (ss IN ('concrete', 'mixed') OR cs IN ('concrete', 'mixed')) THEN 'concrete_descendant_without_concrete_region'
       WHEN st.rs NOT IN ('global', 'concrete') AND NOT (st.rs = 'not_applicable' AND ss = 'not_applicable' AND cs = 'not_applicable') THEN 'no_resolvable_geography' END], lambda x: x IS NOT NULL) AS why, sx.rs AS with_sub, cx.subs AS with_code
  FROM st LEFT JOIN rx USING (id) LEFT JOIN sx USING (id) LEFT JOIN cx USING (id)),
audit AS (SELECT *, CASE WHEN len(why) > 0 THEN 'review' WHEN rs = 'global' THEN 'global' WHEN rs = 'concrete' AND ss = 'concrete' AND cs = 'concrete' THEN 'pass_complete' WHEN rs = 'concrete' AND ss = 'concrete' THEN 'pass_partial' WHEN rs = 'concrete' THEN 'pass_region_only' ELSE 'no_geography' END AS status FROM au),
done AS (SELECT *, CASE status WHEN 'review' THEN why[1] WHEN 'global' THEN 'all_regions_descendants_not_applicable' WHEN 'pass_complete' THEN 'complete_paths_valid' WHEN 'pass_partial' THEN 'region_subregion_valid_country_non_concrete' WHEN 'pass_region_only' THEN 'region_valid_descendants_non_concrete' ELSE 'all_levels_not_applicable' END AS primary_reason FROM audit)"""
ORACLES = {
    "geography_standardization": f"""WITH {_STD}, u AS ({" UNION ALL ".join(f"SELECT '{c}' AS \"column\", 'empty_to_not_applicable' AS rule, count(*) FILTER (len({a}0) = 0) AS changed_values FROM m2 UNION ALL SELECT '{c}', 'contains_unclear_to_unclear', count(*) FILTER (len(list_filter({a}0, lambda x: {_UN})) > 0 AND {a}0 <> ['Unclear']) FROM m2" for c, a in (("regions", "r"), ("subregions", "s"), ("countries", "c")))}
      UNION ALL SELECT 'subregions', 'all_regions_descendant_to_not_applicable', count(*) FILTER (every AND s1 <> ['Not Applicable']) FROM m2 UNION ALL SELECT 'countries', 'all_regions_descendant_to_not_applicable', count(*) FILTER (every AND c1 <> ['Not Applicable']) FROM m2) SELECT * FROM u WHERE changed_values > 0""",
    "geography_standardized_lists": f"WITH {_STD} SELECT id, array_to_string(r1, ';') AS regions, array_to_string(CASE WHEN every THEN ['Not Applicable'] ELSE s1 END, ';') AS subregions, array_to_string(CASE WHEN every THEN ['Not Applicable'] ELSE c1 END, ';') AS countries FROM m2",
    "geography_path_audit": f"WITH {_AUD} SELECT id, status, primary_reason, array_to_string(why, ';') AS reasons, CASE WHEN status = 'pass_complete' THEN concat_ws(';', CASE WHEN len(list_filter(rc, lambda x: NOT list_contains(with_sub, x))) > 0 THEN 'region_without_listed_subregion' END, CASE WHEN len(list_filter(sc, lambda x: NOT list_contains(with_code, x))) > 0 THEN 'subregion_without_listed_country' END) ELSE '' END AS warnings FROM done",
    "geography_audit_summary": f"WITH {_AUD} SELECT status, primary_reason, count(*) AS n_publications FROM done GROUP BY ALL",
    "geography_audit_labels": f"WITH {_AUD} SELECT CASE WHEN status = 'review' THEN 'review_needed' ELSE 'preserved' END AS action, count(*) AS n, count(*) FILTER (status = 'review') AS regions, count(*) FILTER (status = 'review') AS subregions, count(*) FILTER (status = 'review') AS countries, count(*) FILTER (status <> 'review') AS same FROM done GROUP BY ALL",
    "geography_buckets": f"""WITH {_PUBS}, x AS (SELECT unnest(countries) AS x FROM pubs), b AS (SELECT CASE WHEN {_token_sql("x")} IN ({_IN['na']}) THEN 'not_applicable' WHEN {_token_sql("x")} IN ('ALLCOUNTRIES', 'ALLREGIONS', 'ALLSUBREGIONS', 'GLOBAL', 'WORLDWIDE') THEN 'aggregate' WHEN {_token_sql("x")} IN ('UNCLEAR', '') THEN 'unclear' WHEN {_token_sql("x")} IN (SELECT code FROM na WHERE code <> 'NATIONBE') THEN 'mapped' ELSE 'unresolved' END AS b, trim(x) AS x FROM x)
      SELECT 'records_total' AS metric, count(DISTINCT id) AS n FROM pubs UNION ALL SELECT 'records_without_geography', count(*) FILTER (len(countries) = 0) FROM pubs UNION ALL SELECT 'mentions:' || b, count(*) FROM b GROUP BY b UNION ALL SELECT 'unresolved:' || x, count(*) FROM b WHERE b = 'unresolved' GROUP BY x""",
    "region_buckets": f"""WITH {_PUBS}, x AS (SELECT x, unnest([pr, st]) FROM (SELECT pr, st, unnest(regions) AS x FROM pubs WHERE st <> 'O')), b AS (SELECT CASE WHEN {_token_sql("x")} = 'ALLREGIONS' THEN 'aggregate' WHEN x IN (SELECT r_name FROM region WHERE r_name <> 'ASIA') THEN 'mapped' ELSE 'unresolved' END AS b, trim(x) AS x FROM x)
      SELECT 'records_total' AS metric, count(DISTINCT id) AS n FROM pubs UNION ALL SELECT 'records_without_geography', count(*) FILTER (len(regions) = 0) FROM pubs UNION ALL SELECT 'mentions:' || b, count(*) FROM b GROUP BY b UNION ALL SELECT 'unresolved:' || x, count(*) FROM b WHERE b = 'unresolved' GROUP BY x""",
    "country_names": f"WITH {_PUBS}, nm AS (SELECT id, string_agg(coalesce(n_name, x), ';' ORDER BY i) AS names FROM (SELECT id, unnest(countries) AS x, unnest(range(len(countries))) AS i FROM pubs) LEFT JOIN na ON code = x AND region <> 'EUROPE' GROUP BY id) SELECT id, coalesce(names, '') AS names FROM pubs LEFT JOIN nm USING (id)",
    "unmapped_country_tokens": f"WITH {_PUBS} SELECT x AS token, count(*) AS n FROM (SELECT unnest(countries) AS x FROM pubs) WHERE x NOT IN (SELECT code FROM na WHERE region <> 'EUROPE') GROUP BY x",
    "taxa_country_quotients": f"""WITH {_PUBS}, p AS (SELECT DISTINCT id, x AS country FROM (SELECT id, unnest(countries) AS x FROM pubs) WHERE x LIKE 'NATION%'), g AS (SELECT DISTINCT l_orderkey AS id, p_brand AS grp FROM lineitem JOIN part ON l_partkey = p_partkey),
      p2 AS (SELECT * FROM p WHERE id IN (SELECT id FROM g)), g2 AS (SELECT * FROM g WHERE id IN (SELECT id FROM p)), u AS (SELECT count(DISTINCT id) AS u FROM g2), s AS (SELECT country, count(*) AS support FROM p2 GROUP BY country), t AS (SELECT grp, count(*) AS class_total FROM g2 GROUP BY grp)
      SELECT country, grp AS "group", count(*) AS n, any_value(support) AS support, any_value(class_total) AS class_total, round((count(*) / any_value(support)) / (any_value(class_total) / any_value(u)), 6) AS lq, round(100 * any_value(class_total) / any_value(u), 6) AS coverage_pct FROM p2 JOIN g2 USING (id) JOIN s USING (country) JOIN t USING (grp) CROSS JOIN u GROUP BY country, grp""",
}
