"""Queries of items with lineages: a publication's items are its suppliers, their lineage region, nation and supplier;
what was found of an item is its line's return flag."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import rules as U
from corpusloom.operators import lineages as N
from corpusloom.sources.tables import labels, table

R = 6


def _nodes(spark, sf):
    """id, item: an order's lines and their suppliers; item, name, position, rank, node: each supplier's three nodes."""
    own = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("item"))
    sup = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(r).alias("rank"), F.col(c).alias("node")) for i, (r, c) in enumerate((("KINGDOM", "r_name"), ("PHYLUM", "n_name"), ("CLASS", "s_name")))])
    return own, sup.select(F.col("s_suppkey").alias("item"), F.col("s_name").alias("name"), F.explode(nodes).alias("x")).select("item", "name", "x.*")


def nested_lineages(spark, sf):
    """Each order's nested items as text: names of nodes joined by >, items by |."""
    n = N.nested_items(*_nodes(spark, sf), "id", "item", ["name"], "position", ["node"])
    return n.select("id", F.array_join(F.transform("items", lambda i: F.concat(i["name"], F.lit(":"), F.array_join(F.transform(i["lineage"], lambda x: x["node"]), ">"))), "|").alias("items"))


def wide_records(spark, sf):
    w = N.ranked_items(N.nested_items(*_nodes(spark, sf), "id", "item", [], "position", ["rank", "node"]), "id", "rank", "node", ["KINGDOM", "PHYLUM", "CLASS"])
    return w.select("id", *[F.array_join(c, ";").alias(c) for c in ("kingdom", "phylum", "class")])


def position_gaps(spark, sf):
    return N.gaps(table(spark, sf, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long")), ["l_orderkey"], "l_linenumber", 1)


def canonical_paths(spark, sf):
    """Suppliers of Asia lie in the domain Bacteria, those of Europe in a realm."""
    sup = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    node = lambda rank, name: F.struct(F.lit(rank).alias("rank"), name.alias("name"))
    lineage = F.array_compact(F.array(
        F.when(F.col("r_name") == "ASIA", node("domain", F.lit("Bacteria"))), F.when(F.col("r_name") == "EUROPE", node("REALM", F.lit("Riboviria"))), F.when(F.col("r_name") == "AFRICA", node("DOMAIN", F.lit("Eukaryota"))),
        node("Kingdom", F.col("r_name")), node("phylum ", F.concat("n_name", F.lit(" "))), node("CLASS", F.lit(" ")),
    ))
    return sup.select("s_suppkey", *N.canonical_path(lineage))


def flattened_records(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select("n_name", (F.col("s_acctbal") < 0).alias("in_debt"), F.substring("s_name", -1, 1).alias("digit"), F.concat_ws(", ", F.substring("s_name", -1, 1), F.substring("s_name", -2, 1)).alias("habitat"))
    return N.flatten_records(s, "n_name", ["in_debt"], ["digit", "habitat"], ["habitat"])


def accepted_first_lookup(spark, sf):
    p = table(spark, sf, "part").withColumn("status", F.when(F.col("p_size") > 40, "ACCEPTED").when(F.col("p_size") > 20, "synonym"))
    return N.accepted_first(p, F.lower(F.concat_ws(" ", "p_type", "p_brand")), "status", F.col("p_partkey"), ["p_name", "p_size"])


def _items(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "N", "no match").otherwise("api_failure").alias("status"), "l_partkey", "l_returnflag")


def _states(spark, sf):
    """Orders with their items' numbers, groups and names; orders of status P have no output."""
    it = _items(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_type", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("status") == "no match", "Not applicable").when(F.col("status") == "api_failure", " UNCLEAR").otherwise(F.col("p_name"))
    per = it.groupBy("id").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") == "api_failure").alias("failures"), F.count_if(F.col("status") == "accepted").alias("matched"),
        F.collect_set(F.when(F.col("status") == "accepted", F.col("p_type"))).alias("groups"), F.collect_list(name).alias("names"),
    )
    none = F.array().cast("array<string>")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("has"))
    return o.join(per, "id", "left").select("id", "has", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("items", "failures", "matched")], *[F.coalesce(c, none).alias(c) for c in ("groups", "names")])


def record_states(spark, sf):
    """Status, scheme state and inclusion state of all orders, counted. PROMO is the unresolved group, LARGE none."""
    d = _states(spark, sf)
    biological = ["ECONOMY", "STANDARD"]
    return d.groupBy(
        N.record_status(F.col("has"), F.col("items"), F.col("failures"), F.col("matched"), F.col("items") - F.col("matched")).alias("status"),
        N.scheme_state(F.col("groups"), F.array_intersect("groups", F.array(*map(F.lit, biological))), "PROMO").alias("scheme"),
        N.inclusion_state(F.col("groups"), F.col("names"), biological, "PROMO").alias("inclusion"),
    ).agg(F.count(F.lit(1)).alias("n"))


def status_count_columns(spark, sf):
    return N.status_counts(_items(spark, sf), "id", "status", ["accepted", "no match", "api_failure"])


def item_audit(spark, sf):
    return N.item_audit(_items(spark, sf), "id", ["status", "l_returnflag"])


def label_indicators(spark, sf):
    held = labels(spark, sf).groupBy("id").agg(F.collect_set("label").alias("labels"))
    return N.indicators(held, "labels", ["ECONOMY", "PROMO", "LARGE", "MEDIUM", "STANDARD", "SMALL"], ["id"])


def described_diversity(spark, sf):
    rules = [{"group": "cheap", "when": [{"field": "p_type", "op": "in", "values": ["ECONOMY", "SMALL"]}]}, {"group": "fine", "when": [{"field": "p_type", "op": "not_in", "values": ["PROMO"]}, {"field": "p_brand", "op": "in", "values": ["Brand#1", "Brand#2", "Brand#3"]}]}]
    out = N.benchmark_by_group(table(spark, sf, "part"), F.col("p_size") > 10, ["p_type", "p_brand"], U.first_rule(rules, F.col))
    return out.withColumn("share_pct", F.round("share_pct", R))


def label_parents(spark, sf):
    own = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_set("p_brand").alias("brands"))
    dim = table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_type").alias("parent"))
    return N.parents_of(own, "brands", dim, "p_brand", "parent", "id").select("id", F.array_join("parents", ";").alias("parents"))


QUERIES = {f.__name__: f for f in (
    nested_lineages, wide_records, position_gaps, canonical_paths, flattened_records, accepted_first_lookup, record_states, status_count_columns, item_audit, label_indicators, described_diversity, label_parents,
)}

_S = "sup AS (SELECT s_suppkey, s_name, s_acctbal, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), own AS (SELECT DISTINCT l_orderkey AS id, l_suppkey FROM lineitem)"
_FIRST = "(SELECT id, {c} AS v, min(s_suppkey) AS k FROM own JOIN sup ON l_suppkey = s_suppkey GROUP BY ALL)"
_I = "it AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'no match' ELSE 'api_failure' END AS status, l_partkey, l_returnflag FROM lineitem)"
ORACLES = {
    "nested_lineages": f"WITH {_S} SELECT id, string_agg(s_name || ':' || r_name || '>' || n_name || '>' || s_name, '|' ORDER BY s_suppkey) AS items FROM own JOIN sup ON l_suppkey = s_suppkey GROUP BY id",
    "wide_records": f"WITH {_S}, a AS (SELECT id, string_agg(v, ';' ORDER BY k) AS kingdom FROM {_FIRST.format(c='r_name')} GROUP BY id), b AS (SELECT id, string_agg(v, ';' ORDER BY k) AS phylum FROM {_FIRST.format(c='n_name')} GROUP BY id), c AS (SELECT id, string_agg(v, ';' ORDER BY k) AS class FROM {_FIRST.format(c='s_name')} GROUP BY id) SELECT id, kingdom, phylum, class FROM a JOIN b USING (id) JOIN c USING (id)",
    "position_gaps": "SELECT l_orderkey, count(*) AS n, min(l_linenumber)::BIGINT AS lo, max(l_linenumber)::BIGINT AS hi FROM lineitem GROUP BY l_orderkey HAVING count(*) <> count(DISTINCT l_linenumber) OR min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*)",
    "canonical_paths": f"WITH {_S} SELECT s_suppkey, CASE r_name WHEN 'ASIA' THEN 'Bacteria' WHEN 'EUROPE' THEN 'Viruses' ELSE r_name END AS kingdom, n_name AS phylum, NULL::VARCHAR AS class, NULL::VARCHAR AS \"order\" FROM sup",
    "flattened_records": f"WITH {_S}, d AS (SELECT n_name, s_acctbal, substr(s_name, -1, 1) AS a, substr(s_name, -2, 1) AS b FROM sup), h AS (SELECT n_name, string_agg(DISTINCT x, ';' ORDER BY x) AS habitat FROM (SELECT n_name, unnest([a, b]) AS x FROM d) GROUP BY n_name) SELECT n_name, CASE WHEN bool_or(s_acctbal < 0) THEN 'True' ELSE '' END AS in_debt, string_agg(DISTINCT a, ';' ORDER BY a) AS digit, any_value(habitat) AS habitat FROM d JOIN h USING (n_name) GROUP BY n_name",
    "accepted_first_lookup": "SELECT key, p_name, p_size FROM (SELECT lower(p_type || ' ' || p_brand) AS key, p_name, p_size, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY (p_size > 40) DESC, p_partkey) AS r FROM part) WHERE r = 1",
    "record_states": f"""WITH {_I}, d AS (SELECT o_orderkey AS id, o_orderstatus <> 'P' AS has, count(status) AS items, count(*) FILTER (status = 'api_failure') AS failures, count(*) FILTER (status = 'accepted') AS matched, count(*) FILTER (status = 'no match') AS na,
      count(*) FILTER (status = 'accepted' AND p_type IN ('ECONOMY', 'STANDARD')) AS bio, count(*) FILTER (status = 'accepted' AND p_type = 'PROMO') AS promo FROM orders LEFT JOIN it ON it.id = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL)
      SELECT CASE WHEN NOT has THEN 'missing_llm_output' WHEN items = 0 THEN 'no_taxa_reported' WHEN failures > 0 THEN 'api_failure' WHEN matched > 0 AND items > matched THEN 'partly_resolved' WHEN matched > 0 THEN 'resolved' ELSE 'unresolved' END AS status,
        CASE WHEN bio > 0 THEN 'resolved' WHEN promo > 0 THEN 'unresolved_only' ELSE 'no_group' END AS scheme,
        CASE WHEN bio > 0 THEN '{N.INCLUSION[0]}' WHEN promo > 0 THEN '{N.INCLUSION[4]}' WHEN items = 0 THEN '{N.INCLUSION[6]}' WHEN na = items THEN '{N.INCLUSION[1]}' WHEN failures = items THEN '{N.INCLUSION[2]}' WHEN na + failures = items THEN '{N.INCLUSION[3]}' ELSE '{N.INCLUSION[5]}' END AS inclusion, count(*) AS n FROM d GROUP BY ALL""",
    "status_count_columns": f"WITH {_I} SELECT id, count(*) FILTER (status = 'accepted') AS match_status_count__accepted, count(*) FILTER (status = 'no match') AS match_status_count__no_match, count(*) FILTER (status = 'api_failure') AS match_status_count__api_failure FROM it GROUP BY id",
    "item_audit": f"WITH {_I} SELECT 'status' AS axis, status AS value, count(*) AS items, count(DISTINCT id) AS records FROM it GROUP BY status UNION ALL SELECT 'l_returnflag', l_returnflag, count(*), count(DISTINCT id) FROM it GROUP BY l_returnflag",
    "label_indicators": "SELECT l_orderkey AS id, " + ", ".join(f"max((p_type = '{v}')::INT) AS is_{v.lower()}" for v in ("ECONOMY", "PROMO", "LARGE", "MEDIUM", "STANDARD", "SMALL")) + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey",
    "described_diversity": 'SELECT "group", species, round(100 * species / sum(species) OVER (), 6) AS share_pct FROM (SELECT CASE WHEN p_type IN (\'ECONOMY\', \'SMALL\') THEN \'cheap\' WHEN p_type <> \'PROMO\' AND p_brand IN (\'Brand#1\', \'Brand#2\', \'Brand#3\') THEN \'fine\' ELSE \'unassigned\' END AS "group", count(*) AS species FROM part WHERE p_size > 10 GROUP BY 1)',
    "label_parents": "WITH d AS (SELECT p_brand, min(p_type) AS parent FROM part GROUP BY p_brand) SELECT l_suppkey AS id, string_agg(DISTINCT parent, ';' ORDER BY parent) AS parents FROM lineitem JOIN part ON l_partkey = p_partkey JOIN d USING (p_brand) GROUP BY l_suppkey",
}
