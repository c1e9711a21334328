"""Queries of unbalanced trees: region, nation and segment of customers, by orders and by customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import trees as T
from corpusloom.sources.tables import table

LEVELS = ("region", "nation", "segment")
THRESHOLDS = (20.0, 20.0, 21.0)


def _paths(spark, sf):
    """region, nation, segment, n_orders, n_customers."""
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    who = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    who = who.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return who.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_orders"), F.count(F.lit(1)).alias("n_customers"))


def tree_selection(spark, sf):
    """Leaves of the tree whose nodes hold a fifth of their parent by orders or by customers."""
    return T.select_tree(_paths(spark, sf), LEVELS, "n_orders", "n_customers", THRESHOLDS)


def tree_rebase(spark, sf):
    """Customers in the red, counted on the leaves of that tree."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    who = table(spark, sf, "customer").where("c_acctbal < 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    own = who.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), F.lit(1).cast("long").alias("n"))
    return T.rebase_tree(tree_selection(spark, sf), own, LEVELS, "n")


def _fold_sql(source: str, out: str, depth: int, measures: str) -> str:
    above, here, below = LEVELS[:depth], LEVELS[depth], LEVELS[depth + 1 :]
    met = " AND ".join(f"p.{c} IS NOT DISTINCT FROM k.{c}" for c in LEVELS[: depth + 1])
    cols = [f"p.{c}" for c in above] + [f"CASE WHEN p.{here} IS NULL OR k.{here} IS NOT NULL THEN p.{here} ELSE '{T.REMAINING}' END AS {here}"] + [f"CASE WHEN k.{here} IS NOT NULL THEN p.{c} END AS {c}" for c in below]
    return f"{out} AS (SELECT {', '.join(cols)}, {measures} FROM {source} p LEFT JOIN named{depth} k ON {met} GROUP BY ALL)"


def _selection_sql() -> str:
    parts = ["""p0 AS (SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, coalesce(sum(n), 0)::BIGINT AS n_orders, count(*) AS n_customers
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey GROUP BY ALL)"""]
    for d, t in enumerate(THRESHOLDS):
        own, by = ", ".join(LEVELS[: d + 1]), f"PARTITION BY {', '.join(LEVELS[:d])}" if d else ""
        parts.append(f"child{d} AS (SELECT {own}, sum(n_orders) AS a, sum(n_customers) AS b FROM p{d} WHERE {LEVELS[d]} IS NOT NULL GROUP BY ALL)")
        parts.append(f"score{d} AS (SELECT *, greatest(coalesce(100.0::DOUBLE * a / nullif(sum(a) OVER ({by}), 0), 0), coalesce(100.0::DOUBLE * b / nullif(sum(b) OVER ({by}), 0), 0)) AS score FROM child{d})")
        parts.append(f"named{d} AS (SELECT {own} FROM (SELECT *, max(score) OVER ({by}) AS most, row_number() OVER ({by} ORDER BY a DESC, score DESC, {LEVELS[d]}) AS best FROM score{d}) WHERE (score >= {t} OR (most < {t} AND best = 1)) AND {LEVELS[d]} <> '{T.REMAINING}')")
        parts.append(_fold_sql(f"p{d}", f"p{d + 1}", d, "sum(n_orders)::BIGINT AS n_orders, sum(n_customers)::BIGINT AS n_customers"))
    return "WITH " + ",\n".join(parts)


_END = f"p{len(LEVELS)}"
_BENCH = """q0 AS (SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal < 0 GROUP BY ALL)"""
QUERIES = {f.__name__: f for f in (tree_selection, tree_rebase)}
ORACLES = {
    "tree_selection": f"{_selection_sql()} SELECT * FROM {_END}",
    "tree_rebase": ",\n".join([_selection_sql(), _BENCH, *[_fold_sql(f"q{d}", f"q{d + 1}", d, "sum(n)::BIGINT AS n") for d in range(len(LEVELS))]])
    + f" SELECT {', '.join(LEVELS)}, sum(n)::BIGINT AS n FROM (SELECT * FROM q{len(LEVELS)} UNION ALL SELECT {', '.join(LEVELS)}, 0 FROM {_END}) GROUP BY ALL",
}
