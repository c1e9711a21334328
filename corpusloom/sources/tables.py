"""The supplied tables read as publications with list labels.

A publication is an order; its labels are the types of its lines' parts, its countries the nations of
its lines' suppliers, its realm the customer's segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, year, direction."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderstatus").alias("direction"))


def labels(spark: SparkSession, sf_dir: str, column: str = "p_type") -> DataFrame:
    """Distinct id, label."""
    lines, part = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "part").select("p_partkey", column)
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("id"), F.col(column).alias("label")).distinct()


#: Rows of a record's table in one task, where it keeps them in memory.
TASK_ROWS = 500_000


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct id, country, region. A task has about TASK_ROWS lines, so what it keeps in memory doesn't grow with the table; a
    publication's rows are in one."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_suppkey")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // TASK_ROWS))  # the files say how many
    sup, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    dim = sup.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return lines.join(dim.select("s_suppkey", F.col("n_name").alias("country"), F.col("r_name").alias("region")), F.col("l_suppkey") == F.col("s_suppkey")).select("id", "country", "region").repartition(parts, "id").distinct()


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, places (distinct country and region), labels (distinct): one row per publication with lines, from one shuffle of
    the lines."""
    lines, part, sup, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation", "region"))
    dim = sup.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    dim = dim.select("s_suppkey", F.struct(F.col("n_name").alias("country"), F.col("r_name").alias("region")).alias("place"))
    both = lines.select("l_orderkey", "l_partkey", "l_suppkey").join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(dim, F.col("l_suppkey") == F.col("s_suppkey"))
    return both.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("place").alias("places"), F.collect_set("p_type").alias("labels"))


def realms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, year, realm, nation, cregion, priority of each publication's customer."""
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    who = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    who = who.select("c_custkey", F.col("c_mktsegment").alias("realm"), F.col("n_name").alias("nation"), F.col("r_name").alias("cregion"))
    own = orders.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").cast("long").alias("year"), "o_custkey", F.col("o_orderpriority").alias("priority"))
    return own.join(who, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")


#: The same for DuckDB.
SQL = """pub AS (SELECT o_orderkey AS id, year(o_orderdate)::BIGINT AS year, o_orderstatus AS direction FROM orders),
lab AS (SELECT DISTINCT l_orderkey AS id, p_type AS label FROM lineitem JOIN part ON l_partkey = p_partkey),
ctry AS (SELECT DISTINCT l_orderkey AS id, n_name AS country, r_name AS region FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
seg AS (SELECT o_orderkey AS id, year(o_orderdate)::BIGINT AS year, o_orderpriority AS priority, c_mktsegment AS realm, n_name AS nation, r_name AS cregion FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
