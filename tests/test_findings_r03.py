"""Whole and right results where the tables are larger, or lie otherwise, than the small ones."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import geometry, lineages, resampling
from corpusloom.plans import compositions, labelling, storage
from corpusloom.sources import caches, tables


def shuffled(df):
    """df whose rows come in another order each time, as they may from many files."""

    def run(batches):
        for b in batches:
            order = list(range(b.num_rows))
            random.SystemRandom().shuffle(order)
            yield b.take(pa.array(order))

    return df.mapInArrow(run, df.schema)


def test_a_repeated_key_is_one_in_any_order_of_rows(spark, monkeypatch):
    orders = spark.range(5000).select(F.col("id").alias("o_orderkey"), F.element_at(F.array(*map(F.lit, "FOPX")), (F.col("id") % 4 + 1).cast("int")).alias("o_orderstatus"))
    orders = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderstatus")))
    monkeypatch.setattr(storage, "table", lambda *_: shuffled(orders))
    want = {}
    for k in range(5000):
        status = "FOPX"[k % 4] if k % 10 else None
        n, keys = want.get(status, (0, 0))
        want[status] = (n + 1, keys + k)
    assert {r.o_orderstatus: (r.n, r["keys"]) for r in storage.combined_parts(spark, "").collect()} == want


def test_a_digest_of_two_levels_has_two_in_tables_of_any_size(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for n in (3, 4, 5, 100):  # of more than 16 the last level takes over 4
        rows = [sha(f"{len(str(i))}:{i}") for i in range(n)]
        ups = [sha("".join(rows[k : k + 4])) for k in range(0, n, 4)]
        want = ups[0] if len(ups) == 1 else sha("".join(ups))
        assert caches.ordered_digest(spark.range(n), ["id"], F.col("id"), fan=4, levels=2).first()[0] == want


def test_payloads_that_are_alike_are_repaired_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    def marked(text):
        calls.add(1)
        return None if text is None else f"<{text}>"

    events = spark.range(300).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 > 0, "view").alias("event_type"), F.concat(F.lit('{"k": '), F.col("id") % 2, F.lit("}")).alias("props"))
    monkeypatch.setattr(labelling, "table", lambda *_: events)
    monkeypatch.setattr(labelling, "repair_json", lambda text: F.udf(marked, "string")(text))
    out = labelling.repaired_payloads(spark, "").collect()
    assert calls.value <= 2 * 4 * 8  # two texts of each cut of four payloads
    assert {(r.event_id, r.cut, r.props) for r in out} == {(i, n, "<" + f'{{"k": {i % 2}}}'[:n] + ">") for i in range(300) for n in range(1, 9)} and len(out) == 2400
    assert all((r.loose is None) == (r.event_id % 3 == 0) for r in out)


@pytest.mark.parametrize("kind", ["standardized", "contrast", "pattern"])
def test_bootstraps_read_the_records_once(spark, kind):
    reads = spark.sparkContext.accumulator(0)

    def seen(label):
        reads.add(1)
        return label

    cells = spark.range(400).select((F.col("id") / 2).cast("long").alias("id"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("tier"), (F.col("id") % 5 % 2).alias("s"), F.udf(seen, "string")(F.element_at(F.array(*map(F.lit, "xyz")), (F.col("id") % 3 + 1).cast("int"))).alias("label"), F.lit(0.5).alias("w"))
    if kind == "standardized":
        out = resampling.standardized_bootstrap(cells, ("a", "b"), ["s"], 20)
    elif kind == "contrast":
        out = resampling.contrast_bootstrap(cells.withColumnRenamed("tier", "group"), ("a", "b"), 20)
    else:
        out = resampling.pattern_bootstrap(cells, 20)
    assert {r.label for r in out.collect()} == set("xyz") and reads.value == 400


def test_items_are_nested_once_and_equal_those_nested_by_record(spark):
    links = spark.createDataFrame([(1, 7), (1, 5), (1, 7), (2, 5), (3, 9)], "id long, item long")
    lineage = spark.createDataFrame([(5, "e", 0, "K", "x"), (5, "e", 1, "P", "y"), (7, "g", 1, "P", "y"), (7, "g", 0, "K", "z")], "item long, name string, position int, rank string, node string")
    args = ("id", "item", ["name"], "position", ["rank", "node"])
    long = links.distinct().join(lineage, "item")
    mine = lineages.nested_items(links, lineage, *args)
    assert sorted(map(str, mine.collect())) == sorted(map(str, lineages.nested(long, *args).collect()))
    wide = lineages.ranked_items(mine, "id", "rank", "node", ["K", "P"])
    assert sorted(map(str, wide.collect())) == sorted(map(str, lineages.ranked_names(long, "id", "item", "position", "rank", "node", ["K", "P"]).collect()))


def test_countries_are_held_in_parts_of_bounded_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    spark.range(2000).select((F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 3).alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(3).select(F.col("id").alias("s_suppkey"), F.col("id").alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "A", 0), (1, "A", 1), (2, "B", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "R"), (1, "S")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    assert tables.countries(spark, str(tmp_path)).rdd.getNumPartitions() == 40
    assert sorted(map(tuple, compositions.country_counts_metadata_check(spark, str(tmp_path)).collect())) == [("A", 500, "R", False), ("B", 500, "S", True)]


def test_dissolving_sends_no_table_of_rings_through_the_driver(spark):
    square = lambda a, b: F.struct((F.col("id") % 8 + a).cast("double").alias("x"), (F.floor(F.col("id") / 8) + b).cast("double").alias("y"))
    rings = spark.range(64).select((F.col("id") % 3).alias("g"), F.lit(0).alias("ring"), F.array(square(0, 0), square(1, 0), square(1, 1), square(0, 1)).alias("points"))
    out = geometry.dissolved(geometry.turned(rings), "g")
    assert out.agg(F.sum(F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area")))).first()[0] == 64
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
