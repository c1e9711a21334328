"""Scans, sinks, streams, rules and bootstraps on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import rules as U
from corpusloom.operators import resampling as B
from corpusloom.sources import files as S
from corpusloom.streaming import ingest as I


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_exports_with_differing_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('UT,Title\n1,"a, b"\n2,x\n,none\n')
    (tmp_path / "b.csv").write_text("ut,article title\n2,later\n3,y\n")
    out = S.read_exports(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], {"ut": ["UT"], "title": ["Article Title"], "year": []}, "ut")
    assert rows(out) == [("1", "a, b", None), ("2", "x", None), ("3", "y", None)]


def test_latest_valid_record_wins(spark, tmp_path):
    good = lambda k, v: json.dumps({"id": k, "v": v})
    (tmp_path / "run.jsonl").write_text(f"{good('a', 1)}\n{good('b', 1)}\n\n")
    (tmp_path / "run-retry-2.jsonl").write_text(f"{good('a', 3)}\n{{broken\n")
    (tmp_path / "run-retry-10.jsonl").write_text(f"{good('a', 4)}\n{good('a', 5)}\n")
    out = S.latest_valid(S.read_jsonl(spark, str(tmp_path), "id string, v int"), "id").select("id", "v")
    assert rows(out) == [("a", 5), ("b", 1)]


def test_manifest_round_trip_and_change(spark, tmp_path):
    df, at = spark.createDataFrame([(1, ["a"]), (2, None)], "id long, l array<string>"), str(tmp_path / "t")
    S.write_with_manifest(df, at, 3)
    assert rows(S.read_with_manifest(spark, at, 3)) == [(1, ["a"]), (2, None)]
    with pytest.raises(ValueError, match="version"):
        S.read_with_manifest(spark, at, 4)
    df.limit(1).write.mode("append").parquet(f"{at}/data")
    with pytest.raises(ValueError, match="rows"):
        S.read_with_manifest(spark, at, 3)


def test_numbered_parts_and_text_lists(spark, tmp_path):
    df = spark.range(25).select("id", (F.col("id") % 2).alias("year"), F.array(F.lit("x")).alias("l"))
    S.write_numbered_parts(df, str(tmp_path / "p"), "year", "id", 5)
    out = spark.read.parquet(str(tmp_path / "p")).groupBy("year", "part").agg(F.count(F.lit(1)), F.max("id"))
    assert rows(out) == [(0, 1, 5, 24), (0, 2, 5, 14), (0, 3, 3, 4), (1, 1, 5, 23), (1, 2, 5, 13), (1, 3, 2, 3)]
    assert dict(S.lists_to_text(df).dtypes)["l"] == "string"


def test_hierarchy_and_projection(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"E": {"N": [{"code": "SWE"}], "S": [{"code": "ITA"}, {"code": "ESP"}]}}))
    assert rows(S.read_hierarchy(spark, str(tmp_path / "h.json"), "code string")) == [("E", "N", "SWE"), ("E", "S", "ESP"), ("E", "S", "ITA")]
    with pytest.raises(ValueError, match="unknown"):
        S.project(spark.range(1), ["id", "x"])


def test_stream_appends_each_key_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "k string, v int").coalesce(1).write.parquet(src)
    like = spark.read.parquet(src)
    I.append_new(I.read_stream(spark, src, like), "k", out, mark).awaitTermination()
    spark.createDataFrame([("b", 9), ("c", 9)], "k string, v int").write.mode("append").parquet(src)
    I.append_new(I.read_stream(spark, src, like), "k", out, mark).awaitTermination()
    assert [r[0] for r in rows(spark.read.parquet(out).select("k"))] == ["a", "b", "c"]


def test_rules(spark):
    df = spark.createDataFrame([("x", None, True), ("", "q", True), (None, "r", True), ("x", "r", False)], "a string, b string, ok boolean")
    rules = [{"group": "g1", "when": [{"field": "a", "op": "in", "values": ["x"]}, {"field": "b", "op": "missing"}]}, {"group": "g2", "when": [{"field": "b", "op": "not_in", "values": ["r"]}]}]
    assert [r[0] for r in df.select(U.assign_group(F.col("ok"), F.lit(None).cast("string"), rules, F.col)).collect()] == ["g1", "g2", "unassigned", None]
    with pytest.raises(ValueError, match="operator"):
        U.predicate(F.lit("a"), "like")


def test_bootstraps_hold_their_estimates(spark):
    w = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("group"), F.when(F.col("id") % 4 < 3, "x").otherwise("y").alias("label"), F.lit(1.0).alias("w"))
    out = {r.label: r for r in B.contrast_bootstrap(w, ("p", "q"), 100).collect()}
    assert out["x"].contrast == 50.0 and 40 < out["x"].lo < 50 < out["x"].hi < 60 and out["x"].excludes_zero
    pairs = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("label"))
    p = {r.label: r for r in B.pattern_bootstrap(pairs, 50).collect()}
    assert abs(p["x"].share - 100 / 3) < 1e-9 and 28 < p["x"].lo < p["x"].share < p["x"].hi < 38


def test_whole_and_ranks(spark):
    df = spark.createDataFrame([("a", 33.4), ("b", 33.3), ("c", 33.3)], "k string, s double")
    assert rows(B.rounded_to_whole(df, "s", "k").select("k", "whole")) == [("a", 34), ("b", 33), ("c", 33)]
    ranked = spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "v double").select(B.average_rank("v").alias("r"))
    assert sorted(r[0] for r in ranked.collect()) == [1.0, 2.5, 2.5]
