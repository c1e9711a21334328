"""Hand-built frames with exact values."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import labels as L
from corpusloom.functions import text as X
from corpusloom.operators import attribution as A
from corpusloom.operators import contracts as C
from corpusloom.operators import evaluation as E
from corpusloom.operators import geo as G
from corpusloom.operators import sampling as S
from corpusloom.operators import temporal as T


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_fractional_share_and_growth(spark):
    pairs = spark.createDataFrame([("A", 2000, "x"), ("A", 2000, "y"), ("B", 2000, "x"), ("C", 2001, "y")], "id string, year int, label string")
    out = {(r.year, r.label): (r.fractional_count, r.n_pubs, r.share) for r in A.fractional_share(pairs, ["year"]).collect()}
    assert out == {(2000, "x"): (1.5, 2, 75.0), (2000, "y"): (0.5, 2, 25.0), (2001, "y"): (1.0, 1, 100.0)}
    grown = T.cagr_by_period(A.fractional_share(pairs, ["year"]), "label", "year", "fractional_count", [(2000, 2001)])
    assert {r.label: r.cagr_pct for r in grown.collect()} == {"x": -100.0, "y": 100.0}


def test_two_way_weights_sum_to_one(spark):
    c = spark.createDataFrame([("a", "SWE"), ("a", "LTU"), ("b", "USA")], "id string, country string")
    t = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")], "id string, label string")
    w = A.two_way_weights([(c, "country"), (t, "label")])
    assert rows(w.groupBy("id").agg(F.sum("w"), F.count("w"))) == [("a", 1.0, 4), ("b", 1.0, 1)]


def test_standardized_contrast(spark):
    r = [("a", "H", "T1", 0.5), ("a", "L", "T1", 0.5), ("b", "H", "T1", 0.5), ("b", "H", "T2", 0.5), ("c", "L", "T2", 1.0)]
    cells = spark.createDataFrame(r, "id string, tier string, label string, w double").withColumn("stratum", F.lit("one"))
    out = {x.label: round(x.std_H - x.std_L, 6) for x in A.standardized_shares(cells, ("H", "L")).collect()}
    assert out == {"T1": round(100 * (2 / 3 - 1 / 3), 6), "T2": round(-100 * (2 / 3 - 1 / 3), 6)}


def test_geo_counts_and_quotient(spark):
    p = spark.createDataFrame([("A", "USA"), ("A", "BRA"), ("B", "USA")], "id string, country string")
    t = spark.createDataFrame([("A", "P"), ("B", "P"), ("A", "C"), ("D", "C")], "id string, label string")
    assert rows(G.geo_counts(p, t, "country")) == [("C", "BRA", 1, 1), ("C", "USA", 1, 1), ("P", "BRA", 1, 2), ("P", "USA", 2, 2)]
    lq = {(r.country, r.label): r.lq for r in G.location_quotient(p, t, "country").collect()}
    assert lq[("USA", "C")] == 1.0 and lq[("BRA", "C")] == 2.0


def test_parsers(spark):
    cells = [(None,), ("[]",), ("nan",), ('["a", "b", "a"]',), ("['a', 'c']",), (" a ; b;;a",), ("x|y",)]
    df = spark.createDataFrame(cells, "c string")
    assert [r[0] for r in df.select(L.parse_list_labels(F.col("c"))).collect()] == [[], [], [], ["a", "b"], ["a", "c"], ["a", "b"], ["x|y"]]
    assert [r[0] for r in df.select(L.split_cell(F.col("c"))).collect()][-1] == ["x", "y"]
    assert [r[0] for r in df.select(L.label_set(F.col("c"))).collect()][-2] == ["a ; b;;a"]


def test_buckets_and_states(spark):
    df = spark.createDataFrame([("Not Applicable",), ("Global",), ("Unk.",), ("USA",), ("XXX",)], "c string")
    known = F.col("c") == "USA"
    assert [r[0] for r in df.select(L.country_bucket(F.col("c"), known)).collect()] == ["not_applicable", "aggregate", "unclear", "mapped", "unresolved"]
    assert df.select(L.region_bucket(F.col("c"), known)).first()[0] == "unresolved"
    lists = spark.createDataFrame([([],), (["NA"],), (["All Regions"],), (["Asia", "Unclear"],), (["Asia"],)], "l array<string>")
    assert [r[0] for r in lists.select(L.level_state(F.col("l"), "region")).collect()] == ["empty", "not_applicable", "global", "mixed", "concrete"]


def test_ids_round_trip(spark):
    df = spark.createDataFrame([("WOS:000000000000042",), ("WOS:42",)], "u string")
    assert [r[0] for r in df.select(X.record_id(F.col("u"))).collect()] == [42, None]
    assert df.select(X.record_key(X.record_id(F.col("u")))).first()[0] == "WOS:000000000000042"


def test_eligibility(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (1, -1, 1, 0), (1, -1, 1, 1), (1, None, 1, 1)], "a int, b int, c int, d int")
    cols = [F.col(c) for c in "abcd"]
    assert [r[0] for r in df.select(E.eligibility(*cols)).collect()] == ["ELIGIBLE", "NOT_ELIGIBLE", "ELIGIBLE", "NOT_ELIGIBLE"]
    assert [r[0] for r in df.select(E.first_failing_stage(list(zip("abcd", cols)))).collect()] == [None, None, None, None]


def test_label_metrics(spark):
    df = spark.createDataFrame([(["a"], ["a"]), (["a", "b"], ["b"]), (["b"], []), ([], ["a"])], "t array<string>, p array<string>")
    out = {r.label: r for r in E.label_metrics(df, "t", "p").collect()}
    assert (out["a"].tp, out["a"].fp, out["a"].fn, out["a"].tn, out["a"].n) == (1, 0, 1, 1, 3)
    assert out["_micro"].tp == 2 and out["_micro"].fn == 2 and out["_macro"].precision == 1.0
    assert E.label_metrics(df.where("size(t) = 0"), "t", "p").count() == 0


def test_allocation_and_split(spark):
    assert S.allocation(7, [0.6, 0.2, 0.2]) == [4, 2, 1]
    assert S.equal_allocation({"a": 1, "b": 10, "c": 10}, 9) == {"a": 1, "b": 5, "c": 3}
    df = spark.createDataFrame([(i, "s" if i < 7 else "t") for i in range(12)], "k int, s string")
    out = S.split_rows(df, "s", "k", {"train": 0.6, "dev": 0.2, "test": 0.2}, 1)
    assert rows(out.groupBy("s", "split").count()) == [("s", "dev", 2), ("s", "test", 1), ("s", "train", 4), ("t", "dev", 1), ("t", "test", 1), ("t", "train", 3)]


def test_contracts_refuse(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    with pytest.raises(C.ContractError):
        C.assert_unique_key(a, "k")
    with pytest.raises(C.ContractError):
        C.assert_same_keys(a, b, "k")
    with pytest.raises(C.ContractError):
        C.assert_vocabulary(a.select(F.lit("x").alias("l")), "l", ["y"])
    assert rows(C.key_difference(a, b, "k")) == [(2, "left_only"), (3, "right_only")]


def test_series_keep_every_supplier_and_year(spark, tmp_path):
    from corpusloom.plans import records as R

    lines = [(3, "1995-05-01", 2.0), (3, "1995-07-01", 3.0), (3, "1999-01-01", 4.0), (4, "1997-01-01", 5.0), (6, "1996-01-01", 6.0)]
    li = spark.createDataFrame(lines, "l_suppkey long, d string, l_quantity double").withColumn("l_shipdate", F.to_date("d")).drop("d")
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    sf = str(tmp_path)
    assert rows(R.series_unpivot(spark, sf)) == [(3, 1995, 5.0), (3, 1999, 4.0), (4, 1997, 5.0), (6, 1996, 6.0)]
    assert rows(R.series_coverage(spark, sf)) == [(3, 2, 1995, 1999), (4, 1, 1997, 1997), (6, 1, 1996, 1996)]
    assert rows(R.series_latest(spark, sf)) == [(3, 1999, 4.0), (4, 1997, 5.0), (6, 1996, 6.0)]


def test_null_strata_are_strata(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "ab"[i % 2]) for i in range(60)], "id int, s string")
    assert S.proportional_allocation({"b": 20, None: 20, "a": 20}, 6) == {"a": 2, "b": 2, None: 2} and S.equal_allocation({None: 5, "a": 1}, 4) == {"a": 1, None: 3}
    count = lambda out: {r.s: r["count"] for r in out.groupBy("s").count().collect()}
    assert count(S.sample_each(df, "s", "id", 4, 1)) == {"a": 4, "b": 4, None: 4}
    assert count(S.proportional_sample(df, "s", "id", 12, 1)) == {"a": 4, "b": 4, None: 4}
    assert count(S.take_per_stratum(df.select("id", (F.col("id") % 3).alias("s")), "s", "id", {0: 2, 2: 1}, 1)) == {0: 2, 2: 1}
    split = S.split_rows(df, "s", "id", {"train": 0.5, "test": 0.5}, 1).groupBy("s", "split").count().collect()
    assert {(r.s, r.split): r["count"] for r in split} == {(s, x): 10 for s in ("a", "b", None) for x in ("train", "test")}
