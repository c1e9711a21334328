"""Operators that queries alone don't pin down: errors, odd cells, random draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import payloads as P
from corpusloom.functions import rules as U
from corpusloom.functions import text as X
from corpusloom.operators import attribution as A
from corpusloom.operators import geo_audit as G
from corpusloom.operators import lineages as N
from corpusloom.operators import predictions as O
from corpusloom.operators import resampling as B
from corpusloom.operators import rows as R
from corpusloom.operators import sampling as S
from corpusloom.operators.contracts import ContractError, assert_vocabulary, merge_one_to_one
from corpusloom.streaming import ingest as I


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_payload_repair(spark):
    texts = ['{"a": 1}', 'so:\n```json\n[{"a": [1, 2,],}]\n```', '{"a": [1, {"b": "x', "", None, "12", '{"a": "x,}"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.x for r in df.orderBy("i").select(P.json_payload(F.col("t")).alias("x")).collect()] == ['{"a": 1}', '[{"a":[1,2]}]', '{"a":[1,{"b":"x"}]}', None, None, None, '{"a": "x,}"}']


def test_predictions_are_checked(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    preds = spark.createDataFrame([("a", "late", 9), ("a", "early", 1)], "k string, p string, at int")
    assert sorted(map(tuple, O.attach_first(base, preds, "k", {"p": "pred"}, F.col("at")).collect())) == [("a", 1, "early"), ("b", 2, None)]
    with pytest.raises(ContractError, match="lacks"):
        O.attach_first(base.where("k = 'b'"), preds, "k", {"p": "pred"}, F.col("at"))
    assert O.task("Threats-L0") == "threats_l0" and O.task(" Regions") == "geography" and len(O.ALIASES) == len(O.COLUMNS) == 11 and sum(1 + len(x) for x in O.ALIASES.values()) == 23
    with pytest.raises(ValueError, match="unknown task"):
        O.task("nothing")


def test_contracts(spark):
    a, twice = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([(1, "y"), (1, "z")], "k int, b string")
    with pytest.raises(ContractError, match="repeats"):
        merge_one_to_one(a, [twice], "k")
    with pytest.raises(ContractError, match="several rows"):
        R.enrich(a, [(twice, "p_")], "k")
    with pytest.raises(ContractError, match="lacks"):
        R.checked_lookup(a, spark.createDataFrame([(1, None)], "k int, c string"), "k", ["c"])
    assert_vocabulary(a, "a", ["x"])
    with pytest.raises(ContractError, match="unknown"):
        assert_vocabulary(a, "a", ["y"])


def test_hierarchy_with_two_paths_is_refused(spark):
    df = spark.createDataFrame([(1, ["E"], ["N"], ["SWE"])], "id int, r array<string>, s array<string>, c array<string>")
    columns = {"region": "r", "subregion": "s", "country": "c"}
    assert G.path_audit(df, columns, [("E", "N", "SWE")]).first().status == "pass_complete"
    for twice in ([("E", "N", "SWE"), ("A", "N", "X")], [("E", "N", "SWE"), ("E", "M", "SWE")]):
        with pytest.raises(ValueError, match="several paths"):
            G.path_audit(df, columns, twice)


def test_two_names_of_a_rank_are_an_error(spark):
    df = spark.createDataFrame([([("KINGDOM", "a"), ("kingdom", "b")],)], "l array<struct<rank: string, name: string>>")
    with pytest.raises(Exception, match="several names"):
        df.select(*N.canonical_path(F.col("l"))).collect()


def test_states(spark):
    lst = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    assert [one(spark, U.list_state(c, ["out"], ["vague"])) for c in (lst(), lst("in"), lst("out"), lst("vague"), lst("in", "out"), lst("out", "vague"))] == ["missing", "inside", "outside", "unclear", "mixed", "unclear"]
    assert one(spark, X.html_text(F.lit("<p>a<br>b</p><script>x</script>&amp;lt;"))) == "a b &lt;"


def test_numbers_follow_the_order_at_any_partitioning(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(7)
    assert [r.k for r in R.numbered_rows(df, "k", F.desc("v"), first=5).orderBy(F.desc("v")).collect()] == list(range(5, 1005))


def test_strata_ranked_in_ranges(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, "a").alias("s"))
    got = {(r.s, r._r) for r in S.ranked(df, "s", "id", 4).collect()}
    assert got == {("a", k) for k in range(1, 334)} | {(None, k) for k in range(1, 168)}
    assert S.balanced_size({"a": 10, "b": 3}, {"a": 2, "b": 1}) == 9 and S.proportional_allocation({"a": 5, "b": 5, "c": 0}, 5) == {"a": 3, "b": 2, "c": 0}


def test_rank_paths_share_a_records_weight(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "a", "x"), (2, "b", "z")], "id int, p string, q string")
    got = {(r["rank"], r.path): (r.weight, r.n) for r in A.rank_paths(df, ["p", "q"]).collect()}
    assert got == {(1, "a"): (1.5, 2), (1, "b"): (0.5, 1), (2, "a > x"): (1.0, 2), (2, "a > y"): (0.5, 1), (2, "b > z"): (0.5, 1)}


def test_pattern_bootstrap_matches_plain_numpy(spark):
    """Intervals against the same draws applied record pattern by record pattern."""
    sets = {1: "a", 2: "ab", 3: "ab", 4: "b", 5: "abc", 6: "a"}
    pairs = spark.createDataFrame([(i, c) for i, s in sets.items() for c in s], "id int, label string")
    patterns = sorted({"".join(s) for s in sets.values()}, key=lambda s: [(c, 1 / len(s)) for c in s])
    counts = [sum(s == p for s in sets.values()) for p in patterns]
    drawn = []
    draws = [m for first in range(1, 201, B.CHUNK) for m in B.draw_range(B.CHUNK, counts, [6], 0, 3, "all", first)]  # one range
    for m in draws:
        assert m.sum() == 6
        x = {c: sum(k / len(p) for k, p in zip(m, patterns) if c in p) for c in "abc"}
        drawn.append([100 * x[c] / sum(x.values()) for c in "abc"])
    lo, hi = np.percentile(drawn, [2.5, 97.5], axis=0)
    for r in B.pattern_bootstrap(pairs, 200, 3).collect():
        k = "abc".index(r.label)
        assert r.lo == pytest.approx(lo[k]) and r.hi == pytest.approx(hi[k])
        assert r.share == pytest.approx(100 * sum(1 / len(s) for s in sets.values() if r.label in s) / 6)


def test_contrast_bootstrap_matches_plain_numpy(spark):
    rows = [(1, "g", "a", 1.0), (2, "g", "a", 0.5), (2, "g", "b", 0.5), (3, "g", "b", 1.0), (4, "h", "a", 1.0), (5, "h", "c", 1.0), (6, "h", "c", 1.0)]
    df = spark.createDataFrame(rows, "id int, group string, label string, w double")
    own = {"g": [{"a": 1.0}, {"a": 0.5, "b": 0.5}, {"b": 1.0}], "h": [{"a": 1.0}, {"c": 1.0}]}
    order = {"g": [1, 0, 2], "h": [0, 1]}  # patterns as the operator sorts them: by label, then weight
    n = {"g": [1, 1, 1], "h": [1, 2]}
    diffs = {c: [] for c in "abc"}
    draws = {g: [m for first in range(1, 101, B.CHUNK) for m in B.draw_range(B.CHUNK, [n[g][k] for k in order[g]], [3], 0, 9, g, first)] for g in "gh"}
    for r in range(100):
        s = {}
        for g in "gh":
            m = draws[g][r]
            x = {c: sum(q * own[g][k].get(c, 0) for q, k in zip(m, order[g])) for c in "abc"}
            s[g] = {c: 100 * v / sum(x.values()) for c, v in x.items()}
        for c in "abc":
            diffs[c].append(s["g"][c] - s["h"][c])
    for r in B.contrast_bootstrap(df, ("g", "h"), 100, 9).collect():
        assert (r.lo, r.hi) == pytest.approx(tuple(np.percentile(diffs[r.label], [2.5, 97.5])))


def test_standardized_bootstrap_of_alike_records_is_sharp(spark):
    """Where all records of a tier are alike, no replicate can differ from the point."""
    rows = [(i, t, s, label, 1.0) for i, (t, s, label) in enumerate([("a", "s", "x")] * 30 + [("b", "s", "y")] * 30)]
    out = {r.label: r for r in B.standardized_bootstrap(spark.createDataFrame(rows, "id int, tier string, s string, label string, w double"), ("a", "b"), ["s"], 60, 1).collect()}
    assert (out["x"].contrast, out["x"].lo, out["x"].hi) == (100.0, 100.0, 100.0) and out["y"].hi == -100.0


def test_streams_of_windows_and_first_keys(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("2024-01-01 00:00:10", "a", 1.0), ("2024-01-01 00:00:20", "a", 2.0), ("2024-01-01 00:05:00", "b", 4.0)], "t string, k string, value double").select(F.to_timestamp("t").alias("ts"), "k", "value").coalesce(1).write.parquet(src)
    stream = I.read_stream(spark, src, spark.read.parquet(src))
    for name, out, want in (
        ("w", I.window_counts(stream, "ts", ["k"], "1 minute", "1 minute").select("k", "n", "total"), [("a", 2, 3.0), ("b", 1, 4.0)]),
        ("f", I.first_of_key(stream, ["k"], "ts", "1 hour").select("k"), [("a",), ("b",)]),
    ):
        q = out.writeStream.format("memory").queryName(f"t_{name}").outputMode("complete" if name == "w" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(f"t_{name}").collect())) == want
