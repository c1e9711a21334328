"""Lookups, paged scans, finished batches, combined tables and stages, with services that are files."""

import json
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.contracts import ContractError
from corpusloom.sources import caches as K
from corpusloom.sources import lookups as L
from corpusloom.sources import published as P
from corpusloom.sources import services as V


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_calls_are_retried_within_bounds_and_paced():
    clock, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 6))
        clock[0] += s

    pace = L.Pace(4, lambda: clock[0], sleep)
    for _ in range(5):
        pace.wait()
    assert slept == [0.25] * 4
    slept.clear()
    left = [L.Busy("later", 7.0), TimeoutError("slow"), None]

    def client(keys):
        e = left.pop(0)
        if e:
            raise e
        return [{"v": 1}] * len(keys)

    pace = L.Pace(1e9, lambda: clock[0], sleep)
    assert L.call(client, [{"k": 1}], pace, attempts=4, delay=1.0) == ([{"v": 1}], "ok", 3, None) and [s for s in slept if s > 0.1] == [7.0, 2.0]
    left[:] = [ValueError("x")] * 9
    assert L.call(client, [{"k": 1}], pace, attempts=3)[1:] == ("failed", 3, "ValueError: x") and len(left) == 6
    left[:] = [L.Refused("no such")]
    assert L.call(client, [{"k": 1}], pace)[1:] == ("refused", 1, "no such")
    assert L.call(lambda keys: [], [{"k": 1}], pace)[1] == "refused"
    with pytest.raises(ValueError, match="rate"):
        L.Pace(0)


def test_lookups_ask_once_a_key_and_hold_the_rate(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    at = str(calls)

    def client(keys):
        """Throttles each key's first call, fails for 13, refuses 14; every call is a file."""
        with open(f"{at}/{uuid.uuid4().hex}", "w") as f:
            f.write(json.dumps([time.time(), [k["k"] for k in keys]]))
        (k,) = [k["k"] for k in keys]
        if k == 14:
            raise L.Refused("unknown name")
        if k == 13 or k % 5 == 0 and not os.path.exists(f"{at}/seen-{k}"):
            open(f"{at}/seen-{k}", "w").close()
            raise L.Busy("429", 0.05)
        return [{"v": f"value {k}"}]

    def made():
        return [json.loads((calls / n).read_text()) for n in os.listdir(calls) if not n.startswith("seen")]

    cache = K.KeyedCache(spark, str(tmp_path / "c"), "k long, v string", ["k"], buckets=4)
    wanted = spark.createDataFrame([(k,) for k in range(20)] * 2, "k long")
    began = time.time()
    out, failed = L.look_up(wanted, cache, client, rate=25, workers=3, attempts=2, delay=0.01)
    assert rows(failed.select("k", "status", "attempts")) == [(13, "failed", 2), (14, "refused", 1)]
    assert rows(out.distinct()) == sorted([(k, None if k in (13, 14) else f"value {k}") for k in range(20)], key=str)
    done = made()
    asked = [k for _, ks in done for k in ks]
    assert sorted(asked) == sorted([*range(20), 0, 5, 10, 15, 13])  # once, but for what was throttled
    times = sorted(t for t, _ in done)
    for i, t in enumerate(times):  # in any second no more calls than the rate, and one a worker
        assert sum(t <= u < t + 1 for u in times[i:]) <= 25 + 3
    assert time.time() - began > (len(done) / 3 - 2) * 3 / 25 * 0.5
    L.look_up(wanted, cache, client, rate=1000, workers=2, attempts=1)
    assert len(made()) == len(done) + 2  # 13 and 14 only


def test_embeddings_are_checked(spark, tmp_path):
    good = L.checked_vectors(lambda texts: [[len(t), 1] for t in texts], "text")
    out = L.ask(spark.createDataFrame([("a",), ("bb",), ("a",)], "text string"), good, "vector array<double>", 1000, batch=2, workers=1)
    assert rows(out.select("text", "vector", "status")) == [("a", [1.0, 1.0], "ok"), ("bb", [2.0, 1.0], "ok")]
    uneven = L.checked_vectors(lambda texts: [[0.0] * len(t) for t in texts], "text")
    short = L.checked_vectors(lambda texts: [], "text")
    for client in (uneven, short):
        out = L.ask(spark.createDataFrame([("a",), ("bb",)], "text string"), client, "vector array<double>", 1000, batch=2, workers=1)
        assert {r.status for r in out.collect()} == {"refused"}
    with pytest.raises(ValueError, match="share"):
        L.ask(spark.createDataFrame([("a",)], "text string"), good, "text string", 1)


def listing(total, size, drift=None):
    def fetch(page):
        rows = [{"id": i, "name": f"n{i}"} for i in range((page - 1) * size, min(page * size, total))]
        said = {"page": page, "page_size": size, "total": total, "rows": rows}
        return {**said, **drift(page, rows)} if drift else said

    return fetch


def test_pages_are_scanned_side_by_side(spark):
    out = V.read_pages(spark, listing(23, 5), "name string, id long")
    assert out.rdd.getNumPartitions() == 5 and rows(out.select("id")) == sorted([(i,) for i in range(23)], key=str)
    assert rows(out.where("id = 7")) == [("n7", 7)]
    assert V.read_pages(spark, listing(0, 5), "id long").count() == 0 and V.read_pages(spark, listing(10, 5), "id long").count() == 10


@pytest.mark.parametrize("drift", [
    lambda page, rows: {"total": 24} if page == 3 else {}, lambda page, rows: {"rows": rows[1:]} if page == 2 else {}, lambda page, rows: {"page": 1} if page == 2 else {},
    lambda page, rows: {"page_size": 6} if page == 4 else {}, lambda page, rows: {"total": -1},
])
def test_drift_between_pages_is_an_error(spark, drift):
    with pytest.raises(Exception, match="Drift|page"):
        V.read_pages(spark, listing(23, 5, drift), "id long").collect()


def test_finished_batches_are_read_once_over_restarts(spark, tmp_path):
    state, out, mark = tmp_path / "state.json", str(tmp_path / "out"), str(tmp_path / "mark")
    at = str(state)

    def listed():
        with open(at) as f:
            return [tuple(x) for x in json.load(f)]

    def fetch(batch):
        return [(batch, i) for i in range(3)]

    def poll(*states):
        state.write_text(json.dumps([[f"b{k}", s] for k, s in enumerate(states)]))
        stream = V.stream_batches(spark, listed, fetch, "batch string, i long")
        stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination(120)
        return sorted(r[0] for r in spark.read.schema("batch string, i long").parquet(out).collect())

    thrice = lambda *b: sorted(x for x in b for _ in range(3))
    assert poll("running", "completed", "validating") == thrice("b1")
    assert poll("running", "completed", "validating") == thrice("b1")
    assert poll("running", "completed", "completed", "running") == thrice("b1", "b2")
    assert poll("completed", "completed", "completed", "failed", "in_progress") == thrice("b0", "b1", "b2")
    assert poll("completed", "completed", "completed", "failed", "completed") == thrice("b0", "b1", "b2", "b4")


def test_a_combined_table_is_published_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    with P.CombinedWriter(spark, path, "id") as w:
        w.add(spark.createDataFrame([(1, "a")], "id long, v string"))
        w.add(spark.createDataFrame([("b", 2)], "v string, id long"))
        assert rows(w.publish()) == [(1, "a"), (2, "b")]
    before = rows(P.read_combined(spark, path))
    with pytest.raises(ContractError, match=r"3 in parts \[0, 1\]"), P.CombinedWriter(spark, path, "id") as w:
        w.add(spark.createDataFrame([(3, "c")], "id long, v string"))
        w.add(spark.createDataFrame([(3, "d")], "id long, v string"))
        w.publish()
    with pytest.raises(ContractError, match="columns"), P.CombinedWriter(spark, path, "id") as w:
        w.add(spark.createDataFrame([(3, "c")], "id long, v string"))
        w.add(spark.createDataFrame([(4,)], "id long"))
    with pytest.raises(RuntimeError, match="audit"), P.CombinedWriter(spark, path, "id") as w:
        w.add(spark.createDataFrame([(9, "c")], "id long, v string"))
        w.publish(lambda df: (_ for _ in ()).throw(RuntimeError("audit")))
    with P.CombinedWriter(spark, path, "id") as w:
        w.add(spark.createDataFrame([(9, "c")], "id long, v string"))
    assert rows(P.read_combined(spark, path)) == before and len(os.listdir(tmp_path / "t/parts")) == 1  # aborts leave nothing
    late, first = P.CombinedWriter(spark, path, "id"), P.CombinedWriter(spark, path, "id")
    for w, k in ((late, 7), (first, 8)):
        w.add(spark.createDataFrame([(k, "x")], "id long, v string"))
    first.publish()
    with pytest.raises(RuntimeError, match="another"):
        late.publish()
    assert rows(P.read_combined(spark, path)) == [(8, "x")]


def test_stages_are_made_anew_where_something_changed(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("1\n2\n3\n")

    def run(limit=1, factor=10, code="1"):
        s = P.Stages(spark, str(tmp_path / "stages"))
        s.run("read", lambda: spark.read.text(str(src)).select(F.col("value").cast("long").alias("x")), inputs={"in": P.files_fingerprint(spark, [str(src)], contents=True)})
        s.run("kept", lambda df: df.where(F.col("x") > limit), ["read"], rules={"limit": limit})
        s.run("scaled", lambda df: df.select((F.col("x") * factor).alias("x")), ["kept"], rules={"factor": factor}, code=code)
        s.run("other", lambda df: df.agg(F.sum("x").alias("x")), ["read"])
        return s.built, rows(s.result("scaled"))

    assert run() == (["read", "kept", "scaled", "other"], [(20,), (30,)])
    assert run() == ([], [(20,), (30,)])
    assert run(factor=2) == (["scaled"], [(4,), (6,)])
    assert run(limit=2) == (["kept", "scaled"], [(30,)])
    assert run(code="2") == (["scaled"], [(20,), (30,)])
    assert run() == ([], [(20,), (30,)])
    (src / "a.txt").write_text("1\n2\n3\n4\n")
    assert run() == (["read", "kept", "scaled", "other"], [(20,), (30,), (40,)])


def test_a_stage_that_fails_leaves_no_result(spark, tmp_path):
    s = P.Stages(spark, str(tmp_path))
    with pytest.raises(Exception, match="division|DIVIDE"):
        s.run("bad", lambda: spark.range(3).select((F.lit(1) / F.col("id")).alias("x")), rules=1)
    assert rows(s.run("bad", lambda: spark.range(2), rules=1)) == [(0,), (1,)] and s.built == ["bad"]
