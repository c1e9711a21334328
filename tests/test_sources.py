"""Workbooks, archives, caches, resumable builds, batches and scans on small fixtures."""

import hashlib
import io
import json
import os
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators.contracts import ContractError
from corpusloom.sources import caches as K
from corpusloom.sources import files as S
from corpusloom.sources import workbooks as X


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_workbook_round_trip(spark, tmp_path):
    one = spark.createDataFrame([(1, "=1+1", ["a", "b"], None), (2, ' <&"> ', [], 2.5)], "id long, t string, l array<string>, x double").coalesce(1)
    X.write_workbook({"first": one, "second one": one.select("id")}, str(tmp_path / "a.xlsx"))
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    found, failures = X.read_workbooks(spark, str(tmp_path / "*.xlsx"))
    assert rows(X.with_header(found.where("name = 'first'"), ["t", "id", "l", "gone", "x"]).drop("file", "name")) == [(1, "=1+1", "1", '["a", "b"]', None, None), (2, ' <&"> ', "2", "[]", None, "2.5")]
    assert [r.cells for r in found.where("name = 'second one'").orderBy("at").collect()] == [["id"], ["1"], ["2"]]
    assert [r.error.split(":")[0] for r in failures.collect()] == ["BadZipFile"] and X.read_workbooks(spark, str(tmp_path / "*.xlsx"), "second one")[0].count() == 3
    assert not (tmp_path / "a.xlsx.partial").exists()
    for bad in ("x" * 32_768, "a\x01"):
        with pytest.raises(ValueError, match="loss"):
            X.cell_text(bad)


def test_workbook_of_another_writer():
    main = X._MAIN[1:-1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{X._REL[1:-3]}"><sheets><sheet name="S" sheetId="1" r:id="q"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="q" Target="/xl/worksheets/w.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>')
        z.writestr("xl/worksheets/w.xml", f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="AA2"><v>7</v></c></row></sheetData></worksheet>')
    assert X.sheets(data.getvalue()) == {"S": [[], [None, "bc", *[None] * 24, "7"]]}


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("meta.csv", "k\n1\n")
        z.writestr("data.csv", '﻿k,v\n1,"x\ny"\n2,z\n')
        z.writestr("notes.txt", "long" * 100)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("notes.txt", "none")
    found, failures = X.read_archives(spark, str(tmp_path))
    assert rows(X.with_header(found, ["v", "k"]).drop("file")) == [("data.csv", 1, "x\ny", "1"), ("data.csv", 2, "z", "2")]
    assert failures.count() == 1 and [r.name for r in X.read_archives(spark, str(tmp_path), others=True)[0].select("name").distinct().collect()] == ["meta.csv"]


def test_cache_upserts_and_forgets_with_its_signature(spark, tmp_path):
    make = lambda **s: K.KeyedCache(spark, str(tmp_path / "c"), "k string, rank string, v int", ["k", "rank"], s)
    c = make(rules=1)
    assert c.read().count() == 0 and c.misses(spark.createDataFrame([("a", "x"), ("a", "x")], "k string, rank string")).count() == 1
    c.upsert(spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "k string, rank string, v int"))
    c.upsert(spark.createDataFrame([("b", "x", 5), ("b", "x", 4), ("c", "x", 3)], "k string, rank string, v int"), -F.col("v"))
    assert rows(make(rules=1).read()) == [("a", "x", 1), ("b", "x", 5), ("c", "x", 3)]
    assert make(rules=2).read().count() == 0
    asked = []

    def compute(keys):
        asked.append(rows(keys))
        return keys.withColumn("v", F.lit(9))

    wanted = spark.createDataFrame([("a", "x"), ("d", "y")], "k string, rank string")
    assert rows(c.look_up(wanted, compute)) == [("a", "x", 1), ("d", "y", 9)] and rows(c.look_up(wanted, compute)) and asked == [[("d", "y")]]


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    c = K.KeyedCache(spark, str(tmp_path / "c"), "k long, v int", ["k"], buckets=8)
    c.grace = 0
    c.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("v")))
    first = c._state()[1]
    assert len(first) == 8
    touched = c.upsert(spark.createDataFrame([(3, 2), (300, 2)], "k long, v int"))
    now = c._state()[1]
    assert 1 <= len(touched) <= 2 and all((now[b] != first[b]) == (int(b) in touched) for b in now)
    assert rows(c.read().where("v = 2")) == [(3, 2), (300, 2)] and c.read().count() == 201
    for k in range(4):
        c.upsert(spark.createDataFrame([(3, k)], "k long, v int"))
    assert len(c.versions.numbers()) == 2 and len(c.versions.folders("data")) <= 10  # what no version points to goes
    c.upsert(spark.createDataFrame([], "k long, v int"))
    assert c.read().count() == 201


@pytest.mark.parametrize("step", ["_write", "_stage", "_rename", "_clean"])
@pytest.mark.parametrize("after", [False, True])
def test_a_crash_at_any_step_leaves_a_whole_version(spark, tmp_path, monkeypatch, step, after):
    make = lambda: K.KeyedCache(spark, str(tmp_path / "c"), "k long, v int", ["k"], buckets=4)
    make().upsert(spark.range(20).select(F.col("id").alias("k"), F.lit(1).alias("v")))
    c = make()
    owner = c if step in ("_write", "_clean") else c.versions
    real = getattr(owner, step)

    def crash(*a):
        if after:
            real(*a)
        raise OSError("crash")

    monkeypatch.setattr(owner, step, crash)
    with pytest.raises(OSError, match="crash"):
        c.upsert(spark.range(10, 30).select(F.col("id").alias("k"), F.lit(2).alias("v")))
    published = step == "_clean" or step == "_rename" and after
    want = [(k, 1 if k < 10 or not published else 2) for k in range(30 if published else 20)]
    assert sorted(map(tuple, make().read().collect())) == want
    make().upsert(spark.createDataFrame([(0, 9)], "k long, v int"))
    assert sorted(map(tuple, make().read().collect())) == [(0, 9), *want[1:]]


def test_of_two_writers_neither_is_lost(spark, tmp_path, monkeypatch):
    make = lambda: K.KeyedCache(spark, str(tmp_path / "c"), "k long, v int", ["k"], buckets=4)
    a, b = make(), make()
    real, raced = a._write, []

    def slow(*args):
        out = real(*args)
        if not raced:
            raced.append(b.upsert(spark.createDataFrame([(2, 2)], "k long, v int")))
        return out

    monkeypatch.setattr(a, "_write", slow)
    a.upsert(spark.createDataFrame([(1, 1)], "k long, v int"))
    assert rows(make().read()) == [(1, 1), (2, 2)]


def test_resumed_build_tries_failed_shards_again(spark, tmp_path):
    cache, broken = K.KeyedCache(spark, str(tmp_path / "e"), "id long, v array<double>", ["id"]), tmp_path / "broken"
    broken.touch()
    at = str(broken)

    def compute(part):
        if os.path.exists(at) and 7 in part["id"].to_pylist():
            raise RuntimeError("busy")
        return part.append_column("v", pa.array([[1.0, 2.0]] * part.num_rows))

    todo = spark.range(20)
    failed = K.resume(spark, todo, cache, compute, 4)
    assert len(failed) == 1 and "busy" in failed[0][1] and 0 < cache.read().count() < 20
    with pytest.raises(ContractError, match="missing"):
        K.compacted(cache.read(), todo, "id", "v")
    broken.unlink()
    assert K.resume(spark, todo, cache, compute, 4) == [] and [r.id for r in K.compacted(cache.read(), todo, "id", "v").collect()] == list(range(20))
    with pytest.raises(ContractError, match="repeated"):
        K.compacted(cache.read().union(cache.read().limit(1)), todo, "id")

    def always(part):
        raise RuntimeError("down")

    assert len(K.resume(spark, spark.range(30, 60), cache, always, 10)) >= 2 and cache.read().count() == 20


def test_signatures_and_digests(spark, tmp_path):
    (tmp_path / "a.txt").write_text("abc")
    (r,) = K.signature_of(spark, [str(tmp_path / "a.txt")]).collect()
    assert (r.length, r.sha256) == (3, hashlib.sha256(b"abc").hexdigest())
    assert K.rules_digest({"b": 1, "a": [2]}) == hashlib.sha256(b'{"a":[2],"b":1}').hexdigest() == K.rules_digest({"a": [2], "b": 1})
    df = spark.createDataFrame([(2, "ab", "c"), (1, "a", "bc")], "i int, x string, y string")
    digest = lambda d: K.ordered_digest(d, ["x", "y"], F.col("i")).first()[0]
    many = spark.range(5000).select("id", F.col("id").cast("string").alias("x"), F.lit("q").alias("y"), (F.col("id") % 7).alias("i"))
    assert len({K.ordered_digest(d, ["x", "y"], F.col("i"), fan=16).first()[0] for d in (many, many.repartition(5), many.orderBy(F.desc("id")))}) == 1
    assert digest(many) != digest(many.where("id <> 77")) and digest(many.limit(0)) == hashlib.sha256(b"").hexdigest()
    assert digest(df) == digest(df.repartition(3)) != digest(df.withColumn("i", -F.col("i")))
    assert digest(df) != digest(spark.createDataFrame([(2, "a", "bc"), (1, "a", "bc")], "i int, x string, y string"))


def test_text_scans(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b,c\n1,"x\ny",q\n2,z,r\n')
    assert rows(S.read_text_csv(spark, str(tmp_path / "m.csv"), ["c", "b"])) == [("q", "x\ny"), ("r", "z")]
    (tmp_path / "f.csv").write_text("id,keep,junk\n1,TRUE,a\n2,no,b\n3, 1 ,c\n4,,d\n")
    assert rows(S.read_filtered_csv(spark, str(tmp_path / "f.csv"), "id int, keep string, junk string", "keep").select("id")) == [(1,), (3,)]
    (tmp_path / "t.tsv").write_text('id\tname\n1\t"quoted\n2\tx\n')
    assert rows(S.read_strict_tsv(spark, str(tmp_path / "t.tsv"), "id int, name string")) == [(1, '"quoted'), (2, "x")]
    (tmp_path / "w.tsv").write_text("id\tname\n1\ta\tb\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        S.read_strict_tsv(spark, str(tmp_path / "w.tsv"), "id int, name string").collect()


def test_exports_share_a_scan_by_header(spark, tmp_path):
    paths = []
    for i in range(6):
        paths.append(str(tmp_path / f"x {i}+.csv"))
        with open(paths[-1], "w") as f:
            f.write(f"{'UT,Title' if i % 2 else 'Article Title,ut'}\n" + "".join((f"{k},t{i}\n" if i % 2 else f"t{i},{k}\n") for k in (i, 100)))
    out = S.read_exports(spark, paths, {"ut": ["UT"], "title": ["Article Title"]}, "ut")
    assert rows(out) == sorted([("100", "t0"), *[(str(i), f"t{i}") for i in range(6)]], key=str)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2


def test_written_variants_batches_and_combinations(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", 'b"']), (2, None), (3, [])], "id long, l array<string>")
    S.write_variants(df, str(tmp_path / "v"))
    assert rows(spark.read.parquet(str(tmp_path / "v/parquet"))) == rows(df)
    assert rows(spark.read.option("escape", '"').csv(str(tmp_path / "v/csv"), header=True)) == [("1", '["a","b\\""]'), ("2", None), ("3", "[]")]
    whole, some = S.split_outputs(df, F.col("id") > 1, str(tmp_path / "w"), str(tmp_path / "s"))
    assert whole.count() == 3 and rows(some.select("id")) == [(2,), (3,)]
    out = S.combine([df, df.select("l", (F.col("id") + 10).alias("id"))], str(tmp_path / "c"), "id")
    assert out.count() == 6
    with pytest.raises(ContractError):
        S.combine([df, df], str(tmp_path / "d"), "id")
    assert not (tmp_path / "d").exists()
    manifest = S.write_batches(spark.range(25).select(F.col("id").cast("string").alias("custom_id")).coalesce(1), str(tmp_path / "b"), "custom_id", 10)
    assert manifest["requests"] == 25 and [f["n"] for f in manifest["files"]] == [10, 10, 5]
    assert json.loads(spark.read.text(str(tmp_path / "b/manifest")).first()[0]) == manifest
