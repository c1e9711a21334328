"""Row numbers of scans, bitmaps of chosen rows, and the stages that rest on them."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat_format, common, jaccard_join, license_scan, mixing, quality_rules

DOCS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    """Documents in several files, with columns of the names used inside, and a repeated row."""
    docs = spark.read.parquet(DOCS)
    docs = docs.unionByName(docs.limit(1)).withColumns({"_row": F.lit("x"), "_doc": F.lit(1), "shard": F.lit(2), "sid": F.lit("s"), "block": F.lit(None).cast("int"), "a.b": F.lit(3)})
    path = os.path.join(str(tmp_path_factory.mktemp("clash")), "docs")
    docs.repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("derived", [False, True])
@pytest.mark.parametrize("maps", [common.MAX_MAPS, 0])
def test_rows_in_takes_each_wanted_row_once(monkeypatch, clashing, derived, maps):
    monkeypatch.setattr(common, "MAX_MAPS", maps)
    docs = clashing.where("true or doc_id > 0").union(clashing.limit(0)) if derived else clashing
    rows, row = common.numbered(docs, "t")
    assert row not in docs.columns
    assert rows.select(row).distinct().count() == docs.count()
    wanted = rows.where("doc_id % 3 = 1").select(row)
    got = common.rows_in(rows, row, wanted).select(*[F.col(f"`{c}`") for c in docs.columns])
    expect = docs.where("doc_id % 3 = 1")
    assert got.count() == expect.count() and got.exceptAll(expect).count() == 0
    assert common.rows_in(rows, row, wanted.limit(0)).count() == 0


def test_plain_scans_are_not_stored(clashing):
    plan = common.numbered(clashing, "t")[0]._jdf.queryExecution().analyzed().toString()
    assert "corpusloom/" not in plan


def test_stages_take_clashing_columns(clashing):
    docs = clashing
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    n = {r.component_id for r in jaccard_join.jaccard_components(docs).where("n_shingles > 0").collect()}
    assert {r.doc_id for r in kept.collect()} >= n
    verdicts = {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
    ruled = quality_rules.apply_quality_rules(docs)
    assert ruled.columns == docs.columns and {r.doc_id for r in ruled.collect()} == verdicts
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    m = mixing.mix(docs)
    drawn = {r.doc_id: r.n for r in m.draws.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(found.values()) == pytest.approx(sum(drawn.values()), abs=2)
    assert mixed.exceptAll(mixing.apply_mix(docs)).count() == 0


def test_very_long_texts_and_lines(spark):
    """One line of 150,000 words, a text of 30,000 lines, and a word of a million letters."""
    line, many, word = " ".join(f"w{i % 70_000}" for i in range(150_000)), "\n".join(f"line{i} of{i} this{i} long{i} text{i}" for i in range(30_000)), "x" * 1_000_000
    docs = spark.createDataFrame([(1, line, "en", "a", 1), (2, many, "en", "a", 1), (3, word, "en", "a", 1), (4, "short text", "en", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    rules = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert (rules[1].n_words, rules[2].n_words, rules[3].word_chars) == (150_000, 150_000, 1_000_000) and rules[1].base_failed and rules[2].n_dup_lines == 0 and not rules[2].base_failed
    assert {r.doc_id for r in quality_rules.apply_quality_rules(docs).collect()} == {2}
    mixed = mixing.mix(docs)
    assert {r.doc_id: r.size for r in mixed.documents.collect()} == {1: 150_000, 2: 150_000, 3: 1, 4: 2}
    assert {r.doc_id: r.n_words for r in license_scan.scan_licenses(docs).collect()}[2] == 150_000


def test_very_many_turns_of_one_number(spark):
    rows = [(1, 5, ("a", "b")[i % 2], f"t{i:05d}") for i in range(3000)] + [(1, None, "a", "first")]
    out = chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block_turns=8).collect()
    for view in "ab":
        own = sorted((r.start, r.length) for r in out if r.perspective == view)
        assert len(own) == 3001 and own[0][0] == 0 and all(s + n == t for (s, n), (t, _) in zip(own, own[1:]))
