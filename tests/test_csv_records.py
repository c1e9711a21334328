"""Split CSV scans against whole ones, cut at every byte."""

import random
from types import SimpleNamespace

import pyarrow as pa
import pytest

from corpusloom.sources import csv_records as C
from corpusloom.sources import files as S

PLAIN = 'a,b,c\n1,"x\ny",2\n"q""q\n\n,""",3,\n4,,"5"\n6,5" tall,"7\r\n8"\n\n9,"",z\n10,é,"ü\nö,"\n,,\n11,only\n12,"end, ""open""\nlast",x'


@pytest.fixture()
def cut(spark):
    """Splits of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def to(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
        spark.conf.set(names[2], "1")

    yield to
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def whole(spark, path):
    return [tuple(r) for r in spark.read.option("multiLine", True).option("escape", '"').csv(path, header=True).collect()]


def split(spark, path):
    n = len(C.header(spark, path))
    out = C.read_records(spark, [path]).where("not (block = 0 and n = 0)").orderBy("block", "n")
    return [tuple(r.x) for r in out.select(C.fields(out.record, n).alias("x")).collect()]


def parsed(text):
    """Whether quotes are open after each line that a file of CSV begins outside of, or within, quotes: letter by letter."""
    out = []
    for state in ("start", "quoted"):
        for c in text:
            if state == "quoted":
                state = "closed?" if c == '"' else "quoted"
            elif state == "closed?" and c == '"':
                state = "quoted"
            elif c in ",":
                state = "start"
            elif state == "start":
                state = "quoted" if c == '"' else "plain"
            elif state == "closed?":
                state = "plain"
        out.append(state == "quoted")
    return out


def put_together(text, cuts):
    """The records of a text in splits of so many bytes each, by the functions that tasks and driver run."""
    lines, at, size = [], 0, len(text.encode())
    bounds = [0, *cuts, size]
    for line in text.split("\n"):
        if at < size:  # a split has the lines that begin in it
            lines.append(("f", max(b for b in bounds if b <= at), line, *parsed(line.rstrip("\r"))))
        at += len(line.encode()) + 1
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*lines[k : k + 3])], names=["file", "block", "value", "first", "within"]) for k in range(0, len(lines), 3)]
    own = lambda blocks: [b.filter(pa.array([x in blocks for x in b.column("block").to_pylist()])) for b in batches]
    tasks = [own(bounds[k::3]) for k in range(3)]  # a task has several splits
    found = [SimpleNamespace(**r) for t in tasks for b in C._summaries(iter(t)) for r in b.to_pylist()]
    entered = C._entered([vars(r) for r in found])
    rows = [r for t in tasks for b in C._records(entered)(iter(t)) for r in b.to_pylist()]
    whole = {(r["block"], r["n"]): r["record"] for r in rows if r["piece"] == -1}
    for block in {r["block"] for r in rows if r["piece"] != -1}:
        pieces = sorted((r["piece"], r["n"], r["record"]) for r in rows if r["block"] == block and r["piece"] != -1)
        whole[block, max(p[1] for p in pieces)] = "\n".join(p[2] for p in pieces)
    return [v.removesuffix("\r") for _, v in sorted(whole.items())]


def records(text):
    out, held = [], []
    for line in text.split("\n"):
        held.append(line)
        if not parsed("\n".join(held).replace("\r\n", "\n"))[0]:
            out, held = out + ["\n".join(held).removesuffix("\r")], []
    return [r for r in [*out, *(["\n".join(held)] if held else [])] if r]


def test_one_cut_at_every_byte_and_many_cuts():
    rng = random.Random(1)
    size = len(PLAIN.encode())
    want = records(PLAIN)
    assert len(want) == 10 and put_together(PLAIN, []) == want
    for cut in range(1, size):
        assert put_together(PLAIN, [cut]) == want, cut
    assert put_together(PLAIN, list(range(1, size))) == want
    for _ in range(300):
        assert put_together(PLAIN, sorted(rng.sample(range(1, size), rng.randrange(2, 12)))) == want


def test_cuts_at_every_byte(spark, tmp_path, cut):
    path = str(tmp_path / "t.csv")
    with open(path, "w", newline="") as f:
        f.write(PLAIN)
    want = whole(spark, path)
    assert len(want) == 9
    for size in (1, 3, 8, 21, 55):
        cut(size)
        assert split(spark, path) == want, size


def test_lines_that_end_in_both_ways(spark, tmp_path, cut):
    path = str(tmp_path / "t.csv")
    with open(path, "w", newline="") as f:
        f.write('a,b\r\n1,"x\r\ny"\r\n"2",\r\n3,z\n4,"é"\n')
    for size in (3, 5, 11, 100):
        cut(size)
        assert split(spark, path) == [("1", "x\r\ny"), ("2", None), ("3", "z"), ("4", "é")]


def test_random_files(spark, tmp_path, cut):
    rng = random.Random(4)
    for k in range(3):
        cell = lambda: '"' + "".join(rng.choice(['a', ",", "\n", '""', "é", " ", "\r\n"]) for _ in range(rng.randrange(12))) + '"' if rng.random() < 0.5 else "".join(rng.choice("ab 'c") for _ in range(rng.randrange(5)))
        text = "x,y,z\n" + "".join(f"{i},{cell()},{cell()}\n" for i in range(60))
        path = str(tmp_path / f"{k}.csv")
        with open(path, "w", newline="") as f:
            f.write(text)
        want = whole(spark, path)
        for size in (20, 300):
            cut(size)
            assert split(spark, path) == want


def test_records_over_many_splits_and_open_quotes(spark, tmp_path, cut):
    path = str(tmp_path / "t.csv")
    with open(path, "w", newline="") as f:
        f.write('a,b\n1,"' + "line\n" * 200 + '"\n2,"' + "more\n" * 300 + '",x\n3,"never closed\n4,5\n')
    cut(50)
    out = C.read_csv(spark, path)
    assert out.rdd.getNumPartitions() > 10
    rows = {r.a: r.b for r in out.collect()}
    assert rows["1"] == "line\n" * 200 and rows["2"] == "more\n" * 300 and set(rows) == {"1", "2", "3"}


def test_readers_use_splits(spark, tmp_path, cut):
    for name, head in (("a", "ID,Title,Flag"), ("b", "id,title,flag"), ("c", "id,Flag,other")):
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            f.write(f"{head}\n" + "".join(f'{name}{i % 7},"t\n{i}",{i % 2 == 0}\n' for i in range(20)))
    cut(40)
    a = str(tmp_path / "a.csv")
    assert [r[0] for r in S.read_text_csv(spark, a, ["Title"]).collect()].count("t\n3") == 1
    assert S.read_text_csv(spark, a).columns == ["ID", "Title", "Flag"]
    kept = S.read_filtered_csv(spark, a, "id string, title string, flag boolean", "flag").collect()
    assert len(kept) == 10 and {r.title for r in kept} == {f"t\n{i}" for i in range(0, 20, 2)}
    out = S.read_exports(spark, [str(tmp_path / f"{n}.csv") for n in "abc"], {"id": [], "title": [], "flag": []}, "id").collect()
    assert len(out) == 21 and {(r.id, r.title) for r in out if r.id[0] == "a"} == {(f"a{i}", f"t\n{i}") for i in range(7)}
    with pytest.raises(ValueError, match="unknown"):
        S.read_text_csv(spark, a, ["nothing"])


def test_empty_files(spark, tmp_path):
    for text, n in (("a,b\n", 0), ("a,b", 0), ("\na,b\n1,2\n", 1)):
        (tmp_path / "t.csv").write_text(text)
        assert C.read_csv(spark, str(tmp_path / "t.csv")).count() == n
