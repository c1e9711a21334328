"""CSV files whose fields hold line breaks, read by as many tasks as they have splits.

A file is read as lines. From each of two states, outside a quoted field and within one, a line leads to one
of them; a split's lines make one map of the two states. These maps, one a split, are composed in the order
of splits, which tells in which state each split begins. Then every split puts its lines together to
records from its first true beginning of a record on; a record that runs on into later splits is joined from its
pieces, two a split at most.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _line_map(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line ends within quotes: if it begins outside of them, and if it begins within."""
    s = re.escape(sep)
    inside = r'(?>[^"]++|"")*+'
    field = rf'(?:"{inside}"[^{s}]*+|[^"{s}][^{s}]*+|)'  # whole; a quote within a plain field is a character
    opens = rf'(?:{field}{s})*+"{inside}\z'
    return line.rlike(rf"\A{opens}"), line.rlike(rf'\A{inside}(?:"[^{s}]*+{s}{opens}|\z)')


def _lines(spark: SparkSession, paths: Sequence[str], sep: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    # a line's own end is not the field's
    first, within = _line_map(F.rtrim("value", F.lit("\r")), sep)
    return raw.select("file", "block", "value", first.alias("first"), within.alias("within"))


def _cuts(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """Stretches of rows of one split."""
    block, file = batch.column("block").to_numpy(), batch.column("file").dictionary_encode().indices.to_numpy()
    at = [0, *(np.nonzero((np.diff(block) != 0) | (np.diff(file) != 0))[0] + 1).tolist(), batch.num_rows]
    return [(lo, hi) for lo, hi in zip(at, at[1:]) if hi > lo]


def _after(first: np.ndarray, within: np.ndarray, begins: bool) -> np.ndarray:
    """Whether quotes are open after each line, by whether they were before the first."""
    n = np.arange(1, len(first) + 1)
    sets, flips = first == within, first & ~within
    last = np.maximum.accumulate(np.where(sets, n, 0))  # the last line that leads to one state from both
    flipped = np.concatenate([[0], np.cumsum(flips)])
    base = np.where(last > 0, first[np.maximum(last, 1) - 1], begins)
    return base ^ ((flipped[n] - flipped[last]) % 2 == 1)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, first, within: where a split leads to; closes: whether a record in which it begins ends in it."""
    at, ends, closes = None, [False, True], False

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": at[0], "block": at[1], "first": ends[0], "within": ends[1], "closes": closes}])

    for batch in batches:
        for lo, hi in _cuts(batch):
            here = batch.column("file")[lo].as_py(), batch.column("block")[lo].as_py()
            if at != here:
                if at is not None:
                    yield told()
                at, ends, closes = here, [False, True], False
            first, within = (batch.column(n).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for n in ("first", "within"))
            after = [_after(first, within, e) for e in ends]
            closes, ends = closes or not after[1].all(), [bool(a[-1]) for a in after]
    if at is not None:
        yield told()


def _entered(found: Sequence) -> dict[tuple[str, int], int]:
    """The splits (file, block) that begin within a record, and the block in which that one begins, of all splits' summaries."""
    entered: dict[tuple[str, int], int] = {}
    state, began, file = False, 0, None
    for r in sorted(found, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, state = r["file"], False
        if state:
            entered[(r["file"], r["block"])] = began
        if not state or r["closes"]:  # what is open at its end began in it
            began = r["block"]
        state = r["within"] if state else r["first"]
    return entered


def _records(entered: dict[tuple[str, int], int]) -> Callable:
    """file, block, n, piece, record: whole records (piece is -1) and pieces of records that cross splits, with the split
    in which they begin and their number there. entered: splits that begin within a record, and where that one begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_, held, n, owner = None, False, [], 0, None
        names = ["file", "block", "n", "piece", "record"]

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

        def rest() -> list[tuple]:
            """What is left at a split's end: the first lines of a record, or all lines of a split within one."""
            return [(at[0], owner[0], owner[1], at[1], "\n".join(held))] if held else []

        for batch in batches:
            out = []
            for lo, hi in _cuts(batch):
                here = batch.column("file")[lo].as_py(), batch.column("block")[lo].as_py()
                if at != here:
                    out += rest()
                    at, held, n = here, [], 0
                    open_ = here in entered
                    owner = (entered[here], -1) if open_ else (here[1], 0)
                first, within = (batch.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in ("first", "within"))
                after = _after(first, within, open_)
                values = batch.column("value").slice(lo, hi - lo).to_pylist()
                ends = np.nonzero(~after)[0].tolist()
                start = 0
                for end in ends:
                    lines = values[start : end + 1]
                    if held:
                        lines, held = held + lines, []
                    text = lines[0] if len(lines) == 1 else "\n".join(lines)
                    if owner[1] < 0:  # the end of a record of an earlier split
                        out.append((at[0], owner[0], -1, at[1], text))
                    elif text not in ("", "\r"):
                        out.append((at[0], at[1], n, -1, text))
                        n += 1
                    owner = (at[1], n)
                    start = end + 1
                held += values[start:]
                open_ = bool(after[-1])
            if out:
                yield rows(out)
        if at is not None and (left := rest()):
            yield rows(left)

    return run


def read_records(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> DataFrame:
    """file, block, n, record: the records of CSV files, in the order of block and n; their text as it stands, without the
    line's end. Fields may be quoted, with quotes doubled in them. Empty lines are no records.

    Where quotes are never closed, all that follows is one record, and one cell. The driver holds two bits a split."""
    lines = _lines(spark, paths, sep)
    found = lines.select("file", "block", "first", "within").mapInArrow(_summaries, "file string, block long, first boolean, within boolean, closes boolean").collect()  # a row a split
    entered = _entered(found)
    kinds = "file string, block long, n long, piece long, record string"
    out = lines.mapInArrow(_records(entered), kinds)
    whole = out.where("piece = -1").select("file", "block", "n", "record")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "record"))), lambda p: p["record"]), "\n")
    joined = out.where("piece <> -1").groupBy("file", "block").agg(F.max("n").alias("n"), text.alias("record"))
    both = whole.unionByName(joined) if entered else out.select("file", "block", "n", "record")
    return both.withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The names of a CSV file's columns, as Spark gives them; the file's beginning is read."""
    return spark.read.option("multiLine", True).option("escape", '"').csv(path, header=True, sep=sep).columns


def fields(record: Column, n: int, sep: str = ",") -> Column:
    """The n fields c0, c1, ... of a record, as strings; missing ones are null."""
    return F.from_csv(record, ", ".join(f"c{i} string" for i in range(n)), {"sep": sep, "escape": '"', "multiLine": "true"})


def read_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, sep: str = ",", schema: StructType | str | None = None) -> DataFrame:
    """CSV files with one header as a table; all columns, or the wanted ones, as strings, or as schema has them in turn."""
    paths = [path] if isinstance(path, str) else list(path)
    names = header(spark, paths[0], sep)
    body = read_records(spark, paths, sep).where("not (block = 0 and n = 0)")
    if schema is not None:
        return body.select(F.from_csv("record", schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">"), {"sep": sep, "escape": '"', "multiLine": "true"}).alias("r")).select("r.*")
    wanted = names if columns is None else list(columns)
    if unknown := [c for c in wanted if c not in names]:
        raise ValueError(f"unknown columns {unknown}")
    return body.select(fields(F.col("record"), len(names), sep).alias("r")).select(*[F.col("r")[f"c{names.index(c)}"].alias(c) for c in wanted])
