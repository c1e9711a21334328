"""Scans and sinks of files: exports, JSON lines, tables with manifests."""

from __future__ import annotations

import functools
import json
import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.sources.csv_records import fields, header, read_csv, read_records


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="corpusloom-")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir, whose files go when the application ends. Local sessions may do
    without the setting; a cluster may not."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{_local_dir()}"
    path = f"{folder.rstrip('/')}/corpusloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)  # it has to be there
    return f"{path}/data"


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: what depends on sampled ranges or on row places must not change
    between reads."""
    path = scratch(df.sparkSession, "staged")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_exports(spark: SparkSession, paths: Sequence[str], variants: Mapping[str, Sequence[str]], key: str, sep: str = ",") -> DataFrame:
    """CSV exports with differing headers as one table of strings, one row per key.

    variants: names that each column may have, in any case; a column no file has is null. Of a key's rows
    the one of the first file and place stays; rows without a key go. Headers are read by tasks, and files
    with one header are one scan, so the plan has a branch per kind of header."""
    if not paths:
        raise ValueError("no paths")
    heads = spark.read.option("lineSep", "\n").text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value")
    first = heads.where("b = 0").groupBy("file").agg(F.min_by("value", "i").alias("head"))
    order = {p: n for n, p in enumerate(paths)}
    kinds: dict[str, list[str]] = {}
    known = {_bare(r["file"]): r["head"] for r in first.collect()}  # a header per file
    for path in paths:
        kinds.setdefault((known.get(_bare(path)) or "").lstrip("\ufeff").rstrip("\r").strip().lower(), []).append(path)
    number = F.create_map(*[F.lit(x) for p, n in order.items() for x in (_bare(p), n)])
    out: DataFrame | None = None
    for same in kinds.values():
        columns = header(spark, same[0], sep)
        named = {c.strip().lstrip("\ufeff").lower(): i for i, c in reversed(list(enumerate(columns)))}
        at = {want: next((named[v.lower()] for v in (want, *others) if v.lower() in named), None) for want, others in variants.items()}
        raw = read_records(spark, same, sep).where("not (block = 0 and n = 0)").select(fields(F.col("record"), len(columns), sep).alias("r"), "file", "block", "n")
        file = F.regexp_replace(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/+", "/")
        one = raw.select(*[(F.lit(None).cast("string") if i is None else F.col("r")[f"c{i}"]).alias(want) for want, i in at.items()], F.element_at(number, file).alias("_file"), F.struct("block", "n").alias("_at"))
        out = one if out is None else out.unionByName(one)
    held = out.where(F.length(F.trim(F.coalesce(F.col(key), F.lit("")))) > 0)
    best = held.groupBy(key).agg(F.min_by(F.struct(*[c for c in variants if c != key]), F.struct("_file", "_at")).alias("_v")) if len(variants) > 1 else held.select(key).distinct()
    return best.select(*[F.col(key) if c == key else F.col("_v")[c].alias(c) for c in variants])


def _bare(path: str) -> str:
    """A path without its scheme, as file names are compared."""
    return re.sub("^[a-z0-9]+:/+", "/", unquote(path))


def read_text_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV file whose fields may hold line breaks, the wanted columns as strings; a task a split."""
    return read_csv(spark, path, columns)


def split_outputs(df: DataFrame, test: Column, whole: str, some: str) -> tuple[DataFrame, DataFrame]:
    """df written as a whole, and the rows that pass the test written from that copy: the source is read once."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(whole)
    stored = df.sparkSession.read.schema(df.schema).parquet(whole)
    stored.where(test).write.mode("overwrite").option("compression", "zstd").parquet(some)
    return stored, df.sparkSession.read.schema(df.schema).parquet(some)


def write_variants(df: DataFrame, path: str) -> None:
    """A table twice: Parquet with its lists at path/parquet, CSV with lists as JSON text at path/csv, from one pass over
    df."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/parquet")
    write_csv(df.sparkSession.read.schema(df.schema).parquet(f"{path}/parquet"), f"{path}/csv")


def combine(parts: Sequence[DataFrame], path: str, key: str) -> DataFrame:
    """Tables of the same columns in one, written only if no key is in two rows; nothing is left at path otherwise."""
    from corpusloom.operators.contracts import assert_unique_key

    out = parts[0]
    for p in parts[1:]:
        if sorted(p.columns) != sorted(out.columns):
            raise ValueError(f"columns differ: {sorted(set(p.columns) ^ set(out.columns))}")
        out = out.unionByName(p)
    assert_unique_key(out, key, "combined table")
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return parts[0].sparkSession.read.schema(out.schema).parquet(path)


def write_batches(requests: DataFrame, path: str, key: str, per_file: int) -> dict:
    """Request lines (a JSON object a row) in files of at most per_file, and a manifest of files and their rows."""
    write_jsonl(requests, f"{path}/requests", per_file)
    spark = requests.sparkSession
    counts = spark.read.text(f"{path}/requests").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min(F.get_json_object("value", f"$.{key}")).alias("first"))
    rows = sorted((r["file"], r["n"], r["first"]) for r in counts.collect())  # a row per file
    manifest = {"requests": sum(n for _, n, _ in rows), "files": [{"file": f, "n": n, "first": k} for f, n, k in rows]}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_filtered_csv(spark: SparkSession, path: str, schema: StructType | str, flag: str) -> DataFrame:
    """Rows whose flag is true, 1 or yes; a task a split."""
    return read_csv(spark, path, schema=schema).where(F.lower(F.trim(F.col(flag).cast("string"))).isin("true", "1", "yes"))


def read_strict_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated, nothing quoted, any width of field; a row of another number of fields fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("quote", "").option("maxCharsPerColumn", -1).option("enforceSchema", False).csv(path, sep="\t", header=True)


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """These columns in this order; unknown or repeated names are an error."""
    unknown, repeated = [c for c in columns if c not in df.columns], sorted({c for c in columns if list(columns).count(c) > 1})
    if unknown or repeated:
        raise ValueError(f"unknown columns {unknown}, repeated columns {repeated}")
    return df.select(*columns)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fields of schema, with file, line (order within the file) and valid; a broken line has null fields."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    parsed = raw.where(F.length(F.trim("value")) > 0).withColumn("_j", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    names = [f.name for f in parsed.schema["_j"].dataType.fields if f.name != "_bad"]
    return parsed.select(*[F.col(f"_j.{n}") for n in names], "file", "line", (F.col("_j").isNotNull() & F.col("_j._bad").isNull()).alias("valid"))


def retry_rank(file: Column) -> Column:
    """0 for an original file, n for `...retry-n...` or `...retryn...`; retries come later."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(file, r"retry[-_]?(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))


def latest_valid(records: DataFrame, key: str) -> DataFrame:
    """Of each key's records the last valid one: originals, then retries by number, then by line. A broken
    record never replaces a good one. The pick is a max, so it combines before the shuffle."""
    order = F.struct(retry_rank(F.col("file")), F.col("file"), F.col("line"))
    columns = [c for c in records.columns if c not in (key, "valid")]
    best = records.where("valid").groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_v"))
    return best.select(key, *[F.col("_v")[c].alias(c) for c in columns])


def read_hierarchy(spark: SparkSession, path: str, record: str, levels: Sequence[str] = ("region", "subregion")) -> DataFrame:
    """Rows of a JSON document of nested maps down to lists of records: a column per level, then the
    record's fields. The document is one value, so it has to be small."""
    kind = f"array<struct<{record}>>"
    for _ in levels:
        kind = f"map<string,{kind}>"
    out = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("_v"))
    held: list[str] = []
    for level in levels:
        out = out.select(*held, F.explode("_v").alias(level, "_v"))
        held.append(level)
    return out.select(*held, F.inline("_v"))


def lists_to_text(df: DataFrame) -> DataFrame:
    """df with list, map and struct columns as JSON text, for files that hold text only."""
    nested = ("array", "map", "struct")
    return df.select(*[F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with lists as JSON text; white space at the ends of values stays."""
    out = lists_to_text(df).write.mode("overwrite").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    out.csv(path, header=True)


def write_jsonl(df: DataFrame, path: str, per_file: int = 0) -> None:
    """A JSON object per line; at most per_file in a file if that is set."""
    out = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite")
    (out.option("maxRecordsPerFile", per_file) if per_file else out).text(path)


def write_with_manifest(df: DataFrame, path: str, version: int, note: Mapping | None = None) -> dict:
    """df as Parquet at path/data with path/manifest: version, schema, rows and an order-free digest."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/data")
    manifest = {"version": version, **_facts(df.sparkSession.read.parquet(f"{path}/data")), **(note or {})}
    df.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_with_manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The table of write_with_manifest; another version, schema, count or content is an error."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    df = spark.read.parquet(f"{path}/data")
    now = {"version": version, **_facts(df)}
    wrong = [k for k, v in now.items() if manifest.get(k) != v]
    if wrong:
        raise ValueError(f"{path} differs from its manifest in {', '.join(wrong)}")
    return df


def _facts(df: DataFrame) -> dict:
    text = F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns]), {"ignoreNullFields": "false"})
    n, digest = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(text).cast("decimal(38,0)")), F.lit(0))).first()
    return {"schema": df.schema.simpleString(), "rows": n, "digest": str(digest)}


def numbered_parts(df: DataFrame, year: str, key: str, size: int) -> DataFrame:
    """df with part: a year's rows in parts of size rows, the latest key first. They are numbered within ranges of the key,
    so no task needs a year as a whole."""
    ranged = staged(df.repartitionByRange(F.col(year), F.desc(key)).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy(year, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col(year).alias("_y"), F.col("_p").alias("_q"), (F.sum("_n").over(W.partitionBy(year).orderBy("_p")) - F.col("_n")).alias("_b"))
    r = F.row_number().over(W.partitionBy(year, "_p").orderBy(F.desc(key)))
    placed = ranged.withColumn("_r", r).join(before, F.col(year).eqNullSafe(F.col("_y")) & (F.col("_p") == F.col("_q")))
    return placed.withColumn("part", F.ceil((F.col("_b") + F.col("_r")) / size).cast("long")).drop("_p", "_q", "_y", "_r", "_b")


def write_numbered_parts(df: DataFrame, path: str, year: str, key: str, size: int) -> None:
    """Files by year and part, as numbered_parts() has them."""
    numbered_parts(df, year, key, size).write.mode("overwrite").partitionBy(year, "part").parquet(path)
