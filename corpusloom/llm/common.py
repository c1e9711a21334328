"""Pieces shared by the training-data operators: table access, shared storage, components."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in the contracts that count `[^\x20\x09-\x0D]+`.
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of a file that one bitmap of chosen rows covers (4 KB), and the most bitmaps that are broadcast (64 MB); beyond that, texts are sought by a shuffle.
MAP_ROWS, MAX_MAPS = 32_768, 16_384
#: Other tables are broadcast up to so many rows of a few numbers each, beyond that joined by a shuffle.
MAX_SMALL = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as are needed for no column of df to bear it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != F.lit(""))


def count_words(text: Column) -> Column:
    """Number of words without building the word array."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(spaced, " \t\n\x0b\x0c\r", "")).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def crc_of(key: Column) -> Column:
    """crc32 of the key written as text; the folds of the classifiers rest on it."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where it is unset a local session gets a temporary one; a cluster session is refused, as a
    machine-local folder would not be seen by the other machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_local_dir()}"


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="corpusloom-")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut there, an executor
    that is lost takes nothing with it, and later reads are pruned to their columns. The files go
    when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of frames that materialize() made. Only for frames that nothing will read again:
    all that was derived from them has been written itself."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def numbered(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: a struct (f, i) that is each row's own, the hash of its file
    and its place there. Of a plain scan of Parquet these never change, whoever reads it again; any other
    frame is stored first."""
    plain = docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and docs.inputFiles()
    if not plain or "row_index" not in docs.select(docs.metadataColumn("_metadata")).schema[0].dataType.names:
        docs = materialize(docs, label)
    name = fresh(docs, "_row")
    at = docs.metadataColumn("_metadata")
    return docs.select("*", F.struct(F.xxhash64(at["file_path"]).alias("f"), at["row_index"].alias("i")).alias(name)), name


def rows_in(docs: DataFrame, row: str, wanted: DataFrame) -> DataFrame:
    """The rows of docs, from numbered(), whose column row is in wanted's only column. wanted travels as
    bitmaps, one bit a row of docs, so that texts need no shuffle; more than MAX_MAPS of them are not
    broadcast, and Spark chooses the join."""
    at = F.col(wanted.columns[0])
    bucket = lambda i: F.floor(i / MAP_ROWS)
    maps = materialize(
        wanted.select(at["f"].alias("_f"), bucket(at["i"]).alias("_b"), (at["i"] % MAP_ROWS).alias("_p"))
        .groupBy("_f", "_b").agg(F.bitmap_construct_agg("_p").alias("_bits")),
        "bitmaps",
    )
    if maps.count() > MAX_MAPS:
        return docs.join(wanted.select(at.alias("_wanted")), F.col(row) == F.col("_wanted"), "left_semi")
    whole = F.struct(*columns_of(docs)).alias("_doc")  # names may clash
    found = docs.select(whole, F.col(row)["f"].alias("_mf"), bucket(F.col(row)["i"]).alias("_mb"), (F.col(row)["i"] % MAP_ROWS).alias("_mp"))
    place = F.col("_mp")
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    has = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1
    return found.join(F.broadcast(maps), (F.col("_mf") == F.col("_f")) & (F.col("_mb") == F.col("_b"))).where(has).select("_doc.*")


def small(df: DataFrame, label: str) -> DataFrame:
    """df, stored, marked for broadcast if it has no more than MAX_SMALL rows."""
    df = materialize(df, label)
    return F.broadcast(df) if df.count() <= MAX_SMALL else df


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds; each node hangs under a smaller one, until
    nothing moves. A star's centre may be hot: its minimum is aggregated map-side first, and the
    join that hands the minimum out can be split by adaptive execution. Nothing is collected but
    two numbers a round.
    """
    spark = edges.sparkSession
    now = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    if now.isEmpty():
        kind = edges.schema["a"].dataType
        return spark.createDataFrame([], "node long, component long").select(
            F.col("node").cast(kind), F.col("component").cast(kind)
        )
    seen = None
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every (u, v) here has v < u; u hangs its smaller neighbours under the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, materialize(hung.union(least.select("u", F.col("m").alias("v"))).distinct(), "star")
        release(before)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
