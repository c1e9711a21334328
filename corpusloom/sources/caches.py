"""Keyed caches and resumable builds as versioned Parquet tables.

A cache's rows lie in buckets of their keys. An upsert rewrites the buckets that it touches, beside the old
files, and then publishes a version that points to them; a reader sees a whole version, and a write that fails
at any step leaves the last one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators.contracts import ContractError
from corpusloom.sources.commits import VersionConflict, Versions
from corpusloom.sources.files import staged

#: Versions that stay readable, and for how many seconds files that no version points to are left alone, as
#: another writer may be about to publish them.
KEPT_VERSIONS, GRACE_SECONDS = 2, 3600.0


class KeyedCache:
    """Rows by key in the folder at path, under a signature (a mapping, such as the version of rules): a cache with another
    signature is empty. All writers of a cache have to name the same number of buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: Sequence[str], signature: Mapping | None = None, buckets: int = 64):
        self.spark, self.path, self.keys, self.signature, self.buckets = spark, path.rstrip("/"), list(keys), dict(signature or {}), buckets
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        self.versions = Versions(spark, self.path)
        self.grace = GRACE_SECONDS

    def _state(self) -> tuple[int, dict[str, str]]:
        """The last version's number, and the folder of each bucket that has rows."""
        number, said = self.versions.latest()
        if said is None or said["signature"] != self.signature:
            return number, {}
        if said["buckets"] != self.buckets:
            raise ValueError(f"{self.path} has {said['buckets']} buckets")
        return number, said["folders"]

    def _read(self, folders: Mapping[str, str]) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self._state()[1])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def misses(self, wanted: DataFrame) -> DataFrame:
        """The keys of wanted that the cache lacks, each once."""
        return wanted.select(*self.keys).distinct().join(self.read().select(*self.keys), self.keys, "left_anti")

    def upsert(self, rows: DataFrame, *newest: Column, attempts: int = 5) -> list[int]:
        """Rows take the place of those with their keys; of several with one key the first by newest stays. The buckets
        that were rewritten. Where another writer was faster, its version is built upon."""
        rest = [c for c in self.schema.names if c not in self.keys]
        order = F.struct(*newest) if newest else F.struct(F.xxhash64(*self.schema.names))
        one = rows.select(*self.schema.names).groupBy(*self.keys).agg(F.min_by(F.struct(*rest), order).alias("_v")).select(*self.keys, *[F.col("_v")[c].alias(c) for c in rest])
        fresh = staged(one)
        touched = sorted(r[0] for r in fresh.select(self._bucket()).distinct().collect())  # buckets at most
        for attempt in range(attempts):
            number, folders = self._state()
            kept = self._read({b: f for b, f in folders.items() if int(b) in touched}).join(fresh.select(*self.keys), self.keys, "left_anti")
            try:
                self._publish(number, {**folders, **self._write(kept.unionByName(fresh), touched)})
                return touched
            except VersionConflict:
                if attempt == attempts - 1:
                    raise
        return touched

    def replace(self, rows: DataFrame) -> None:
        """These rows and no others; keys must not repeat."""
        fresh = staged(rows.select(*self.schema.names))
        touched = [r[0] for r in fresh.select(self._bucket()).distinct().collect()]
        self._publish(self._state()[0], self._write(fresh, touched))

    def _write(self, rows: DataFrame, touched: Sequence[int]) -> dict[str, str]:
        if not touched:
            return {}
        folder = f"u-{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket()).repartition(min(len(touched), self.buckets), "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/data/{folder}")
        return {str(b): folder for b in touched}

    def _publish(self, number: int, folders: Mapping[str, str]) -> None:
        self.versions.publish(number + 1, {"signature": self.signature, "buckets": self.buckets, "folders": dict(folders)})
        self._clean()

    def _clean(self) -> None:
        self.versions.forget(KEPT_VERSIONS)
        used = {f for n in self.versions.numbers() for f in self.versions.read(n)["folders"].values()}
        for folder, age in self.versions.folders("data").items():
            if folder not in used and age >= self.grace:
                self.versions.delete(f"data/{folder}")

    def look_up(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """wanted's keys with the cache's rows; what it lacks is computed and kept first."""
        missing = self.misses(wanted)
        if not missing.isEmpty():
            self.upsert(compute(missing))
        return wanted.join(self.read(), self.keys, "left")


def resume(spark: SparkSession, todo: DataFrame, done: KeyedCache, compute: Callable[[pa.Table], pa.Table], shard_rows: int = 10_000) -> list[tuple[int, str]]:
    """Work off what of todo the cache lacks, in shards of about shard_rows by a hash of the keys, all in one job. compute
    makes a shard's rows (the cache's columns) of its keys, in a task. A shard that fails is told of and left to
    the next run; the others are kept."""
    missing = staged(done.misses(todo))
    shards = max(1, -(-missing.count() // shard_rows))
    names, kinds = done.schema.names, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in done.schema.fields)
    like = done.read().limit(0).toArrow().schema

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        shard, error = key[0].as_py(), None
        try:
            out = compute(rows.drop_columns(["_shard"])).select(names).cast(like)
        except Exception as e:  # noqa: BLE001  any failure is the shard's
            out, error = like.empty_table(), f"{type(e).__name__}: {str(e)[:200]}"
        if error is not None:
            out = pa.table([pa.nulls(1, f.type) for f in like], names=names)
        return out.append_column("_shard", pa.array([shard] * out.num_rows, pa.int64())).append_column("_error", pa.array([error] * out.num_rows, pa.string()))

    found = staged(missing.withColumn("_shard", F.pmod(F.xxhash64(*done.keys, F.lit(shards)), F.lit(shards))).groupBy("_shard").applyInArrow(run, f"{kinds}, _shard long, _error string"))
    failed = sorted(map(tuple, found.where("_error is not null").select("_shard", "_error").collect()))  # a row a failed shard
    done.upsert(found.where("_error is null").drop("_shard", "_error"))
    return failed


def compacted(shards: DataFrame, expected: DataFrame, key: str, vector: str | None = None) -> DataFrame:
    """The shards' rows as one table in the order of keys, after checks: no key twice, none missing or unknown, vectors of
    one length."""
    twice = shards.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    missing = expected.select(key).join(shards.select(key), key, "left_anti").limit(5).collect()
    unknown = shards.select(key).join(expected.select(key), key, "left_anti").limit(5).collect()
    bad = [f"{what}: {[r[0] for r in rows]}" for what, rows in (("repeated", twice), ("missing", missing), ("unknown", unknown)) if rows]
    if vector:
        lengths = [r[0] for r in shards.select(F.size(vector).alias("n")).distinct().limit(3).collect()]
        bad += [f"vectors of lengths {lengths}"] if len(lengths) > 1 else []
    if bad:
        raise ContractError("; ".join(bad))
    return shards.repartitionByRange(key).sortWithinPartitions(key)


def signature_of(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, length, modified, sha256 of files, read where they lie."""
    out = None
    for path in paths:
        one = spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no paths")
    return out


def rules_digest(rules) -> str:
    """sha256 of rules as canonical JSON."""
    import hashlib

    return hashlib.sha256(json.dumps(rules, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def ordered_digest(df: DataFrame, columns: Sequence[str], *order: Column, fan: int = 1024, levels: int | None = None) -> DataFrame:
    """digest: of each row's values with their lengths in front, and of the rows in order.

    Rows are numbered in ranges of the order, and their digests are digested by fan neighbours again and again until one
    is left: the same at any partitioning, and no task or row holds more than fan of them. With levels the last of so
    many is over all that are left, as a format may fix: with two, one row holds 64 bytes for every fan rows. Equal places
    in the order are told apart by the rows' digests."""
    if levels is not None and levels < 1:
        raise ValueError(f"levels is {levels}")
    parts = [F.concat(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    rows = df.select(F.struct(*order).alias("o"), F.sha2(F.concat(*parts), 256).alias("d"))
    ranged = staged(rows.repartitionByRange("o", "d").withColumn("p", F.spark_partition_id()))
    counts = ranged.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("p").alias("q"), (F.sum("n").over(W.orderBy("p")) - F.col("n")).alias("b"))  # a row a range
    r = F.row_number().over(W.partitionBy("p").orderBy("o", "d")) - 1
    now = ranged.withColumn("r", r).join(before, F.col("p") == F.col("q")).select((F.col("r") + F.col("b")).alias("at"), "d")
    left, level = ranged.count(), 0
    while True:
        level += 1
        up = now.groupBy((F.lit(0).cast("long") if level == levels else F.expr(f"at div {fan}")).alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "d"))).alias("x"))
        now = up.select(F.col("up").alias("at"), F.sha2(F.array_join(F.transform("x", lambda x: x["d"]), ""), 256).alias("d"))
        left = 1 if level == levels else -(-left // fan)
        if left <= 1:
            return now.agg(F.coalesce(F.max("d"), F.sha2(F.lit(""), 256)).alias("digest"))
