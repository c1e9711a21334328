"""Tables that are made of parts and published as a whole, and stage results that are used again.

Nothing that is half done is ever read: parts and results lie in folders of their own until one atomic step
publishes them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.contracts import ContractError
from corpusloom.sources.commits import VersionConflict, Versions


class CombinedWriter:
    """One table of parts that come one after another: each is written when it comes, and all are checked together before
    they take the place of the table at path. An abort, or a failed check, leaves that as it was."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key, self.versions = spark, path.rstrip("/"), key, Versions(spark, path)
        self.based_on, self.folder, self.parts, self.schema, self.open = self.versions.latest()[0], f"parts/{uuid.uuid4().hex}", 0, None, True

    def add(self, part: DataFrame) -> None:
        self._check_open()
        if self.schema is None:
            self.schema = part.schema
        if sorted(part.columns) != sorted(self.schema.names):
            raise ContractError(f"columns differ: {sorted(set(part.columns) ^ set(self.schema.names))}")
        part.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields]).write.option("compression", "zstd").parquet(f"{self.path}/{self.folder}/part-{self.parts:06d}")
        self.parts += 1

    def staged(self) -> DataFrame:
        """The parts so far, with the number of each row's."""
        if not self.parts:
            raise ContractError("no part was added")
        paths = [f"{self.path}/{self.folder}/part-{k:06d}" for k in range(self.parts)]
        return self.spark.read.schema(self.schema).parquet(*paths).withColumn("_part", F.regexp_extract(F.col("_metadata.file_path"), r"/part-(\d{6})/", 1).cast("int"))

    def publish(self, check: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """Put the parts in place of the table, if no key is null or in two rows and check raises nothing; else abort."""
        self._check_open()
        try:
            held = self.staged()
            bad = held.groupBy(self.key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("_part")).alias("parts")).where(F.col(self.key).isNull() | (F.col("n") > 1)).limit(5).collect()
            if bad:
                raise ContractError(f"{self.key} is null or repeats: " + ", ".join(f"{r[self.key]!r} in parts {r['parts'][:5]}" for r in bad))
            if check is not None:
                check(held.drop("_part"))
            self.versions.publish(self.based_on + 1, {"folder": self.folder, "parts": self.parts, "schema": self.schema.json()})
        except Exception:
            self.abort()
            raise
        self.open = False
        return read_combined(self.spark, self.path)

    def abort(self) -> None:
        if self.open:
            self.open = False
            self.versions.delete(self.folder)

    def _check_open(self) -> None:
        if not self.open:
            raise ValueError("this writer has published or aborted")

    def __enter__(self) -> CombinedWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        self.abort()  # what was not published is not wanted


def read_combined(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql.types import StructType

    _, said = Versions(spark, path).latest()
    if said is None:
        raise ValueError(f"nothing is published at {path}")
    paths = [f"{path.rstrip('/')}/{said['folder']}/part-{k:06d}" for k in range(said["parts"])]
    return spark.read.schema(StructType.fromJson(json.loads(said["schema"]))).parquet(*paths)


def files_fingerprint(spark: SparkSession, paths: Sequence[str], contents: bool = False) -> str:
    """Of files' names, lengths and times; or of what they hold, whatever their times."""
    found = spark.read.format("binaryFile").load(list(paths))
    what = ["path", "length"] + (["sha256"] if contents else ["modificationTime"])
    if contents:
        found = found.withColumn("sha256", F.sha2("content", 256))
    rows = sorted([[str(v) for v in r] for r in found.select(*what).collect()])  # a row a file
    return hashlib.sha256(json.dumps(rows).encode()).hexdigest()


class Stages:
    """Results of stages in the folder at path, found by a fingerprint of what they are made of."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.built = spark, path.rstrip("/"), []
        self.prints: dict[str, str] = {}

    def run(self, name: str, build: Callable[..., DataFrame], after: Sequence[str] = (), inputs: Mapping[str, str] | None = None, rules=None, code: str = "") -> DataFrame:
        """The result of build(*results of the stages named in after), from an earlier run if the stage's name, rules
        (anything that JSON holds), code version, fingerprints of inputs and those of the stages before are the same. A change
        makes this stage and those after it anew, and no others."""
        facts = {"name": name, "rules": rules, "code": code, "inputs": dict(inputs or {}), "after": {a: self.prints[a] for a in after}}
        self.prints[name] = hashlib.sha256(json.dumps(facts, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
        versions = Versions(self.spark, self._at(name))
        if versions.latest()[1] is None:
            folder = f"data/{uuid.uuid4().hex}"
            out = build(*[self.result(a) for a in after])
            out.write.option("compression", "zstd").parquet(f"{self._at(name)}/{folder}")
            self.built.append(name)
            try:
                versions.publish(1, {"folder": folder, "schema": out.schema.json(), "facts": facts})
            except VersionConflict:  # another run was faster; its result is as good
                versions.delete(folder)
        return self.result(name)

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}-{self.prints[name][:32]}"

    def result(self, name: str) -> DataFrame:
        from pyspark.sql.types import StructType

        said = Versions(self.spark, self._at(name)).read(1)
        return self.spark.read.schema(StructType.fromJson(json.loads(said["schema"]))).parquet(f"{self._at(name)}/{said['folder']}")
