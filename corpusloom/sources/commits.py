"""Versions of a table that are published by one atomic step.

A version is a small JSON file in the folder `versions`, named by its number. It is written under another
name and renamed to its own, which fails if that exists; so a version is there whole or not at all, and of two
writers that build on the same version one is told so.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession


class VersionConflict(RuntimeError):
    """Another writer has published this version."""


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("versions").getFileSystem(self.conf)

    def numbers(self) -> list[int]:
        fs, at = self._fs(), self._at("versions")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)\.json", n)))

    def read(self, number: int) -> dict:
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/versions/v{number:012d}.json").collect()))

    def latest(self) -> tuple[int, dict | None]:
        """The last version's number and content; 0 and None before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, None)

    def publish(self, number: int, content: dict) -> None:
        staged = self._stage(content)
        self._rename(staged, number)

    def _stage(self, content: dict):
        at = self._at(f"versions/.{uuid.uuid4().hex}")
        out = self._fs().create(at, True)
        try:
            out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            out.close()
        return at

    def _rename(self, staged, number: int) -> None:
        fs = self.jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            fs.FileContext.getFileContext(staged.toUri(), self.conf).rename(staged, self._at(f"versions/v{number:012d}.json"), none)
        except Exception as e:  # noqa: BLE001  py4j's errors have no common class with Spark's
            if self._fs().exists(self._at(f"versions/v{number:012d}.json")):
                raise VersionConflict(f"version {number} of {self.path} is another writer's") from e
            raise

    def forget(self, keep: int) -> list[dict]:
        """Drop all versions but the last keep; their contents."""
        old = self.numbers()[:-keep]
        said = [self.read(n) for n in old]
        for n in old:
            self._fs().delete(self._at(f"versions/v{n:012d}.json"), False)
        return said

    def folders(self, name: str) -> dict[str, float]:
        """Folders in path/name, and the seconds since they were last written to."""
        fs, at = self._fs(), self._at(name)
        now = self.jvm.java.lang.System.currentTimeMillis()
        return {s.getPath().getName(): (now - s.getModificationTime()) / 1000 for s in fs.listStatus(at)} if fs.exists(at) else {}

    def delete(self, name: str) -> None:
        self._fs().delete(self._at(name), True)
