"""Lookups of keys by a remote service: a shared rate, bounded retries, results by key.

The client is a parameter, a callable that gets a batch of keys and returns as many results. Every key is asked for
once; successes go to a keyed cache, so a run that is repeated asks for what is missing only, and a task that is
run again writes the same keys.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.caches import KeyedCache
from corpusloom.sources.files import staged


class Busy(RuntimeError):
    """The service asks to come back later, after so many seconds if it says."""

    def __init__(self, said: str = "busy", after: float | None = None):
        super().__init__(said)
        self.after = after


class Refused(RuntimeError):
    """The service will not answer this, however often it is asked."""


class Pace:
    """Starts of calls, at least 1 / rate seconds apart."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if rate <= 0:
            raise ValueError("the rate must be positive")
        self.interval, self.clock, self.sleep, self.next = 1 / rate, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        start = max(now, self.next)
        self.next = start + self.interval
        if start > now:
            self.sleep(start - now)


def call(client: Callable[[list[dict]], list[dict]], keys: list[dict], pace: Pace, attempts: int = 4, delay: float = 1.0, longest: float = 60.0) -> tuple[list[dict] | None, str, int, str | None]:
    """(results or None, status, attempts made, error): status is ok, refused, or failed after so many attempts. Waits double from
    delay to longest, or are as long as the service says."""
    error = None
    for n in range(1, attempts + 1):
        pace.wait()
        try:
            found = client(keys)
            if len(found) != len(keys):
                raise Refused(f"{len(found)} results for {len(keys)} keys")
            return found, "ok", n, None
        except Refused as e:
            return None, "refused", n, str(e)[:500]
        except Exception as e:  # noqa: BLE001  a client may raise anything; it is tried again
            error = f"{type(e).__name__}: {str(e)[:500]}"
            if n < attempts:
                pace.sleep(min(longest, e.after if isinstance(e, Busy) and e.after is not None else delay * 2 ** (n - 1)))
    return None, "failed", attempts, error


def ask(keys: DataFrame, client: Callable[[list[dict]], list[dict]], fields: str, rate: float, batch: int = 1, workers: int | None = None, attempts: int = 4, delay: float = 1.0) -> DataFrame:
    """keys' columns, the fields that the client gives (a schema), status, attempts and error, a row for each distinct key.

    rate is of calls a second, of all workers together: each has its share of it, so it holds however many of them run at a
    time. A batch that fails or is refused leaves its keys' fields null. Tasks run twice (on a lost executor, or
    speculatively) ask twice."""
    spark = keys.sparkSession
    n = workers or spark.sparkContext.defaultParallelism
    names, kinds = keys.columns, keys.schema
    more = spark.createDataFrame([], fields).schema
    clash = set(names) & set(more.names)
    if clash:
        raise ValueError(f"keys and fields share names: {sorted(clash)}")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (*kinds.fields, *more.fields)) + ", status string, attempts int, error string"
    like = spark.createDataFrame([], out).limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace, held = Pace(rate / n), []

        def answered(own: list[dict]) -> pa.RecordBatch:
            found, status, tries, error = call(client, own, pace, attempts, delay)
            rows = [{**k, **{f: (r or {}).get(f) for f in more.names}, "status": status, "attempts": tries, "error": error} for k, r in zip(own, found or [None] * len(own))]
            return pa.RecordBatch.from_pylist(rows, like)

        for b in batches:
            for row in b.to_pylist():
                held.append(row)
                if len(held) == batch:
                    yield answered(held)
                    held = []
        if held:
            yield answered(held)

    return keys.distinct().repartition(n, *names).mapInArrow(run, out)


def look_up(wanted: DataFrame, cache: KeyedCache, client: Callable[[list[dict]], list[dict]], rate: float, **how) -> tuple[DataFrame, DataFrame]:
    """(wanted's keys with what the cache has of them, keys that could not be answered with status, attempts and error). What
    the cache lacks is asked for and kept; failures are not, so the next run asks for them again."""
    rest = [f for f in cache.schema.fields if f.name not in cache.keys]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    found = staged(ask(cache.misses(wanted), client, fields, rate, **how))
    cache.upsert(found.where("status = 'ok'").select(*cache.schema.names))
    return wanted.join(cache.read(), cache.keys, "left"), found.where("status <> 'ok'").select(*cache.keys, "status", "attempts", "error")


def checked_vectors(embed: Callable[[list[str]], Sequence[Sequence[float]]], text: str, vector: str = "vector") -> Callable[[list[dict]], list[dict]]:
    """A client that embeds a batch of texts: as many vectors as texts, all of one length, or the batch is refused."""

    def client(keys: list[dict]) -> list[dict]:
        vectors = embed([k[text] for k in keys])
        if len(vectors) != len(keys) or len({len(v) for v in vectors}) > 1:
            raise Refused(f"{len(vectors)} vectors of lengths {sorted({len(v) for v in vectors})} for {len(keys)} texts")
        return [{vector: [float(x) for x in v]} for v in vectors]

    return client
