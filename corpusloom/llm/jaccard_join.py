"""N-gram Jaccard join, size-aware: heavy and light sets are joined in different ways.

Documents are sets of hashed word shingles. Texts with equal sets are collapsed into classes. Under
one global order of shingles (those held by many documents last), two sets whose Jaccard is at
least t share at least l shingles of their l-prefixes (size - least overlap + l first ones). Light
(small) sets enumerate all subsets of l = 2 of their prefixes as keys, so that a key is rare and
is nearly always a hit; heavy (large) ones, whose subsets would be too many, go into inverted lists of
single prefix shingles (l = 1). The boundary between them is the one of least estimated cost; sets
just below it do both, so no pair is lost between the kinds.

Pairs that share a key are verified exactly, but not all: first each key's members are held against
one pivot, the member with fewest rare shingles, which in a group of near copies is their source.
Only pairs that are then in different components are enumerated. So a large group of near copies
costs a star, not all its pairs, and no component loses a link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import columns_of, connected_components, materialize, numbered, release, rows_in, table

#: Words of a shingle, and the least Jaccard in per cent.
SHINGLE_WORDS = 3
PERCENT = 90
#: A shingle that more documents hold comes last in the order.
FREQUENT = 24
#: The boundary is sought up to this size.
MAX_BOUNDARY = 512
#: Bits of the map of frequent shingles: for each of them, and at most 16 MB.
BITS_EACH, MAX_BITS = 32, 1 << 27
#: Needed texts are sought by a broadcast of at most so many ids (16 MB), beyond that by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of text of a counting group, while there are at most 65,536 of them, and beyond.
PART_BYTES, WIDE_PART_BYTES = 4e6, 64e6
#: Spark takes tables that it knows nothing of to be larger than this; they are stored first.
UNKNOWN_BYTES = 1 << 60
#: Members of a key that are held against each other in one task; a key with more is cut into pairs of chunks.
CHUNK_MEMBERS = 2000
#: Members of a key beyond which they are held against those of about their size only.
SIZED_MEMBERS = 256
#: Longest prefix that travels with a set's keys, to tell the first key of a pair; sets with longer ones are pairs at every key.
TOLD_PREFIX = 128
#: Shingles that a task sorts at a time; bytes of text split at a time.
FLUSH, TEXT_BLOCK = 4_000_000, 1 << 23
BITS = ("b0", "b1", "b2", "b3")
#: Sets of more shingles have so many parity bits besides.
WIDE_FROM, WIDE_BITS = 500, 2048

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, in order; long texts in blocks."""
    data = text.encode("utf-8", "replace").lower()
    if len(data) <= TEXT_BLOCK:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, data.split()), np.uint64)
    out, rest = [], b""
    for i in range(0, len(data), TEXT_BLOCK):
        block = rest + data[i : i + TEXT_BLOCK]
        cut = max(map(block.rfind, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))) + 1
        rest = block[cut:]
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, block[:cut].split()), np.uint64))
    out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, rest.split()), np.uint64))
    return np.concatenate(out)


def shingles(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted set of a text's shingles; a shorter sequence is one shingle, no words are none."""
    h = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    n = min(width, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        s = mixed(s * _M1 + h[i : len(h) - n + 1 + i])
    return np.unique(s)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return int(s.sum(dtype=np.uint64).astype(np.int64)), int(mixed(s ^ _M1).sum(dtype=np.uint64).astype(np.int64))


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def prefix(n: int, l: int, percent: int = PERCENT) -> int:
    return min(n, n - least_overlap(n, percent) + l)


def parity(s: np.ndarray, bits: int = 256) -> list[int]:
    """bits, in longs: of the shingles that fall on a bit, whether their number is odd. Two sets differ in at
    least as many shingles as their bits differ."""
    odd = np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))
    return odd.view(np.int64).tolist()


def may_match(x: str, y: str, percent: int = PERCENT) -> Column:
    """Whether two sets' parity bits allow a Jaccard of percent: |x - y| + |y - x| of sets that link is at
    most (100 - percent) / (100 + percent) of their sizes' sum. Never false for sets that link."""
    apart = " + ".join(f"bit_count({x}{b} ^ {y}{b})" for b in BITS)
    return F.expr(f"{100 + percent} * ({apart}) <= {100 - percent} * ({x}n + {y}n)")


def plausible(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose parity bits, narrow and wide, allow a link."""
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("cid").alias(side), F.col("n").alias(f"{side}n"), F.col("wide").alias(f"{side}w"), *[F.col(b).alias(f"{side}{b}") for b in BITS]), side)
    apart = F.aggregate(F.zip_with("aw", "bw", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    return pairs.where(may_match("a", "b", percent)).where(F.coalesce((100 + percent) * apart <= (100 - percent) * (F.col("an") + F.col("bn")), F.lit(True))).select("a", "b")


def subset_keys(first: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(len(first), 1)
    return mixed(mixed(first[i]) * _M1 + first[j])


def best_boundary(histogram: dict[int, int], list_length: float, percent: int = PERCENT) -> int:
    """Largest light size of least total cost: subsets enumerated up to it, lists scanned above (and
    in the band below that may match above). Sizes over MAX_BOUNDARY are scanned at any boundary."""
    subsets = lambda s: math.comb(prefix(s, 2, percent), 2)
    scans = lambda s: prefix(s, 1, percent) * (1 + list_length)

    def cost(b: int) -> float:
        return sum(n * ((subsets(s) if s <= b else 0) + (scans(s) if 100 * s >= percent * (b + 1) else 0)) for s, n in histogram.items())

    return min(range(MAX_BOUNDARY + 1), key=lambda b: (cost(b), b))


def tallied(heads: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted heads, each once, and how often each came (n: how often at each place)."""
    starts = np.nonzero(np.concatenate([[len(heads) > 0], heads[1:] != heads[:-1]]))[0]
    return heads[starts], np.diff(np.append(starts, len(heads))) if n is None else np.add.reduceat(n, starts)


def profile(docs: DataFrame, parts: int, width: int = SHINGLE_WORDS) -> DataFrame:
    """From docs(doc_id, text): a row per document with doc_id, n, f1, f2; and rows with part, blob and more, for counting: the
    different 32-bit shingle heads (sorted, as differences) of many documents, and of those that came more than once the
    place and how often."""
    kind = docs.schema["doc_id"].dataType
    shift = np.uint64(64 - int(math.log2(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n_held, key_type = 0, None

        def flush() -> pa.RecordBatch:
            s = np.sort(np.concatenate(held))
            at = np.searchsorted(s >> shift, np.arange(parts + 1, dtype=np.uint64))
            heads = (s >> np.uint64(32)).astype("<u4")
            some, blobs, more = [p for p in range(parts) if at[p] < at[p + 1]], [], []
            for p in some:
                own, n = tallied(heads[at[p] : at[p + 1]])
                often = np.nonzero(n > 1)[0]
                blobs.append(np.diff(own, prepend=np.uint32(0)).astype("<u4").tobytes())
                more.append(np.stack([often, n[often]]).astype("<u4").tobytes())
            none = lambda k: pa.nulls(len(some), k)
            return pa.RecordBatch.from_arrays([none(key_type), none(pa.int64()), none(pa.int64()), none(pa.int64()), pa.array(some, pa.int32()), pa.array(blobs, pa.binary()), pa.array(more, pa.binary())], names=names)

        names = ["doc_id", "n", "f1", "f2", "part", "blob", "more"]
        for batch in batches:
            key_type = batch.schema.field(0).type
            rows = []
            for t in batch.column(1):
                s = shingles(t.as_py(), width)
                rows.append((len(s), *fingerprint(s)))
                held.append(s)
                n_held += len(s)
                if n_held >= FLUSH:
                    yield flush()
                    held, n_held = [], 0
            if rows:
                n = len(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in zip(*rows)], pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)
        if n_held:
            yield flush()

    return docs.mapInArrow(run, f"doc_id {kind.simpleString()}, n long, f1 long, f2 long, part int, blob binary, more binary")


def frequent(profiled: DataFrame, limit: int = FREQUENT) -> tuple[np.ndarray, float]:
    """(bit map of the heads of shingles that more than limit documents hold, mean list length of the
    others as a document meets them). Where these are more than the map has room for, those that the most
    documents hold are told: the limit is doubled until they fit. The map only decides on the order, never on a
    result."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        told, first = np.concatenate([np.cumsum(np.frombuffer(b, "<u4"), dtype=np.uint32) for b in rows.blob]).astype(np.uint64) << np.uint64(32), 0
        told += np.uint64(1)  # a head, and below it how often it came
        for b, m in zip(rows.blob, rows.more):
            places, counts = np.frombuffer(m, "<u4").reshape(2, -1)
            told[first + places.astype(np.int64)] += counts.astype(np.uint64) - np.uint64(1)
            first += len(b) // 4
        told.sort()
        heads, n = tallied((told >> np.uint64(32)).astype(np.uint32), (told & np.uint64(0xFFFFFFFF)).astype(np.int64))
        often = n > limit
        few = n[~often].astype(float)
        k = int(often.sum())
        return pd.DataFrame({"head": [*heads[often].astype(np.int64).tolist(), None], "held": [*n[often].tolist(), 0], "s1": [0.0] * k + [few.sum()], "s2": [0.0] * k + [(few * few).sum()]}).astype({"head": "Int64"})

    found = materialize(profiled.where("part is not null").select("part", "blob", "more").groupBy("part").applyInPandas(count, "head long, held long, s1 double, s2 double"), "frequent")
    s1, s2 = found.agg(F.coalesce(F.sum("s1"), F.lit(0.0)), F.coalesce(F.sum("s2"), F.lit(0.0))).first()
    # of each doubling of the limit, how many heads are held by more documents
    doublings = {r["d"]: r["n"] for r in found.where("head is not null").groupBy(F.ceil(F.log2(F.col("held") / F.lit(float(limit)))).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least = 0
    while (n := sum(c for d, c in doublings.items() if d > least)) * BITS_EACH > MAX_BITS:
        least += 1
    found_often = found.where(F.col("head").isNotNull() & (F.col("held") > limit * 2.0**least))
    bits = 1 << min(int(math.log2(MAX_BITS)), max(10, math.ceil(math.log2(max(1, n) * BITS_EACH))))
    at = F.col("head").bitwiseAND(F.lit(bits - 1))
    words = found_often.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast((head & {bits - 1}) % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    out = np.zeros(bits // 64, np.uint64)
    for r in words:
        out[r["w"]] = np.uint64(r["b"] & 0xFFFFFFFFFFFFFFFF)
    release(found)
    return out, (s2 / s1 - 1 if s1 else 0.0)


def with_keys(docs: DataFrame, often: np.ndarray, boundary: int, percent: int = PERCENT, width: int = SHINGLE_WORDS) -> DataFrame:
    """f1, f2, n, rare (shingles that are not frequent), parity bits, prefix (a short one) and keys of every document:
    first the pairs of prefix shingles, row by row of their triangle, then the single ones."""
    shared = docs.sparkSession.sparkContext.broadcast(often)  # at most MAX_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        mask = np.uint64(len(bits) * 64 - 1)
        for batch in batches:
            rows, keys, wide, prefixes = [], [], [], []
            for t in batch.column(0):
                s = shingles(t.as_py(), width)
                n = len(s)
                head = (s >> np.uint64(32)) & mask
                last = (bits[(head >> np.uint64(6)).astype(np.int64)] >> (head & np.uint64(63))) & np.uint64(1) == 1
                ordered = np.concatenate([s[~last], s[last]])
                own = [np.zeros(0, np.uint64)]
                if n and least_overlap(n, percent) < n or n and 100 * n >= percent * (n + 1):  # else only an equal set matches
                    if n <= boundary:
                        own.append(subset_keys(ordered[: prefix(n, 2, percent)]))
                    if 100 * n >= percent * (boundary + 1):
                        own.append(mixed(ordered[: prefix(n, 1, percent)] ^ _M2))
                keys.append(np.concatenate(own).view(np.int64))
                prefixes.append(ordered[: prefix(n, 2, percent)].view(np.int64) if prefix(n, 2, percent) <= TOLD_PREFIX else None)
                rows.append((*fingerprint(s), n, int(n - last.sum()), *parity(s)))
                wide.append(parity(s, WIDE_BITS) if n > WIDE_FROM else None)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 8)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(wide, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["f1", "f2", "n", "rare", *BITS, "wide", "prefix", "keys"])

    return docs.select("text").mapInArrow(run, "f1 long, f2 long, n long, rare long, b0 long, b1 long, b2 long, b3 long, wide array<long>, prefix array<long>, keys array<long>")


def with_shingles(keyed: DataFrame, light: Column) -> DataFrame:
    """keyed (prefix, and pos, a key's place among its set's) with s0 and s1, the key's shingles, and at0, the place of s0 in
    its set's order; s1 is null of a single one, both are null of a set without a prefix. light sets have pairs before their
    single ones."""
    p, pos = F.size("prefix").cast("long"), F.col("pos").cast("long")
    total = F.when(light, F.floor(p * (p - 1) / 2)).otherwise(F.lit(0).cast("long"))
    pair = pos < total
    i = F.when(pair, p - 2 - F.floor(F.sqrt((4 * p * (p - 1) - 8 * pos - 7).cast("double")) / 2 - 0.5)).otherwise(pos - total)
    j = pos + i + 1 - total + F.floor((p - i) * (p - i - 1) / 2)
    at = lambda k: F.get("prefix", k.cast("int"))
    return keyed.withColumns({"s0": at(i), "s1": F.when(pair, at(j)), "at0": i.cast("long")})


def first_key(x: str, y: str) -> Column:
    """Whether a key is the first of those that two sets share: that of the first shingles that both prefixes hold. Both are
    in one order. True where a set has no prefix here."""
    both = F.array_intersect(f"{x}prefix", f"{y}prefix")
    first = F.get(both, F.lit(0)).eqNullSafe(F.col(f"{x}s0")) & (F.col(f"{x}s1").isNull() | F.get(both, F.lit(1)).eqNullSafe(F.col(f"{x}s1")))
    return F.col(f"{x}prefix").isNull() | F.col(f"{y}prefix").isNull() | first


def enough_left(x: str, y: str, percent: int = PERCENT) -> Column:
    """Whether two sets that share a key's first shingle can have the overlap that a link needs, by how much of either comes
    behind it; and before it, unless it is the first that they share. Never false for sets that link."""
    told = F.col(f"{x}prefix").isNotNull() & F.col(f"{y}prefix").isNotNull()
    ahead = F.when(told, F.lit(0)).otherwise(F.least(f"{x}at0", f"{y}at0"))
    behind = F.least(F.col(f"{x}n") - F.col(f"{x}at0"), F.col(f"{y}n") - F.col(f"{y}at0"))
    return (100 + percent) * (ahead + behind) >= percent * (F.col(f"{x}n") + F.col(f"{y}n"))


def size_class(n: Column, percent: int = PERCENT) -> Column:
    """A number such that those of sets that may link differ by one at most."""
    return n if percent == 100 else F.floor(F.ln(n) / F.lit(math.log(100 / percent) * (1 + 1e-9)))


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """cid and set (sorted 64-bit shingles as bytes), stored, of the classes in wanted(cid), from the texts of
    their first documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width) for t in batch.column(0)]
            prints = [fingerprint(s) for s in found]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())], names=["f1", "f2", "set"])

    ids = materialize(wanted.join(classes.select("cid", "f1", "f2", "first"), "cid"), "wanted")
    few = ids.select(F.col("first").alias("_first")).distinct()
    few = F.broadcast(few) if ids.count() <= BROADCAST_IDS else few
    texts = docs.join(few, F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi").select("text")
    found = texts.mapInArrow(run, "f1 long, f2 long, set binary")
    sets = materialize(found.join(ids.select("f1", "f2", "cid"), ["f1", "f2"]).groupBy("cid").agg(F.first("set").alias("set")), "sets")
    release(ids)
    return sets


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int = PERCENT, width: int = SHINGLE_WORDS) -> DataFrame:
    """The pairs (a, b) of class ids whose sets' Jaccard is at least percent."""
    pairs = materialize(pairs, "candidates")
    sets = sets_of(docs, classes, pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), width)
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = materialize(both.mapInArrow(run, "a long, b long"), "verified")
    release(pairs, sets)
    return out


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Two documents link when 100 * intersection >= percent * union of their sets of
    width-word shingles; component_id
    is the smallest doc_id reachable by links. A null or empty text, or one without words, has the
    empty set and links with nothing. Rows of equal sets link; repeated rows are in one component. A
    null doc_id is never the smallest where there is another. Other columns are not looked at; an
    empty table gives an empty table.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    said = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # noqa: E731  what a scan reads, without reading it
    if (size := said(docs)) > UNKNOWN_BYTES:
        docs = materialize(docs, "join-texts")
        size = said(docs)
    parts = 1 << math.ceil(math.log2(max(64, min(65_536, size / PART_BYTES), size / WIDE_PART_BYTES)))
    profiled = materialize(profile(docs, parts, width), "shingle-profile")
    rows = materialize(profiled.where("part is null").select("doc_id", "n", "f1", "f2"), "profile-rows")
    often, length = frequent(profiled)
    release(profiled)
    histogram = {r["s"]: r["c"] for r in rows.groupBy(F.least("n", F.lit(MAX_BOUNDARY + 1)).alias("s")).agg(F.count(F.lit(1)).alias("c")).collect()}
    boundary = best_boundary(histogram, length, percent)
    # one class per distinct set; hot sets are combined before the shuffle
    classes = rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("first"))
    keyed = with_keys(docs, often, boundary, percent, width).where("n > 0").groupBy("f1", "f2", "n").agg(*[F.first(c).alias(c) for c in ("rare", *BITS, "wide", "prefix", "keys")])
    with_posts = materialize(classes.join(keyed, ["f1", "f2", "n"]).withColumn("cid", F.monotonically_increasing_id()), "classes-keys")
    classes = materialize(with_posts.drop("keys"), "classes")

    posted = with_posts.select(F.posexplode("keys").alias("pos", "key"), "cid", "n", "rare")
    pivots = posted.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("rare", "cid", "n")).alias("p")).where("m > 1").select(F.col("key").alias("k"), F.col("p.cid").alias("pivot"), F.col("p.n").alias("pn"))
    shared = materialize(posted.join(pivots, F.col("key") == F.col("k")).select("key", "pos", "cid", "n", "pivot", "pn"), "shared-keys")
    release(with_posts)
    fits = lambda x, y: f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"
    star = shared.where("cid <> pivot").where(fits("n", "pn")).select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()
    links = verify(plausible(star, classes, percent), docs, classes, percent, width)
    component = materialize(connected_components(links), "components")

    def labelled(at: DataFrame) -> DataFrame:
        return at.join(component, F.col("cid") == F.col("node"), "left").withColumn("c", F.coalesce("component", "cid")).drop("node", "component")

    # what is left: members of a key in different components
    marked = labelled(shared)
    mixed_keys = marked.groupBy(F.col("key").alias("k")).agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi")
    mixed_keys = mixed_keys.select("k", F.ceil(F.col("m") / CHUNK_MEMBERS).cast("int").alias("chunks"), (F.col("m") > SIZED_MEMBERS).alias("sized"))
    left = marked.join(mixed_keys, F.col("key") == F.col("k")).select("key", "pos", "cid", "n", "pivot", "c", "chunks", "sized")
    left = materialize(with_shingles(left.join(classes.select("cid", "prefix", *BITS), "cid"), F.col("n") <= boundary).drop("pos"), "unsettled")
    release(shared, component)
    # a key of many members is spread over pairs of chunks, and over classes of sizes, each of which meets itself and its
    # neighbours; each pair of members meets in one of these. Near copies share hundreds of keys: they are a pair at the first
    # of them only
    own, every = F.pmod(F.xxhash64("cid"), "chunks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    sized = F.when(F.col("sized"), size_class(F.col("n"), percent)).otherwise(0).cast("long")
    near = F.explode(F.when(F.col("sized"), F.sequence(sized - 1, sized + 1)).otherwise(F.array(sized)))
    x, y = left.withColumn("i", own).withColumn("j", every).withColumn("s", sized).alias("x"), left.withColumn("j", own).withColumn("i", every).withColumn("s", near).alias("y")
    alike = may_match("x.", "y.", percent) & enough_left("x.", "y.", percent)
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.s") == F.col("y.s")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & (F.col("x.c") < F.col("y.c")) & F.expr(fits("x.n", "y.n")) & alike & (F.col("x.cid") != F.col("x.pivot")) & (F.col("y.cid") != F.col("x.pivot")) & first_key("x.", "y."))
    more = more.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()
    found = verify(plausible(more, classes, percent), docs, classes, percent, width)
    component = materialize(connected_components(links.union(found)), "components")
    release(left, links, found)
    merged = labelled(classes.select("f1", "f2", "n", "cid", "first"))
    smallest = merged.groupBy(F.col("c").alias("d")).agg(F.min("first").alias("component_id"))
    of = materialize(merged.join(smallest, F.col("c") == F.col("d")).select("f1", "f2", "n", "component_id"), "class-components")
    release(classes, component)
    out = rows.join(of, ["f1", "f2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = SHINGLE_WORDS) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id; all columns. Rows without a
    shingle all stay."""
    rows, row = numbered(docs, "join-docs")
    found = jaccard_components(rows.select(F.col(row).alias("_r"), F.col(text).alias("t")), "_r", "t", percent, width)
    named = found.join(rows.select(F.col(row).alias("doc_id"), F.col(doc_id).alias("id")), "doc_id")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id")).alias("m")).select(F.col("m.doc_id").alias("_r"))
    return rows_in(rows, row, first).select(*columns_of(docs))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op7_jaccard_join": op7_jaccard_join}
ORACLES: dict[str, str] = {}
