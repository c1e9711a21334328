"""Bootstraps of shares and contrasts, rank correlation and rounding to a whole.

Records that are alike (one pattern of group, stratum, labels and weights) are counted first, and a
replicate draws the patterns' numbers by the multinomial law, which is what drawing as many records
with replacement comes to. A population's patterns lie in ranges of their hash, the leaves of a binary tree: each
node deals its number of records out to its halves by the binomial law, and a range draws its own patterns given
the number that reaches it. The halves' shares come from seed, population, replicates and node alone, so every range
finds its number by itself, going down from the root, and a task that is lost and run again draws the same. No task
holds a population; work is patterns x replicates.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.sources.files import staged

#: Between the parts of a key.
SEP = "\u001f"
#: Replicates that are drawn at a time, and patterns of a range, about.
CHUNK, RANGE_PATTERNS = 50, 512
#: Where there are fewer ranges than this, the replicates are spread over tasks too.
MANY_RANGES = 256


def range_totals(n: int, totals: Sequence[int], leaf: int, seed: int, population: str, first: int) -> np.ndarray:
    """How many records of each of n replicates (numbered from first) fall into a range. totals: records of the nodes on the
    way from the root to the range, both included; leaf: the range's number, whose bits are the way."""
    depth, left = len(totals) - 1, np.full(n, totals[0], np.int64)
    for d in range(depth):
        node, bit = leaf >> depth - d, leaf >> depth - d - 1 & 1
        lower = totals[d] - totals[d + 1] if bit else totals[d + 1]
        rng = np.random.default_rng([seed, zlib.crc32(population.encode()), first, d, node])
        drawn = rng.binomial(left, lower / totals[d])
        left = left - drawn if bit else drawn
    return left


def draw_range(n: int, counts: Sequence[int], totals: Sequence[int], leaf: int, seed: int, population: str, first: int) -> np.ndarray:
    """(n, patterns): how often each pattern of a range comes in n replicates."""
    own = np.asarray(counts, np.int64)
    rng = np.random.default_rng([seed, zlib.crc32(population.encode()), first, len(totals), leaf])
    return rng.multinomial(range_totals(n, totals, leaf, seed, population, first), own / own.sum())


def ranges(patterns: DataFrame, population: str, size: int = RANGE_PATTERNS) -> DataFrame:
    """population, leaf, totals (of the nodes from the root to the range), patterns (array of items and n): a row a range."""
    own = patterns.select(F.col(population).alias("population"), "items", F.col("n").cast("long").alias("n")).where("n > 0")
    depths = own.groupBy("population").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / size))).cast("int").alias("depth"))
    leaf = F.expr("if(depth = 0, 0L, shiftrightunsigned(xxhash64(items), 64 - depth))")
    leaves = own.join(depths, "population").groupBy("population", "depth", leaf.alias("leaf")).agg(F.array_sort(F.collect_list(F.struct("items", "n"))).alias("patterns"), F.sum("n").alias("total"))
    way = leaves.select("population", "leaf", "depth", "total", F.explode(F.sequence(F.lit(0), "depth")).alias("d")).withColumn("node", F.expr("shiftright(leaf, depth - d)"))
    nodes = way.groupBy("population", "d", "node").agg(F.sum("total").alias("t"))
    gone = way.join(nodes, ["population", "d", "node"]).groupBy("population", "leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "t"))), lambda x: x["t"]).alias("totals"))
    return leaves.join(gone, ["population", "leaf"]).select("population", "leaf", "totals", "patterns")


def resampled(patterns: DataFrame, population: str, n: int, seed: int, size: int = RANGE_PATTERNS) -> DataFrame:
    """r, key, x: the weight of each key in each of n replicates.

    patterns: population (text), items (array of key and w), n (records that are alike). The records of each population are
    resampled by themselves. A key that no record of a replicate has is absent."""
    patterns = staged(patterns)  # read several times, and a small part of the records
    kind = dict(patterns.select(F.col("items")[0]["key"].alias("k")).dtypes)["k"]
    held = ranges(patterns, population, size)
    spread = F.explode(F.sequence(F.lit(1), F.lit(n), F.lit(CHUNK)))
    if patterns.count() < size * MANY_RANGES:
        tasks = held.withColumn("first", spread).withColumn("firsts", F.array("first")).drop("first")
    else:
        tasks = held.withColumn("firsts", F.sequence(F.lit(1), F.lit(n), F.lit(CHUNK)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            counts = [p["n"] for p in row["patterns"]]
            entries = sorted(((i["key"], j, i["w"]) for j, p in enumerate(row["patterns"]) for i in p["items"] if i["w"]), key=lambda e: e[:2])
            if not entries:
                continue
            of, w = np.array([e[1] for e in entries]), np.array([e[2] for e in entries], float)
            starts = [k for k, e in enumerate(entries) if k == 0 or e[0] != entries[k - 1][0]]
            keys = np.array([entries[k][0] for k in starts], object)
            for first in row["firsts"]:
                m = draw_range(min(CHUNK, n - first + 1), counts, row["totals"], row["leaf"], seed, row["population"], first)[:, of]
                x = np.add.reduceat(m * w, starts, axis=1)
                r, k = np.nonzero(np.add.reduceat(m, starts, axis=1))
                yield pa.RecordBatch.from_arrays([pa.array((r + first).astype(np.int32)), pa.array(keys[k]), pa.array(x[r, k])], names=["r", "key", "x"])

    drawn = tasks.repartition("population", "leaf", F.col("firsts")[0]).mapInArrow(draw, f"r int, key {kind}, x double")
    return drawn.groupBy("r", "key").agg(F.sum("x").alias("x"))


def interval(by: Sequence[str], value: str, level: float = 0.95) -> list[Column]:
    """lo, hi and excludes_zero of a value's replicates: percentiles with linear interpolation."""
    tail = (1 - level) / 2
    lo, hi = F.percentile(value, F.lit(tail)), F.percentile(value, F.lit(1 - tail))
    return [lo.alias("lo"), hi.alias("hi"), ((lo > 0) | (hi < 0)).alias("excludes_zero")]


def _contrast(summed: DataFrame, groups: tuple[str, str], keys: Sequence[str]) -> DataFrame:
    """From keys, group, label, x: keys, label and the difference of the groups' shares in per cent."""
    shared = summed.withColumn("s", 100 * F.col("x") / F.sum("x").over(W.partitionBy(*keys, "group")))
    a, b = (F.sum(F.when(F.col("group") == g, F.col("s")).otherwise(0.0)) for g in groups)
    return shared.groupBy(*keys, "label").agg((a - b).alias("d"))


def contrast_bootstrap(weights: DataFrame, groups: tuple[str, str], n: int = 1000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """label, contrast, lo, hi, excludes_zero: difference of two groups' label shares, records resampled
    in each group by itself.

    weights: id, group, label, w. A share is a ratio of sums. A label that a replicate lacks has share
    0 there."""
    own = weights.where(F.col("group").isin(*groups)).groupBy("group", "id", "label").agg(F.sum("w").alias("w"))
    items = own.groupBy("group", "id").agg(F.array_sort(F.collect_list(F.struct(F.concat_ws(SEP, "group", "label").alias("key"), "w"))).alias("items"))
    alike = staged(items.groupBy(F.col("group").alias("population"), "items").agg(F.count(F.lit(1)).alias("n")))
    sums = resampled(alike, "population", n, seed).select("r", F.split("key", SEP)[0].alias("group"), F.split("key", SEP)[1].alias("label"), "x")
    each = alike.select("n", F.explode("items").alias("i")).select(F.split("i.key", SEP)[0].alias("group"), F.split("i.key", SEP)[1].alias("label"), (F.col("n") * F.col("i.w")).alias("x"))
    point = _contrast(each.groupBy("group", "label").agg(F.sum("x").alias("x")), groups, [])
    return _intervals(point, _contrast(sums, groups, ["r"]), n, level)


def _intervals(point: DataFrame, drawn: DataFrame, n: int, level: float) -> DataFrame:
    every = point.select("label", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("r"))  # labels x replicates
    full = every.join(drawn, ["r", "label"], "left").fillna({"d": 0.0})
    return point.select("label", F.col("d").alias("contrast")).join(full.groupBy("label").agg(*interval(["label"], "d", level)), "label")


def standardized_bootstrap(cells: DataFrame, tiers: tuple[str, str], stratum: Sequence[str], n: int = 1000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """label, contrast, lo, hi, excludes_zero of directly standardized shares, whole records resampled.

    cells: id, tier, stratum columns, label, w. The weights of the strata are those of all records and
    stay fixed; a stratum without rows of a tier in a replicate adds nothing there."""
    own = cells.select("id", F.concat_ws(SEP, *[F.col(c).cast("string") for c in stratum]).alias("s"), "tier", "label", "w").groupBy("id", "s", "tier", "label").agg(F.sum("w").alias("w"))
    items = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.struct("s", "tier", "label").alias("k"), "w"))).alias("items"))
    whole = staged(items.groupBy("items").agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("n_ids")))  # records that are alike; the records are read once
    each = whole.select("n", F.explode("items").alias("i")).select("n", "i.k.*", "i.w")
    met = each.groupBy("s").agg(*[F.sum(F.when(F.col("tier") == t, F.col("n")).otherwise(0)).alias(f"n{i}") for i, t in enumerate(tiers)]).where("n0 > 0 and n1 > 0")
    docs = whole.select("n_ids", F.explode(F.array_distinct(F.transform("items", lambda i: i["k"]["s"]))).alias("s")).groupBy("s").agg(F.sum("n_ids").alias("n_docs"))
    fixed = met.join(docs, "s").select("s", (F.col("n_docs") / F.sum("n_docs").over(W.partitionBy())).alias("wt"))  # a row per stratum
    strata = fixed.agg(F.collect_set("s").alias("strata"))
    kept = whole.crossJoin(F.broadcast(strata)).select(F.filter("items", lambda i: F.array_contains("strata", i["k"]["s"])).alias("items"), "n").where(F.size("items") > 0)
    text = F.transform("items", lambda i: F.struct(F.to_json(i["k"]).alias("key"), i["w"].alias("w")))
    alike = kept.groupBy(F.lit("all").alias("population"), text.alias("items")).agg(F.sum("n").alias("n"))
    drawn = resampled(alike, "population", n, seed).select("r", F.from_json("key", "s string, tier string, label string").alias("k"), "x").select("r", "k.*", "x")

    def contrast(summed: DataFrame, keys: Sequence[str]) -> DataFrame:
        s = summed.join(fixed, "s").withColumn("s_", 100 * F.col("wt") * F.col("x") / F.sum("x").over(W.partitionBy(*keys, "s", "tier")))
        a, b = (F.sum(F.when(F.col("tier") == t, F.col("s_")).otherwise(0.0)) for t in tiers)
        return s.groupBy(*keys, "label").agg((a - b).alias("d"))

    point = contrast(each.join(fixed.select("s"), "s", "left_semi").groupBy("s", "tier", "label").agg(F.sum(F.col("n") * F.col("w")).alias("x")), [])
    return _intervals(point, contrast(drawn, ["r"]), n, level)


def patterns(pairs: DataFrame, id_col: str = "id", label: str = "label") -> DataFrame:
    """pattern (a record's sorted distinct labels) and n, its number of records."""
    held = pairs.groupBy(id_col).agg(F.array_sort(F.collect_set(label)).alias("pattern"))
    return held.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def pattern_bootstrap(pairs: DataFrame, n: int = 1000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """label, share, lo, hi of fractional label shares, records resampled."""
    found = staged(patterns(pairs))
    alike = found.select(F.lit("all").alias("population"), F.transform("pattern", lambda x: F.struct(x.alias("key"), (1.0 / F.size("pattern")).alias("w"))).alias("items"), "n")
    share = lambda df, *by: df.withColumn("s", 100 * F.col("x") / F.sum("x").over(W.partitionBy(*by)))
    each = found.select(F.explode("pattern").alias("label"), (F.col("n") / F.size("pattern")).alias("w")).groupBy("label").agg(F.sum("w").alias("x"))
    point = share(each).select("label", F.col("s").alias("share"))
    drawn = share(resampled(alike, "population", n, seed).withColumnRenamed("key", "label"), "r")
    every = point.select("label", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("r")).join(drawn, ["r", "label"], "left").fillna({"s": 0.0})  # labels x replicates
    return point.join(every.groupBy("label").agg(*interval(["label"], "s", level)[:2]), "label")


def average_rank(value: str, by: Sequence[str] = ()) -> Column:
    """Rank from 1, ties at their mean."""
    w = W.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*by, value)) - 1) / 2


def compare_specs(table: DataFrame, spec: str, key: str, value: str, main: str) -> DataFrame:
    """spec, n, spearman, max_abs_change, same_sign of each alternative specification against the main
    one, over the keys that both have."""
    base = table.where(F.col(spec) == main).select(F.col(key).alias("_k"), F.col(value).alias("_b"))
    both = table.where(F.col(spec) != main).join(base, F.col(key) == F.col("_k"))
    ranked = both.withColumn("_x", average_rank(value, [spec])).withColumn("_y", average_rank("_b", [spec]))
    return ranked.groupBy(spec).agg(
        F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("spearman"), F.max(F.abs(F.col(value) - F.col("_b"))).alias("max_abs_change"),
        F.avg((F.signum(value) == F.signum("_b")).cast("double")).alias("same_sign"),
    )


def rounded_to_whole(df: DataFrame, share: str, key: str, by: Sequence[str] = (), whole: int = 100, out: str = "whole") -> DataFrame:
    """Shares as whole numbers that add up to whole: floors, and one more for the largest fractions, ties
    by key."""
    w = W.partitionBy(*by)
    floor = F.floor(share)
    marked = df.withColumn("_f", floor).withColumn("_r", F.row_number().over(w.orderBy(F.desc(F.col(share) - floor), key)))
    return marked.withColumn(out, (F.col("_f") + F.when(F.col("_r") <= whole - F.sum("_f").over(w), 1).otherwise(0)).cast("long")).drop("_f", "_r")


def top_share(df: DataFrame, value: str, key: str, counts: Sequence[int]) -> DataFrame:
    """k and share_pct: what the k largest hold of the total. df has a row per key of a small dimension."""
    ranked = df.withColumn("_r", F.row_number().over(W.orderBy(F.desc(value), key))).select(value, "_r", F.explode(F.array(*map(F.lit, counts))).alias("k"))
    return ranked.groupBy("k").agg((100 * F.sum(F.when(F.col("_r") <= F.col("k"), F.col(value)).otherwise(0)) / F.sum(value)).alias("share_pct"))
