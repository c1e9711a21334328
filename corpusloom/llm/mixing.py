"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are dealt into blocks by a hash. Its target is met by whole passes over its
blocks and one partial pass, in the order of a permutation per pass; of the block in which the
target falls, and of as many later ones as are needed where its documents are longer than a block,
the documents whose words come nearest are taken. The exact block quotas of all sources are then
split recursively among the output shards: each node of the tree draws its left half's share from
its own by the multivariate hypergeometric law, so a shard holds a random share of every source
and quotas add up exactly. A leaf owns a disjoint stretch of each source's permuted blocks, and
documents are shuffled within their shard by a hash. What the mix takes is what the leaves own.

The driver holds one row per source (some 100 bytes each, so a million sources are 0.1 GB) and the
top of the tree, at most TOP_CELLS counts; below that, each subtree is descended where its row is.
Blocks and shards keep their size at any size of the corpus: more words make more of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import MAX_SMALL, columns_of, count_words, materialize, numbered, small, table

WEIGHTS = (5, 2, 1)
CAP = 3
#: Words of a block, about.
BLOCK_WORDS = 50_000
#: Blocks of a shard, about.
SHARD_BLOCKS = 64
#: Counts of the splitting tree that the driver draws; the rest of the tree is drawn by tasks.
TOP_CELLS = 200_000
#: Where too few documents are shorter than a block, the one that comes nearest to what is left is sought in so many
#: blocks' words of the others.
LONG_BLOCKS = 64
#: A source's blocks are ranked in so many ranges of their hash, each by itself.
RANGES = 4096
SEED = 11


def share_out(sizes: Sequence[int], weights: Sequence[float], cap: float = CAP) -> list[float]:
    """Targets that share sum(sizes) by weight; none above cap times its size, the excess reshared."""
    total, targets, free = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if total * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in free:
                targets[i] = total * weights[i] / weight
            break
        for i in over:
            targets[i] = float(cap * sizes[i])
        total -= sum(targets[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return targets


def _halved(lo: int, hi: int, own: np.ndarray, seed: int) -> tuple[int, np.ndarray]:
    """The middle of a node's shards, and its left half's share of its quotas."""
    half = (lo + hi) // 2
    left = int(round(int(own.sum()) * (half - lo) / (hi - lo)))
    return half, np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(own, left, method="marginals")


def descend(lo: int, hi: int, own: np.ndarray, start: np.ndarray, seed: int, depth: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Nodes (first shard, end, quotas, starts of their stretches) depth levels below a node, or its leaves."""
    if hi - lo == 1 or depth == 0:
        yield lo, hi, own, start
        return
    half, drawn = _halved(lo, hi, own, seed)
    yield from descend(lo, half, drawn, start, seed, depth - 1)
    yield from descend(half, hi, own - drawn, start + drawn, seed, depth - 1)


def split_quotas(quotas: Sequence[int], shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources) whole numbers: the leaves of the splitting tree. Columns add up to quotas, rows
    differ by rounding only."""
    own = np.asarray(quotas, np.int64)
    return np.stack([leaf for _, _, leaf, _ in descend(0, shards, own, np.zeros_like(own), seed)])


def leaves(spark: SparkSession, quotas: Sequence[int], shards: int, seed: int) -> DataFrame:
    """sid, pos, shard: the shard that owns each place of each source's sequence of blocks."""
    own = np.asarray(quotas, np.int64)
    depth = max(0, int(np.log2(max(1, TOP_CELLS // max(1, len(own))))))
    top = []
    for lo, hi, q, at in descend(0, shards, own, np.zeros_like(own), seed, depth) if own.sum() else ():
        some = np.nonzero(q)[0]
        top.append((lo, hi, some.tolist(), q[some].tolist(), at[some].tolist()))

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                sids = np.asarray(r.sids)
                for shard, _, q, at in descend(r.lo, r.hi, np.asarray(r.quotas, np.int64), np.asarray(r.starts, np.int64), seed):
                    some = q > 0
                    yield pd.DataFrame({"sid": sids[some].astype(np.int32), "shard": shard, "first": at[some], "n": q[some]})

    nodes = spark.createDataFrame(top, "lo int, hi int, sids array<int>, quotas array<long>, starts array<long>")
    found = nodes.repartition(max(1, min(len(top), 256))).mapInPandas(below, "sid int, shard int, first long, n long")
    return found.select("sid", "shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("pos"))


def nearest(sizes: Sequence[int], left: float, exact_below: int = 50_000) -> list[int]:
    """Positions of documents whose sizes add up to about left: taken in order while more than
    exact_below is left, then the subset of all others whose sum is nearest. Where a long document
    by itself, or after what was taken before it, comes nearer than that: these."""
    took, over = [], (float("inf"), 0, -1)  # over: words off, documents taken before, the long document
    first = left
    for k in range(len(sizes)):
        if sizes[k] > min(first, exact_below):  # by itself
            over = min(over, (abs(sizes[k] - first), 0, k))
        if left > exact_below:
            if sizes[k] > left:
                over = min(over, (sizes[k] - left, len(took), k))
            elif sizes[k] > 0:
                took.append(k)
                left -= sizes[k]
    greedy, want = list(took), int(round(left))
    if want <= exact_below:
        by = np.full(2 * want + 1, -1, np.int64)  # the document that first reached a sum; its own sum before that was reached earlier
        reached = np.zeros(2 * want + 1, bool)
        reached[0] = True
        held = set(took)
        for k in range(len(sizes)):
            n = int(sizes[k])
            if 0 < n <= 2 * want and k not in held:
                new = np.nonzero(reached[:-n] & ~reached[n:])[0] + n
                by[new], reached[new] = k, True
                if reached[want]:
                    break
        sums = np.nonzero(reached)[0]
        total = int(sums[np.argmin(np.abs(sums - want))])
        left -= total
        while total:
            took.append(int(by[total]))
            total -= int(sizes[by[total]])
    return [*greedy[: over[1]], over[2]] if over[0] < abs(left) else took


@dataclass
class Mix:
    documents: DataFrame  # _rid, doc_id, size, source_size, target, sid
    draws: DataFrame  # _rid, doc_id, epoch, shard, order, words
    sources: DataFrame  # sid, s_source and more, a row per source
    dealt: DataFrame  # sid, block, epoch, cut, shard: where each pass of each block goes
    chosen: DataFrame  # _rid of the documents that are taken of cut blocks
    quotas: list[int]  # blocks that each source gives, passes counted
    shards: int


def block_of(seed: int) -> Column:
    """A document's block, from its id and text: ids that repeat or are null don't gather in one."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.col("n_blocks")).cast("int")


def in_order(blocks: DataFrame, group: Sequence[str], order: str, sums: dict[str, str]) -> DataFrame:
    """blocks with rank (from 0) and running sums (before each row) in each group by the hash `order`.
    Ranges of the hash are ranked by themselves and shifted by what lies before them, so that no
    task holds a whole group; a group has RANGES of them."""
    at = F.floor((F.col(order) / F.lit(2.0**64) + 0.5) * RANGES).cast("int")
    b = blocks.withColumn("_at", F.least(at, F.lit(RANGES - 1)))
    inner = W.partitionBy(*group, "_at").orderBy(order, "block")
    upto = inner.rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    b = b.withColumns({"rank": F.row_number().over(inner).cast("long") - 1, **{name: F.coalesce(F.sum(c).over(upto), none) for name, c in sums.items()}})
    ranges = blocks.withColumn("_at", F.least(at, F.lit(RANGES - 1))).groupBy(*group, "_at").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    over = W.partitionBy(*group).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(*group, "_at", F.coalesce(F.sum("_n").over(over), none).alias("_n0"), *[F.coalesce(F.sum(f"_{name}").over(over), none).alias(f"_{name}0") for name in sums])
    b = b.join(ranges, [*group, "_at"])
    return b.withColumns({"rank": F.col("rank") + F.col("_n0"), **{name: F.col(name) + F.col(f"_{name}0") for name in sums}}).drop("_at", "_n0", *[f"_{name}0" for name in sums])


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: str | None = None, weights: Sequence[float] = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> Mix:
    """The mix of all rows of docs. Sources by code point, null last, weigh weights in turn.

    A null text has no words; documents without words come with their blocks and count nothing. A
    null source is a source of its own. Repeated rows are documents each, in one block. An empty table
    gives empty results. The same rows give the same mix, whatever their order.
    """
    spark = docs.sparkSession
    rid = F.col(keep) if keep else F.monotonically_increasing_id()
    d = materialize(
        docs.select(rid.alias("_rid"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), count_words(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("text_hash")), "sizes"
    )
    found = d.groupBy("source").agg(F.sum("size").alias("n")).collect()
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["n"] for r in found]
    targets = share_out(sizes, [weights[i % len(weights)] for i in range(len(sizes))], cap)
    passes = [min(cap, int(t // n)) if n else 0 for t, n in zip(targets, sizes, strict=True)]
    rest = [max(0.0, t - p * n) if n and p < cap else 0.0 for t, n, p in zip(targets, sizes, passes, strict=True)]
    n_blocks = [max(1, -(-n // block_words)) for n in sizes]
    rows = [(i, r["source"], r["n"], t, p, float(e), b) for i, (r, t, p, e, b) in enumerate(zip(found, targets, passes, rest, n_blocks, strict=True))]
    sources = spark.createDataFrame(rows, "sid int, s_source string, source_size long, target double, passes int, rest double, n_blocks long")
    d = d.join(sources, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source", "source").withColumn("block", block_of(seed))

    # blocks that hold documents, ranked in the partial pass: which come whole, and in which one the target falls
    blocks = d.groupBy("sid", "block", "passes", "rest").agg(F.sum("size").alias("words")).withColumn("turn", F.xxhash64(F.lit(seed), "passes", "block"))
    ranked = materialize(in_order(blocks, ["sid"], "turn", {"before": "words"}), "blocks")
    ranked = ranked.withColumn("part", F.when(F.col("before") + F.col("words") <= F.col("rest"), "whole").when((F.col("before") < F.col("rest")), "cut").otherwise("none"))
    # documents longer than a block may not fill what is left: later blocks are cut too until the others hold enough, or until
    # there are plenty of long ones to choose from, so that what is chosen from has a bound
    at = small(ranked.where("part = 'cut'").select(F.col("sid").alias("c_sid"), F.col("rank").alias("c_rank"), (F.col("rest") - F.col("before")).alias("left")), "cuts")
    fits = d.join(at, F.col("sid") == F.col("c_sid")).where(F.col("size") <= block_words).groupBy("sid", "block").agg(F.sum("size").alias("fit"))
    from_cut = lambda c: F.when(F.col("rank") >= F.col("c_rank"), F.coalesce(c, F.lit(0))).otherwise(0)
    ranked = ranked.join(at, F.col("sid") == F.col("c_sid"), "left").join(fits, ["sid", "block"], "left").withColumns({"fit": from_cut("fit"), "any": from_cut("words")}).drop("rank", "before")
    ranked = in_order(ranked, ["sid"], "turn", {"fit_before": "fit", "any_before": "any"})
    more = (F.col("rank") > F.col("c_rank")) & (F.col("fit_before") < F.col("left")) & (F.col("any_before") < F.col("left") + LONG_BLOCKS * block_words)
    ranked = ranked.withColumn("part", F.when(more, "cut").otherwise(F.col("part"))).drop("c_sid", "c_rank", "fit", "fit_before", "any", "any_before")
    ranked = materialize(ranked, "ranked-blocks")

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        """Documents of a source's cut blocks that come nearest to what is left: in the order of blocks and
        of their hash while much is left, then the best sum of all others."""
        rows = rows.sort_values(["rank", "key", "doc_id", "_rid"])
        took = nearest(rows["size"].to_numpy(), float(rows.left.iloc[0]))
        return pd.DataFrame({"_rid": rows._rid.to_numpy()[took]})

    cut = ranked.where("part = 'cut'").select("sid", "block", "rank", "left")
    chosen = (
        d.join(cut, ["sid", "block"]).where("size > 0").select("sid", "rank", "_rid", "doc_id", "size", "left", F.xxhash64(F.lit(seed + 1), "doc_id", "size").alias("key"))
        .groupBy("sid").applyInPandas(fill, f"_rid {d.schema['_rid'].dataType.simpleString()}").withColumn("_chosen", F.lit(True))
    )

    held = {r["sid"]: (r["n"], r["part"]) for r in ranked.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("part") == "none", 0).otherwise(1)).alias("part")).collect()}
    quotas = [p * held.get(i, (0, 0))[0] + held.get(i, (0, 0))[1] for i, p in enumerate(passes)]
    shards = max(1, -(-sum(quotas) // shard_blocks))

    # each block once per pass, at its place in its source's sequence; the leaf that owns the place draws it
    turns = F.sequence(F.lit(0), F.col("passes") - F.when(F.col("part") == "none", 1).otherwise(0))
    drawn = ranked.where((F.col("passes") > 0) | (F.col("part") != "none")).select("sid", "block", "passes", "part", F.explode(turns).alias("epoch")).withColumn("turn", F.xxhash64(F.lit(seed), "epoch", "block"))
    # of the partial pass the blocks with the least ranks come, so their ranks among themselves are the same
    drawn = in_order(drawn, ["sid", "epoch"], "turn", {})
    counts = ranked.groupBy(F.col("sid").alias("n_sid")).agg(F.count(F.lit(1)).alias("held"))
    drawn = drawn.join(counts, F.col("sid") == F.col("n_sid")).withColumn("pos", F.col("epoch") * F.col("held") + F.col("rank"))
    owned = leaves(spark, quotas, shards, seed)
    dealt = drawn.join(owned, ["sid", "pos"]).select("sid", "block", "epoch", ((F.col("part") == "cut") & (F.col("epoch") == F.col("passes"))).alias("cut"), "shard")
    dealt = materialize(dealt, "dealt")
    draws = d.join(dealt, ["sid", "block"]).join(chosen, "_rid", "left").where(~F.col("cut") | F.col("_chosen"))
    draws = draws.select("_rid", "doc_id", "epoch", "shard", F.xxhash64(F.lit(seed + 2), "shard", "epoch", "doc_id", "_rid").alias("order"), F.col("size").alias("words"))
    return Mix(d.select("_rid", "doc_id", "size", "source_size", "target", "sid"), draws, sources, dealt, chosen.select("_rid"), quotas, shards)


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mixed rows themselves, all columns of docs, a document as often as it is drawn, each shard in one
    partition and shuffled. Texts are shuffled once, to their shards: a document's block follows from its
    id and text, and what becomes of a block is a small table. A null text or source is as in mix(); names
    of docs' columns may be any; an empty table gives an empty one."""
    seed = how.get("seed", SEED)
    rows, row = numbered(docs, "mix-docs")
    rid = F.concat_ws(":", F.col(row)["f"], F.col(row)["i"])
    m = mix(rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), F.col(source).alias("s"), rid.alias("_rid")), "doc_id", "t", "s", keep="_rid", **how)
    whole = F.struct(*columns_of(docs)).alias("_doc")  # names may clash
    d = rows.select(whole, F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.xxhash64(F.col(text)).alias("text_hash"), rid.alias("_rid"))
    sources = F.broadcast(m.sources) if len(m.quotas) <= MAX_SMALL else m.sources  # a row a source
    d = d.join(sources, F.col("source").eqNullSafe(F.col("s_source"))).withColumn("block", block_of(seed))
    dealt = small(m.dealt, "dealt")
    chosen = small(m.chosen.withColumn("_chosen", F.lit(True)), "chosen")
    out = d.join(dealt, ["sid", "block"]).join(chosen, "_rid", "left").where(~F.col("cut") | F.col("_chosen"))
    out = out.select("_doc", "shard", F.xxhash64(F.lit(seed + 2), "shard", "epoch", "doc_id", "text_hash").alias("order"))
    return out.repartition("shard").sortWithinPartitions("shard", "order").select("_doc.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per document; shards has the shard of each of its draws, places its order there."""
    m = mix(table(spark, sf_dir, "documents"))
    taken = m.draws.groupBy("_rid").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "order"))).alias("at"))
    found = m.documents.join(taken, "_rid", "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("at.shard").alias("shards"), F.col("at.order").alias("places"))


QUERIES = {"op3_mixing": op3_mixing}
ORACLES: dict[str, str] = {}
