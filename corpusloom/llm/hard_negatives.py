"""Hard negatives by a dual-tree search.

Candidates are dealt into chunks, each with a tree: its upper levels part the labels, its lower ones halve
along the widest dimension. Anchors come in blocks with trees of the same kind. For two nodes, the inner
products of their rows lie in an interval about that of their centres; a pair of nodes whose interval misses
what every anchor of the one node still looks for is dropped with all its anchors and candidates, and so is
one whose labels can't be wanted. The others are opened from the most promising on, and pairs of leaves are
scored exactly, as inner products of whole numbers.

A chunk is one task's: its candidates come first, then the blocks of anchors pass by its tree one after
another, so a task holds a chunk and a block, however many anchors there are. Only anchors are copied to
the chunks. Positives are found first; their scores are the windows in which negatives are sought.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, named, table

#: Positives of an anchor, negatives of a positive.
POSITIVES = NEGATIVES = 5
#: A negative's score is within these percentages of the positive's.
LEAST_PERCENT, MOST_PERCENT = 80, 100
#: Components are multiplied by this and rounded down.
SCALE = 256
#: Rows of a chunk of candidates, of a block of anchors, about; rows of the trees' leaves, at most.
CHUNK_ROWS, BLOCK_ROWS, CANDIDATE_LEAF, ANCHOR_LEAF = 32_768, 1024, 128, 16
#: Inner products below this are exact in double precision.
_EXACT = 2.0**53


class Tree:
    """Rows in the order of the leaves; of each node its rows (first, end), children (-1: a leaf), centre, radius,
    norm of the centre, and least and greatest label."""

    def __init__(self, x: np.ndarray, label: np.ndarray, leaf: int):
        self.order = np.argsort(label, kind="stable")
        self.nodes: list[tuple[int, int, int, int]] = []
        centres, self.radius, self.low, self.high = [], [], [], []
        open_ = [(0, len(x), -1, 0)]
        while open_:
            lo, hi, parent, side = open_.pop()
            at, own = len(self.nodes), self.order[lo:hi]
            if parent >= 0:
                f, e, left, right = self.nodes[parent]
                self.nodes[parent] = (f, e, at, right) if side == 0 else (f, e, left, at)
            rows, labels = x[own], label[own]
            centre = rows.mean(0)
            centres.append(centre)
            self.radius.append(float(np.sqrt(((rows - centre) ** 2).sum(1).max())))
            self.low.append(labels.min())
            self.high.append(labels.max())
            self.nodes.append((lo, hi, -1, -1))
            if hi - lo <= leaf:
                continue
            if self.low[at] != self.high[at]:  # rows are in the order of labels down to here
                cuts = np.nonzero(np.diff(labels))[0] + 1
                cut = int(cuts[np.argmin(np.abs(cuts - (hi - lo) // 2))])
            else:
                if self.radius[at] == 0:  # equal rows: nothing tells them apart
                    continue
                cut = (hi - lo) // 2
                widest = int(rows.var(0).argmax())
                self.order[lo:hi] = own[np.argsort(rows[:, widest], kind="stable")]
            open_ += [(lo, lo + cut, at, 0), (lo + cut, hi, at, 1)]
        self.centres = np.array(centres)
        self.norms = np.sqrt((self.centres**2).sum(1))
        self.radius = np.array(self.radius)
        self.x, self.label = x[self.order], label[self.order]


class Best:
    """Of each slot the best scores so far, and their ids: the highest first, ties by smaller id. Slots belong to
    anchors (of_anchor); each takes scores from its floor to its cap."""

    def __init__(self, of_anchor: np.ndarray, floor: np.ndarray, cap: np.ndarray, k: int):
        self.of_anchor, self.floor, self.cap, self.k = of_anchor, floor, cap, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in of_anchor]

    def need(self, slot: int) -> float:
        """Scores below it are of no use."""
        own = self.found[slot]
        return max(self.floor[slot], own[-1][0]) if len(own) == self.k else self.floor[slot]

    def offer(self, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = np.nonzero((scores >= self.need(slot)) & (scores <= self.cap[slot]))[0]
        if len(ok):
            if len(ok) > 4 * self.k:  # all that tie with the k-th stay
                ok = ok[scores[ok] >= np.partition(scores[ok], -self.k)[-self.k]]
            new = zip((-scores[ok]).tolist(), ids[ok].tolist())
            self.found[slot] = [(-s, i) for s, i in heapq.nsmallest(self.k, [*((-s, i) for s, i in self.found[slot]), *new])]


def search(anchors: Tree, candidates: Tree, anchor_rows: np.ndarray, candidate_rows: np.ndarray, ids: np.ndarray, best: Best, same_label: bool) -> int:
    """Fill best's slots from the candidates; the number of pairs of leaves that were scored. Row numbers tell an anchor
    from itself; ids break ties."""
    slots: list[list[int]] = [[] for _ in anchor_rows]
    for s, a in enumerate(best.of_anchor.tolist()):
        slots[a].append(s)
    of = [slots[i] for i in anchors.order.tolist()]
    rows_a, rows_c, ids_c = anchor_rows[anchors.order], candidate_rows[candidates.order], ids[candidates.order]
    caps = np.array([max((best.cap[s] for s in own), default=-np.inf) for own in of])
    needs = np.array([min((best.need(s) for s in own), default=np.inf) for own in of])
    exact = float(np.abs(anchors.x).sum(1).max()) * float(np.abs(candidates.x).max()) < _EXACT
    scored = 0

    def interval(a: int, c: int) -> tuple[float, float]:
        mid = float(anchors.centres[a] @ candidates.centres[c])
        off = anchors.radius[a] * candidates.norms[c] + candidates.radius[c] * anchors.norms[a] + anchors.radius[a] * candidates.radius[c]
        off += 1 + 1e-9 * (abs(mid) + anchors.norms[a] * candidates.norms[c])  # rounding
        return mid - off, mid + off

    def wanted(a: int, c: int, low: float, high: float) -> bool:
        apart = anchors.high[a] < candidates.low[c] or candidates.high[c] < anchors.low[a]
        one = anchors.low[a] == anchors.high[a] == candidates.low[c] == candidates.high[c]
        if apart if same_label else one:
            return False
        lo, hi, _, _ = anchors.nodes[a]
        return high >= needs[lo:hi].min() and low <= caps[lo:hi].max()

    heap = []

    def push(a: int, c: int) -> None:
        low, high = interval(a, c)
        if wanted(a, c, low, high):
            heapq.heappush(heap, (-high, a, c, low))

    if len(rows_a) and len(rows_c):
        push(0, 0)
    while heap:
        high, a, c, low = heapq.heappop(heap)
        if not wanted(a, c, low, -high):
            continue
        (alo, ahi, aleft, aright), (clo, chi, cleft, cright) = anchors.nodes[a], candidates.nodes[c]
        if aleft >= 0 and (cleft < 0 or anchors.radius[a] * candidates.norms[c] > candidates.radius[c] * anchors.norms[a]):
            push(aleft, c)
            push(aright, c)
        elif cleft >= 0:
            push(a, cleft)
            push(a, cright)
        else:
            scored += 1
            x, y = anchors.x[alo:ahi], candidates.x[clo:chi]
            scores = (x @ y.T).astype(np.int64) if exact else x.astype(np.int64) @ y.astype(np.int64).T
            fit = (anchors.label[alo:ahi, None] == candidates.label[None, clo:chi]) == same_label
            fit &= rows_a[alo:ahi, None] != rows_c[None, clo:chi]
            of_use = fit & (scores >= needs[alo:ahi, None]) & (scores <= caps[alo:ahi, None])
            for k in np.nonzero(of_use.any(1))[0].tolist():
                mine = of_use[k]
                for s in of[alo + k]:
                    best.offer(s, scores[k][mine], ids_c[clo:chi][mine])
                needs[alo + k] = min((best.need(s) for s in of[alo + k]), default=np.inf)
    return scored


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def _search_chunks(same_label: bool, k: int) -> Callable:
    """Rows come in the order of chunks; in a chunk candidates (block -1) first, then the blocks of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidates: tuple[Tree, np.ndarray, np.ndarray] | None = None

        def block(rows: pa.Table) -> pa.RecordBatch | None:
            nonlocal candidates
            dims = rows["dims"][0].as_py()
            x, label, row, ident = _vectors(rows["x"].combine_chunks(), dims), rows["label"].to_numpy(), rows["row"].to_numpy(), rows["vec_id"].to_numpy()
            if rows["block"][0].as_py() < 0:
                candidates = Tree(x, label, CANDIDATE_LEAF), row, ident
                return None
            if candidates is None:
                return None
            windows = rows["windows"].to_pylist()
            of, slot, floor, cap = (np.array(v, np.int64) for v in zip(*((a, w["slot"], w["floor"], w["cap"]) for a, own in enumerate(windows) for w in own)))
            best = Best(of, floor, cap, k)
            search(Tree(x, label, ANCHOR_LEAF), candidates[0], row, candidates[1], candidates[2], best, same_label)
            found = [(row[of[s]], slot[s], score, i) for s, own in enumerate(best.found) for score, i in own]
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * 4
            return pa.RecordBatch.from_arrays(columns, names=["row", "slot", "score", "found_id"])

        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            names = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("dims", "chunk", "block")])
            cuts = [0, *(np.nonzero((np.diff(names) != 0).any(0))[0] + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                at = tuple(names[:, lo].tolist())
                if at != now and held:
                    out = block(pa.Table.from_batches(held))
                    if out is not None:
                        yield out
                    held = []
                if now is None or at[:2] != now[:2]:
                    candidates = None  # of another chunk
                now = at
                held.append(batch.slice(lo, hi - lo))
        if held:
            out = block(pa.Table.from_batches(held))
            if out is not None:
                yield out

    return run


def _passed(candidates: DataFrame, anchors: DataFrame, chunks: int, same_label: bool, k: int) -> DataFrame:
    """row, slot, score, found_id: each anchor's k best of every chunk, by its windows (slot, floor, cap)."""
    windows = "array<struct<slot: int, floor: long, cap: long>>"
    home = candidates.select("dims", F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk"), F.lit(-1).cast("long").alias("block"), "row", "vec_id", "label", "x", F.lit(None).cast(windows).alias("windows"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk")
    come = anchors.select("dims", every, "block", "row", "vec_id", "label", "x", "windows")
    together = home.union(come)
    parts = max(chunks, int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = together.repartition(parts, "dims", "chunk").sortWithinPartitions("dims", "chunk", "block")
    return dealt.mapInArrow(_search_chunks(same_label, k), "row long, slot long, score long, found_id long")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "found_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: str = "is_anchor", vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of components times SCALE, rounded down. An anchor's positives are its first POSITIVES
    other rows of its label by score, ties by smaller id; each positive has the first NEGATIVES rows of other labels
    whose score is LEAST_PERCENT to MOST_PERCENT of the positive's. Fewer, where there are not so many; a positive
    of a score below 0 has none.

    Rows take no part if their id or label is null, or their vector is null, empty or holds null or non-finite
    components. Vectors of different lengths are not compared. Rows that repeat an id, or all of a row, count each, as
    anchors too. Other columns are not looked at, whatever their names; an empty table gives an empty table. Ids and
    labels are whole numbers; products must be within 64 bits.
    """
    v = vectors.select(named(vec_id).cast("long").alias("vec_id"), named(label).cast("long").alias("label"), named(embedding).cast("array<double>").alias("e"), named(is_anchor).alias("anchor"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & ~bad)
    v = v.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.coalesce("anchor", F.lit(False)).alias("anchor"), F.size("e").cast("long").alias("dims"), "e")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ends = np.floor(SCALE * b.column("e").flatten().to_numpy()), np.cumsum([0, *b.column("dims").to_pylist()])
            packed = pa.array([x[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("row", "vec_id", "label", "anchor", "dims")), packed], names=["row", "vec_id", "label", "anchor", "dims", "x"])

    rows = materialize(v.mapInArrow(whole, "row long, vec_id long, label long, anchor boolean, dims long, x binary"), "vectors")
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    chunks, blocks = max(1, -(-n // chunk_rows)), max(1, -(-n_anchors // block_rows))
    anchors = rows.where("anchor").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))

    any_score = F.array(F.struct(F.lit(0).alias("slot"), F.lit(-(2**63)).alias("floor"), F.lit(2**63 - 1).alias("cap")))
    positives = _first(_passed(rows, anchors.withColumn("windows", any_score), chunks, True, POSITIVES), ["row"], POSITIVES)
    positives = materialize(positives.select("row", F.col("rank").alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    score = F.col("positive_score")
    # 80 p <= 100 n in whole numbers; the remainder keeps products small
    floor = F.expr(f"positive_score div 100 * {LEAST_PERCENT} + CAST(ceil((positive_score % 100) * {LEAST_PERCENT} / 100) AS LONG)")
    cap = F.expr(f"positive_score div 100 * {MOST_PERCENT} + CAST(floor((positive_score % 100) * {MOST_PERCENT} / 100) AS LONG)")
    sought = positives.where(score >= 0).groupBy(F.col("row").alias("r")).agg(F.collect_list(F.struct("slot", floor.alias("floor"), cap.alias("cap"))).alias("windows"))  # POSITIVES at most
    negatives = _first(_passed(rows, anchors.join(sought, F.col("row") == F.col("r")).drop("r"), chunks, False, NEGATIVES), ["row", "slot"], NEGATIVES)
    named_ = rows.where("anchor").select(F.col("row").alias("a"), F.col("vec_id").alias("anchor_id"))
    out = negatives.join(positives.withColumnsRenamed({"row": "p", "slot": "s"}), (F.col("row") == F.col("p")) & (F.col("slot") == F.col("s"))).join(named_, F.col("row") == F.col("a"))
    return out.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(v.select("vec_id", "embedding", moved.alias("label"), (F.col("vec_id") % 100 == 0).alias("is_anchor")))


SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.alike AND {LEAST_PERCENT} * p.positive_score <= 100 * s.score AND 100 * s.score <= {MOST_PERCENT} * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= {NEGATIVES}"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {"op12_hard_negatives": SQL}
