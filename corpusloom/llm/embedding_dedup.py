"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks of dimensions. Two vectors within the squared
distance that belongs to the least cosine are, in at least one block, within that block's share of
it, so a range join of each block under its share finds every pair; pairs found are verified
exactly, as cosines of the original vectors in double precision. A pair is counted in the first
block only that finds it, so blocks need not be merged.

A block's range join uses a grid over some of its dimensions: a vector is at home in its cell and
visits the cells that its ball reaches. Large cells are cut into chunks of homes and of visitors,
so no task holds an unbounded cell; within a chunk a matrix product rules out nearly all pairs. Equal
vectors are collapsed first. Only counts per vector and the edges of a spanning forest of each chunk
leave a task; no list of all pairs is ever made. Vectors are scaled by powers of two, which is exact,
so that neither tiny nor huge components spoil a norm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import connected_components, materialize, table

LEAST_COSINE = 0.93
#: Dimensions of a block, about.
BLOCK_DIMS = 16
#: Vectors that a cell should hold, and at most, about, a chunk; a grid gets a dimension for every fourfold of it that the largest label has.
CELL_ROWS = CHUNK_ROWS = 8192
#: Visitors of a chunk that are held against its homes at a time.
STRIP = 512
SEED = 5
_EPS = 1e-9
#: Room for single precision in the squared distances of the first test.
_ROUGH = 1e-5


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def block_bounds(dims: int) -> list[tuple[int, int]]:
    n = max(1, round(dims / BLOCK_DIMS))
    cuts = [round(i * dims / n) for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to between 1/2 and 1: exact."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def turned(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated, of scaled rows."""
    return x / np.sqrt((x * x).sum(-1, keepdims=True)) @ turn


def cells_of(x: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, their cells, whether these are their homes): every cell that the ball around a row reaches. Cells are two
    radii wide, so a ball reaches the nearer neighbour at most in each dimension."""
    width = 2 * radius
    home = np.floor(x / width).astype(np.int64)
    into = x - home * width
    side, off = np.where(into < radius, -1, 1), np.minimum(into, width - into) ** 2
    for mask in range(1 << x.shape[1]):
        bits = np.array([mask >> d & 1 for d in range(x.shape[1])], np.int64)
        rows = np.nonzero(off @ bits <= radius * radius)[0]
        yield rows, home[rows] + side[rows] * bits, mask == 0


def pairs_within(h: np.ndarray, v: np.ndarray, bounds: list[tuple[int, int]], block: int, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (home, visitor) whose distance is within the budget in this block and in no earlier one. h and v are
    turned rows. The verdict on a pair does not hang on what else is in the chunk."""
    share = [budget * (hi - lo) / bounds[-1][1] + _EPS for lo, hi in bounds]
    lo, hi = bounds[block]
    x, y = h[:, lo:hi], v[:, lo:hi]
    one = lambda m: np.ones((len(m), 1))
    square = lambda m: (m * m).sum(1, keepdims=True)
    rough = np.hstack([-2 * x, square(x), one(x)]).astype(np.float32) @ np.hstack([y, one(y), square(y)]).astype(np.float32).T
    i, j = np.nonzero(rough <= np.float32(share[block] + _ROUGH))
    for b in (block, *range(block)):
        lo, hi = bounds[b]
        near = np.concatenate([((h[i[k : k + 50_000], lo:hi] - v[j[k : k + 50_000], lo:hi]) ** 2).sum(1) for k in range(0, max(1, len(i)), 50_000)]) <= share[b]
        ok = near if b == block else ~near
        i, j = i[ok], j[ok]
    return i, j


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: links are pairs with equal labels that are not
    null and a cosine of at least `least` in double precision.

    A vector that is null, empty or zero, or holds null or non-finite components, links with nothing,
    nor do vectors of different lengths. Equal vectors of one label are linked with each other. Rows
    that repeat a vec_id are vectors of their own which share the component of their id. Other columns
    are not looked at; an empty table gives an empty table. Components are of vec_id, which must be a
    number or text that is one.
    """
    budget = 2 - 2 * least
    kind = vectors.schema[label].dataType.simpleString()
    v = vectors.select(F.monotonically_increasing_id().alias("_rid"), F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("e"))
    bad = F.coalesce(F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) | ~F.coalesce(F.exists("e", lambda x: x != 0), F.lit(False))
    fit = ~bad & F.col("label").isNotNull()
    # -0.0 and 0.0 are one value
    v = v.withColumn("fit", fit).withColumn("e", F.when(F.col("fit"), F.transform("e", lambda x: x + F.lit(0.0)))).withColumn("print", F.when(F.col("fit"), F.sha2(F.array_join("e", ",").cast("binary"), 256)))
    v = materialize(v, "vectors")
    # one member for each distinct vector of a label; a hot vector's copies are counted map-side
    classes = v.where("fit").groupBy("label", "print").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"), F.min("_rid").alias("rep"))
    reps = materialize(v.select("_rid", "e", F.size("e").alias("dims")).join(classes.select("rep", "label", "copies", "first"), F.col("_rid") == F.col("rep")).drop("_rid"), "distinct-vectors")
    shapes = reps.groupBy("dims", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("dims").agg(F.max("n").alias("n")).collect()  # lengths of vectors: a few
    grid = {r["dims"]: max(0, min(*(h - l for l, h in block_bounds(r["dims"])), math.ceil(math.log(max(1, r["n"]) / CELL_ROWS, 4)))) if r["dims"] > 1 else 0 for r in shapes}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = {n: rotation(n) for n in grid}
        for batch in batches:
            sizes = batch.column("dims").to_numpy()
            for dims in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == dims))
                x = scaled(own.column("e").flatten().to_numpy().reshape(-1, dims))
                y, raw = turned(x, turns[dims]), pa.array([r.tobytes() for r in x], pa.binary())
                for b, (lo, hi) in enumerate(block_bounds(dims)):
                    radius = math.sqrt(budget * (hi - lo) / dims) + _EPS
                    for rows, cells, home in cells_of(y[:, lo : lo + grid[dims]], radius):
                        names = pa.array([np.array([dims, b, *c], np.int32).tobytes() for c in cells], pa.binary())
                        at = pa.array(rows)
                        kept = [own.column(n).take(at) for n in ("rep", "label", "copies", "first")]
                        yield pa.RecordBatch.from_arrays([names, pa.array([home] * len(rows), pa.bool_()), *kept, raw.take(at)], names=["cell", "home", "rep", "label", "copies", "first", "e"])

    placed = reps.select("rep", "e", "dims", "label", "copies", "first").mapInArrow(spread, f"cell binary, home boolean, rep long, label {kind}, copies long, first long, e binary")
    placed = materialize(placed, "placed")
    full = placed.groupBy(F.col("cell").alias("c"), F.col("label").alias("l")).agg(
        F.ceil(F.sum(F.when(F.col("home"), 1).otherwise(0)) / CHUNK_ROWS).cast("int").alias("nh"), F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("nv")
    )
    full = full.where("nh > 0")  # a cell without homes needs no visitors
    sized = placed.join(full, (F.col("cell") == F.col("c")) & (F.col("label") == F.col("l"))).drop("c", "l")
    at_home = sized.where("home").withColumn("i", F.pmod(F.xxhash64("rep"), "nh")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nv") - 1))).withColumn("host", F.lit(True))
    visiting = sized.withColumn("j", F.pmod(F.xxhash64("rep"), "nv")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nh") - 1))).withColumn("host", F.lit(False))
    names = ["cell", "label", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "host", "rep", "copies", "first", "e"]

    def link(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Per home its links (copies counted), and edges that span what is linked here."""
        dims, block, *_ = np.frombuffer(key[0].as_py(), np.int32).tolist()
        homes, visitors = rows.filter(rows["host"]), rows.filter(pc.invert(rows["host"]))
        counted, edges = (np.zeros(0, np.int64), np.zeros(0, np.int64)), []
        if homes.num_rows and visitors.num_rows:
            hx, vx = (np.frombuffer(b"".join(t["e"].to_pylist()), np.float64).reshape(-1, dims) for t in (homes, visitors))
            bounds, turn = block_bounds(dims), rotation(dims)
            hy, vy = turned(hx, turn), turned(vx, turn)
            hn, vn = np.sqrt((hx * hx).sum(1)), np.sqrt((vx * vx).sum(1))
            (hr, hf), (vr, vf, vc) = ([t[n].to_numpy() for n in names] for t, names in ((homes, ("rep", "first")), (visitors, ("rep", "first", "copies"))))
            parent: dict[int, int] = {}

            def root(a: int) -> int:
                while parent.setdefault(a, a) != a:
                    parent[a] = a = parent[parent[a]]
                return a

            counts = np.zeros(len(hr), np.int64)
            for lo in range(0, len(vr), STRIP):
                i, j = pairs_within(hy, vy[lo : lo + STRIP], bounds, block, budget)
                j = j + lo
                apart = hr[i] != vr[j]
                i, j = i[apart], j[apart]
                for k in range(0, len(i), 50_000):
                    a, b = i[k : k + 50_000], j[k : k + 50_000]
                    ok = (hx[a] * vx[b]).sum(1) / (hn[a] * vn[b]) >= least
                    a, b = a[ok], b[ok]
                    np.add.at(counts, a, vc[b])
                    for p, q in zip(hf[a].tolist(), vf[b].tolist()):
                        x, y = root(p), root(q)
                        if x != y:
                            parent[max(x, y)] = min(x, y)
                            edges.append((p, q))
            counted = hr[counts > 0], counts[counts > 0]
        n, m = len(counted[0]), len(edges)
        ends = np.array(sorted(edges), np.int64).reshape(-1, 2)
        padded = [pa.concat_arrays([pa.array(c, pa.int64()), pa.nulls(m, pa.int64())]) for c in counted] + [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(c, pa.int64())]) for c in ends.T]
        return pa.table(padded, names=["rep", "n", "a", "b"])

    found = at_home.select(*names).union(visiting.select(*names)).groupBy("cell", "label", "i", "j").applyInArrow(link, "rep long, n long, a long, b long")
    found = materialize(found, "links")
    counts = found.where("rep is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    links = reps.select(F.col("rep").alias("r"), "copies").join(counts, F.col("r") == F.col("rep"), "left").select(F.col("r"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    components = connected_components(found.where("a is not null").select("a", "b"))
    # copies hang under the first of their class, classes under their component
    of = classes.select(F.col("label").alias("l"), F.col("print").alias("p"), "rep", F.col("first")).join(components, F.col("first") == F.col("node"), "left").join(links, F.col("rep") == F.col("r"))
    of = of.select("l", "p", "n_links", F.coalesce("component", "first").alias("component"))
    out = v.select("vec_id", "label", "print").join(of, (F.col("label") == F.col("l")) & (F.col("print") == F.col("p")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {LEAST_COSINE}
), reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a"""

QUERIES = {"op10_embedding_dedup": op10_embedding_dedup}
ORACLES = {"op10_embedding_dedup": SQL}
