"""Polygons as rings: reading, dissolving by a column, and simplifying.

Dissolving needs no plane sweep where neighbours share their borders' vertices: outer rings run counter-clockwise and
holes clockwise, so a border within a group is there once in each direction, and an aggregate over edges cancels it. What
is left is stitched to rings again, in tasks of rings that hang together.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.files import staged

POINTS = "array<struct<x:double,y:double>>"


def _wkb_rings(data: bytes) -> Iterator[tuple[int, int, list[dict]]]:
    """(part, ring, points) of a polygon or several in well-known binary; heights and measures are left out."""
    at = 0

    def take(kind: str, order: str):
        nonlocal at
        out = struct.unpack_from(order + kind, data, at)
        at += struct.calcsize(order + kind)
        return out

    def head() -> tuple[str, int, int]:
        order = "<" if take("B", "<")[0] else ">"
        (kind,) = take("I", order)
        more = (kind >= 0x80000000) + (kind >> 30 & 1) if kind >= 0x40000000 else {0: 0, 1: 1, 2: 1, 3: 2}[kind // 1000 % 4]
        if kind & 0x20000000:
            take("I", order)
        return order, (kind & 0xFFFF) % 1000, 2 + more

    order, kind, width = head()
    parts = [(order, width)] if kind == 3 else None
    if kind not in (3, 6):
        raise ValueError(f"geometry of kind {kind} is no polygon")
    for part in range(1 if parts else take("I", order)[0]):
        if not parts:
            order, _, width = head()
        for ring in range(take("I", order)[0]):
            (n,) = take("I", order)
            flat = take(f"{n * width}d", order)
            yield part, ring, [{"x": flat[k], "y": flat[k + 1]} for k in range(0, n * width, width)]


def rings_of(features: DataFrame, wkb: str = "geometry") -> DataFrame:
    """features without their geometry, and part, ring (0 is the outer one), points, a row a ring: outer rings counter-
    clockwise, holes clockwise, closed. A null geometry has no rings."""
    kept = [f for f in features.schema.fields if f.name != wkb]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema = features.select(*[f.name for f in kept]).limit(0).toArrow().schema
    point = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, *r) for k, g in enumerate(b.column(wkb)) if g.as_py() is not None for r in _wkb_rings(g.as_py())]
            rows = pa.array([r[0] for r in found], pa.int64())
            columns = [b.column(f.name).take(rows) for f in kept] + [pa.array([r[i] for r in found], k) for i, k in ((1, pa.int32()), (2, pa.int32()), (3, point))]
            yield pa.RecordBatch.from_arrays(columns, names=[*schema.names, "part", "ring", "points"])

    return turned(features.mapInArrow(run, f"{kinds}, part int, ring int, points {POINTS}"))


def signed_area(points: Column) -> Column:
    """Of a closed ring; positive if it runs counter-clockwise."""
    cross = F.zip_with(points, F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda p, q: F.coalesce(p["x"] * q["y"] - q["x"] * p["y"], F.lit(0.0)))
    return F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2


def turned(rings: DataFrame) -> DataFrame:
    """Closed rings, outer ones (ring is 0) counter-clockwise, others clockwise."""
    closed = F.when(F.get("points", F.lit(0)) == F.element_at("points", -1), F.col("points")).otherwise(F.concat("points", F.slice("points", 1, 1)))
    rings = rings.withColumn("points", closed)
    right = (signed_area(F.col("points")) >= 0) == (F.col("ring") == 0)
    return rings.withColumn("points", F.when(right, F.col("points")).otherwise(F.reverse("points")))


def _apart(df: DataFrame) -> DataFrame:
    """df, joined by a shuffle: it has a row a ring, whose numbers make small files and large tables, which would go through the
    driver once a round."""
    return df.hint("merge")


def _clusters(rings: DataFrame, touching: DataFrame) -> DataFrame:
    """uid, cluster: the least uid of those that hang together by touching (a, b)."""
    both = staged(touching.union(touching.select("b", "a")).distinct())
    now = staged(rings.select("uid", F.col("uid").alias("cluster")))
    while True:
        near = both.join(_apart(now), F.col("b") == F.col("uid")).groupBy("a").agg(F.min("cluster").alias("least"))
        step = now.join(_apart(near), F.col("uid") == F.col("a"), "left").select("uid", F.least("cluster", F.coalesce("least", "cluster")).alias("cluster"))
        jump = step.select(F.col("uid").alias("u"), F.col("cluster").alias("far"))
        new = staged(step.join(_apart(jump), F.col("cluster") == F.col("u")).select("uid", "far").withColumnRenamed("far", "cluster"))
        if new.join(_apart(now.select(F.col("uid").alias("v"), F.col("cluster").alias("was"))), F.col("uid") == F.col("v")).where("cluster <> was").isEmpty():
            return new
        now = new


def dissolved(rings: DataFrame, by: str) -> DataFrame:
    """by, hole, area, points: the rings of each group's union, from rings (by, ring, points) of polygons that do not overlap and
    share the vertices of common borders. A null group is a group."""
    rings = staged(rings.select(F.monotonically_increasing_id().alias("uid"), F.col(by).alias("g"), "points").where(F.size("points") > 3))
    edges = rings.select("uid", "g", F.explode(F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("p"), F.slice("points", 2, F.size("points") - 1).alias("q"))).alias("e")).select("uid", "g", "e.p", "e.q").where("p <> q")
    along = F.col("p") < F.col("q")
    tallied = edges.groupBy("g", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).agg(F.sum(F.when(along, 1).otherwise(-1)).alias("net"), F.min("uid").alias("a"), F.max("uid").alias("b"))
    tallied = staged(tallied)
    clusters = _clusters(rings, tallied.where("a <> b").select("a", "b"))
    left = tallied.where("net <> 0").join(_apart(clusters), F.col("a") == F.col("uid")).select("g", "cluster", F.when(F.col("net") > 0, F.col("lo")).otherwise(F.col("hi")).alias("p"), F.when(F.col("net") > 0, F.col("hi")).otherwise(F.col("lo")).alias("q"))
    kind = rings.schema["g"].dataType.simpleString()
    like = rings.select("g").limit(0).toArrow().schema.field("g").type
    point = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def stitch(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        at: dict[tuple, list[tuple]] = {}
        for p, q in zip(rows["p"].to_pylist(), rows["q"].to_pylist()):
            at.setdefault((p["x"], p["y"]), []).append((q["x"], q["y"]))
        found = []
        while at:
            first = min(at)
            ring, here, heading = [first], first, 0.0
            while True:
                ways = at[here]
                # what lies to the left is inside: where rings meet, the sharpest turn to the left stays on this one
                turn = lambda q: (math.atan2(q[1] - here[1], q[0] - here[0]) - heading + math.pi) % (2 * math.pi)  # noqa: E731, B023
                to = max(ways, key=turn) if len(ring) > 1 else ways[0]
                ways.remove(to)
                if not ways:
                    del at[here]
                heading = math.atan2(to[1] - here[1], to[0] - here[0])
                ring.append(to)
                here = to
                if here == first or here not in at:
                    break
            found.append([{"x": x, "y": y} for x, y in ring])
        return pa.table({"g": pa.array([rows["g"][0].as_py()] * len(found), like), "points": pa.array(found, point)})

    out = left.groupBy("cluster").applyInArrow(stitch, f"g {kind}, points {POINTS}")
    area = signed_area(F.col("points"))
    return out.select(F.col("g").alias(by), (area < 0).alias("hole"), F.abs(area).alias("area"), "points")


def _kept(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay so that none is further than tolerance from what is left."""
    keep = np.zeros(len(xy), bool)
    keep[[0, -1]] = True
    open_ = [(0, len(xy) - 1)]
    while open_:
        i, j = open_.pop()
        if j - i < 2:
            continue
        d, inner = xy[j] - xy[i], xy[i + 1 : j] - xy[i]
        length = math.hypot(*d)
        if length == 0:
            off = np.hypot(*inner.T)
        else:  # from the piece between its ends, not the line through them
            t = np.clip(inner @ d / length**2, 0, 1)
            off = np.hypot(*(inner - t[:, None] * d).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[i + 1 + k] = True
            open_ += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep


def simplified(rings: DataFrame, tolerance: float, keep_all: bool = False) -> DataFrame:
    """rings with fewer points, none of which is further than tolerance from the ring it was. A ring that collapses goes, or
    stays as it is with keep_all. Each ring by itself: simplify after dissolving, as neighbours' borders may part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, rows = [], []
            for k, points in enumerate(b.column("points").to_pylist()):
                xy = np.array([(p["x"], p["y"]) for p in points or []]).reshape(-1, 2)
                if len(xy) < 4:
                    continue
                far = int(np.hypot(*(xy - xy[0]).T).argmax())
                keep = np.concatenate([_kept(xy[: far + 1], tolerance), _kept(xy[far:], tolerance)[1:]])
                new = xy[keep]
                area = (new[:-1, 0] * new[1:, 1] - new[1:, 0] * new[:-1, 1]).sum()
                if len(new) < 4 or area == 0:
                    if not keep_all:
                        continue
                    new = xy
                rows.append(k)
                out.append([{"x": x, "y": y} for x, y in new.tolist()])
            columns = {f.name: b.column(f.name).take(pa.array(rows, pa.int64())) for f in b.schema} | {"points": pa.array(out, b.schema.field("points").type)}
            yield pa.RecordBatch.from_pydict(columns, schema=b.schema)

    return rings.mapInArrow(run, rings.schema)
