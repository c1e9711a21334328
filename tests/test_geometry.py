"""Polygons: well-known binary, dissolving against brute force on a grid, simplifying."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import geometry as G


def polygon(*rings, order="<", z=False):
    flag = b"\x01" if order == "<" else b"\x00"
    body = struct.pack(order + "I", len(rings))
    for r in rings:
        body += struct.pack(order + "I", len(r)) + b"".join(struct.pack(order + ("3d" if z else "2d"), *p, *([9.0] if z else [])) for p in r)
    return flag + struct.pack(order + "I", 1003 if z else 3) + body


def several(*polygons):
    return b"\x01" + struct.pack("<II", 6, len(polygons)) + b"".join(polygons)


def square(x, y, n=1):
    return [(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)]


def test_rings_of_well_known_binary(spark):
    clockwise = square(0, 0, 4)[::-1]
    rows = [(1, polygon(clockwise, square(1, 1, 1))), (2, several(polygon(square(5, 5), order=">"), polygon(square(8, 8), z=True))), (3, None)]
    out = sorted(G.rings_of(spark.createDataFrame(rows, "id long, geometry binary")).withColumn("area", G.signed_area(F.col("points"))).collect())
    assert [(r.id, r.part, r.ring, r.area) for r in out] == [(1, 0, 0, 16.0), (1, 0, 1, -1.0), (2, 0, 0, 1.0), (2, 1, 0, 1.0)]
    with pytest.raises(Exception, match="no polygon"):
        G.rings_of(spark.createDataFrame([(1, b"\x01" + struct.pack("<I2d", 1, 0, 0))], "id long, geometry binary")).collect()


def test_two_adjoining_squares_become_one_ring(spark):
    rows = [("a", polygon(square(0, 0))), ("a", polygon(square(1, 0)[::-1])), ("b", polygon(square(2, 0))), (None, polygon(square(9, 9)))]
    out = G.dissolved(G.rings_of(spark.createDataFrame(rows, "g string, geometry binary")), "g").collect()
    assert sorted((r.g or "", r.hole, r.area, len(r.points)) for r in out) == [("", False, 1.0, 5), ("a", False, 2.0, 7), ("b", False, 1.0, 5)]
    ring = next(r.points for r in out if r.g == "a")
    assert ring[0] == ring[-1] and {(p.x, p.y) for p in ring} == {(0, 0), (1, 0), (2, 0), (2, 1), (1, 1), (0, 1)}


def test_areas_of_random_grids_equal_brute_force(spark):
    rng = random.Random(5)
    cells = {(x, y): rng.choice("abc") for x in range(14) for y in range(14) if rng.random() < 0.9}
    rows = [(g, polygon(square(x, y))) for (x, y), g in cells.items()]
    rng.shuffle(rows)
    out = G.dissolved(G.rings_of(spark.createDataFrame(rows, "g string, geometry binary")), "g").collect()
    for g in "abc":
        own = {c for c, k in cells.items() if k == g}
        rings = [r for r in out if r.g == g]
        assert sum(-r.area if r.hole else r.area for r in rings) == len(own)
        assert sum(len(r.points) - 1 for r in rings) == sum((x + a, y + b) not in own for x, y in own for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        seen, pieces = set(), 0  # pieces that hang together by sides
        for c in own:
            if c not in seen:
                pieces, todo = pieces + 1, [c]
                while todo:
                    x, y = todo.pop()
                    if (x, y) not in seen:
                        seen.add((x, y))
                        todo += [n for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if n in own]
        assert sum(not r.hole for r in rings) == pieces
        assert all(r.points[0] == r.points[-1] for r in rings)


def test_simplified_rings_stay_within_the_tolerance(spark):
    rng = random.Random(2)
    circle = [(10 * math.cos(t / 200 * math.tau) + rng.uniform(-0.02, 0.02), 10 * math.sin(t / 200 * math.tau)) for t in range(200)]
    rows = [(1, polygon([*circle, circle[0]])), (2, polygon(square(0, 0))), (3, polygon([(0, 0), (0.01, 0), (0.01, 0.01), (0, 0)])), (4, polygon([(0, 0), (1, 0), (2, 0), (2, 2), (0, 2), (0, 0)]))]
    rings = G.rings_of(spark.createDataFrame(rows, "id long, geometry binary"))
    out = {r.id: r.points for r in G.simplified(rings, 0.2).collect()}
    assert set(out) == {1, 2, 4} and len(out[1]) < 40 and len(out[2]) == 5 and len(out[4]) == 5

    def off(p, a, b):
        d = (b[0] - a[0], b[1] - a[1])
        t = max(0, min(1, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / (d[0] ** 2 + d[1] ** 2)))
        return math.hypot(p[0] - a[0] - t * d[0], p[1] - a[1] - t * d[1])

    left = [(p.x, p.y) for p in out[1]]
    assert max(min(off(p, a, b) for a, b in zip(left, left[1:])) for p in circle) <= 0.2 + 1e-9
    assert {r.id for r in G.simplified(rings, 0.2, keep_all=True).collect()} == {1, 2, 3, 4}
