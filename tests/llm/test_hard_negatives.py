"""op12 against SQL and against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives as h

KIND = "vec_id long, label int, embedding array<float>, is_anchor boolean"


def all_pairs(rows):
    fit = [(i, l, [math.floor(256 * float(x)) for x in e], a) for i, l, e, a in rows if None not in (i, l, e) and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for k, (i, l, e, a) in enumerate(fit):
        if not a:
            continue
        scores = [(-sum(x * y for x, y in zip(e, f)), j, m) for n, (j, m, f, _) in enumerate(fit) if n != k and len(f) == len(e)]
        for p, pid, _ in sorted(s for s in scores if s[2] == l)[:5]:
            near = sorted((s, j) for s, j, m in scores if m != l and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(i, pid, r, j, -p, -s) for r, (s, j) in enumerate(near, 1)]
    return sorted(out)


def some_rows(seed, n, dims=6, labels=4, clustered=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims)) * (2 if clustered else 0)
    label = rng.integers(labels, size=n)
    x = (centres[label] + rng.normal(size=(n, dims)) * 0.5).astype(np.float32)
    return [(i, int(label[i]), x[i].tolist(), i % 9 == 0) for i in range(n)]


@pytest.mark.parametrize("seed, chunk_rows, block_rows", [(1, 10_000, 1024), (2, 60, 10), (3, 7, 3)])
def test_chunks_and_blocks_match_all_pairs(spark, seed, chunk_rows, block_rows):
    rows = some_rows(seed, 300, clustered=seed != 3)
    got = h.mine(spark.createDataFrame(rows, KIND), chunk_rows=chunk_rows, block_rows=block_rows)
    assert sorted(map(tuple, got.collect())) == all_pairs(rows)


def test_ties_copies_and_odd_rows(spark):
    rng = random.Random(4)
    few = [[rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)] for _ in range(6)]
    rows = [(i, rng.randrange(3), rng.choice(few), i % 5 == 0) for i in range(150)] + [(7, 1, few[0], True)] * 12  # equal rows, anchors too
    rows += [(200, None, few[0], True), (201, 1, None, True), (202, 1, [1.0, None, 0.0], True), (203, 1, [float("nan"), 1.0, 1.0], True), (204, 1, [float("inf")] * 3, True), (205, 1, [], True), (None, 1, few[1], True)]
    rows += [(300 + i, i % 2, [1.0, 0.5], i == 0) for i in range(8)] + [(400, 3, [0.0, 0.0, 0.0], True), (401, 3, [0.0, 0.0, 0.0], None)]  # another length; zeros
    docs = spark.createDataFrame(rows, KIND).withColumns({"row": F.lit(1), "chunk": F.lit(2), "score": F.lit("s"), "a.b": F.lit(3)})
    for chunk_rows in (10_000, 16):
        assert sorted(map(tuple, h.mine(docs, chunk_rows=chunk_rows, block_rows=8).collect())) == all_pairs(rows)
    assert h.mine(docs.limit(0)).count() == 0 and h.mine(docs.where("not is_anchor")).count() == 0


def test_large_components_are_exact(spark):
    rows = [(i, i % 2, [float(2**19 + i), float(2**20 - 3 * i)], i < 3) for i in range(40)]
    assert sorted(map(tuple, h.mine(spark.createDataFrame(rows, KIND.replace("float", "double"))).collect())) == all_pairs(rows)


def test_groups_of_anchors_are_pruned():
    rng = np.random.default_rng(5)
    label = np.repeat(np.arange(8), 400)
    x = np.floor(256 * (rng.normal(size=(8, 16))[label] * 4 + rng.normal(size=(3200, 16)) * 0.2))
    ids = np.arange(3200)
    pick = ids[ids % 20 == 0]
    anchors, candidates = h.Tree(x[pick], label[pick], 8), h.Tree(x, label, 32)
    best = h.Best(np.arange(len(pick)), np.full(len(pick), -(2**63)), np.full(len(pick), 2**63 - 1), 5)
    scored = h.search(anchors, candidates, pick, ids, ids, best, True)
    leaves = [sum(n[2] < 0 for n in t.nodes) for t in (anchors, candidates)]
    assert scored < leaves[0] * leaves[1] / 4
    for k, a in enumerate(pick):
        want = sorted((-int(x[a] @ x[i]), int(i)) for i in ids if label[i] == label[a] and i != a)[:5]
        assert best.found[k] == [(-s, i) for s, i in want]
