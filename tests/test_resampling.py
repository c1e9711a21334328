"""The splitting tree's draws against the multinomial law, and bootstraps of many patterns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import resampling as B


def tree_draws(counts, size, n, seed):
    """Draws of all patterns in ranges of size neighbours, each range by itself."""
    depth = max(0, int(np.ceil(np.log2(len(counts) / size))))
    leaves = [counts[k * len(counts) >> depth : (k + 1) * len(counts) >> depth] for k in range(1 << depth)]
    sums = [sum(x) for x in leaves]
    way = lambda k: [sum(sums[(k >> depth - d) << depth - d : ((k >> depth - d) + 1) << depth - d]) for d in range(depth + 1)]
    return np.hstack([np.vstack([B.draw_range(B.CHUNK, own, way(k), k, seed, "p", f) for f in range(1, n, B.CHUNK)]) for k, own in enumerate(leaves) if own])


@pytest.mark.parametrize("size", [64, 8, 1])
def test_draws_have_the_multinomial_law(size):
    counts = [1, 2, 3, 40, 5, 6, 7, 8, 100, 1, 1, 1, 20, 30, 2, 19]
    n, total, p = 8000, sum(counts), np.array(counts) / sum(counts)
    got = tree_draws(counts, size, n, 3)
    assert got.shape == (n, 16) and (got.sum(1) == total).all()
    plain = np.random.default_rng(1).multinomial(total, p, n)
    error = lambda c: 5 * np.sqrt((np.outer(np.diag(c), np.diag(c)) + c**2) / n) + 1e-9  # noqa: E731  five standard errors of a covariance
    law = total * (np.diag(p) - np.outer(p, p))
    assert (abs(got.mean(0) - total * p) <= 5 * np.sqrt(total * p / n) + 1e-9).all()
    assert (abs(np.cov(got.T) - law) <= error(law)).all() and (abs(np.cov(plain.T) - law) <= error(law)).all()
    for j in (0, 3, 8):  # the law of one pattern, by quantiles
        assert (abs(np.quantile(got[:, j], [0.05, 0.5, 0.95]) - np.quantile(plain[:, j], [0.05, 0.5, 0.95])) <= 1).all()
    assert len(np.unique(got, axis=0)) > n / 2  # chunks and replicates differ


def some_patterns(spark, k):
    item = F.array(F.struct((F.col("id") % 50).alias("key"), (1 + F.col("id") % 3).cast("double").alias("w")), F.struct((50 + F.col("id")).alias("key"), F.lit(0.5).alias("w")))
    return spark.range(k).select(F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("population"), item.alias("items"), (1 + F.col("id") % 5).alias("n"))


def test_ranges_are_bounded_and_hold_all(spark):
    found = B.ranges(some_patterns(spark, 4000), "population", 100).collect()
    assert max(len(r.patterns) for r in found) < 200 and sum(len(r.patterns) for r in found) == 4000
    for p in "ab":
        own = [r for r in found if r.population == p]
        total = sum(x.n for r in own for x in r.patterns)
        assert all(r.totals[0] == total and r.totals[-1] == sum(x.n for x in r.patterns) for r in own)
        assert len({r.leaf for r in own}) == len(own)


@pytest.mark.parametrize("many", [256, 0])
def test_many_patterns(spark, monkeypatch, many):
    monkeypatch.setattr(B, "MANY_RANGES", many)
    patterns = some_patterns(spark, 3000)
    rows = patterns.collect()
    out = B.resampled(patterns, "population", 60, 5, 64).collect()
    by = np.zeros((61, 50))
    singles = np.zeros(61)
    for r in out:
        if r.key < 50:
            by[r.r, r.key] = r.x
        else:
            singles[r.r] += r.x
    assert (singles[1:] == 0.5 * sum(r.n for r in rows)).all()  # each record has one such item: all records were drawn
    want, var = np.zeros(50), np.zeros(50)
    for r in rows:
        want[r["items"][0].key] += r.n * r["items"][0].w
        var[r["items"][0].key] += r.n * r["items"][0].w ** 2
    assert (abs(by[1:].mean(0) - want) < 5 * np.sqrt(var / 60)).all()
    assert sorted(map(tuple, out)) == sorted(map(tuple, B.resampled(patterns.repartition(7), "population", 60, 5, 64).collect()))
