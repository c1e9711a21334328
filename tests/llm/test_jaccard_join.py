"""The Jaccard join's second join against all pairs: sizes, chunks, positions, and tallied heads."""

import random

import numpy as np
import pytest

from corpusloom.llm import jaccard_join as J


def all_pairs(rows, percent, width):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[i] if g == group[j] else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(least.get(g, i), i)
    return sorted((i, len(s), least[g]) for (i, _), s, g in zip(rows, sets, group))


@pytest.mark.parametrize("percent, width, members, sized", [(80, 5, 3, 2), (90, 3, 5, 1), (80, 5, 2000, 2), (100, 3, 2, 1), (60, 2, 4, 2)])
def test_keys_of_many_members_in_other_components(spark, monkeypatch, percent, width, members, sized):
    """Families of texts of many sizes that share a passage, so that its keys hold members of many components; small chunks,
    and classes of sizes for nearly all keys."""
    monkeypatch.setattr(J, "CHUNK_MEMBERS", members)
    monkeypatch.setattr(J, "SIZED_MEMBERS", sized)
    monkeypatch.setattr(J, "FREQUENT", 10_000)  # shared passages come first in the order
    rng = random.Random(percent + width)
    word = lambda: f"w{rng.randrange(100_000)}"
    passage, rows = [word() for _ in range(30)], []
    for family in range(14):
        own = [word() for _ in range(rng.choice([6, 10, 40, 100, 110, 120, 130, 700]))]
        whole = passage[: rng.randrange(10, 30)] + own if family % 2 else own[: len(own) // 2] + passage + own[len(own) // 2 :]
        rows.append(whole)
        for _ in range(rng.randrange(1, 6)):
            copy = list(whole)
            for at in rng.sample(range(len(copy)), rng.randrange(0, max(2, len(copy) * (100 - percent) // (100 * width) + 2))):
                copy[at] = word()
            rows.append(copy[: len(copy) - rng.randrange(0, max(1, len(copy) * (100 - percent) // 100) + 1)])
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    rng.shuffle(rows)
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, width=width)
    assert sorted(map(tuple, got.collect())) == all_pairs(rows, percent, width)


def test_sizes_of_sets_that_may_link_are_in_neighbouring_classes(spark):
    for percent in (50, 80, 90, 99, 100):
        rows = [(n, -(-percent * n // 100)) for n in range(1, 3000)]
        df = spark.createDataFrame(rows, "n long, k long")
        apart = df.select((J.size_class(df.n, percent) - J.size_class(df.k, percent)).alias("d")).distinct().collect()
        assert {r.d for r in apart} <= {0, 1}


def test_tallied_heads_match_plain_counts():
    rng = np.random.default_rng(1)
    heads = np.sort(rng.integers(0, 50, 400).astype(np.uint32))
    own, n = J.tallied(heads)
    assert dict(zip(own.tolist(), n.tolist())) == {h: (heads == h).sum() for h in set(heads.tolist())}
    again, m = J.tallied(np.repeat(own, 2), np.repeat(n, 2))
    assert again.tolist() == own.tolist() and m.tolist() == (2 * n).tolist()
    assert [x.tolist() for x in J.tallied(heads[:0])] == [[], []]


def test_frequent_heads_are_counted_over_all_flushes(spark, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT", 3)
    texts = [f"common words here a{i} b{i} c{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    profiled = J.profile(docs, 64)
    rows = profiled.where("part is not null").collect()
    heads = [h for r in rows for h in np.cumsum(np.frombuffer(r.blob, "<u4"), dtype=np.uint32).tolist()]
    assert len(heads) < 40 * 4 and len(set(heads)) == 1 + 40 * 3  # the common shingle comes once a task
    bits, _ = J.frequent(profiled, 3)
    assert sum(int(b).bit_count() for b in bits) == 1


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["word", "é", " ", "\n", "\t", "X", "longer-word "]) for _ in range(3000))
    want = J.word_hashes(text).tolist()
    for block in (1, 7, 64, 1000, 10**6):
        monkeypatch.setattr(J, "TEXT_BLOCK", block)
        assert J.word_hashes(text).tolist() == want


def test_sets_whose_prefix_does_not_travel(spark, monkeypatch):
    """Pairs of such sets are pairs at every key."""
    monkeypatch.setattr(J, "TOLD_PREFIX", 3)
    monkeypatch.setattr(J, "SIZED_MEMBERS", 2)
    rng = random.Random(6)
    rows = []
    for _ in range(8):
        own = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 90, 300]))]
        for _ in range(4):
            copy = list(own)
            for at in rng.sample(range(len(copy)), max(1, len(copy) // 60)):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append(copy)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=85, width=2)
    assert sorted(map(tuple, got.collect())) == all_pairs(rows, 85, 2)
