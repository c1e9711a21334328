"""The training-data operators against brute force, on small hand-made tables with odd rows."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat_format, embedding_dedup, jaccard_join, language_id, license_scan, mixing, packing, quality_classifier, quality_rules, url_filter

DOCS = "doc_id long, text string, lang string, source string, extra int"


def prose(rng, n, words=("alpha", "beta", "gamma", "delta", "of", "the", "rho", "sigma", "tau", "phi")):
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(1, None, None, None, 1), (2, "", "en", "a", 1), (3, " \n\t", "en", "a", 1), (4, "One", "en", "b", 1), (None, prose(rng, 60), "en", "b", 1)]
    base = prose(rng, 120).split()
    for i in range(10, 24):  # near copies of one text
        own = list(base)
        own[rng.randrange(len(own))] = f"odd{i}"
        rows.append((i, " ".join(own), "en", "hot", 1))
    rows += [(30, " ".join(base), "en", "hot", 1), (31, " ".join(base), "en", "hot", 1), (31, " ".join(base), "en", "hot", 1)]
    rows += [(i, prose(rng, rng.randrange(20, 200)), "en", rng.choice("abc"), 1) for i in range(40, 70)]
    rows += [(70, prose(rng, 9), "en", "a", 1), (71, prose(rng, 10), "en", "a", 1), (80, "x " * 30000, "en", "c", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def shingle_sets(rows):
    out = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        out.append(set(zip(w, w[1:], w[2:])) if len(w) >= 3 else {tuple(w)} if w else set())
    return out


def test_jaccard_components_match_brute_force(docs):
    rows = docs.collect()
    sets = shingle_sets(rows)
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * same >= 90 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(root(i), []).append(r.doc_id)
    want = sorted(((r.doc_id, len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None)) for i, r in enumerate(rows)), key=str)
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs).collect()), key=str) == want
    kept = jaccard_join.keep_one(docs)
    alone = {root(i) for i in range(len(rows)) if sets[i]}
    assert kept.columns == docs.columns and kept.count() == len(alone) + sum(not s for s in sets)


def test_jaccard_prefix_keys_lose_no_pair():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(9, 60))
        x = rng.choice(10_000, n, replace=False)
        y = x.copy()
        y[: rng.integers(0, n // 8 + 1)] += 20_000
        y = y[: n - int(rng.integers(0, 2))]
        same = len(np.intersect1d(x, y))
        if 100 * same >= 90 * len(np.union1d(x, y)) and set(x) != set(y):
            a, b = np.sort(x).astype(np.uint64), np.sort(y).astype(np.uint64)
            for l, keys in ((1, lambda s: s), (2, jaccard_join.subset_keys)):
                assert set(keys(a[: jaccard_join.prefix(len(a), l)])) & set(keys(b[: jaccard_join.prefix(len(b), l)]))


def test_pipeline_stage_matches_brute_force(spark, docs):
    import corpus_pipeline

    rng = random.Random(8)
    rows = []
    for i in range(100, 160, 6):  # a text, its first 70 to 95 per cent, and itself with odd words
        words = prose(rng, 200).split()
        rows += [(i + k, " ".join(words[: 2 * share]), "en", "cut", 1) for k, share in enumerate((100, 95, 85, 70))]
        for k in (4, 5):
            own = list(words)
            for at in rng.sample(range(200), k):
                own[at] = f"odd{at}"
            rows.append((i + k, " ".join(own), "en", "cut", 1))
    many = docs.where("doc_id is not null and doc_id <> 31").union(spark.createDataFrame(rows, DOCS))
    found = many.collect()
    sets = []
    for r in found:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0d]+", r.text or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(found)))
    for i in range(len(found)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[i] if g == group[j] else g for g in group]
    least = {}
    for g, r in zip(group, found):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in corpus_pipeline.jaccard_join(spark, many, "").collect()) == sorted(least.values())


def test_quality_rules(docs):
    out = quality_rules.quality_rules(docs, max_docs=3)
    assert out.count() == docs.count()
    got = {(r.doc_id, r.n_words): r for r in out.collect()}
    assert got[(1, 0)].base_failed and not got[(2, 0)].kept
    assert got[(80, 30000)].n_repeat_words == 30000 and got[(80, 30000)].base_failed
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0d]+", r.text or "")
        g = list(zip(w, w[1:], w[2:]))
        counts = {x: g.count(x) for x in set(g)} if len(g) < 1000 else None
        if counts is not None:
            hit = {i + k for i, x in enumerate(g) if counts[x] > 1 for k in range(3)}
            assert got[(r.doc_id, len(w))].n_repeat_words == len(hit)
    kept = quality_rules.apply_quality_rules(docs)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()


def test_boilerplate_lines_go_but_for_the_first(spark):
    rng = random.Random(1)
    line = "click here to subscribe to our letter and read more about it"
    rows = [(i, prose(rng, 80) + "\n" + line.upper(), "en", "h", 0) for i in range(20)] + [(99, "\n".join([line] * 30), "en", "h", 0)]
    df = spark.createDataFrame(rows, DOCS)
    left = {r.doc_id: r.text for r in quality_rules.apply_quality_rules(df).collect()}
    assert line.upper() in left[0] and all(line.upper() not in left[i] for i in range(1, 20)) and 99 not in left


def test_classifier(spark, docs):
    rng = random.Random(2)
    rows = [(i, prose(rng, 150) if i % 3 else "".join(rng.choice("#*$%") * 3 + "AB " for _ in range(100)), "en", "a", 0) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    out = quality_classifier.classify(df, labels).collect()
    assert all(r.predicted == (r.doc_id % 3 > 0) and 0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert quality_classifier.classify(docs, labels.limit(0)).count() == docs.count()
    assert quality_classifier.keep_good(df, labels).count() == 200


def test_language(spark, docs):
    rng = random.Random(4)
    words = {"en": ["the", "and", "house", "with"], "de": ["und", "das", "straße", "nicht"], "fr": ["été", "le", "maison", "avec"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(30)), x, "a", 0) for i, x in enumerate(list(words) * 60)]
    rows += [(1000, "12 34 !!", None, "a", 0), (1001, None, "en", "a", 0)]
    out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(out[i].lang_pred == x for i, _, x, *_ in rows[:180]) and out[1000].lang_pred == out[1001].lang_pred == "und"
    assert {r.lang_pred for r in language_id.identify(docs.where("lang is null")).collect()} == {"und"}


def test_licenses(spark):
    texts = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "under cc by-nc 4.0", None, "the version of the software", "under the MIT license under the mit license",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"]
    out = sorted(license_scan.scan_licenses(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)).collect())
    assert [r.base_labels for r in out] == ["mit", "apache-2", "cc-by-nc", "", "", "mit", ""]
    assert out[6].labels == "mit" and out[4].labels == "" and out[5].n_base == 2 and (out[5].first_word, out[5].last_word) == (0, 4)


def test_licenses_of_a_long_file_with_all_notices(spark):
    rng = random.Random(2)
    found, at = [], []
    for label, notice, _ in license_scan.TEMPLATES:
        found += prose(rng, 150).split()
        at.append(f"{label}@{len(license_scan.words(' '.join(found)))}")  # places count letters' and digits' words: 2.0 is two
        found += notice.split()
    texts = [" ".join(found), *[f"{notice} {prose(rng, 30)}" for _, notice, _ in license_scan.TEMPLATES]]
    out = sorted(license_scan.scan_licenses(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)).collect())
    assert set(at) <= set(out[0].spans.split(",")), set(at) - set(out[0].spans.split(","))
    assert set(out[0].labels.split(",")) == {t[0] for t in license_scan.TEMPLATES} and out[0].score == 1.0


def test_packing_round_trip(docs):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    rows = packing.pack(docs.where("doc_id is not null and doc_id <> 31"), with_ids=True).collect()
    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d in docs.where("doc_id is not null and doc_id <> 31").collect():
        ids = whole.encode(d.text or "", add_special_tokens=False).ids + [1]
        got = b"".join(bytes(p.ids) for p in sorted(by_doc[d.doc_id], key=lambda p: p.start))
        assert got == np.array(ids, "<u4").tobytes()
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.ids_crc32 == zlib.crc32(bytes(p.ids))
            at += p.length
        assert at <= 2048


def test_mixing(docs):
    assert mixing.share_out([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.share_out([10, 190, 100], [5, 2, 1]) == [30.0, 180.0, 90.0]
    m = mixing.mix(docs.where("doc_id is null or doc_id <> 80"), block_words=200)
    taken = m.draws.join(m.documents.select("_rid", "sid", "target"), "_rid").groupBy("sid", "target").agg(F.sum("words").alias("w"), F.max("words").alias("longest")).collect()
    assert all(abs(r.w - r.target) <= r.longest / 2 + 1 for r in taken)  # sums of whole documents lie no further apart than the longest
    per = m.draws.groupBy("_rid").count().collect()
    assert max(r["count"] for r in per) <= 3
    q = mixing.split_quotas([100, 7, 33], 8)
    assert q.sum(0).tolist() == [100, 7, 33] and q.sum(1).max() - q.sum(1).min() <= 2
    assert sorted(mixing.nearest([5, 7, 11], 12)) == [0, 1]


def test_mixing_reaches_all_documents_of_a_block():
    short = [20] * 2000
    assert sum(short[k] for k in mixing.nearest(short, 20_000)) == 20_000
    rng = random.Random(5)
    for _ in range(50):
        sizes, left = [rng.randrange(0, 40) for _ in range(rng.randrange(1, 9))], rng.randrange(1, 100)
        took = mixing.nearest(sizes, left)
        assert len(set(took)) == len(took)
        sums = [sum(n for i, n in enumerate(sizes) if m >> i & 1) for m in range(1 << len(sizes))]
        assert abs(sum(sizes[k] for k in took) - left) == min(abs(x - left) for x in sums)


def test_mixing_with_documents_longer_than_a_block(spark):
    took = lambda sizes, left: sum(sizes[k] for k in mixing.nearest(sizes, left))
    assert took([120_000], 90_000) == 120_000 and took([120_000], 50_000) == 0
    assert took([20_000, 80_000, 5_000], 95_000) == 100_000 and took([60_000, 80_000], 90_000) == 80_000
    assert took([300_000, *[1_000] * 200], 90_000) == 90_000
    # a long document in each source; what it does not fill comes from the short ones of other blocks
    rows = [(1000 * s + i, "x " * (3000 if i < 1 else 10), "en", "abc"[s], 1) for s in range(3) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    for seed in range(3):
        m = mixing.mix(docs, block_words=200, seed=seed)
        taken = m.draws.join(m.documents.select("_rid", "sid", "target"), "_rid").groupBy("sid", "target").agg(F.sum("words").alias("w")).collect()
        assert len(taken) == 3 and all(abs(r.w - r.target) <= (6 if r.sid == 2 else 1500) for r in taken), (seed, taken)  # the short ones of a and b may be too few


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bob", "yo"), (1, 2, "user", None), (2, 0, None, "x"), (1, 300, "bob", "end")]
    out = chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for view in ("user", "bob"):
        own = sorted((r for r in out if r.perspective == view), key=lambda r: r.start)
        whole = "".join(r.segment for r in own)
        assert len(own) == 4 and all(whole[r.start : r.start + r.length] == r.segment for r in own)
        assert all((r.mask_start is not None) == (r.speaker == view) for r in own)
    assert not [r for r in out if r.conv_id == 2]


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/a?x", "http://m.example.com/en/", "https://a.net/es/", "https://anet/es/", "ftp", None, "http://a.com", "http://spam-farm.example.org/x", "https://www.library.example.org/en/3"]
    out = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [out[i].rule for i in range(9)] == ["www.example.com/en/", "example.com/en/", "net/es/", None, None, None, None, None, None]
    assert [out[i].verdict for i in (0, 1, 2, 4, 5, 7, 8)] == ["allow", "block", "block", "allow", "allow", "block", "allow"]
    assert out[0].host == "www.example.com" and out[0].path == "/en/a" and (out[5].host, out[5].path) == ("", "")


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 24))
    v = [*base, *(base[:25] + rng.normal(scale=0.25, size=(25, 24))), base[0], base[0], np.zeros(24)]
    rows = [(i, x.astype(np.float32).tolist(), i % 2 if i < 60 else 0) for i, x in enumerate(v)]
    rows += [(200, None, 0), (201, [float("nan")] * 24, 0), (202, [1.0, None], 0), (203, base[0].tolist(), None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    x = {i: np.array(e, np.float32).astype(float) for i, e, l in rows if l is not None and e and None not in e and np.isfinite(e).all() and np.any(e)}
    lab = {i: l for i, _, l in rows}
    near = {i: {j for j in x if j != i and lab[i] == lab[j] and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.93} if i in x else set() for i, *_ in rows}
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (len(near[i]), min(seen), min(seen) == i)
    assert sum(map(len, near.values())) > 10


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert jaccard_join.jaccard_components(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0
    assert license_scan.scan_licenses(none).count() == 0
    assert language_id.identify(none).count() == 0
    assert packing.pack(none).count() == 0
    assert mixing.mix(none).draws.count() == 0
    assert chat_format.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_jaccard_keys_name_their_shingles(spark):
    """Of each key its shingles, from its place; and a pair of sets meets at one key only, the first they share."""
    rng = np.random.default_rng(3)
    rows, posted = [], []
    for cid in range(12):
        p = int(rng.integers(0, 30))
        own = np.sort(rng.choice(40, p, replace=False)).tolist()
        pairs = [(own[i], own[j]) for i, j in zip(*np.triu_indices(p, 1))]
        for pos, k in enumerate([*pairs, *[(x, None) for x in own]]):
            posted.append((cid, own, pos, k[0], k[1]))
        rows.append(set(pairs))
    df = jaccard_join.with_shingles(spark.createDataFrame(posted, "cid int, prefix array<long>, pos int, a long, b long"), F.lit(True)).cache()
    assert df.where("not (s0 <=> a) or not (s1 <=> b)").count() == 0
    x, y = df.where("s1 is not null").alias("x"), df.where("s1 is not null").alias("y")
    met = x.join(y, (F.col("x.s0") == F.col("y.s0")) & (F.col("x.s1") == F.col("y.s1")) & (F.col("x.cid") < F.col("y.cid")) & jaccard_join.first_key("x.", "y.")).select("x.cid", "y.cid").collect()
    want = {(i, j) for i in range(12) for j in range(i + 1, 12) if rows[i] & rows[j]}
    assert len(met) == len(set(met)) == len(want) and set(map(tuple, met)) == want
