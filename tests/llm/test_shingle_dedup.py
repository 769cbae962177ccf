import random

import corpus_pipeline as P
import numpy as np
from edges import edge_frame, edge_rows, sentence

from normcast.llm import shingle_dedup as D


def plain_set(x):
    w = (x or "").encode().lower().split()
    return frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def plain_first(rows, similarity=0.8):
    """Smallest ids of the components by search over all pairs of distinct sets."""
    sets, least = {}, []
    for i, x in rows:
        sets.setdefault(plain_set(x), []).append(float("inf") if i is None else i)
    rest = list(sets)
    while rest:
        queue, found = [rest.pop()], []
        while queue:
            x = queue.pop()
            found += sets[x]
            near = [y for y in rest if len(x & y) >= similarity * len(x | y) and x and y]
            rest = [y for y in rest if y not in near]
            queue += near
        least.append(min(found))
    return sorted(least)


def planted(copies=4, n=40):
    """Texts with copies that differ by a few changed words: similarities on both sides of 0.8."""
    rng = random.Random(11)
    rows = []
    for _ in range(n):
        words = sentence(rng, "en", rng.randint(60, 300)).split()
        rows.append(" ".join(words))
        for k in range(1, copies + 1):
            other = list(words)
            for at in rng.sample(range(len(words)), max(1, k * len(words) // 150)):
                other[at] = "changed"
            rows.append(" ".join(other))
    return list(enumerate(rows))


def test_stage_finds_near_copies(spark, small):
    rows = planted()
    want = plain_first(rows)
    assert len(want) < len(rows) / 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in P.near_duplicates(spark, docs, small).collect()) == want


def test_awkward_rows_and_large_groups(spark):
    got = D.one_of_each(edge_frame(spark))
    assert got.columns == edge_frame(spark).columns
    have = sorted(float("inf") if r["doc_id"] is None else r["doc_id"] for r in got.collect())
    assert have == plain_first([r[:2] for r in edge_rows()])
    assert D.one_of_each(edge_frame(spark).limit(0)).count() == 0
    rows = planted(30, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id AS number", "text", "0L AS node", "array(0L) AS keys")
    signed = docs.withColumn("s", D.signatures(docs.text, 5)).selectExpr("number", "text", "s.node", "s.keys")
    for tile in (5, 1000):  # the same components however a group is dealt
        links = D.near_links(signed, tile=tile)
        roots = {r["node"]: r["root"] for r in D.components(links).collect()}
        found = {}
        for r in signed.select("number", "node").collect():
            k = roots.get(r["node"], r["node"])
            found[k] = min(r["number"], found.get(k, r["number"]))
        assert sorted(found.values()) == plain_first(rows)


def test_signature_is_the_simhash_of_the_shingle_set():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 255, 256, 5000):
        grams = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        for word, factor in zip(D._simhash(grams), D._FACTORS):
            hashes = [int(x) for x in D._stirred(grams * factor)]
            assert int(word) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_blocks_and_bits_lose_no_pair_at_the_similarity():
    rng = np.random.default_rng(4)
    mask = np.uint64((1 << D.BITS) - 1)
    for common, own in ((4, (1, 0)), (8, (1, 1)), (40, (5, 5)), (80, (10, 10)), (400, (100, 0))):  # Jaccard 0.8 each
        lost = 0
        for _ in range(1000):
            grams = rng.integers(0, 1 << 63, common + sum(own), np.uint64)
            x, y = (D._simhash(g) for g in (grams[: common + own[0]], np.concatenate([grams[:common], grams[common + own[0] :]])))
            meet = any(((x ^ y) >> np.uint64(D.BITS * i) & mask == 0).any() for i in range(D.PER_WORD))
            pairs = list(D._close(np.stack([x, y])[:, : D.CHECKED]))
            lost += not (meet and len(pairs[0][0]))
        assert lost <= 2, (common, own, lost)


def test_near_links_join_what_the_fingerprints_join(spark, monkeypatch):
    """Crowded values of a block, dealt into parts and sides, give the same components; so do the one task and the stars."""
    rows = planted(30, 4)
    text = spark.createDataFrame(rows, "number long, text string")
    signed = text.withColumn("s", D.signatures(text.text, 5)).selectExpr("number", "text", "s.node", "s.keys").localCheckpoint()

    def classes():
        got = {}
        for r in D.components(D.near_links(signed)).collect():
            got.setdefault(r["root"], set()).add(r["node"])
        return sorted(map(sorted, got.values()))

    want = classes()
    monkeypatch.setattr(D, "_CROWD", 3)
    assert classes() == want
    fps = np.array([r["keys"][: D.CHECKED] for r in signed.collect()], np.int64).view(np.uint64)
    monkeypatch.setattr(D, "_SIDE", 16)
    a, b = (np.concatenate(x) for x in zip(*D._close(fps)))
    apart = np.bitwise_count(fps[:, None] ^ fps[None]).astype(int)
    near = np.argwhere((apart[:, :, :2].sum(2) <= D.AT_FIRST) & (apart.sum(2) <= D.DIFFERING))
    assert (D.least_reached(a, b, len(fps)) == D.least_reached(near[:, 0], near[:, 1], len(fps))).all()


def test_components_by_one_task_equal_the_stars(spark):
    rng = random.Random(6)
    pairs = [(rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(70)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    links = spark.createDataFrame(pairs, "a long, b long")
    stars, task = (sorted(map(tuple, D.components(links, at_once=n).collect())) for n in (0, 1 << 20))
    assert stars == task and D.components(links.limit(0), at_once=9).count() == 0


def test_stage_spares_the_driver(spark, small):
    """Some hundred plans of the stars took the driver over its memory; few links are joined by one task."""
    docs = spark.createDataFrame(planted(), "doc_id long, text string")
    sc = spark.sparkContext
    sc.setJobGroup("spares", "near duplicates")
    P.near_duplicates(spark, docs, small).count()
    jobs = len(sc.statusTracker().getJobIdsForGroup("spares"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    print("jobs", jobs)
    assert 0 < jobs < 60
