import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from edges import edge_frame, edge_rows, empty_frame
from oracle import check_same
from pyspark.sql import functions as F

from normcast.llm import hash_mixing as H
from normcast.llm import simhash_dedup as S
from normcast.llm.prefix_sharding import shards, write_shards
from normcast.llm.queries import OP1, OP9, queries
from normcast.llm.scratch import new_path


def plain_fingerprint(x):
    w = (x or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, differing=3):
    """Label of each distinct fingerprint by search over all pairs."""
    fps = sorted(set(fps))
    label = {}
    for f in fps:
        if f in label:
            continue
        queue, label[f] = [f], f
        while queue:
            x = queue.pop()
            for y in fps:
                if y not in label and bin(x ^ y).count("1") <= differing:
                    label[y] = f
                    queue.append(y)
    return label


def test_components_equal_brute_force(spark):
    rows = edge_rows()
    got = S.near_duplicates(edge_frame(spark)).collect()
    label = plain_components(plain_fingerprint(r[1]) for r in rows)
    least = {}
    for i, x, *_ in rows:
        k = label[plain_fingerprint(x)]
        least[k] = min(i if i is not None else 10**9, least.get(k, 10**9))
    least = {k: None if v == 10**9 else v for k, v in least.items()}
    want = Counter((i, plain_fingerprint(x), least[label[plain_fingerprint(x)]]) for i, x, *_ in rows)
    assert Counter((r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    assert S.near_duplicates(empty_frame(spark)).count() == 0


def test_components_with_hot_keys(spark):
    """A hub with most of the links, copies of one text that are most of the rows, and many texts without words."""
    links = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(30)] + [(399, 1000), (5000, 5001)]
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    assert got == {**{i: 0 for i in [*range(400), *range(1000, 1031)]}, 5000: 5000, 5001: 5000}
    rows = [(i, "one and the same text in every row") for i in range(500)] + [(i, " ") for i in range(500, 900)] + [(900, "something else altogether"), (None, None)]
    found = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {(r["id"], r["component_id"]) for r in found} == {*((i, 0) for i in range(500)), *((i, 500) for i in range(500, 900)), (900, 900), (None, 500)}
    assert len(found) == len(rows)


@pytest.mark.parametrize("tile", [4, 64])
def test_links_of_crowded_fingerprints(spark, tile):
    """Chains, tight balls and strays: the links join exactly what brute force joins, whatever the tile."""
    rng = random.Random(tile)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << b
            fps.add(x)
    x = rng.getrandbits(64)
    for k in range(20):
        x ^= 0b111 << (3 * k)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] for r in S.components(S.near_links(nodes, 3, tile)).collect()}
    label = plain_components(fps)
    groups = defaultdict(set)
    for f in fps:
        groups[roots.get(f, f - (1 << 64) if f >> 63 else f)].add(f)
    want = defaultdict(set)
    for f in fps:
        want[label[f]].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in S.components(links).collect()} == {0}
    assert S.components(links.limit(0)).count() == 0


def test_fingerprint_in_steps(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500)).encode()
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "_STEP", 7)
    assert S.fingerprint(text) == whole == plain_fingerprint(text.decode())


def water_fill(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if w[s] * level > most * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in free}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over


def test_mix(spark):
    got = H.mix(edge_frame(spark)).collect()
    rows = edge_rows()
    size = lambda x: len((x or "").encode().split())
    assert Counter((r["id"], r["source"], r["size"]) for r in got) == Counter((i, s, size(x)) for i, x, _, s in rows)
    sizes = Counter()
    for _, x, _, s in rows:
        sizes[s] += size(x)
    target, taken, largest = water_fill(sizes), Counter(), Counter()
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s], s
    assert sorted(map(str, H.mix(edge_frame(spark)).collect())) == sorted(map(str, got))
    assert H.mix(empty_frame(spark)).count() == 0 and H.mixed(empty_frame(spark)).count() == 0
    copies = H.mixed(edge_frame(spark))
    assert copies.columns == edge_frame(spark).columns
    want = Counter()
    for r in got:
        want[r["id"]] += r["epochs"]
    assert Counter(r["doc_id"] for r in copies.collect()) == +want


def test_smaller_budgets_are_nested(spark):
    takes = []
    for share in (0.2, 0.5, 0.9, 1.4):
        takes.append({(r["id"], i): r["epochs"] for i, r in enumerate(sorted(H.mix(edge_frame(spark), share=share).collect(), key=str)) if r["id"] is not None and r["id"] != 1010})
    for a, b in zip(takes, takes[1:]):
        a, b = ({k[0]: v for k, v in x.items()} for x in (a, b))
        assert all(b[k] >= v for k, v in a.items())


def test_shards(spark):
    got = sorted(shards(edge_frame(spark), 5).collect(), key=lambda r: (r["shard"], r["slot"]))
    total = sum(r["size"] for r in got)
    at, seen = 0, Counter()
    for r in got:
        assert r["slot"] == seen[r["shard"]] and r["shard"] == (2 * at + r["size"]) * 5 // (2 * total)
        seen[r["shard"]] += 1
        at += r["size"]
    ids = [r["id"] for r in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert Counter((r["id"], r["size"]) for r in got) == Counter((i, len((x or "").encode()) + 1) for i, x, *_ in edge_rows())
    assert shards(empty_frame(spark), 5).count() == 0


def test_written_shards(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(50)], "doc_id long, text string")
    folder = new_path(spark, "shards")
    write_shards(docs, shards(docs, 4), folder)
    assert spark.read.parquet(folder).count() == 50 and spark.read.parquet(folder).select("shard").distinct().count() == 4


@pytest.mark.parametrize("name,sql", [("op1_topk_search", OP1), ("op9_hash_mixing", OP9)])
def test_queries_equal_sql(spark, small, name, sql):
    check_same(queries()[name](spark, small), small, sql)


def test_all_ten_run(spark, small):
    made = {n: f(spark, small).count() for n, f in queries().items()}
    assert len(made) == 10 and all(made.values())
    assert np.array([made[n] for n in made if n not in ("op1_topk_search", "op3_url_filter", "op4_harmonic_packing")]).tolist() == [200] * 7


def test_most_is_a_whole_number(spark):
    for most in (1.5, 0.5, 0):
        with pytest.raises(ValueError):
            H.mix(edge_frame(spark), most=most)
    taken = H.mix(edge_frame(spark), most=3.0, share=2.5)
    assert taken.agg(F.max(F.expr("try_divide(taken, size)"))).first()[0] <= 3


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from normcast.llm.scratch import shared_dir

    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda name, *_: folder)
        context = SimpleNamespace(master=master, applicationId=f"app-{master}", getConf=lambda: SimpleNamespace(get=lambda name: None))
        return SimpleNamespace(conf=conf, sparkContext=context)

    assert shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(session("local[8]")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
