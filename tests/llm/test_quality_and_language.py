import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from edges import edge_frame, edge_rows, empty_frame, sentence
from pyspark.sql import functions as F

from normcast.llm import importance_resampling as I
from normcast.llm import quality_rules as Q
from normcast.llm import segment_langid as G

PIECES = public_tokenizers.path("piece_bpe_32k.model")
LABELS = "doc_id long, quality int, toxic int"


def labels(spark):
    return spark.createDataFrame([*[(i, 1, 0) for i in range(0, 120, 2)], (1010, 0, 0), (1, None, None), (None, 1, 0), (5, 1, 1), (99999, 1, None), (4, 1, 0)], LABELS)


def base(x):
    x = x or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    found = defaultdict(list)
    for i in range(len(w) - 7):
        found[tuple(w[i : i + 8])].append(i)
    covered = {j for v in found.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [s for s in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def grams(x, buckets):
    w = re.findall(r"[^\x20\x09-\x0D]+", x or "")

    def spark_hash(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed)
        return seed

    one = [spark_hash(a) for a in w]
    pairs = [spark_hash(a.to_bytes(8, "little"), b.to_bytes(8, "little")) for a, b in zip(one, one[1:])]
    return [(h - (1 << 64) if h >> 63 else h) % buckets for h in one + pairs]


def test_rules_and_ratio_equal_brute_force(spark):
    rows = edge_rows()
    rows.append((1013, "\n".join(["line one two three four five six seven eight", "other line"] * 6), "en", "s1"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'x' AS w", "'y' AS id", "'z' AS n_words", "0 AS bucket")
    got = Q.judge(df, labels(spark), buckets=512, smoothing=1.0).collect()
    good = {*range(0, 120, 2), 99999}
    t, c = Counter(), Counter()
    for i, x, *_ in rows:
        g = grams(x, 512)
        c.update(g)
        if i in good:
            t.update(g)
    scale = sum(t.values()) / sum(c.values())
    weight = {b: round(math.log((t[b] + 1) / (c[b] * scale + 1)) * Q.UNIT) for b in c}
    want = Counter((i, *base(x), len(grams(x, 512)), sum(weight[b] for b in grams(x, 512))) for i, x, *_ in rows)
    have = Counter((r["id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["n_grams"], r["ratio"]) for r in got)
    loose = lambda c: sorted(((str(x[:8]), x[8]) for x in c.elements()))
    for a, b in zip(loose(have), loose(want)):
        assert a[0] == b[0] and abs(a[1] - b[1]) <= 5000
    for r in got:
        assert r["kept"] == (not r["base_failed"] and r["ratio"] >= round(-0.15 * Q.UNIT) * r["n_grams"])
    assert Q.judge(empty_frame(spark), labels(spark)).count() == 0
    assert Q.judge(df, labels(spark).limit(0)).filter("ratio <> 0").count() == 0


def noisy(spark, n=400):
    import random

    rng = random.Random(5)
    rows, marks = [], []
    for i in range(n):
        junk = i % 5 == 0
        text = sentence(rng, "en", rng.randint(30, 90))
        rows.append((i, " | ".join(text.split()) if junk else text))
        if i % 3 == 0:
            marks.append((i, int(not junk), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, LABELS)


def test_quality_keeps_clean_and_drops_junk(spark):
    docs, marks = noisy(spark)
    for rows in (Q.judge(docs, marks), I.resample(docs, marks)):
        kept = {r["id"]: r["kept"] for r in rows.collect()}
        assert all(kept[i] == (i % 5 != 0) for i in range(400))


def test_log_weights_equal_brute_force(spark):
    df = edge_frame(spark)
    w = I.fit(df, labels(spark), buckets=256)
    got = I.resample(df, labels(spark), buckets=256).collect()
    digest, top = xxhash.xxh64_intdigest, (1 << 64) - 1

    def total(x):
        h = [digest(b) for b in (x or "").encode().lower().split()]
        pairs = [(((a * 0x9E3779B97F4A7C15) & top) ^ b) for a, b in zip(h, h[1:])]
        return sum(int(w[g % 256]) for g in h + [p ^ (p >> 29) for p in pairs])

    assert Counter((r["id"], r["log_weight"]) for r in got) == Counter((i, total(x)) for i, x, *_ in edge_rows())
    for k in (0, 1, 17, len(got), 10**6):
        rows = I.resample(df, labels(spark), buckets=256, k=k).collect()
        keys = sorted((r["key"] for r in rows), reverse=True)
        least = keys[min(k, len(keys)) - 1] if k else math.inf
        assert all(r["kept"] == (r["key"] >= least) for r in rows)
    assert I.resample(empty_frame(spark), labels(spark)).count() == 0
    assert I.resample(df, labels(spark).limit(0)).filter("kept").count() > 0


def test_gumbel_noise_is_standard(spark):
    x = np.array([r[0] for r in spark.range(20_000).select(I.gumbel(F.col("id"), F.lit(""), 7)).collect()]) / I.UNIT
    assert abs(x.mean() - 0.5772) < 0.05 and abs(x.var() - math.pi**2 / 6) < 0.1


def test_forward_sums_all_segmentations():
    pieces = G.Pieces(PIECES)
    rng = np.random.default_rng(0)
    p = rng.random((len(pieces.names), 2))
    p /= p.sum(axis=0)
    place = {n: i for i, n in enumerate(pieces.names)}

    def brute(w, k):
        if not w:
            return 1.0
        return G.UNKNOWN * brute(w[1:], k) + sum(p[place[w[:j]], k] * brute(w[j:], k) for j in range(1, len(w) + 1) if w[:j] in place)

    words = ["hello", "überaus", "漢字x", "a", "z" * 9]
    want = np.log([[brute("▁" + w, k) for k in (0, 1)] for w in words])
    assert np.allclose(pieces.forward(words, pieces.scaled(p)), want)
    long = "ab" * 40  # cut
    got = pieces.forward([long, "漢" * 70, *words, long[: G._LONG], long[G._LONG :]], pieces.scaled(p))
    assert np.isfinite(got).all() and np.allclose(got[0], got[-2] + got[-1]) and np.allclose(got[2:-2], want)
    logs = G.WordLogs(PIECES, p, keep=6)
    for some in (words, words[::-1], [long, "one", "two", "three", "four"], ["漢字x", *"bcdefghi"], words):
        assert np.allclose(logs.of(pa.array(some, pa.large_string())), pieces.forward(some, pieces.beside_background(p)))
        assert len(logs.words) <= 6 and max(map(len, logs.words.to_pylist())) <= 60
    uses = pieces.expected(["hello"], np.array([2.0]), pieces.scaled(p[:, 0]))
    assert abs((uses * pieces.sizes).sum() - 12) < 0.1


def test_language(spark):
    df = edge_frame(spark, 300)
    rows = G.identify(df, PIECES).collect()
    truth = defaultdict(list)
    for i, x, lang, _ in edge_rows(300):
        truth[i].append((x, lang))
    assert len(rows) == len(edge_rows(300))
    right = n = 0
    for r in rows:
        key = zlib.crc32(str(r["id"]).encode()) if r["id"] is not None else 0
        assert r["held_out"] == (key % 3 == 1) and 0 <= r["score"] <= 1
        if r["id"] is not None and r["id"] < 1000 and r["held_out"]:
            n += 1
            right += r["lang_pred"] == truth[r["id"]][0][1]
    assert n > 50 and right / n > 0.98
    by = {r["id"]: r["lang_pred"] for r in rows}
    assert all(by[i] == "und" for i in (1000, 1001, 1002, 1011))
    again = G.identify(df.withColumn("lang", F.when(G.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang"))), PIECES).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert G.identify(empty_frame(spark), PIECES).count() == 0
    assert {r["lang_pred"] for r in G.identify(df.withColumn("lang", F.lit(None).cast("string")), PIECES).collect()} == {"und"}
    fits = {r["id"]: r["fit"] for r in rows}
    assert all(0.3 < fits[i] < 2 for i in range(300)) and fits[1000] == fits[1011] == 0


def test_language_of_unspaced_text(spark):
    """Two invented languages without spaces, whose words are whole texts, are learned and told apart."""
    import random

    rng = random.Random(2)
    rows = [(i, "".join(rng.choices(("ba", "do", "ki", "lu") if i % 2 else ("ché", "ren", "sto", "wu"), k=rng.randint(40, 3_000))), "x" if i % 2 else "y") for i in range(120)]
    got = G.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect()
    assert all(r["lang_pred"] == ("x" if r["id"] % 2 else "y") and r["fit"] > 0.5 for r in got)


def test_one_id_with_many_rows_teaches_once(spark):
    rows = edge_rows(60)
    same = [(3, t, "en", None) for _, t, *_ in rows[:50]] * 40
    docs = spark.createDataFrame([*rows, *same], "doc_id long, text string, lang string, source string")
    languages, p, typical = G.fit(docs, PIECES, rows_per_language=5)
    assert languages == ["de", "en", "fr"] and np.allclose(p.sum(axis=0), 1) and (typical > 0).all()
