"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Each text is a bag of hashed word n-grams (words and pairs of words). Its log weight is the sum of
log P(bucket | target) - log P(bucket | raw), the plain ratio of the two models. As texts have very different lengths,
they compete by their weight at a common length: the mean over their n-grams times ``LENGTH``. Adding Gumbel noise and
taking the k largest samples k documents without replacement in proportion to these weights. The noise is a hash of the id,
so reruns agree.

A few insults weigh little in a sum over a whole text, so toxic text is found apart: by the share of words
that labelled toxic texts hold far more often than other labelled texts. It is never kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normcast.llm.encoding import in_slices, whole
from normcast.llm.scratch import dropped, hash_sample, small_batches, tidied, written

#: Keys are whole numbers of 2 ** -20, so sums and comparisons are exact.
UNIT = 1 << 20
#: Bytes of text whose n-grams are in memory at once, some 40 bytes for each byte.
_SLICE = 2 << 20
#: N-grams of the length at which texts are compared.
LENGTH = 256
#: Losing a labelled good text counts as much as keeping so many poor ones.
_GOOD_TO_POOR = 8
#: A word is toxic where at least so many labelled toxic texts hold it, and a text holds it with this log odds ratio.
_TOXIC_TEXTS, _TOXIC_RATIO = 3, 3.0
#: A text is toxic with two toxic words at least, whose ratios come to this for each of its words (of at least 20).
TOXIC_MEAN = 0.015


def hashed_grams(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, bucket)`` of every word and pair of following words, A-Z in lower case, of an array of texts.

    Words are runs without ASCII white space. Nulls have none.
    """
    parts = pc.split_pattern_regex(whole(texts), "[ \t-\r]+")
    coded = parts.flatten().dictionary_encode()
    digest = xxhash.xxh64_intdigest
    known = np.array([digest(w.encode().lower()) if w else 0 for w in coded.dictionary.to_pylist()], np.uint64)
    hashes = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    real = hashes != 0  # what is left of white space at a text's ends
    hashes, owner = hashes[real], owner[real]
    follow = owner[1:] == owner[:-1]
    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[1:]
    pairs ^= pairs >> np.uint64(29)
    grams = np.concatenate([hashes, pairs[follow]])
    return np.concatenate([owner, owner[1:][follow]]), (grams % np.uint64(buckets)).astype(np.int64)


def target_ids(labels: DataFrame, most: int) -> list:
    """Ids of good, non-toxic labelled documents: all, or the ``most`` (a bound on the driver) with the smallest hash."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return [r[0] for r in hash_sample(good, most).collect()]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 16, target_rows: int = 20_000, smoothing: float = 20.0) -> np.ndarray:
    """Weights by bucket. Raw counts cover every row of ``docs``; the target's are those of at most
    ``target_rows`` labelled rows. What returns to the driver is one row for each bucket."""
    spark = docs.sparkSession
    small_batches(spark)
    wanted = spark.sparkContext.broadcast(frozenset(target_ids(labels, target_rows)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for b in tidied(batches):
            ids = b.column(0).to_pylist()
            for lo, hi in in_slices(b.column(1), _SLICE):
                owner, grams = hashed_grams(b.column(1).slice(lo, hi - lo), buckets)
                sums[1] += np.bincount(grams, minlength=buckets)
                chosen = np.fromiter((i in wanted.value for i in ids[lo:hi]), bool, hi - lo)
                sums[0] += np.bincount(grams[chosen[owner]], minlength=buckets)
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_pydict({"bucket": at, "t": sums[0][at], "c": sums[1][at]})

    counted = docs.select(id_col, text_col).mapInArrow(count, "bucket long, t long, c long")
    got = counted.groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).toPandas()
    sums = np.zeros((2, buckets))
    sums[:, got["bucket"].to_numpy(np.int64)] = got[["t", "c"]].to_numpy(float).T
    sums[1] *= sums[0].sum() / max(1.0, sums[1].sum())  # both to the target's size: what is rare in both weighs nothing
    p = sums + smoothing
    return np.round(np.log(p[0] / p[1]) * UNIT).astype(np.int64)


def toxic_words(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = 20_000, most: int = 65_536) -> dict[str, float]:
    """Log odds ratio of each toxic word, from at most ``rows`` labelled toxic and as many other texts; of
    the words (runs of letters in lower case) the ``most`` (a bound on the driver) in most toxic texts."""
    spark = docs.sparkSession
    marked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = {x: hash_sample(marked.filter(F.col("toxic") == x).select("doc_id"), rows) for x in (0, 1)}
    chosen = F.broadcast(ids[1].select(F.col("doc_id").alias("i"), F.lit(1).alias("x")).union(ids[0].select("doc_id", F.lit(0))))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(chosen, "i")
    texts = written(texts.select("x", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("words")).filter("words IS NOT NULL"), "labelled")
    n = {r[0]: r[1] for r in texts.groupBy("x").count().collect()}
    counted = texts.select("x", F.explode("words").alias("word")).groupBy("word").agg(F.sum("x").alias("t"), F.sum(1 - F.col("x")).alias("c"))
    ratio = F.log((F.col("t") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("c") + 0.5) / (n.get(0, 0) + 1))
    found = counted.filter(F.col("t") >= _TOXIC_TEXTS).withColumn("ratio", ratio).filter(F.col("ratio") > _TOXIC_RATIO)
    out = {r["word"]: r["ratio"] for r in found.orderBy(F.desc("t"), "word").limit(most).collect()}
    dropped(texts)
    return out


def is_toxic(text: F.Column, words: dict[str, float]) -> F.Column:
    """Whether a string column's text holds toxic words enough; nulls do not."""
    names, ratios = pa.array(list(words), pa.large_string()), np.array([*words.values(), 0.0])

    @F.arrow_udf("boolean")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in tidied(batches):
            out = np.zeros(len(texts), bool)
            for lo, hi in in_slices(texts, _SLICE):
                parts = pc.split_pattern_regex(pc.utf8_lower(whole(texts.slice(lo, hi - lo))), r"[^\pL]+")
                coded = parts.flatten().dictionary_encode()
                owner = np.repeat(np.arange(hi - lo), np.diff(parts.offsets.to_numpy()))
                at = pc.fill_null(pc.index_in(coded.dictionary, names), len(names)).to_numpy()[coded.indices.to_numpy()]
                real = (pc.binary_length(coded.dictionary).to_numpy() > 0)[coded.indices.to_numpy()]
                n = np.bincount(owner[real], minlength=hi - lo)
                hits = np.bincount(owner[at < len(names)], minlength=hi - lo)
                out[lo:hi] = (hits > 1) & (np.bincount(owner, ratios[at], hi - lo) > TOXIC_MEAN * np.maximum(20, n))
            yield pa.array(out)

    return judged(text) if words else F.lit(False)


def log_weights(text: F.Column, weights: np.ndarray) -> F.Column:
    """``struct(total, n)`` of a string column: its log weight in units of 2 ** -20, and its number of n-grams."""

    @F.arrow_udf("struct<total: long, n: long>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in tidied(batches):
            total, n = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for lo, hi in in_slices(texts, _SLICE):
                owner, grams = hashed_grams(texts.slice(lo, hi - lo), len(weights))
                np.add.at(total, owner + lo, weights[grams])
                n[lo:hi] = np.bincount(owner, minlength=hi - lo)
            yield pa.StructArray.from_arrays([pa.array(total), pa.array(n)], ["total", "n"])

    return scored(text)


def gumbel(id_: F.Column, text: F.Column, seed: int) -> F.Column:
    """Standard Gumbel noise from a hash of the id (of the text where that is null), in units of 2 ** -20."""
    u = (F.pmod(F.xxhash64(F.coalesce(id_.cast("string"), text, F.lit("")), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.round(-F.log(-F.log(u)) * UNIT).cast("long")


def top_threshold(rows: DataFrame, key: str, k: int, bits: int = 12) -> int:
    """The k-th largest of a long column: histograms over its next ``bits`` bits, refined in the boundary bucket alone."""
    low, prefix, above, shift = -(1 << 59), 0, 0, 60
    shifted = F.col(key) - F.lit(low)
    while shift:
        shift -= bits
        own = rows.filter(F.shiftright(shifted, shift + bits) == prefix)
        counts = sorted(((r[0], r[1]) for r in own.groupBy(F.shiftright(shifted, shift).alias("b")).count().collect()), reverse=True)
        for b, n in counts:
            if above + n >= k:
                prefix = b
                break
            above += n
    return prefix + low


def fitted_limit(rows: DataFrame, labels: DataFrame, most: int) -> int | None:
    """The weight (at common length) from which on a labelled text is likelier good than poor, in units of 2 ** -20.

    Of rows ``(id, weight)`` those of at most ``most`` good and ``most`` poor labelled ids count, an id's smallest
    weight where it has several. The limit is in the middle of the gap that loses the fewest good and keeps the fewest poor
    texts, a good one counting as much as ``_GOOD_TO_POOR`` poor ones. None if either kind is lacking.
    """
    marked = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = {x: hash_sample(marked.filter(F.col("quality") == x).select("doc_id"), most).select("doc_id", F.lit(x).alias("x")) for x in (0, 1)}
    chosen = F.broadcast(ids[0].union(ids[1]).withColumnRenamed("doc_id", "i"))
    got = rows.join(chosen, F.col("id") == F.col("i")).groupBy("i", "x").agg(F.min("weight").alias("weight")).toPandas()
    good, poor = (np.sort(got["weight"][got["x"] == x].to_numpy(np.int64)) for x in (1, 0))
    if not len(good) or not len(poor):
        return None
    cuts = np.unique(np.concatenate([good, poor]))
    cost = _GOOD_TO_POOR * np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(poor, cuts) / len(poor)
    k = int(np.flatnonzero(cost == cost.min())[-1])
    return int((cuts[k - 1] + cuts[k]) // 2 if k else cuts[0])


def resample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, buckets: int = 1 << 16, target_rows: int = 20_000, smoothing: float = 20.0, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, log_weight, key, kept)`` of every row, and the columns named in ``carry``.

    ``log_weight`` is the sum of the text's log ratios, ``key`` its weight at common length with Gumbel noise, both in
    units of 2 ** -20; ``kept`` marks the ``k`` largest keys of the texts that are not toxic. Without ``k``, it is fitted: the number of these
    texts whose weight reaches the limit that best parts labelled good and poor texts (all without such labels). The noise then only moves
    rows at the margin. Rows with the k-th key all stay.

    Null, empty and blank texts have weight 0. Null ids take
    their noise from the text. Repeated rows share a key and stay or go together. Labels that are
    null or name no row teach nothing. An empty table gives no row.
    """
    weights = fit(docs, labels, id_col=id_col, text_col=text_col, buckets=buckets, target_rows=target_rows, smoothing=smoothing)
    toxic = is_toxic(F.col(text_col), toxic_words(docs, labels, id_col=id_col, text_col=text_col, rows=target_rows))
    rows = docs.select(F.col(id_col).alias("id"), *carry, log_weights(F.col(text_col), weights).alias("__w"), toxic.alias("__toxic"), gumbel(F.col(id_col), F.col(text_col), seed).alias("__noise"))
    at_length = F.expr(f"if(__w.n > 0, {LENGTH} * __w.total div greatest(__w.n, 1), 0L)")
    rows = written(rows.withColumn("weight", at_length).withColumn("key", F.col("weight") + F.col("__noise")), "weights")
    clean = rows.filter(~F.col("__toxic"))
    if k is None:
        limit = fitted_limit(rows, labels, target_rows)
        k = (clean if limit is None else clean.filter(F.col("weight") >= limit)).count()
    least = top_threshold(clean, "key", k) if k > 0 else None
    kept = F.lit(False) if least is None else ~F.col("__toxic") & (F.col("key") >= F.lit(least))
    return rows.select("id", *carry, F.col("__w.total").alias("log_weight"), "key", kept.alias("kept"))
