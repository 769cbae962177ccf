"""Quality rules: repetition and length, then a log-likelihood ratio of hashed n-grams between trusted
documents and the whole corpus. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normcast.llm.scratch import dropped, hash_sample, small_batches, written

WHITE = "[\\x20\\x09-\\x0D]+"
#: Weights are kept as integers in units of 2 ** -20, so sums do not depend on their order.
UNIT = 1 << 20


def words(text: F.Column) -> F.Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def word_hashes(w: F.Column) -> F.Column:
    """64 bits of XXH64 of each word: windows, pairs and single words are all told apart by these."""
    return F.transform(w, lambda x: F.xxhash64(x))


def chained(h: F.Column, step: int) -> F.Column:
    """A hash of the hashes ``h[i]`` and ``h[i + step]``, for each i that has both."""
    return F.transform(F.slice(h, step + 1, F.greatest(F.size(h) - step, F.lit(0))), lambda y, i: F.xxhash64(F.get(h, i), y))


def repeated_window_words(rows: DataFrame, n: int = 8) -> DataFrame:
    """``rows`` (with ``w``, its words, ``hw``, their hashes, and ``pairs``, ``chained(hw, 1)``) with ``n_repeat_words``:
    the words that lie in an ``n``-word window (2 words at least) found twice or more in ``w``, the first included.

    A window's hash is chained from those of two windows half as long, which may overlap. Windows whose hashes repeat
    within a row are compared by 32 further bits of their words, 96 in all.
    """
    span, rows = 2, rows.withColumn("windows", F.col("pairs"))
    while span < n:
        step = min(span, n - span)
        rows, span = rows.withColumn("windows", chained(F.col("windows"), step)), span + step

    def twins(s: F.Column, *names: str) -> F.Column:
        def alike(a: F.Column, b: F.Column) -> F.Column:
            out = a[names[0]] == b[names[0]]
            for name in names[1:]:
                out = out & (a[name] == b[name])
            return F.coalesce(out, F.lit(False))

        return F.filter(s, lambda e, k: alike(e, F.get(s, k - 1)) | alike(e, F.get(s, k + 1)))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def cover(acc: F.Column, i: F.Column) -> F.Column:
        return F.struct((acc["n"] + i + n - F.greatest(acc["end"], i)).cast("long").alias("n"), (i + n).alias("end"))

    def covered(sorted_by_hash: F.Column) -> F.Column:
        # one-element arrays name intermediate values, so that each is computed once a row
        checked = F.transform(F.array(twins(sorted_by_hash, "x")), lambda s: F.array_sort(F.transform(s, lambda e: F.struct(e["x"], F.hash(F.slice(F.col("w"), e["i"] + 1, n)).alias("y"), e["i"]))))
        return F.get(F.transform(checked, lambda s: F.aggregate(F.array_sort(F.transform(twins(s, "x", "y"), lambda e: e["i"])), none, cover)["n"]), F.lit(0))

    keyed = F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    found = F.get(F.transform(F.array(keyed), covered), F.lit(0))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    return rows.withColumn("n_repeat_words", F.when(repeats, found).otherwise(F.lit(0).cast("long"))).drop("windows")


def base_features(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``w`` (its words) and the features of the base rules; no text counts as an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = hashed(docs, text_col).withColumn("lines", lines).withColumn("n_words", F.size("w").cast("long"))
    rows = repeated_window_words(rows)
    return (
        rows.withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .drop("lines")
    )


def hashed(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``w`` (its words), ``hw`` (their hashes) and ``pairs`` (hashes of words that follow each other)."""
    rows = docs.withColumn("w", words(F.col(text_col)))
    return rows.withColumn("hw", word_hashes(F.col("w"))).withColumn("pairs", chained(F.col("hw"), 1))


def gram_buckets(rows: DataFrame, buckets: int, *keep: F.Column | str) -> DataFrame:
    """One row for each word and each pair of words, with its hash bucket; rows without words have one with a null bucket."""
    grams = rows.select(*keep, F.explode_outer(F.concat("hw", "pairs")).alias("__gram"))
    return grams.withColumn("bucket", F.pmod("__gram", F.lit(buckets)).cast("int")).drop("__gram")


def trusted_ids(labels: DataFrame, most: int) -> DataFrame:
    """Ids of good, non-toxic labelled documents: all, or the ``most`` with the smallest hash."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return hash_sample(good, most)


def fit(docs: DataFrame, trusted: DataFrame, *, id_col: str, text_col: str, buckets: int, smoothing: float) -> DataFrame:
    """``(bucket, weight)``: log P(bucket | trusted) - log P(bucket | corpus) in units of 2 ** -20.

    Corpus counts are scaled to the trusted ones' size before both are smoothed, so what is rare in both weighs nothing.
    Corpus counts cover every row of ``docs``. ``trusted`` (column ``doc_id``) is bounded by its
    maker and is broadcast; the result has ``buckets`` rows at most.
    """
    own = F.broadcast(trusted.select(F.col("doc_id").alias("__t"), F.lit(1).alias("__one")))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(own, F.col("__id") == F.col("__t"), "left")
    grams = gram_buckets(hashed(rows, "text"), buckets, F.coalesce("__one", F.lit(0)).alias("t")).filter("bucket IS NOT NULL")
    counts = grams.groupBy("bucket").agg(F.sum("t").alias("t"), F.count("*").alias("c"))
    counts = written(counts, "grams")
    every = counts.agg((F.sum("t") / F.sum("c")).alias("scale"))
    ratio = F.log((F.col("t") + smoothing) / (F.col("c") * F.col("scale") + smoothing))
    weights = written(counts.crossJoin(F.broadcast(every)).select("bucket", F.round(ratio * UNIT).cast("long").alias("weight")), "weights")
    dropped(counts)
    return weights


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 16, smoothing: float = 20.0, trusted_rows: int = 20_000, threshold: float = -0.15) -> DataFrame:
    """Features and verdict of every row: ``id``, ``n_words``, the base features, ``base_failed``,
    ``n_grams``, ``ratio`` (sum of weights, units of 2 ** -20) and ``kept``.

    A row is kept if the base rules pass and its mean weight by gram is ``threshold`` or more. The
    trusted model is fitted on at most ``trusted_rows`` labelled documents, those with the smallest
    hash of their id; the corpus model on all rows. Nulls in labels and unknown ids teach nothing;
    without any trusted row all weights are 0. Null, empty and blank texts have no
    words and fail the base rules. Repeated rows and ids are each judged. An empty table gives no
    row. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    weights = fit(docs, trusted_ids(labels, trusted_rows), id_col=id_col, text_col=text_col, buckets=buckets, smoothing=smoothing)
    keys = ["row", "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = base_features(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").withColumn("row", F.monotonically_increasing_id())
    grams = gram_buckets(rows, buckets, *keys)
    scored = grams.join(F.broadcast(weights), "bucket", "left").groupBy(*keys).agg(F.count("bucket").alias("n_grams"), F.coalesce(F.sum("weight"), F.lit(0)).alias("ratio"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= F.lit(round(threshold * UNIT)) * F.col("n_grams"))).drop("row")
