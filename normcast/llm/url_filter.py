"""URL filters: rules on hosts and paths, then naive Bayes over segmented host and path tokens.

A host's labels are cut into words by a unigram Viterbi pass: the words and their ranks come from a
public vocabulary, a word's probability falls with its rank, and the most probable cut wins. The URLs that a rule
decides are labelled examples for a multinomial naive Bayes model, without what the rule itself looks at; of the other URLs
those whose segmented host holds a seed word are further examples of the unwanted kind, and the rest stand for the wanted one (without
seeds these others teach nothing).
The model then scores every URL by all its tokens, so words that keep company with blocked URLs and seeds come to count as well.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of the host names of unwanted sites (gambling, pills, spam, advertising and tracking, adult): a choice, not a standard.
SEED_WORDS = ("ads", "bet", "bets", "betting", "casino", "gambling", "jackpot", "lottery", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx")
_TOKEN = re.compile(r"[a-z]+|[0-9]+")


def host_of(url: F.Column) -> F.Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: F.Column) -> F.Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without a host's ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest_of_host(host: F.Column, own: str) -> F.Column:
    return host.substr(F.lit(1), F.length(host) - F.lit(len(own)))


def rule_of(host: F.Column, path: F.Column, rules: Sequence[tuple[str, str]]) -> F.Column:
    """``struct(rule, verdict, host, path)`` of the longest fitting rule, else null: host and path without the part that
    the rule looks at. A rule is ``(verdict, "host/path")``."""
    out = F.lit(None).cast("struct<rule:string,verdict:string,host:string,path:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), _rest_of_host(host, own).alias("host"), F.substring(path, len(start) + 2, 1 << 30).alias("path"))).otherwise(out)
    return out


class Segmenter:
    """Most probable cut of a name into words.

    ``vocabulary`` is a tokenizer file whose whole words end with ``</w>``, in order of frequency:
    the r-th has probability in proportion to 1 / (r + 10). A stretch of n letters that is no
    such word costs as much as a word of probability 10 ** -(6 + 2 n). Ties go to fewer words.
    """

    def __init__(self, vocabulary: str, longest: int = 24, keep: int = 200_000):
        with open(vocabulary, encoding="utf-8") as f:
            ranked = sorted(json.load(f)["model"]["vocab"].items(), key=lambda x: x[1])
        names = [t[:-4] for t, _ in ranked if t.endswith("</w>") and t[:-4].isascii() and t[:-4].isalpha() and (len(t) > 5 or t[0] in "ai")]
        total = sum(1 / (r + 10) for r in range(len(names)))
        self.cost = {w: math.log(total * (r + 10)) for r, w in enumerate(names)}
        self.longest, self.keep, self.known, self.longest_kept = longest, keep, {}, 64

    def _cut(self, name: str) -> tuple[str, ...]:
        best = [(0.0, 0, 0)]
        for j in range(1, len(name) + 1):
            found = (math.inf, 0, 0)
            for i in range(max(0, j - self.longest), j):
                cost = self.cost.get(name[i:j], (6 + 2 * (j - i)) * math.log(10))
                found = min(found, (best[i][0] + cost, best[i][1] + 1, i))
            best.append(found)
        words, j = [], len(name)
        while j:
            i = best[j][2]
            words.append(name[i:j])
            j = i
        return tuple(reversed(words))

    def words(self, name: str) -> tuple[str, ...]:
        got = self.known.get(name)
        if got is None:
            got = self._cut(name)
            if len(name) <= self.longest_kept:
                if len(self.known) >= self.keep:
                    self.known.clear()
                self.known[name] = got
        return got

    def tokens(self, host: str, path: str) -> tuple[list[str], list[str]]:
        """Host words, and path tokens marked as such; numbers count as one token by their number of digits."""
        hosts = [w for t in _TOKEN.findall(host) for w in (self.words(t) if t.isalpha() else (f"#{len(t)}",))]
        paths = [f"/{t}" if t.isalpha() else f"/#{len(t)}" for t in _TOKEN.findall(path.lower())]
        return hosts, paths


def _bucket(token: str, buckets: int) -> int:
    return xxhash.xxh64_intdigest(token) % buckets


def fit(urls: DataFrame, vocabulary: str, seeds: Sequence[str], buckets: int, smoothing: float) -> tuple[float, np.ndarray]:
    """Prior log odds and each token bucket's log odds of the unwanted class, from every row of ``(host, path, verdict)``.

    A row with a verdict is of its class; others are unwanted where the host holds a seed word, else wanted, and teach nothing without seeds. Smoothing is over the buckets seen; others weigh nothing. What returns to the driver is one row
    for each bucket, and two counts.
    """
    unwanted = frozenset(seeds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, sums = Segmenter(vocabulary), np.zeros((2, buckets + 1), np.int64)
        for b in batches:
            for host, path, verdict in zip(*(c.to_pylist() for c in b.columns)):
                hosts, paths = segmenter.tokens(host, path)
                if not (verdict or unwanted):
                    continue
                k = int(verdict == "block" if verdict else not unwanted.isdisjoint(hosts))
                sums[k, buckets] += 1
                for t in (*hosts, *paths):
                    sums[k, _bucket(t, buckets)] += 1
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_pydict({"bucket": at, "good": sums[0][at], "bad": sums[1][at]})

    counted = urls.mapInArrow(count, "bucket long, good long, bad long").groupBy("bucket").agg(F.sum("good"), F.sum("bad"))
    sums = np.zeros((2, buckets + 1))
    for b, good, bad in counted.collect():
        sums[:, b] = good, bad
    rows = sums[:, buckets] + smoothing
    tokens = sums[:, :buckets]
    seen = tokens.any(axis=0)
    p = (tokens + smoothing) / (tokens.sum(axis=1, keepdims=True) + smoothing * max(1, seen.sum()))
    odds = np.where(seen, np.log(p[1] / p[0]), 0.0)
    return float(np.log(rows[1] / rows[0])), odds


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], vocabulary: str, *, id_col: str = "page_id", url_col: str = "url", seeds: Sequence[str] = SEED_WORDS, buckets: int = 1 << 16, smoothing: float = 0.1) -> DataFrame:
    """``(id, host, path, rule, verdict, log_odds)`` of every row.

    The longest fitting rule gives the verdict and its name; without one, ``rule`` is null and the
    model blocks where its log odds are over 0. The model learns from all rows: those that rules decide, less what the rule looks at, and the others by their seed words. URLs that are null or lack ``://`` have an empty host
    and path, no token, and the prior decides. Repeated rows are judged alike, each with its row; null ids
    are kept. An empty table gives no row. Other columns are ignored.
    """
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    parts = parts.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    learnt = parts.select(F.coalesce("r.host", "host").alias("host"), F.coalesce("r.path", "path").alias("path"), F.col("r.verdict").alias("verdict"))
    prior, odds = fit(learnt, vocabulary, seeds, buckets, smoothing)

    @F.arrow_udf("double")
    def scored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        segmenter = Segmenter(vocabulary)
        for hosts, paths in batches:
            out = []
            for h, p in zip(hosts.to_pylist(), paths.to_pylist()):
                own, more = segmenter.tokens(h, p)
                out.append(prior + sum(float(odds[_bucket(t, buckets)]) for t in (*own, *more)))
            yield pa.array(out, pa.float64())

    ruled = parts.withColumn("log_odds", scored("host", "path"))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return ruled.select("id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "log_odds")
