"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a word
is the sum over all its segmentations into pieces, found by a forward pass; a text's is the product
over its words. Pieces never cross white space, nor every ``_LONG``-th place of a longer word; a word
starts with the piece mark of word starts. Beside the languages stands a background that gives every
piece the same probability: what it explains as well as the best language is in none of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normcast.llm.encoding import in_slices, whole
from normcast.llm.scratch import small_batches, tidied

UNDETERMINED = "und"
_MARK = "▁"
#: Probability of any one character as a piece of its own besides the vocabulary: the same in every language.
UNKNOWN = 1e-7
#: Piece probabilities are multiplied by this for each character, so that products stay within a float's range.
_SCALE = np.exp(2.5)
#: Longer words are cut after so many characters, in learning and in scoring; as many unknown ones stay within a float's range.
_LONG = 48
#: Bytes of the longest word whose log probabilities are kept.
_KEPT_BYTES = 64
#: Words that go through a forward pass together.
_TOGETHER = 8_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary's pieces of at most ``longest`` characters, in lower case, and their places in words.

    A piece is found by the 64-bit hash of its characters, rolled over all stretches of one length at a time.
    """

    def __init__(self, path: str, longest: int = 12):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        names = (model.id_to_piece(i) for i in ids)
        self.names = sorted({p for p in names if p == p.lower() and 0 < len(p) <= longest})
        self.sizes = np.array([len(p) for p in self.names])
        self._by_size = []
        for n in range(1, longest + 1):
            at = np.flatnonzero(self.sizes == n)
            codes = np.frombuffer("".join(self.names[i] for i in at).encode("utf-32-le"), "<u4").reshape(-1, n).astype(np.uint64)
            hashes = np.zeros(len(at), np.uint64)
            for k in range(n):
                hashes = self._rolled(hashes, codes[:, k])
            order = np.argsort(hashes)
            sieve = np.zeros(1 << 20, bool)
            sieve[hashes >> np.uint64(44)] = True
            self._by_size.append((hashes[order], at[order], sieve))

    @staticmethod
    def _rolled(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        x = (hashes + codes) * _FACTOR
        return x ^ (x >> np.uint64(29))

    def matches(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(word, end, piece)``: all places of pieces by their end within the word. ``codes`` are the characters of
        words that a line end follows each; ``starts`` where they start."""
        found = []
        hashes = np.zeros(len(codes), np.uint64)
        for n, (known, piece, sieve) in enumerate(self._by_size, 1):
            hashes = self._rolled(hashes[: len(codes) - n + 1], codes[n - 1 :])
            if not len(known):
                continue
            at = np.flatnonzero(sieve[hashes >> np.uint64(44)])
            k = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
            right = known[k] == hashes[at]
            found.append(((at[right] + n), piece[k[right]]))
        ends, pieces = (np.concatenate(x) for x in zip(*found))
        owner = np.searchsorted(starts, ends, "left") - 1
        return owner, ends - starts[owner], pieces

    def _pass(self, words: list[str], scaled: np.ndarray):
        """Forward sums of words of at most ``_LONG`` characters, by model, place and word."""
        joined = "\n".join([_MARK + w for w in words]) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
        line_ends = np.flatnonzero(codes == 10)
        starts = np.concatenate([[0], line_ends[:-1] + 1])
        lengths = line_ends - starts
        owner, end, piece = self.matches(codes, starts)
        order = np.argsort(end.astype(np.uint16), kind="stable")
        owner, end, piece = owner[order], end[order], piece[order]
        begin = end - self.sizes[piece]
        n = int(lengths.max())
        cuts = np.searchsorted(end, np.arange(n + 2))
        f = np.zeros((scaled.shape[1], n + 1, len(words)))
        f[:, 0] = 1.0
        for j in range(1, n + 1):
            at = slice(cuts[j], cuts[j + 1])
            places = begin[at] * len(words) + owner[at]
            for k in range(len(f)):
                f[k, j] = f[k, j - 1] * (UNKNOWN * _SCALE) + np.bincount(owner[at], f[k].reshape(-1)[places] * scaled[piece[at], k], len(words))
        return lengths, f, (owner, begin, end, piece, cuts)

    def forward(self, words: list[str], scaled: np.ndarray) -> np.ndarray:
        """log P of each word (rows) in each model (columns); ``scaled``: piece by model, times scale ** length."""
        out = np.zeros((len(words), scaled.shape[1]))
        parts, owner = in_stretches(words)
        for at in range(0, len(parts), _TOGETHER):
            some = parts[at : at + _TOGETHER]
            lengths, f, _ = self._pass(some, scaled)
            logs = np.log(f[:, lengths, np.arange(len(some))]) - lengths * np.log(_SCALE)
            np.add.at(out, owner[at : at + _TOGETHER], logs.T)
        return out

    def expected(self, words: list[str], counts: np.ndarray, scaled: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of all words (one language): forward, then backward."""
        lengths, f, (owner, begin, end, piece, cuts) = self._pass(words, scaled[:, None])
        f = f[0]
        b = np.zeros_like(f)
        b[lengths, np.arange(len(words))] = 1.0
        for j in range(len(f) - 1, 0, -1):
            b[j - 1] += b[j] * (UNKNOWN * _SCALE)
            at = slice(cuts[j], cuts[j + 1])
            np.add.at(b, (begin[at], owner[at]), b[j, owner[at]] * scaled[piece[at]])
        total = f[lengths, np.arange(len(words))]
        uses = f[begin, owner] * scaled[piece] * b[end, owner] * (counts / total)[owner]
        return np.bincount(piece, uses, len(self.names))

    def scaled(self, probabilities: np.ndarray) -> np.ndarray:
        return (probabilities.T * _SCALE**self.sizes).T

    def beside_background(self, probabilities: np.ndarray) -> np.ndarray:
        """``scaled`` models with one more, in which all pieces are equally likely."""
        return self.scaled(np.column_stack([probabilities, np.full(len(self.names), 1 / len(self.names))]))


def in_stretches(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Words cut after every ``_LONG`` characters, and the word that each stretch is of."""
    if max(map(len, words), default=0) <= _LONG:
        return words, np.arange(len(words))
    parts = [(w[a : a + _LONG], i) for i, w in enumerate(words) for a in range(0, max(1, len(w)), _LONG)]
    return [p for p, _ in parts], np.array([i for _, i in parts])


def words_of(text: str) -> list[str]:
    return text.lower().split()


def fit_language(texts: list[str], pieces: Pieces, rounds: int, smoothing: float) -> tuple[np.ndarray, float]:
    """Piece probabilities of one language by expectation maximisation from equal ones, and by how much they
    explain a character of these texts better than equal ones do (mean log ratio)."""
    counted = Counter(p for t in texts for p in in_stretches(words_of(t))[0])
    words, counts = list(counted), np.array(list(counted.values()), float)
    p = np.full(len(pieces.names), 1 / len(pieces.names))
    for _ in range(rounds if words else 0):
        uses = np.zeros(len(p))
        for at in range(0, len(words), _TOGETHER):
            uses += pieces.expected(words[at : at + _TOGETHER], counts[at : at + _TOGETHER], pieces.scaled(p))
        p = (uses + smoothing) / (uses.sum() + smoothing * len(p))
    if not words:
        return p, 0.0
    logs = pieces.forward(words, pieces.beside_background(p[:, None]))
    return p, float(counts @ (logs[:, 0] - logs[:, 1]) / (counts @ [len(w) + 1 for w in words]))


def held_out(id_: F.Column) -> F.Column:
    """Rows that teach nothing: CRC-32 of the id as text leaves 1 when divided by 3. A null id counts as no text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 300, rounds: int = 3, smoothing: float = 0.1) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Learned languages in order, piece by language probabilities, and each language's mean log ratio to the background.

    Learns from rows that are not held out and have a language and a text: of each language those
    with the smallest hash of their id, ``rows_per_language`` at most. Ids are ranked without their
    texts; only the chosen ids are broadcast, and each language is fitted by a task of its own. An id that
    has several texts in a language teaches the one with the smallest hash, so repeated rows count once.
    """
    eligible = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    h = F.pmod(F.xxhash64("i"), F.lit(1 << 32))
    slim = eligible.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"))
    # about twice the wanted rows of a language pass its limit, so no task ranks a whole language
    limits = slim.groupBy(F.col("l").alias("l1")).agg(F.least(F.lit(1.0), 2.0 * rows_per_language / F.count("*")).alias("part"))
    few = slim.join(F.broadcast(limits), F.col("l") == F.col("l1")).filter(h < F.col("part") * (1 << 32)).select("i", "l").distinct()
    chosen = few.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(h, "i"))).filter(F.col("r") <= rows_per_language).select("i", "l")
    rows = eligible.select(F.col(id_col).alias("i0"), F.col(lang_col).alias("l0"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    rows = rows.join(F.broadcast(chosen), (F.col("i0") == F.col("i")) & (F.col("l0") == F.col("l"))).groupBy("i", "l").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x")).select("l", "x.text")

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p, ratio = fit_language(sorted(rows["text"]), Pieces(vocabulary), rounds, smoothing)
        return pd.DataFrame({"l": [key[0]], "p": [p.tolist()], "ratio": [ratio]})

    got = rows.groupBy("l").applyInPandas(one, "l string, p array<double>, ratio double").collect()
    got.sort(key=lambda r: r["l"])
    return [r["l"] for r in got], np.array([r["p"] for r in got]).T, np.array([r["ratio"] for r in got])


class WordLogs:
    """Log probabilities of words, kept for at most ``keep`` short words; when there are more, those met again stay."""

    def __init__(self, vocabulary: str, probabilities: np.ndarray, keep: int):
        self.pieces, self.keep = Pieces(vocabulary), keep
        self.scaled = self.pieces.beside_background(probabilities)
        self.words, self.logs, self.met = pa.array([], pa.large_string()), np.zeros((0, self.scaled.shape[1])), np.zeros(0, np.int64)

    def of(self, words: pa.Array) -> np.ndarray:
        """By word and model, of distinct words."""
        at = pc.index_in(words, value_set=self.words)
        new = pc.is_null(at).to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        out = np.zeros((len(words), self.scaled.shape[1]))
        out[~new] = self.logs[at[~new]]
        self.met[at[~new]] += 1
        if new.any():
            lacking = words.filter(pa.array(new))
            out[new] = logs = self.pieces.forward([w.lower() for w in lacking.to_pylist()], self.scaled)
            self._remember(lacking, logs)
        return out

    def _remember(self, words: pa.Array, logs: np.ndarray) -> None:
        short = pc.less_equal(pc.binary_length(words), _KEPT_BYTES).to_numpy(zero_copy_only=False)
        words, logs = words.filter(pa.array(short))[: self.keep // 2], logs[short][: self.keep // 2]
        if len(self.words) + len(words) > self.keep:
            stay = np.argsort(-self.met, kind="stable")[: min(self.keep // 2, int((self.met > 0).sum()))]
            self.words, self.logs, self.met = self.words.take(pa.array(stay)), self.logs[stay], np.zeros(len(stay), np.int64)
        self.words, self.logs = pa.concat_arrays([self.words, words]), np.concatenate([self.logs, logs])
        self.met = np.concatenate([self.met, np.zeros(len(words), np.int64)])


_FOUND = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())])


def predictions(text: F.Column, languages: list[str], probabilities: np.ndarray, typical: np.ndarray, vocabulary: str, keep: int = 200_000) -> F.Column:
    """``struct(lang, score, fit)`` of a string column; see ``identify``."""

    @F.arrow_udf(_FOUND)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        logs = WordLogs(vocabulary, probabilities, keep) if languages else None
        names = pa.array([*languages, UNDETERMINED], pa.string())

        def judged(texts: pa.Array) -> list[np.ndarray]:
            flat = whole(texts)
            parts = pc.utf8_split_whitespace(flat)
            coded = parts.flatten().dictionary_encode()
            real = (pc.binary_length(coded.dictionary).to_numpy() > 0)[:, None]  # what is left of white space at a text's ends
            table = logs.of(coded.dictionary) * real
            owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
            codes = coded.indices.to_numpy()
            sizes = (pc.utf8_length(coded.dictionary).to_numpy() + 1) * real[:, 0]
            *totals, background = (np.bincount(owner, table[codes, k], len(texts)) if len(owner) else np.zeros(len(texts)) for k in range(len(languages) + 1))
            n_chars = np.bincount(owner, sizes[codes], len(texts)) if len(owner) else np.zeros(len(texts))
            totals = np.stack(totals, axis=1)
            best = totals.argmax(axis=1)
            top = totals.max(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = (top - background) / n_chars / typical[best]
            score = 1 / np.exp(totals - top[:, None]).sum(axis=1)
            letters = pc.match_substring_regex(flat, r"\pL").to_numpy(zero_copy_only=False)
            return [np.where(letters, best, len(languages)), np.where(letters, score, 0.0), np.where(letters & np.isfinite(ratio), ratio, 0.0)]

        for texts in tidied(batches):
            if languages:
                found = [judged(texts.slice(lo, hi - lo)) for lo, hi in in_slices(texts, 2 << 20)]
                best, score, fit_ = (np.concatenate(x) if x else np.zeros(0) for x in (zip(*found) if found else ((), (), ())))
            else:
                best, score, fit_ = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
            yield pa.StructArray.from_arrays([names.take(pa.array(best.astype(np.int64))), pa.array(score), pa.array(fit_)], ["lang", "score", "fit"])

    return scored(text)


def identify(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = (), **fitting) -> DataFrame:
    """``(id, held_out, lang_pred, score, fit)`` of every row, and the columns named in ``carry``.

    The prediction reads the text alone. It is ``und`` with score 0 where the text is null or has no
    letter, or nothing could be learned; else the learned language that gives the text the highest probability, and its
    posterior under equal priors. A posterior says which language fits best, not whether it fits: ``fit`` is by how
    much that language explains a character better than the background does (mean log ratio), in shares of the same of the
    language's learned texts. It is about 1 for texts in the language at any length, and about 0 or less for text in
    none of the learned languages; 0 where the prediction is ``und``.

    Repeated rows are each predicted; ties go to the first language by name. An empty table gives no row.
    """
    small_batches(docs.sparkSession)
    languages, p, typical = fit(docs, vocabulary, id_col=id_col, text_col=text_col, lang_col=lang_col, **fitting)
    rows = docs.select(F.col(id_col).alias("id"), *carry, held_out(F.col(id_col)).alias("held_out"), predictions(F.col(text_col), languages, p, typical, vocabulary).alias("__found"))
    return rows.select("id", *carry, "held_out", F.col("__found.lang").alias("lang_pred"), F.col("__found.score").alias("score"), F.col("__found.fit").alias("fit"))
