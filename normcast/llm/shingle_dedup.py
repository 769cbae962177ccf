"""Operator 10 at a similarity of 0.8: SimHash fingerprints of word shingles, blocks, Hamming checks, then the exact Jaccard similarity; components.

Texts with a similarity of 0.8 differ in 15 of 100 bits of a SimHash (19 in sets of five shingles), too many for 64 bits in a few blocks.
So a fingerprint has 704 bits in ``BLOCKS`` blocks of ``BITS``, and two texts meet where one block is equal: at a similarity of 0.8 all
blocks differ with a chance of (1 - 0.85 ** 10) ** 66, one in a million (one in 7,000 for sets of five). What meets and differs in at most
``DIFFERING`` of the first 192 bits (unrelated texts: 3 in 100 million) is compared by its whole sets of shingles.
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
from normcast.llm.scratch import dropped, joined, shuffle_width, small_batches, tidied, written
from normcast.llm.simhash_dedup import AT_ONCE, components, least_reached

#: A fingerprint: words of 64 bits, each cut into blocks; four bits of a word are in none.
WORDS, PER_WORD, BITS = 11, 6, 10
BLOCKS = WORDS * PER_WORD
#: Bits that may differ of the ``CHECKED`` first words, and of the first two alone, which are compared first.
CHECKED, DIFFERING, AT_FIRST = 3, 58, 46
#: Rows of a block's value that one task compares; more are dealt into parts.
_CROWD = 1 << 14
_SIDE = 512
_STEP = 1 << 12
_SLICE = 2 << 20
_FACTORS = np.random.default_rng(42).integers(1, 1 << 63, WORDS, np.uint64) | np.uint64(1)


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its ``width``-word shingles, A-Z in lower case.

    Words are runs without ASCII white space. Fewer words than ``width`` make one shingle; no word makes none.
    """
    for lo, hi in in_slices(texts, _SLICE):
        parts = pc.split_pattern_regex(whole(texts.slice(lo, hi - lo)), "[ \t-\r]+")
        coded = parts.flatten().dictionary_encode()
        known = np.array([xxhash.xxh64_intdigest(w.encode().lower()) if w else 0 for w in coded.dictionary.to_pylist()], np.uint64)
        hashes = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)
        offsets = parts.offsets.to_numpy()
        for a, b in zip(offsets - offsets[0], offsets[1:] - offsets[0]):
            words = hashes[a:b]
            words = words[words != 0]  # what is left of white space at a text's ends
            n = min(width, len(words))
            grams = np.full(max(0, len(words) - n + 1) if n else 0, n, np.uint64)
            for i in range(n):
                grams = _stirred(grams * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(grams)])
            yield np.unique(grams)


def _simhash(grams: np.ndarray) -> np.ndarray:
    """The words of a set's SimHash: a bit is 1 if set in over half of the shingles' hashes, which are stirred anew for each word."""
    set_in = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(grams), _STEP):
        hashes = _stirred(grams[at : at + _STEP, None] * _FACTORS)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        for lo in range(0, len(bits), 255):  # as many as one byte counts
            set_in += bits[lo : lo + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * set_in > len(grams), bitorder="little").view("<u8").astype(np.uint64)


_SIGNED = "struct<node: long, keys: array<long>>"


def signatures(text: F.Column, width: int) -> F.Column:
    """``struct(node, keys)`` of a string column: a hash of its set of shingles, and its SimHash's words. No word, no key."""

    @F.arrow_udf(_SIGNED)
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in tidied(batches):
            found = [(xxhash.xxh64_intdigest(g.tobytes()), _simhash(g) if len(g) else g) for g in shingle_sets(texts, width)]
            keys = np.concatenate([np.zeros(0, np.uint64), *(k for _, k in found)]).view(np.int64)
            bounds = np.cumsum([0, *(len(k) for _, k in found)]).astype(np.int32)
            nodes = pa.array(np.fromiter((n for n, _ in found), np.uint64, len(found)).view(np.int64))
            yield pa.StructArray.from_arrays([nodes, pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys))], ["node", "keys"])

    return signed(text)


def _sets(text: F.Column, width: int) -> F.Column:
    @F.arrow_udf("array<long>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in tidied(batches):
            found = list(shingle_sets(texts, width))
            bounds = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))

    return made(text)


def _close(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that join what chains of rows within the bits join: all such pairs, or a forest where they are many."""
    n = len(fps)
    for lo in range(0, n, _SIDE):
        x = fps[lo : lo + _SIDE]
        for hi in range(lo, n, _SIDE):
            y = fps[hi : hi + _SIDE]
            apart = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
            apart += np.bitwise_count(x[:, None, 1] ^ y[None, :, 1])
            r, c = np.nonzero(apart <= AT_FIRST)
            if lo == hi:
                r, c = r[r < c], c[r < c]
            whole_apart = apart[r, c].astype(int) + np.bitwise_count(x[r, 2:] ^ y[c, 2:]).sum(axis=1, dtype=int)
            near = whole_apart <= DIFFERING
            r, c = r[near] + lo, c[near] + hi
            if len(r) > len(x) + len(y):
                nodes, ends = np.unique(np.concatenate([r, c]), return_inverse=True)
                roots = least_reached(ends[: len(r)], ends[len(r) :], len(nodes))
                r, c = nodes, nodes[roots]
                r, c = r[r != c], c[r != c]
            yield r, c


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over batches ordered by tile ``(k, i, j)``: candidate links within each tile, one row (a, b) each."""

    def linked(tiles: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.flatnonzero((tiles[1:] != tiles[:-1]).any(axis=1)) + 1, [len(nodes)]])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(starts, starts[1:]):
            if e - s > 1:
                for r, c in _close(fps[s:e]):
                    a.append(nodes[s + r])
                    b.append(nodes[s + c])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        tiles = np.stack(columns[:3], axis=1)
        now = [tiles, columns[3], np.stack(columns[4:], axis=1).view(np.uint64)]
        same = (tiles == tiles[-1]).all(axis=1)
        if held and not (held[0][0][0] == tiles[-1]).all() or not same.all():
            last = len(tiles) - (len(tiles) if same.all() else int(np.argmin(same[::-1])))
            yield linked(*(np.concatenate(x) for x in zip(*held, [y[:last] for y in now])))
            held, now = [], [y[last:] for y in now]
        held.append(now)
    if held:
        yield linked(*(np.concatenate(x) for x in zip(*held)))


def _near(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Links that join what is linked among the sets: a spanning forest, by breadth-first search."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.unique(np.concatenate(sets), return_inverse=True)[1], np.repeat(np.arange(len(sets)), sizes)
    starts = np.cumsum(sizes) - sizes
    rest, queue, marked = np.ones(len(sets), bool), [], np.zeros(int(flat.max()) + 1, bool)
    while rest.any():
        if not queue:
            queue = [int(np.argmax(rest))]
            rest[queue[0]] = False
        x = queue.pop()
        mine = flat[starts[x] : starts[x] + sizes[x]]
        marked[mine] = True
        common = np.bincount(owner[marked[flat]], minlength=len(sets))
        marked[mine] = False
        near = np.flatnonzero(rest & (common >= similarity * (sizes + sizes[x] - common) - 1e-9))
        yield from ((nodes[x], nodes[y]) for y in near)
        rest[near] = False
        queue.extend(near.tolist())
        if 2 * (left := rest[owner]).sum() < len(owner) and not queue:
            flat, owner = flat[left], owner[left]
            sizes = np.where(rest, sizes, 0)
            starts = np.cumsum(sizes) - sizes


def _tile_links(similarity: float):
    """Over batches ordered by tile: links within each tile, one row (a, b) each."""

    def linked(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        nodes = np.array([n for n, _ in rows], np.int64)
        got = list(_near(nodes, [s for _, s in rows], similarity)) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []
        for batch in batches:
            grams = batch.column(4)
            offsets, values = grams.offsets.to_numpy(), grams.values.to_numpy()
            for k, (*now, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if now != tile and rows:
                    yield linked(rows)
                    rows = []
                tile = now
                rows.append((node, values[offsets[k] : offsets[k + 1]].copy()))
        if rows:
            yield linked(rows)

    return run


def _paired(rows: DataFrame) -> DataFrame:
    """Rows with a number ``g`` of parts, dealt by a hash of ``node``, once for each pair (i, j) of parts with their own."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    others = F.when(F.col("g") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("g") - 1), F.col("own")))
    return rows.withColumn("other", F.explode(others)).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


def near_links(rows: DataFrame, width: int = 5, similarity: float = 0.8, tile: int = 256) -> DataFrame:
    """Links (a, b) that connect exactly the nodes that chains of near pairs connect, of rows ``(number, node, keys, text)``.

    Nodes that share a block of the fingerprint and differ in few bits are candidates; what chains of them reach is a
    group. A group of over ``tile`` nodes is dealt into parts of about that many and each two parts are compared in a task
    of their own, so no pair of a group goes unchecked; a block's value with over ``_CROWD`` nodes alike.
    """
    spark = rows.sparkSession
    nodes = written(rows.groupBy("node").agg(F.min("number").alias("number"), F.first("keys").alias("keys")), "nodes")
    word = F.col("keys").getItem
    blocks = [F.shiftrightunsigned(word(i // PER_WORD), BITS * (i % PER_WORD)).bitwiseAND(F.lit((1 << BITS) - 1)).bitwiseOR(F.lit(i << BITS)).cast("int") for i in range(BLOCKS)]
    keyed = nodes.filter(F.size("keys") > 0).select("node", *[word(i).alias(f"w{i}") for i in range(CHECKED)], F.explode(F.array(*blocks)).alias("k"))
    # one row for each value of a block: BLOCKS * 2 ** BITS at most
    crowds = keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k", F.ceil(F.col("n") / _CROWD).cast("int").alias("g"))
    dealt = _paired(keyed.join(F.broadcast(crowds), "k")).select("k", "i", "j", "node", *[f"w{i}" for i in range(CHECKED)])
    meets = dealt.repartition(shuffle_width(spark), "k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(_candidates, "a long, b long")
    groups = written(components(meets, at_once=AT_ONCE).withColumnRenamed("root", "group"), "groups")
    sizes = groups.groupBy("group").agg(F.count("*").alias("n")).withColumn("g", F.ceil(F.col("n") / tile).cast("int"))
    members = joined(groups, sizes, ["group"], groups.count()).join(nodes.select("node", "number"), "node")
    texts = rows.select("number", "text").join(members, "number").select("group", "g", "node", _sets(F.col("text"), width).alias("grams"))
    texts = written(texts, "sets")
    dealt = _paired(texts).select("group", "i", "j", "node", "grams").repartition(shuffle_width(spark), "group", "i", "j").sortWithinPartitions("group", "i", "j")
    links = written(dealt.mapInArrow(_tile_links(similarity), "a long, b long"), "near")
    dropped(nodes, groups, texts)
    return links


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of near-duplicates, all its columns: that with the smallest id (null last),
    of rows that share it the first read. Rows are told apart by a number of their own, so repeated rows leave one.

    Texts link where the Jaccard similarity of their sets of ``width``-word shingles is ``similarity`` or
    more. Null, empty and blank texts have the empty set and are near each other alone. An empty table gives no row.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), signatures(F.col(text_col), width).alias("s"))
    rows = rows.select("__row", "id", F.col("s.node").alias("node"), F.col("s.keys").alias("keys"), F.monotonically_increasing_id().alias("number"))
    rows = written(rows, "numbered")
    links = near_links(rows.select("number", "node", "keys", F.col("__row")[text_col].alias("text")), width, similarity)
    roots = written(components(links, at_once=AT_ONCE), "roots")
    copies = rows.groupBy("node").agg(F.count("*").alias("n")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n")
    slim = joined(rows.select("id", "node", "number"), copies, ["node"], rows.count())
    first = slim.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "number")).alias("x"))
    return rows.join(first.select("x.number"), "number", "left_semi").select("__row.*")
