"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, exact Hamming checks, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normcast.llm.scratch import dropped, joined, shuffle_width, small_batches, tidied, written

#: Shingles whose bits are counted at once.
_STEP = 1 << 16


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of the ``width``-word shingles, repeats included, of text with A-Z in lower case.

    Words are runs without ASCII white space. Fewer words than ``width`` make one shingle; no word gives 0.
    A bit is set where over half of the shingles' XXH64 values set it.
    """
    words = text.lower().split()  # bytes: ASCII case and white space alone
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    set_in = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _STEP):
        rows = range(at, min(n, at + _STEP))
        hashes = np.fromiter((digest(b" ".join(words[i : i + width]), seed) for i in rows), np.uint64, len(rows))
        set_in += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > n, bitorder="little").tobytes(), "little")


def fingerprints(text: F.Column, width: int = 3, seed: int = 42) -> F.Column:
    """``fingerprint`` of a string column as a signed long; of nulls 0."""

    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in tidied(batches):
            yield pa.array(np.fromiter((fingerprint(t.as_py() or b"", width, seed) for t in texts), np.uint64, len(texts)).view(np.int64))

    return simhash(text.cast("binary"))


def _block_keys(fp: F.Column, differing: int) -> F.Column:
    """One key for each choice of blocks that ``differing`` flipped bits may leave equal.

    ``differing + 2`` blocks: flipped bits touch at most ``differing`` of them, so two equal blocks
    are left, and each pair of blocks is a key of about 128 / (differing + 2) bits.
    """
    n = differing + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    keys = [F.struct(F.lit(t).alias("t"), F.shiftleft(blocks[i], edges[j + 1] - edges[j]).bitwiseOR(blocks[j]).alias("v")) for t, (i, j) in enumerate(combinations(range(n), 2))]
    return F.explode(F.array(*keys))


def _forest(fps: np.ndarray, differing: int) -> Iterator[tuple[int, int]]:
    """Links that join what is linked among ``fps``: at most one for each of them, by breadth-first search."""
    rest, queue = fps, []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        x = queue.pop()
        near = np.bitwise_count(rest ^ x) <= differing
        if near.any():
            found = rest[near]
            yield from ((x, y) for y in found)
            queue.extend(found)
            rest = rest[~near]


def _tile_links(differing: int):
    """Over batches ordered by tile: links within each tile, one row (a, b) each."""

    def linked(tiles: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.flatnonzero((tiles[1:] != tiles[:-1]).any(axis=1)) + 1, [len(fps)]])
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= differing]
        a, b = [fps[two]], [fps[two + 1]]
        for s, n in zip(starts[:-1][sizes > 2], sizes[sizes > 2]):
            if got := list(_forest(fps[s : s + n], differing)):
                x, y = np.array(got, np.uint64).T
                a.append(x)
                b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, fps = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            tiles = np.concatenate([tiles, np.stack([c.to_numpy() for c in batch.columns[:4]], axis=1).astype(np.int64)])
            fps = np.concatenate([fps, batch.column(4).to_numpy().view(np.uint64)])
            if not len(fps):
                continue
            last = len(fps) - int(np.argmin((tiles == tiles[-1]).all(axis=1)[::-1])) if (tiles != tiles[-1]).any() else 0
            if last:
                yield linked(tiles[:last], fps[:last])
                tiles, fps = tiles[last:], fps[last:]
        if len(fps):
            yield linked(tiles, fps)

    return run


def near_links(nodes: DataFrame, differing: int = 3, tile: int = 1024) -> DataFrame:
    """Links (a, b) that connect exactly the rows of distinct ``fp`` that chains of near pairs connect.

    Rows meet where two blocks agree. A key with over ``tile`` rows is dealt into groups of about that
    many, and each pair of groups is a tile of its own, so no task holds a whole large key and no
    pair goes unchecked; a tile gives a spanning forest of its links, never all pairs.
    """
    spark = nodes.sparkSession
    keyed = nodes.select("fp", _block_keys(F.col("fp"), differing).alias("k")).select("fp", "k.t", "k.v")
    n_keys = (differing + 2) * (differing + 1) // 2
    shared = keyed.groupBy("t", "v").agg(F.count("*").alias("n")).filter("n > 1").withColumn("g", F.ceil(F.col("n") / tile).cast("int"))
    rows = joined(keyed, shared, ["t", "v"], n_keys * nodes.count()).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    others = F.when(F.col("g") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("g") - 1), F.col("own")))
    tiles = rows.select("fp", "t", "v", "own", F.explode(others).alias("other")).select("t", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    dealt = tiles.repartition(shuffle_width(spark), "t", "v", "i", "j").sortWithinPartitions("t", "v", "i", "j")
    return dealt.mapInArrow(_tile_links(differing), "a long, b long")


#: Links of which one task finds the components, where a caller lets it: 16 MB.
AT_ONCE = 1 << 20


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each of n nodes the smallest that links (a, b) between them reach."""
    least = np.arange(n)
    while True:
        now, m = least.copy(), np.minimum(least[a], least[b])
        for ends in (a, b, least[a], least[b]):
            np.minimum.at(now, ends, m)
        now = now[now]
        if (now == least).all():
            return least
        least = now


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [np.stack([c.to_numpy() for c in b.columns]) for b in batches]
    nodes, ends = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), return_inverse=True)
    ends = ends.reshape(2, -1)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[least_reached(*ends, len(nodes))])], ["node", "root"])


def components(links: DataFrame, at_once: int = 0) -> DataFrame:
    """``(node, root)`` of every node that has a link; the root is the component's smallest node.

    Up to ``at_once`` links are joined by one task; that spares the driver some hundred plans. More, or by default all, go by
    alternating large and small stars, each round written to the shared folder. The minimum of a
    node's neighbours is combined before it is shuffled; joins move single links, but not those of hubs,
    whose minima are broadcast.
    """

    def directed(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def with_least(e: DataFrame, n: int) -> DataFrame:
        return joined(e, e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), ["u"], n)

    edges = written(directed(links), "links")
    before = state(edges)
    if before[0] <= at_once:
        return edges.coalesce(1).mapInArrow(_rooted, "node long, root long")
    while True:
        both = edges.union(edges.select("v", "u"))
        large = written(with_least(both, 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")), "large")
        small = with_least(large, before[0])
        small = small.select("u", F.col("m").alias("v")).union(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        following = written(small.distinct(), "links")
        dropped(edges, large)
        edges, now = following, state(following)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, differing: int = 3) -> DataFrame:
    """``(id, fp, component_id)`` of every row: the smallest id that chains of fingerprints reach, own id included.

    Fingerprints link at ``differing`` or fewer differing bits. Null, empty and blank texts have
    fingerprint 0 and are linked like any other. Repeated rows each give a row; rows of one id with
    different texts each have their own fingerprint. Null ids take part as links but are never a
    component's smallest, which is null only if all its ids are. An empty table gives no row. Other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = written(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), width, seed).alias("fp")), "fingerprints")
    return joined(rows, classes(rows, differing), ["fp"], rows.count()).select("id", "fp", "component_id")


def classes(rows: DataFrame, differing: int = 3) -> DataFrame:
    """``(fp, component_id, n)`` for each distinct ``fp`` of rows ``(id, fp)``, and its number of rows."""
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "nodes")
    roots = written(components(near_links(nodes, differing)), "roots")
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    linked = written(nodes.drop("n").join(roots, F.col("fp") == F.col("node")).select("fp", "root", "rep"), "linked")
    named = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    members = written(joined(linked.drop("rep"), named.join(sizes, "root"), ["root"], linked.count()).select(F.col("fp").alias("node"), F.lit(True).alias("linked"), "component_id"), "members")
    out = nodes.join(members, F.col("fp") == F.col("node"), "left")
    dropped(roots, linked)
    return out.select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id"), "n")
