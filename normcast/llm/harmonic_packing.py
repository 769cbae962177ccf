"""Packing of token sequences into fixed capacity by reciprocal length classes (harmonic packing)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from normcast.llm.encoding import in_slices, shared_encoder
from normcast.llm.scratch import small_batches, tidied

_PIECES = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("tokens", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Bins:
    """One worker's open bins.

    Class j holds pieces longer than capacity/(j+1) and not longer than capacity/j; a bin of class j
    takes exactly j of them. Full bins leave at once, so what is held is less than one bin of each
    class. ``finish`` puts the pieces of the bins still open together, longest first, each into the
    emptiest bin that has room.
    """

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id, self.open = capacity, first_id, {}

    def _closed(self, pieces: list) -> list:
        rows, at = [], 0
        for piece in pieces:
            rows.append((*piece, self.next_id, at))
            at += piece[2]
        self.next_id += 1
        return rows

    def add(self, piece: tuple) -> list:
        """piece: (document, start, length, tokens, document's tokens). Returns the rows of a bin that it fills."""
        j = self.capacity // piece[2]
        if j == 1:
            return self._closed([piece])
        held = self.open.setdefault(j, [])
        held.append(piece)
        return self._closed(self.open.pop(j)) if len(held) == j else []

    def finish(self) -> list:
        rest = sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2])
        self.open, bins, fill = {}, [], []
        for piece in rest:
            if fill and fill[0][0] + piece[2] <= self.capacity:
                used, k = heapq.heappop(fill)
            else:
                used, k = 0, len(bins)
                bins.append([])
            bins[k].append(piece)
            heapq.heappush(fill, (used + piece[2], k))
        return [row for pieces in bins for row in self._closed(pieces)]


def cut(n: int, capacity: int, least_cut: int) -> list[int]:
    """Lengths of a document's pieces: whole bins, then the exact halves, quarters, ... of the capacity
    that its rest holds, down to ``least_cut``, then what remains. Exact reciprocals fill bins without padding."""
    pieces, size = [capacity] * (n // capacity), capacity
    n %= capacity
    while size % 2 == 0 and size // 2 >= least_cut:
        size //= 2
        if n >= size:
            pieces.append(size)
            n -= size
    return pieces + [n] * (n > 0)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = 1024, least_cut: int = 64) -> DataFrame:
    """Encode every whole text, end it with ``end_id`` and pack all ids into sequences of ``capacity``.

    One row for each piece: the id column, ``start`` (ids of its document before it), ``length``,
    ``tokens`` (its ids as packed little-endian unsigned 32-bit integers), ``doc_tokens``,
    ``sequence_id`` and ``offset`` (its place there; places are gapless from 0).

    Workers pack on their own: there is no shuffle, a sequence's pieces come from one input
    partition, and a worker leaves at most a few bins unfilled. Sequence ids are unique, with the
    partition in the high bits. Null and empty texts give the end id alone. Rows are packed as they
    come: repeated ids and repeated rows are packed as often as they occur, null ids are kept.
    An empty table gives no row. Other columns of ``docs`` are ignored.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(n, T.BinaryType() if n == "tokens" else T.LongType()) for n in _PIECES.names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_arrow), *(pa.array(c, f.type) for c, f in zip(cols[1:], _PIECES))], [id_col, *_PIECES.names])

        id_arrow = pa.int64()
        for b in tidied(batches):
            ids, id_arrow = b.column(0).to_pylist(), b.column(0).type
            for lo, hi in in_slices(b.column(1)):
                bounds, tokens = encoder.encode_batch(b.column(1).slice(lo, hi - lo))
                for k in range(hi - lo):
                    raw = tokens[bounds[k] : bounds[k + 1]].astype("<u4").tobytes() + end
                    at, n = 0, len(raw) // 4
                    for size in cut(n, capacity, least_cut):
                        rows += bins.add((ids[lo + k], at, size, raw[4 * at : 4 * (at + size)], n))
                        at += size
                if rows:
                    yield batch()
        rows += bins.finish()
        if rows:
            yield batch()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
