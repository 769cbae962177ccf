"""Token ids in Arrow stream files of equal-length sequences with masks.

A dataset is a folder of pairs of Arrow IPC streams, one pair for each range of document ids:

``tokens-NNNNN.arrow``
    Batches of the columns ``input_ids`` (fixed-size list of ``length`` unsigned integers, 16 bits
    where the vocabulary allows) and ``mask`` (fixed-size list of booleans, true at real ids). All
    batches but the last have ``batch`` rows and no nulls, so row i is row ``i % batch`` of batch
    ``i // batch``; a memory-mapped reader slices it without a copy.
``documents-NNNNN.arrow``
    ``doc_id``, ``start`` (ids of the file's earlier documents), ``n_tokens``.

The documents' ids follow each other without gaps; only a file's last sequence is padded, with mask false.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normcast.llm.encoding import in_slices, shared_encoder
from normcast.llm.scratch import shuffle_width, small_batches, tidied

_WRITTEN = "part long, n_docs long, n_tokens long"


def _names(part: int) -> tuple[str, str]:
    return f"tokens-{part:05d}.arrow", f"documents-{part:05d}.arrow"


class TokenWriter:
    """Writes one pair of streams under names of its own; ``close`` gives them their final names."""

    def __init__(self, folder: str, part: int, attempt: int, dtype: np.dtype, id_type: pa.DataType, length: int, batch: int):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.root, recursive=True)
        self.final = [f"{self.root}/{n}" for n in _names(part)]
        self.temporary = [f"{self.root}/_{attempt}-{n}" for n in _names(part)]
        self.sinks = [self.store.open_output_stream(p) for p in self.temporary]
        self.length, self.batch, self.dtype = length, batch, dtype
        ids = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([pa.field("input_ids", pa.list_(pa.field("item", ids, False), length), False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), length), False)])
        self.index_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.streams = [pa.ipc.new_stream(s, x) for s, x in zip(self.sinks, (self.schema, self.index_schema))]
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = 0

    def _rows(self, ids: np.ndarray, n_real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < n_real)
        lists = [pa.FixedSizeListArray.from_arrays(v, type=f.type) for v, f in zip((pa.array(ids), mask), self.schema)]
        self.streams[0].write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.streams[1].write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(sizes)], schema=self.index_schema))
        self.n_tokens += len(ids)
        self.n_docs += len(sizes)
        self.held.append(ids)
        self.n_held += len(ids)
        step = self.length * self.batch
        if self.n_held >= step:
            ids = np.concatenate(self.held)
            whole = len(ids) // step * step
            for at in range(0, whole, step):
                self._rows(ids[at : at + step], step)
            self.held, self.n_held = [ids[whole:].copy()], len(ids) - whole

    def close(self) -> None:
        ids = np.concatenate([np.zeros(0, self.dtype), *self.held])
        if len(ids):
            self._rows(np.concatenate([ids, np.zeros(-len(ids) % self.length, self.dtype)]), len(ids))
        for x in (*self.streams, *self.sinks):
            x.close()
        for a, b in zip(self.temporary, self.final):
            self.store.move(a, b)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, length: int = 1024, batch: int = 512, parts: int | None = None, part_bytes: int = 256 << 20) -> list[tuple[int, int, int]]:
    """Encode every whole text, end each document with ``end_id`` and write all in ascending order of the id.

    ``folder`` is a URI that every machine reaches (``file://`` on shared storage, ``hdfs://``,
    ``s3://``, ...). Returns ``(part, documents, ids)`` of each file in order, one entry for each
    partition of the range exchange. Without ``parts`` there are as many as the session's shuffle partitions,
    and more where these would hold over about ``part_bytes`` bytes of text each.

    Null ids come first; rows of one id are ordered by their text's hash, then text, and repeated rows are all
    written. Null and empty texts hold the end id alone. An empty table gives no files. A task
    writes under a name of its own attempt and renames at its end, so a repeated task replaces its
    file by an equal one.
    """
    small_batches(docs.sparkSession)
    if parts is None:
        n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
        parts = max(shuffle_width(docs.sparkSession), -(-n_bytes // part_bytes))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, part = None, None, TaskContext.get().partitionId()
        for b in tidied(batches):
            if not b.num_rows:
                continue
            if writer is None:
                encoder = shared_encoder(tokenizer)
                writer = TokenWriter(folder, part, TaskContext.get().taskAttemptId(), encoder.dtype, b.column(0).type, length, batch)
            for lo, hi in in_slices(b.column(1)):
                bounds, ids = encoder.encode_batch(b.column(1).slice(lo, hi - lo))
                writer.add(b.column(0).slice(lo, hi - lo), np.diff(bounds) + 1, np.insert(ids, bounds[1:], end_id))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]})

    return sorted(tuple(r) for r in ordered.mapInArrow(run, _WRITTEN).collect())


class TokenFile:
    """Random access to one pair of files; sequences of a local file are views of the mapped memory. A remote
    one is read into memory: to go through it once, use ``read_documents``, which holds a batch at a time."""

    def __init__(self, folder: str, part: int):
        store, root = fs.FileSystem.from_uri(folder)
        tokens, index = (f"{root}/{n}" for n in _names(part))
        local = isinstance(store, fs.LocalFileSystem)
        with store.open_input_stream(index) as s:
            self.index = pa.ipc.open_stream(s).read_all()
        self._source = pa.memory_map(tokens) if local else store.open_input_file(tokens)
        self.batches = pa.ipc.open_stream(self._source).read_all().to_batches()
        self.per_batch = self.batches[0].num_rows if self.batches else 1
        self.length = self.batches[0].schema.field("input_ids").type.list_size if self.batches else 0

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _flat(self, name: str, k: int) -> pa.Array:
        return self.batches[k].column(name).flatten()

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of sequence ``i``."""
        k, row = divmod(i, self.per_batch)
        at = slice(row * self.length, (row + 1) * self.length)
        return self._flat("input_ids", k).to_numpy()[at], self._flat("mask", k)[at].to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the file's id stream; a view unless it spans batches."""
        step, out = self.length * self.per_batch, []
        while n:
            k, at = divmod(start, step)
            out.append(self._flat("input_ids", k).to_numpy()[at : at + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate(out or [np.zeros(0, "<u2")])


class _Ids:
    """The real ids of a token stream in order, one batch in memory at a time."""

    def __init__(self, stream: pa.RecordBatchReader):
        self.stream, self.ids = stream, np.zeros(0, "<u2")

    def next(self, n: int) -> np.ndarray:
        out = []
        while n:
            if not len(self.ids):
                self.ids = self.stream.read_next_batch().column("input_ids").flatten().to_numpy()
            out.append(self.ids[:n])
            n, self.ids = n - len(out[-1]), self.ids[n:]
        return out[0] if len(out) == 1 else np.concatenate(out or [np.zeros(0, "<u2")])


def read_documents(spark: SparkSession, folder: str, parts: list[tuple[int, int, int]], id_type: T.DataType = T.LongType()) -> DataFrame:
    """Documents as the files hold them: ``doc_id``, ``start`` (ids of all documents before it, over all
    files), ``n_tokens`` and ``tokens`` (packed little-endian unsigned 32-bit integers).

    A task reads its pairs of streams once, batch by batch; local ones as views of mapped memory."""
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.BinaryType())])
    before = accumulate((n for _, _, n in parts), initial=0)
    files = spark.createDataFrame([(p, b) for (p, _, _), b in zip(parts, before)], "part long, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        local = isinstance(store, fs.LocalFileSystem)
        for b in batches:
            for part, base in zip(*(c.to_pylist() for c in b.columns)):
                tokens, index = (f"{root}/{n}" for n in _names(part))
                with pa.memory_map(tokens) if local else store.open_input_stream(tokens) as t, store.open_input_stream(index) as s:
                    ids = _Ids(pa.ipc.open_stream(t))
                    for some in pa.ipc.open_stream(s):
                        starts, sizes = some.column(1).to_numpy() + base, some.column(2).to_numpy()
                        held, first, n_held = [], 0, 0
                        for k, n in enumerate(sizes.tolist()):
                            held.append(ids.next(n).astype("<u4").tobytes())
                            n_held += 4 * n
                            if k + 1 == len(sizes) or n_held > 16 << 20:
                                at = slice(first, k + 1)
                                yield pa.RecordBatch.from_arrays([some.column(0)[at], pa.array(starts[at]), pa.array(sizes[at]), pa.array(held, pa.binary())], ["doc_id", "start", "n_tokens", "tokens"])
                                held, first, n_held = [], k + 1, 0

    return files.repartition(max(1, len(parts))).mapInArrow(run, schema)
