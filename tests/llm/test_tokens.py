import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from edges import edge_frame, edge_rows, empty_frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from normcast.llm.encoding import Encoder, in_slices
from normcast.llm.harmonic_packing import Bins, cut, pack
from normcast.llm.scratch import new_path
from normcast.llm.token_files import TokenFile, read_documents, write_token_files

#: Strings of special tokens, parts of them and what may stand beside them.
SPECIAL = ("<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", " ", "\n", "a", " word", "\t")
FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ENCODERS = {f: Encoder(public_tokenizers.path(f), keep=50) for f in FILES}
LIBRARY = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}


def plain(f, text):
    """The library alone, with objects of its own."""
    return LIBRARY[f].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("f", FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="ab '.\n\t é1sStT\x00\u3000́", max_size=60), st.lists(st.sampled_from(SPECIAL), max_size=8).map("".join)), max_size=6))
def test_ids_equal_the_library(f, texts):
    bounds, ids = ENCODERS[f].encode_batch(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain(f, t) for t in texts]


@pytest.mark.parametrize("f", FILES)
def test_special_strings_as_text(f):
    want = Tokenizer.from_file(public_tokenizers.path(f))
    want.encode_special_tokens = True
    text = "a <|endoftext|> b<|startoftext|>"
    got = Encoder(public_tokenizers.path(f), special_as_text=True)
    assert got.encode(text).tolist() == want.encode(text, add_special_tokens=False).ids != plain(f, text)


@pytest.mark.parametrize("f", FILES)
def test_long_chunks_are_not_kept(f):
    encoder = Encoder(public_tokenizers.path(f))
    texts = ["y" * 100_000, "x" * 65 + " of " + "z" * 3_000, "one two", None, ""]
    bounds, ids = encoder.encode_batch(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain(f, t) for t in texts]
    assert max(map(len, encoder._known.to_pylist())) <= 64


@pytest.mark.parametrize("f", FILES)
def test_ids_in_slices(f):
    texts = pa.array([r[1] for r in edge_rows()], pa.string())
    for a, b in in_slices(texts, 5_000):
        bounds, ids = ENCODERS[f].encode_batch(texts.slice(a, b - a))
        for k in range(b - a):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == plain(f, texts[a + k].as_py())


def test_files_round_trip(spark):
    folder = new_path(spark, "t")
    parts = write_token_files(edge_frame(spark), folder, public_tokenizers.path(FILES[0]), length=64, batch=4, parts=3)
    rows = sorted(read_documents(spark, folder, parts).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:]) and len(ids) == len(edge_rows())
    texts = defaultdict(list)
    for i, t, *_ in edge_rows():
        texts[i].append(plain(FILES[0], t) + [2])
    at = 0
    for r in rows:
        got = np.frombuffer(r["tokens"], "<u4").tolist()
        assert r["start"] == at and len(got) == r["n_tokens"]
        texts[r["doc_id"]].remove(got)
        at += r["n_tokens"]
    assert not any(texts.values())
    stream = np.concatenate([np.frombuffer(r["tokens"], "<u4") for r in rows])
    base = 0
    for part, _, n in parts:
        file = TokenFile(folder, part)
        assert len(file) == -(-n // 64)
        for i in range(len(file)):
            seq, mask = file.sequence(i)
            want = stream[base + 64 * i : base + min(n, 64 * (i + 1))]
            assert len(seq) == 64 and mask.sum() == len(want) and mask[: len(want)].all() and (seq[: len(want)] == want).all()
        first, _ = file.sequence(0)
        assert not first.flags.owndata
        base += n


def test_empty_table_has_no_files(spark):
    folder = new_path(spark, "t")
    parts = write_token_files(empty_frame(spark), folder, public_tokenizers.path(FILES[0]), parts=2)
    assert parts == [] and read_documents(spark, folder, parts).count() == 0
    assert pack(empty_frame(spark), public_tokenizers.path(FILES[1])).count() == 0


@given(st.integers(0, 5000))
def test_cuts_add_up(n):
    pieces = cut(n, 1024, 64)
    assert sum(pieces) == n and all(0 < p <= 1024 for p in pieces)


@settings(deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=80))
def test_bins_hold_every_piece(sizes):
    bins, rows = Bins(1024, 7), []
    for d, n in enumerate(sizes):
        at = 0
        for p in cut(n, 1024, 64):
            rows += bins.add((d, at, p, b"", n))
            at += p
    rows += bins.finish()
    fill = defaultdict(int)
    for r in rows:
        assert r[-1] == fill[r[-2]]
        fill[r[-2]] += r[2]
    assert sum(fill.values()) == sum(sizes) and max(fill.values(), default=0) <= 1024


def test_pieces_are_whole(spark):
    got = pack(edge_frame(spark).repartition(2), public_tokenizers.path(FILES[1])).collect()
    want = defaultdict(int)
    for i, t, *_ in edge_rows():
        ids = plain(FILES[1], t) + [0]
        want[i, len(ids)] += len(ids)
        if i is not None and i != 1010:
            own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
            assert zlib.crc32(b"".join(r["tokens"] for r in own)) == zlib.crc32(np.array(ids, "<u4").tobytes())
    have = defaultdict(int)
    for r in got:
        assert len(r["tokens"]) == 4 * r["length"]
        have[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert have == want
    real = sum(r["length"] for r in got)
    n = {}
    for r in got:
        n[r["sequence_id"]] = n.get(r["sequence_id"], 0) + r["length"]
    padded = sum(x if x & (x - 1) == 0 else 1024 for x in n.values())
    assert real / padded > 0.9
