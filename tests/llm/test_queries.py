"""Every column that the queries of the training-data operators promise, against plain Python over the same table."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_dedup_mix_shards import plain_components, plain_fingerprint
from test_quality_and_language import base
from test_search_and_urls import parts_of, rule_of
from test_tokens import plain

from normcast.llm.queries import queries

Q = queries()


@pytest.fixture(scope="module")
def docs(small):
    return {r["doc_id"]: r for r in pq.read_table(f"{small}/documents.parquet").to_pylist()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2(spark, small, docs):
    got = {r["doc_id"]: r for r in Q["op2_token_files"](spark, small).collect()}
    assert set(got) == set(docs)
    start = 0
    for i in sorted(docs):
        ids = plain("word_bpe_49k.json", docs[i]["text"]) + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def test_op3(spark, small):
    urls = {r["page_id"]: r["url"] for r in pq.read_table(f"{small}/pages.parquet", columns=["page_id", "url"]).to_pylist()}
    got = Q["op3_url_filter"](spark, small).collect()
    assert sorted(r["page_id"] for r in got) == sorted(urls)
    for r in got:
        host, path = parts_of(urls[r["page_id"]])
        rule, verdict = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])


def test_op4(spark, small, docs):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in Q["op4_harmonic_packing"](spark, small).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(docs)
    for i, rows in pieces.items():
        ids, at = plain("byte_bpe_50k.json", docs[i]["text"]) + [0], 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    real = padded = 0
    for rows in sequences.values():
        n = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == n
            n += r["length"]
        assert n <= 1024
        real, padded = real + n, padded + (n if n & (n - 1) == 0 else 1024)
    assert real / padded > 0.95


def test_op5(spark, small, docs):
    got = {r["doc_id"]: r for r in Q["op5_quality_rules"](spark, small).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(docs[i]["text"])
        assert not (r["kept"] and r["base_failed"])


def test_op6(spark, small, docs):
    got = Q["op6_prefix_sharding"](spark, small).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    total, slots = defaultdict(int), defaultdict(list)
    for r in got:
        text = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "bytes", None) and 0 <= r["shard"] < 16
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in got)
    assert max(total.values()) - min(total.get(k, 0) for k in range(16)) <= 2 * largest


def test_op7(spark, small, docs):
    got = Q["op7_importance_resampling"](spark, small).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs) and {r["kept"] for r in got} == {True, False}


def test_op8(spark, small, docs):
    got = {r["doc_id"]: r for r in Q["op8_segment_langid"](spark, small).collect()}
    assert set(got) == set(docs)
    learned = {d["lang"] for d in docs.values()} - {None}
    for i, r in got.items():
        text = docs[i]["text"]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (text is None or not any(c.isalpha() for c in text)) and r["lang_pred"] in learned | {"und"}
    held = [r["lang_pred"] == docs[i]["lang"] for i, r in got.items() if r["held_out"] and docs[i]["lang"] and r["lang_pred"] != "und"]
    assert np.mean(held) > 0.98


def test_op10(spark, small, docs):
    got = {r["doc_id"]: r for r in Q["op10_simhash_dedup"](spark, small).collect()}
    prints = {i: plain_fingerprint(d["text"]) for i, d in docs.items()}
    label = plain_components(prints.values())
    least = {}
    for i, f in prints.items():
        least[label[f]] = min(i, least.get(label[f], i))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{f:016x}", least[label[f]]) for i, f in prints.items()}
