"""The registered queries themselves: names and types of their columns, and what their contracts say of every row."""

from __future__ import annotations

import collections
import re
import zlib

import pytest

from signalwright.llm import queries

SF = "/root/testdata/sf0.001"
TYPES = {
    "op1_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op4_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op6_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op8_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
}


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def results(spark):
    kept: dict = {}

    def of(name):
        if name not in kept:
            df = queries.QUERIES[name](spark, SF)
            kept[name] = (dict(df.dtypes), df.collect())
        return kept[name]

    return of


def crc(x):
    return zlib.crc32(str(x).encode())


@pytest.mark.parametrize("name", sorted(TYPES))
def test_columns(results, docs, name):
    types, rows = results(name)
    want = dict(x.split(" ") for x in TYPES[name].split(", "))
    assert {c: types.get(c) for c in want} == want
    assert {r["doc_id"] for r in rows} == set(docs)
    if name != "op1_best_fit_packing":
        assert len(rows) == len(docs)


def test_held_out(results):
    assert all(r["held_out"] == (crc(r["doc_id"]) % 7 == 2) for r in results("op3_lm_scoring")[1])
    assert all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) for r in results("op4_language_id")[1])


def test_languages(results, docs):
    learned = {d["lang"] for d in docs.values() if d["lang"] and crc(d["doc_id"]) % 4 != 2}
    for r in results("op4_language_id")[1]:
        assert r["lang_pred"] in learned | {"und"} and 0 <= r["score"] <= 1


def test_shards(results, docs):
    rows = results("op5_sharding")[1]
    slots = collections.defaultdict(list)
    for r in rows:
        text = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "bytes", None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_token_files(results):
    at = 0
    for r in sorted(results("op6_token_files")[1], key=lambda r: r["doc_id"]):
        assert r["start"] == at and 0 <= r["ids_crc32"] < 1 << 32
        at += r["n_tokens"]


def test_fingerprints(results):
    rows = {r["doc_id"]: r for r in results("op8_simhash")[1]}
    for r in rows.values():
        assert re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) and r["component_id"] <= r["doc_id"] and rows[r["component_id"]]["component_id"] == r["component_id"]


def test_media(results, docs):
    by = collections.defaultdict(set)
    for r in results("op10_media_columns")[1]:
        text = (docs[r["doc_id"]]["text"] or "").encode()
        padded = text + bytes(64 - len(text) % 64 if len(text) % 64 or not text else 0)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(text), len(padded), zlib.crc32(padded[-64:]))
        by[text].add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(x) == 1 for x in by.values())


def test_sequences(results):
    spans = collections.defaultdict(list)
    for r in results("op1_best_fit_packing")[1]:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


