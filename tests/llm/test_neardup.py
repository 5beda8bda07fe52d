"""Near copies by word 5-shingles: against brute-force Jaccard similarity."""

from __future__ import annotations

import itertools
import random

import pytest

import corpus_pipeline
from signalwright.llm import neardup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def grams(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(own):
    """The least doc_id of each row's group."""
    sets, root = [grams(t) for _, t in own], list(range(len(own)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(own)), 2):
        if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(own):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(own)}


def edited(rng, words, times):
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def own():
    """Texts with zero to nine edited words out of 200 (similarity 1 to 0.63), short ones, empty ones."""
    rng = random.Random(5)
    texts = ["", " ", None, "one", "One", "two words", "a b c d e", "a b c d e f"]
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [edited(rng, words, k) for k in (0, 0, rng.randrange(10), rng.randrange(10))]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_groups_are_those_of_all_pairs(spark, own):
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_groups(spark.createDataFrame(own, SCHEMA).repartition(3)).collect()}
    assert got == brute(own)


def test_stage_drops_near_copies(spark, own):
    """The rule of two bits keeps nearly all of them."""
    kept = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(own, SCHEMA), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute(own).values()))


def test_large_group_goes_through_windows(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    own = [(i, edited(rng, words, 2)) for i in range(300)]
    groups = neardup.near_groups(spark.createDataFrame(own, SCHEMA).repartition(3), hot=8).collect()
    assert {r["component_id"] for r in groups} == {0} == set(brute(own).values())


@pytest.mark.parametrize("queries,chunk", [(256, 4096), (5, 7)])
def test_large_loose_group_is_compared_whole(spark, monkeypatch, queries, chunk):
    """Copies with many edits, most of them close to a few others only: what turns of neighbours miss, tiles find."""
    monkeypatch.setattr(neardup, "QUERIES", queries)
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rng = random.Random(7)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    own = [(i, edited(rng, words, rng.choice([1, 2, 3, 4, 5, 6, 8, 12]))) for i in range(200)]
    want = brute(own)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_groups(spark.createDataFrame(own, SCHEMA).repartition(3), hot=4).collect()}
    assert got == want and len(set(want.values())) > 20


def test_odd_and_empty_tables(spark):
    shape = "doc_id long, text string, mark string, root string, sig string, fp string"
    own = [(None, None), (None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (5, ""), (6, "w " * 50_000), (7, "w " * 50_001)]
    rows = spark.createDataFrame([(*r, "x", "x", "x", None) for r in own], shape)
    got = sorted(((r["doc_id"], r["component_id"]) for r in neardup.near_groups(rows).collect()), key=repr)
    assert got == sorted([(None, 5), (None, 4), (4, 4), (4, 4), (5, 5), (6, 6), (7, 6)], key=repr)
    assert neardup.near_groups(spark.createDataFrame([], shape)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_groups(docs).collect()} == want


def test_candidates_of_another_method(spark, monkeypatch):
    """Candidates that no band gives are verified as those of bands are: texts of one group that are near are linked, others aren't."""

    def alone(words):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[m] for m in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["doc_id", "mark", "sigs"])

        return run

    monkeypatch.setattr(neardup, "_sketches", alone)
    same = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, same + " tail"), (2, same + " other"), (3, "something else that is not near to any of them"), (4, same + " more")], SCHEMA)
    found = lambda also: {r["doc_id"]: r["component_id"] for r in neardup.near_groups(docs, also=also).collect()}
    assert found(None) == {1: 1, 2: 2, 3: 3, 4: 4}
    marks = docs.selectExpr("xxhash64(text) AS mark", "CASE WHEN doc_id < 4 THEN 7 ELSE 8 END AS group")
    assert found(marks) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_the_stage_takes_simhash_components(spark, monkeypatch):
    called = []
    monkeypatch.setattr(corpus_pipeline.simhash, "near_groups", lambda docs, own=corpus_pipeline.simhash.near_groups, **o: called.append(1) or own(docs, **o))
    docs = spark.createDataFrame([(1, "one text of a few words here"), (2, "one text of a few words here"), (3, "quite another one with words of its own")], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, SF).collect()) == [1, 3]
    assert called == [1]
