"""The near-dedup stage moves texts only where they may go: its shuffles don't hold the texts, and its rows are the same however few are told apart."""

from __future__ import annotations

import random

import pytest
from test_neardup import SCHEMA, SF, brute, edited

import corpus_pipeline
from signalwright.llm import _common


def shuffled(spark):
    """Bytes that each stage so far wrote into shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return {(s := stages.apply(k)).stageId(): s.shuffleWriteBytes() for k in range(stages.size())}


def test_texts_stay_where_they_are(spark):
    """Beyond the size of a broadcast, too, which these small tables never reach by themselves."""
    rng = random.Random(8)
    own = [(i, " ".join(f"{rng.getrandbits(48):x}" for _ in range(1_500))) for i in range(300)]
    own += [(300, own[7][1]), (301, edited(rng, own[8][1].split(), 3))]
    docs = spark.createDataFrame(own, SCHEMA).repartition(4).localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        kept = _common.stored(corpus_pipeline.simhash_dedup(spark, docs, SF), "test-moves")
        moved = sum(n for stage, n in shuffled(spark).items() if stage not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(300))
    assert 0 < moved < 0.5 * sum(len(t) for _, t in own)


@pytest.mark.parametrize("words", [1, 64, 1 << 19])
def test_same_rows_however_few_are_told_apart(spark, monkeypatch, words):
    monkeypatch.setattr(_common, "SIEVE", words)
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [edited(rng, base, rng.randrange(12)) for _ in range(60)] + [" ".join(f"v{rng.randrange(5000)}" for _ in range(50)) for _ in range(40)]
    own = list(enumerate(texts))
    repeats = [own[0], own[70], own[70], (None, texts[71]), (None, "no id"), (None, "no id"), (None, None), (200, None)]
    docs = spark.createDataFrame(own + repeats, SCHEMA).repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.simhash_dedup(spark, docs, SF).collect()), key=repr)
    stay = set(brute(own).values())
    assert got == sorted([r for r in own if r[0] in stay] + [(None, "no id"), (200, None)], key=repr)


@pytest.mark.parametrize("words", [1, 1 << 19])
def test_no_key_is_missed(spark, monkeypatch, words):
    monkeypatch.setattr(_common, "SIEVE", words)
    rows = spark.range(20_000).selectExpr("nullif(id, 7) AS a", "id * 3 AS b", "'x' AS _word", "'y' AS _bits")
    keys = rows.where("b % 5 = 0 OR a IS NULL").select("a", "b")
    told = _common.sifted(rows, "maybe", keys, "a", "b")
    assert told.columns == [*rows.columns, "maybe"] and told.count() == 20_000
    assert told.where("NOT maybe AND (b % 5 = 0 OR a IS NULL)").count() == 0
    others = told.where("maybe AND b % 5 != 0 AND a IS NOT NULL").count()
    assert others < 100 if words > 1 else others > 0
