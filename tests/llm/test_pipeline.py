"""The pipeline, stage by stage, each against a brute-force version on its own input."""

from __future__ import annotations

import collections
import hashlib
import math

import pytest
from test_neardup import brute
from test_operators import SF, brute_lines, check_packing, texts_of

import corpus_pipeline
from signalwright.llm import langid
from signalwright.llm._common import crc_mod, stored
from pyspark.sql import functions as F


def draws(doc_id, mean, seed=7):
    """Poisson counts by inversion of md5 numbers, in parts of a mean of 4 at most."""
    parts, n = max(1, math.ceil(mean / 4)), 0
    for j in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{doc_id}:{j}".encode()).hexdigest()[:13], 16) / 2**52
        p = total = math.exp(-mean / parts)
        k = 0
        while u >= total and k < 60:
            k += 1
            p *= mean / parts / k
            total += p
        n += k
    return n


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_stages_return_the_columns_of_documents(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_language_stage(stages):
    model = langid.fit(stages[0], crc_mod(F.col("doc_id"), 4) == 2)
    kept = {r["doc_id"] for r in stages[1].collect()}
    for doc, text in texts_of(stages[0]):
        lang, score = model.predict(text)
        assert (doc in kept) == (lang != "und" and score >= corpus_pipeline.LEAST_SCORE)
    assert len(kept) >= 0.95 * stages[0].count()


def test_line_stage(stages):
    left = brute_lines(texts_of(stages[1]))
    assert sorted(texts_of(stages[2])) == sorted((d, left[(d, t)]) for d, t in texts_of(stages[1]) if left[(d, t)] is not None)


def test_near_dedup_stage(stages):
    """The stage's rule is a similarity of 0.8 of word 5-shingles; the two bits of op8's contract bind its query only."""
    assert sorted(d for d, _ in texts_of(stages[3])) == sorted(set(brute(texts_of(stages[2])).values()))


def test_mixing_stage(stages):
    own = stages[3].collect()
    n = collections.Counter(r["source"] for r in own)
    want = {r["doc_id"]: draws(r["doc_id"], len(own) / len(n) / n[r["source"]]) for r in own}
    assert collections.Counter(d for d, _ in texts_of(stages[4])) == {d: k for d, k in want.items() if k}


def test_packing_stage(stages):
    used, tokens = check_packing(stages[4])
    assert used <= math.ceil(tokens / 2048 * 1.01) and used == stages[5].select("sequence_id").distinct().count()
