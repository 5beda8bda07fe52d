"""The pipeline's stages on odd and on empty tables, and the whole run as registered."""

from __future__ import annotations

import pytest
from test_operators import ODD, SF

import corpus_pipeline
from signalwright.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = SCHEMA + ", _row string, n_removed string, lang_pred string, score string, fp string, component_id string, _copy string, sequence_id_ string"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [*ODD, None, ODD[8], "plain words of a simple kind that stand in a row here", "big " * 20_000]
    rows = [(i, t, None if i % 5 == 0 else ("en", "de")[i % 2], None if i % 4 == 0 else f"s{i % 3}", None, *["x"] * 8) for i, t in enumerate(texts)]
    rows += [rows[8], (None, "no id at all", None, None, None, *[None] * 8), (None,) * 13]
    return spark.createDataFrame(rows, CLASHING).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_and_empty_tables(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    last = name == corpus_pipeline.STAGES[-1][0]
    got = stage(spark, odd, SF)
    rows = got.collect()
    if not last:
        assert got.columns == odd.columns
        assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in odd.collect()}
    else:
        assert len(rows) >= odd.count() and got.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]
    empty = stage(spark, odd.limit(0), SF)
    assert empty.collect() == [] and empty.columns == got.columns


def test_the_registered_pipeline(spark):
    rows = queries.QUERIES["pipeline"](spark, SF).collect()
    assert len(rows) > 50
    total: dict = {}
    for r in rows:
        total[r["sequence_id"]] = total.get(r["sequence_id"], 0) + r["length"]
    assert max(total.values()) <= 2048
