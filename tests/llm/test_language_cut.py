"""The pipeline's language stage drops what none of the learned languages fits."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from signalwright.llm._common import crc_mod

SF = "/root/testdata/sf0.01"
UNLEARNED = [
    "Это простой текст на русском языке, который модель никогда не видела.", "日本語のテキストです。今日は天気がいいですね。", "Αυτό είναι ένα απλό κείμενο στα ελληνικά.",
    "Tämä on suomenkielinen teksti, jota malli ei ole koskaan nähnyt.", "To jest zwykły tekst po polsku, którego model nigdy nie widział."]


def test_unlearned_texts_go_and_held_out_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(UNLEARNED)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(more), SF).select("doc_id").collect()}
    held = {r["doc_id"] for r in docs.where(crc_mod(F.col("doc_id"), 4) == 2).collect()}
    assert held <= kept and not {d for d in kept if d < 0}
