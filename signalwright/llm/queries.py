"""The operators' queries on the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalwright.llm import anntree, convrepair, convtrie, langid, linededup, media, mixing, packing, quality, scoring, sharding, simhash, tokenfiles
from signalwright.llm._common import crc_mod, cut, documents


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(documents(spark, sf_dir))
    held = crc_mod(F.col("doc_id"), 4) == 2
    return found.select("doc_id", held.alias("held_out"), f"{found.columns[-1]}.lang_pred", f"{found.columns[-1]}.score")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign_shards(cut(sharding.sized(documents(spark, sf_dir))))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(*quality.CONTRACT)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(documents(spark, sf_dir))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.trie(convtrie.sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convrepair.repair(convrepair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anntree.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_source_mixing, op3_lm_scoring, op4_language_id, op5_sharding, op6_token_files, op7_line_dedup, op8_simhash, op9_quality_rules, op10_media_columns, op11_conversation_trie, op12_structure_repair, op13_nearest_neighbours, pipeline)}
ORACLE_SQL = {"op2_source_mixing": mixing.SQL, "op7_line_dedup": linededup.SQL, "op9_quality_rules": quality.SQL, "op11_conversation_trie": convtrie.SQL, "op12_structure_repair": convrepair.SQL}
