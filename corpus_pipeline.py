"""A corpus pipeline of five stages over `documents`: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next stage's docs; all but the
last return the columns of documents, with any others that there are, whatever their names.

Odd rows: a null or letterless text goes with the first stage, and so does an empty one; very long texts are read whole by every stage;
repeated rows, and rows that share a doc_id, are rows of their own for languages, mixing (each is drawn as its doc_id is) and packing, and
one document or one group of copies for the two dedup stages; a null doc_id comes last where places are ordered and can't be the one that
stays of its copies while another has an id; a null source is a source; an empty table gives an empty one at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalwright.llm import langid, linededup, mixing, neardup, packing, simhash
from signalwright.llm._common import cut, documents, stored

#: The least score of a prediction that keeps a document. Those without any letter have score 0; two families of two languages each give 0.25
#: to 1, and texts of a script or language that none of them has lie near the lower end.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    found = langid.identify(docs)
    name = found.columns[-1]
    return found.where(f"{name}.lang_pred != '{langid.UNKNOWN}' AND {name}.score >= {LEAST_SCORE}").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines stay at their first place only."""
    return linededup.dedup_lines(docs).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (word 5-shingles, similarity 0.8 or more) stays. SimHash fingerprints and their components, as
    in op8, give the first candidates; MinHash bands add the pairs that differ in more bits than fingerprints can find. All are verified on
    the whole sets."""
    linked = simhash.near_groups(docs)
    # a component is named by its least doc_id, one of null doc_ids alone by its fingerprints
    named = linked.select("mark", F.xxhash64(F.col("component_id").isNull(), F.coalesce("component_id", "fp")).alias("group"))
    return simhash.one_of_each(docs, cut(neardup.near_groups(docs, also=cut(named))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same weight; documents repeat or go by their draw."""
    return mixing.mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", simhash_dedup), ("mix_sources", mix_sources), ("pack", pack)]
#: SQL can't fit the language machines.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
