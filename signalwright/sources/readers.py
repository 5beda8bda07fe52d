"""Sources and sinks: tables, event documents, signal files, frames by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts) -> F.Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    day = F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return day * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as streams: k (stream), f (frame), t (microseconds), v (hundredths), e (type)."""
    events = table(spark, sf_dir, "events")
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return events.select(F.col("user_id").alias("k"), frame.cast("long").alias("f"), micros(F.col("ts")).alias("t"), F.round(F.col("value") * 100).cast("long").alias("v"), F.col("event_type").alias("e"))


def event_documents(spark: SparkSession, path: str) -> DataFrame:
    """Result documents (one JSON object a file) as rows of their events, with the file's name."""
    docs = spark.read.option("multiLine", True).json(path)
    return docs.select(F.input_file_name().alias("file"), F.explode("events").alias("event")).select("file", "event.*")


def write_document(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def result_documents(summaries: DataFrame, lists: dict[str, DataFrame], key: str, metadata: Sequence[str], order: str = "frame") -> DataFrame:
    """key, metadata, summary, and an array for each list: one nested document a source, as it stands in a result file.

    summaries: key, the columns of `metadata`, and those of the summary, one row a source. lists: the events of each kind by name, with the
    same key; they are in the order of `order`, and empty where a source has none. A document is one row, so a source's events must fit in it.
    """
    rest = [c for c in summaries.columns if c != key and c not in metadata]
    out = summaries.select(key, F.struct(*metadata).alias("metadata"), F.struct(*rest).alias("summary"))
    for name, rows in lists.items():
        own = [order, *(c for c in rows.columns if c not in (key, order))]
        listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*own))).alias(name))
        out = out.join(listed, key, "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def documents_of(spark: SparkSession, path: str, shape: StructType) -> DataFrame:
    """Result documents written by write_document."""
    return spark.read.schema(shape).json(path)


def segment_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, segment: the folder's files numbered in the order of their names, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("segment", F.row_number().over(Window.orderBy(name)) - 1)


def source_metadata(frames: DataFrame, key: list[str], fps: F.Column) -> DataFrame:
    """Frames, rate (25 where unknown) and duration of each source."""
    rate = F.when(fps > 0, fps).otherwise(25.0)
    return frames.groupBy(*key).agg(F.count("*").alias("frames"), F.max(rate).alias("fps")).withColumn("duration", F.col("frames") / F.col("fps"))


def frames_at(times: DataFrame, frames: DataFrame, key: list[str], seconds: str, fps: float) -> DataFrame:
    """Each time with the frame int(time * fps) of its stream; no frame: nulls."""
    wanted = times.withColumn("f", F.floor(F.col(seconds) * fps).cast("long"))
    return wanted.join(frames, [*key, "f"], "left")


def latest(df: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    """The latest n rows of each stream."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def render(df: DataFrame, template: str, mark: str = "{{DATA}}", most: int = 10_000) -> str:
    """A small report table as compact JSON in a template; an error if it has more than `most` rows."""
    rows = df.limit(most + 1).select(F.to_json(F.struct(*df.columns)).alias("j")).collect()
    if len(rows) > most:
        raise ValueError("aggregate before rendering")
    return template.replace(mark, "[" + ",".join(r["j"] for r in rows) + "]")
