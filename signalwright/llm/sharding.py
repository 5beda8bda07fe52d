"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, and the records are range-partitioned.

The key puts equal texts side by side (the upper bits come from the text, the lower ones from doc_id; a salt tells rows of one key
apart), so a group of copies stays in one shard where the law allows it, and yet a group that holds a third of all rows is cut into
as many ranges as its size needs. Each range's exact total is then counted; one that the sample left overfull (`OVERFULL` times the mean)
is sampled again by itself and subdivided, until none is or its rows can't be told apart. Exact totals of the ranges then move the cuts
between shards from the sampled boundaries to the exact place: at the edge of a group within `tolerance` of a shard's size, else between
two rows. The law is `bytes`: sizes near equal. The salt and the sample decide who works on what, never the result: that depends
on the rows alone, not on how the input is split into files.

Defined results: a null text has size 1 and checksum 0, as an empty one; a very long text is one record of its size; rows that repeat a
doc_id, or each other, are placed each on its own, equal ones side by side in any order; of two places as near to an even cut, the first
is taken; an empty table gives no rows; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalwright.llm._common import cut

LOW = (1 << 24) - 1
#: A range is subdivided beyond so many times the mean.
OVERFULL = 2.0
#: How often ranges are counted and subdivided, at most; a range of very unlike rows may need more than one turn.
TURNS = 8


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the sort key and the salt of every document; the texts stay behind."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).bitwiseAND(F.lit(~LOW)).bitwiseOR(F.xxhash64(F.col("doc_id").cast("long")).bitwiseAND(F.lit(LOW))).alias("key"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )


#: What rows are ordered by; a null doc_id comes first.
ORDER = ["key", "doc_id", "salt"]


def _joint(columns: list[pa.Array]) -> np.ndarray:
    """The columns of ORDER as strings of 24 bytes that order as they do."""
    all_ = np.empty((len(columns[0]), len(ORDER)), dtype=">u8")
    for k, c in enumerate(columns):
        all_[:, k] = c.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return all_.view("S24").ravel()


NONE = np.zeros(0, dtype="S24")


def _quantiles(sample: pa.Table, ranges: int) -> np.ndarray:
    """Boundaries of equal weight of a small sample of (ORDER, weight)."""
    if not len(sample):
        return NONE
    keys = _joint([sample[c].combine_chunks() for c in ORDER])
    order = np.argsort(keys)
    total = sample["weight"].to_numpy()[order].cumsum()
    at = np.searchsorted(total, np.arange(1, ranges) * total[-1] / ranges)
    return np.unique(keys[order][np.minimum(at, len(total) - 1)])


def _drawn(rows: DataFrame, mean: float, step: Column, *also: str) -> pa.Table:
    """A sample of one row for each `step` of weight: a row counts its size and the mean size, so that no range has many more rows,
    or more bytes, than the others. A row whose weight is that of several steps counts for each."""
    chance = (F.col("size") + F.lit(mean)) / step
    draw = F.xxhash64(F.lit("draw"), "key", "salt").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    return rows.where(draw < chance).select(*also, *ORDER, F.greatest(F.lit(1.0), chance).alias("weight")).toArrow()


def splitters(rows: DataFrame, ranges: int, per_range: int = 24) -> np.ndarray:
    """Quantile boundaries of a size-weighted sample of about ranges * per_range keys."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return NONE
    return _quantiles(_drawn(rows, size / n, F.lit(2.0 * size / (ranges * per_range))), ranges)


def _ranged(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """rows plus the number of the range that holds each."""
    spread = rows.sparkSession.sparkContext.broadcast(bounds)
    schema = T.StructType([*rows.schema.fields, T.StructField("range", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _joint([b.column(b.schema.get_field_index(c)) for c in ORDER])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.searchsorted(spread.value, own, side="right").astype(np.int32))], [*b.schema.names, "range"])

    return rows.mapInArrow(run, schema)


def ranges_of(rows: DataFrame, ranges: int, per_range: int = 24, first: np.ndarray | None = None) -> DataFrame:
    """rows with their `range`, none of them overfull. The bounds stay few: `ranges`, and two for each mean range of what was overfull."""
    bounds = splitters(rows, ranges, per_range) if first is None else first
    for _ in range(TURNS):
        found = _ranged(rows, bounds)
        totals = found.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("r")).collect()  # a row for each range
        if not totals:
            return found
        mean = sum(t["b"] for t in totals) / sum(t["r"] for t in totals)
        even = sum(t["b"] + mean * t["r"] for t in totals) / ranges
        heavy = {t["range"]: w for t in totals if (w := t["b"] + mean * t["r"]) > OVERFULL * even and t["r"] > 1}
        parts = {k: math.ceil(w / even) + 1 for k, w in heavy.items()}
        new = bounds
        if heavy:  # one sample of all overfull ranges, each by its own step
            steps = rows.sparkSession.createDataFrame([(k, w / (parts[k] * per_range)) for k, w in heavy.items()], "range int, _step double")
            sample = _drawn(found.join(F.broadcast(steps), "range"), mean, F.col("_step"), "range")
            own = sample["range"].to_numpy()
            new = np.unique(np.concatenate([bounds, *(_quantiles(sample.filter(pa.array(own == k)), n) for k, n in parts.items())]))
        if len(new) == len(bounds):  # nothing overfull, or only rows that outweigh a range by themselves
            return found
        bounds = new
    return _ranged(rows, bounds)


def assign_shards(rows: DataFrame, shards: int = 16, tolerance: float = 0.01) -> DataFrame:
    """rows (key, salt, size and others) plus shard and slot."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inside = Window.partitionBy("range").orderBy(*ORDER)
    run = inside.rowsBetween(Window.unboundedPreceding, -1)
    group = F.shiftright("key", 24)
    ordered = cut(
        ranges_of(rows, 8 * n).select(
            "*",
            F.coalesce(F.sum("size").over(run), F.lit(0)).alias("bytes_before"),
            (F.row_number().over(inside) - 1).cast("long").alias("rows_before"),
            (F.lag(group).over(inside) != group).alias("new_group"),
        )
    )
    totals = ordered.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("r"), F.min(group).alias("lo"), F.max(group).alias("hi")).orderBy("range").collect()  # a row for each range
    base, b, r, last = [], 0, 0, None
    for t in totals:
        base.append((t["range"], b, r, last is not None and t["lo"] != last))
        b, r, last = b + t["b"], r + t["r"], t["hi"]
    bases = F.broadcast(spark.createDataFrame(base, "range int, byte_base long, row_base long, begins boolean"))
    placed = ordered.join(bases, "range").select(
        *ordered.columns, (F.col("byte_base") + F.col("bytes_before")).alias("at"), (F.col("row_base") + F.col("rows_before")).alias("nth"), F.coalesce("new_group", "begins").alias("edge")
    )
    cuts = _cuts(placed, b, shards, tolerance)
    shard = sum((F.when(F.col("at") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    sharded = placed.withColumn("shard", shard.cast("int"))
    firsts = {x["shard"]: x["first"] for x in sharded.groupBy("shard").agg(F.min("nth").alias("first")).collect()}
    first = F.coalesce(*(F.when(F.col("shard") == s, F.lit(f)) for s, f in firsts.items()), F.lit(0)) if firsts else F.lit(0)
    return sharded.select(*rows.columns, "shard", (F.col("nth") - first).cast("long").alias("slot"))


def _cuts(placed: DataFrame, total: int, shards: int, tolerance: float) -> list[int]:
    """Where the second to last shard begin, in bytes: at the group's edge next to the even cut, if within the tolerance, else at the
    row next to it."""
    even = [total * k // shards for k in range(1, shards)]
    near = tolerance * total / shards
    found = placed.agg(
        *(F.min(F.when(F.col("edge") & (F.abs(F.col("at") - c) <= near), F.struct(F.abs(F.col("at") - c).alias("d"), "at"))).alias(f"g{k}") for k, c in enumerate(even)),
        *(F.min(F.struct(F.abs(F.col("at") - c).alias("d"), "at")).alias(f"r{k}") for k, c in enumerate(even)),
    ).first()
    return [(found[f"g{k}"] or found[f"r{k}"] or (0, c))[1] for k, c in enumerate(even)]
