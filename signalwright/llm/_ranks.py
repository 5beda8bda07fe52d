"""Global order without one large task: range-partitioned sorts whose partitions' totals are added up."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalwright.llm._common import cut, fresh


@dataclass(frozen=True)
class Ranked:
    df: DataFrame
    key: str
    rank: str
    per_partition: dict[tuple[int, object], int]

    def counts(self) -> dict:
        """Rows of each key."""
        out: dict = {}
        for (_, k), n in self.per_partition.items():
            out[k] = out.get(k, 0) + n
        return out


def rank_within(df: DataFrame, key: str, order: Sequence[str]) -> Ranked:
    """Numbers the rows of each key from 0 by `order`; a key with most of the rows is spread over many partitions.

    df is sorted by (key, order) in range partitions and checkpointed with its place there; a row's rank is its place in its partition
    and key plus the rows of that key in the partitions before. The key must have few values (lengths up to a capacity), so that
    the counts by partition and key stay small: each range holds a run of keys, so there are partitions + keys rows at most.
    """
    place, rank = fresh(df, "_place"), fresh(df, "_rank")
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # without the salt, rows that are alike in all sort columns would be one range
    salt = fresh(df, "_salt")
    placed = cut(
        df.withColumn(salt, F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(n, key, *order, salt)
        .sortWithinPartitions(key, *order, salt)
        .drop(salt)
        .withColumn(place, F.monotonically_increasing_id())
    )
    part = F.shiftright(F.col(place), 33)
    rows = placed.groupBy(part.alias("p"), F.col(key).alias("k")).agg(F.count("*").alias("n"), F.min(place).alias("first")).collect()
    before: dict = {}
    starts = []
    for r in sorted(rows, key=lambda r: (r["p"], r["first"])):
        starts.append((r["p"], r["k"], before.get(r["k"], 0) - r["first"]))
        before[r["k"]] = before.get(r["k"], 0) + r["n"]
    schema = f"_p long, _k {dict(df.dtypes)[key]}, _shift long"
    shift = spark.createDataFrame(starts, schema)
    ranked = placed.join(F.broadcast(shift), (part == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k"))).withColumn(rank, F.col(place) + F.col("_shift")).drop(place, "_p", "_k", "_shift")
    return Ranked(ranked, key, rank, {(r["p"], r["k"]): r["n"] for r in rows})
