"""Rules that look at the events kept or used before: minimum gap, close-pair merge, greedy matching.

Spark brings the rows of a key together and sorts them (spilling where it must), and a task passes them by in Arrow batches, with the last
kept row (for matching: the detections about the current label) as its only state: linear, for a stream of any length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalwright.operators.machines import Matcher, by_machine


def in_order(df: DataFrame, key: Sequence[str], order: str, ties: Sequence[str]) -> DataFrame:
    first = [*key, order, *ties]
    return df.repartition(*key).sortWithinPartitions(*first, *(c for c in df.columns if c not in first))


def _keys(batch: pa.RecordBatch, key: Sequence[str]) -> Iterator[tuple]:
    return zip(*(batch.column(k).to_pylist() for k in key), strict=True)


def keep_spaced(df: DataFrame, key: Sequence[str], order: str, gap: int, ties: Sequence[str] = ()) -> DataFrame:
    """Events at least `gap` after the last kept one; the first is kept. One without a time stays and counts for no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            kept = []
            for own, t in zip(_keys(batch, key), batch.column(order).to_pylist(), strict=True):
                if own != now:
                    now, last = own, None
                keep = t is None or last is None or t - last >= gap
                if keep and t is not None:
                    last = t
                kept.append(keep)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return in_order(df, key, order, ties).mapInArrow(run, df.schema)


def merge_close(df: DataFrame, key: Sequence[str], order: str, strength: str, within: int, strong: float, ties: Sequence[str] = ()) -> DataFrame:
    """Of two events at most `within` apart, one of them stronger than `strong`, the stronger stays (the earlier if equal); each event
    meets the last one kept. One without a time or a strength is close to none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, held = None, None, None  # held: the row of `last` (time, strength) as a batch, if it came with an earlier batch
        for batch in batches:
            rows, at, done = zip(_keys(batch, key), batch.column(order).to_pylist(), batch.column(strength).to_pylist(), strict=True), None, []
            for i, (own, t, p) in enumerate(rows):
                close = own == now and None not in (t, p, *last) and t - last[0] <= within and max(p, last[1]) > strong
                if close and p <= last[1]:
                    continue
                if not close:  # the last one stays
                    if held is not None:
                        yield held
                    elif at is not None:
                        done.append(at)
                now, last, held, at = own, (t, p), None, i
            yield batch.take(pa.array(done, pa.int32()))
            if at is not None:
                held = batch.take(pa.array([at], pa.int32()))
        if held is not None:
            yield held

    return in_order(df, key, order, ties).mapInArrow(run, df.schema)


def greedy_match(labels: DataFrame, found: DataFrame, key: Sequence[str], order: str, within: int) -> DataFrame:
    """key, label, detection (null: missed): labels in order, each takes the nearest detection that is left, if at most `within` away; of
    two as near, the earlier. A row without a time takes no part. One pass; what is held is the detections about the current label."""
    both = labels.select(*key, order, F.lit(0).cast("long").alias("_kind")).unionByName(found.select(*key, order, F.lit(1).cast("long").alias("_kind")))
    kind = dict(labels.dtypes)[order]
    return by_machine(both, key, [order, "_kind"], lambda: Matcher(within), f"label {kind}, detection {kind}")


def extras(labels: DataFrame, found: DataFrame, key: Sequence[str], order: str, within: int) -> DataFrame:
    """Detections that greedy_match leaves unmatched, each row of them: of equal times, as many as there are more than matches."""
    used = greedy_match(labels, found, key, order, within).where("detection IS NOT NULL").groupBy(*key, F.col("detection").alias(order)).agg(F.count("*").alias("_used"))
    total = found.groupBy(*key, order).agg(F.count("*").alias("_n")).join(used, [*key, order], "left")
    return total.select(*key, order, F.explode(F.sequence(F.lit(0), F.col("_n") - F.coalesce("_used", F.lit(0)))).alias("_k")).where("_k > 0").drop("_k")
