"""Event operators: echoes, close pairs, breaks, intervals, nearest partners, segments of a day."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from signalwright.operators import refractory
from signalwright.operators.machines import Outweighing
from signalwright.operators.signals import ordered


def _sources(df: DataFrame, key: Sequence[str], order: str, strength: str, within: int, ratio: Column, ties: Sequence[str], audit: bool) -> DataFrame:
    """audit: the echoes, with the latest earlier event that outweighs each; else the rows that are none."""
    rate = df.withColumn("_ratio", ratio.cast("double"))
    n, own = len(df.columns), [df.schema[order], df.schema[strength]]
    shape = df.schema
    if audit:
        for name, field in zip(("preceding", "preceding_strength"), own, strict=True):
            shape = StructType([*shape.fields, StructField(name, field.dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine = None, None
        for batch in batches:
            found = []
            names = (*key, order, strength, "_ratio")
            for *at, t, p, r in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if machine is None or at != now:
                    now, machine = at, Outweighing(within, bool(ties))
                found.append(machine.meet(t, p, r))
            if audit:
                kinds = batch.schema.field(order).type, batch.schema.field(strength).type
                sources = [pa.array([f and f[i] for f in found], kind) for i, kind in enumerate(kinds)]
                batch = pa.RecordBatch.from_arrays([*batch.columns[:n], *sources], names=shape.names)
            else:
                batch = batch.select(list(range(n)))
            yield batch.filter(pa.array([(f is not None) == audit for f in found], pa.bool_()))

    return refractory.in_order(rate, key, order, ties).mapInArrow(run, shape)


def drop_echoes(df: DataFrame, key: Sequence[str], order: str, strength: str, within: int, ratio: Column, ties: Sequence[str] = ()) -> DataFrame:
    """Without events weaker than `ratio` of an earlier event at most `within` before; of equal times, the one that `ties` puts first is earlier
    (without ties neither is). An event without a time or a strength stays, and outweighs none. One pass, linear however dense the events."""
    return _sources(df, key, order, strength, within, ratio, ties, False)


def echo_audit(df: DataFrame, key: Sequence[str], order: str, strength: str, within: int, ratio: Column, ties: Sequence[str] = ()) -> DataFrame:
    """The dropped events, each row of them, with the latest one before that outweighs each (of one time, the strongest): `preceding`,
    `preceding_strength`."""
    return _sources(df, key, order, strength, within, ratio, ties, True)


def flag_close(df: DataFrame, key: Sequence[str], order: str, strength: str, within: int, strong: float, out: str) -> DataFrame:
    """Marks both members of neighbouring events at most `within` apart, one of them stronger than `strong`."""
    w = ordered(key, [order])

    def pair(t: Column, p: Column) -> Column:
        return F.coalesce((F.abs(F.col(order) - t) <= within) & (F.greatest(F.col(strength), p) > strong), F.lit(False))

    return df.withColumn(out, pair(F.lag(order).over(w), F.lag(strength).over(w)) | pair(F.lead(order).over(w), F.lead(strength).over(w)))


def pair_breaks(markers: DataFrame, key: Sequence[str], order: str, kind: str) -> DataFrame:
    """key, start, stop: each start with the marker right after it, if that is an end (else null)."""
    w = ordered(key, [order])
    nxt = markers.withColumn("_k", F.lead(kind).over(w)).withColumn("stop", F.when(F.col("_k") == "end", F.lead(order).over(w)))
    return nxt.where(F.col(kind) == "start").select(*key, F.col(order).alias("start"), "stop")


def break_time(breaks: DataFrame, ends: DataFrame, key: Sequence[str], open_end: str) -> DataFrame:
    """key, break_time, active_time. ends: key, duration, last_event. open_end: what closes a break without an end ('duration',
    'last_event' or 'drop')."""
    total = ends.join(breaks, list(key), "left")
    stop = F.col("stop") if open_end == "drop" else F.coalesce("stop", F.col(open_end))
    spent = F.coalesce(F.sum(stop - F.col("start")), F.lit(0)).alias("break_time")
    return total.groupBy(*key, "duration").agg(spent).select(*key, "break_time", (F.col("duration") - F.col("break_time")).alias("active_time"))


def _bounds(left: DataFrame, right: DataFrame, key: Sequence[str], lt: str, rt: str, low: int, high: int) -> DataFrame:
    """left with `_before` and `_after`: the latest right time up to a place in its range, and the earliest one after it.

    Both sides are one stream, sorted to and fro within each key, so there are no pairs and the time is linear: a left row stands at the place
    of its range that is nearest to it. A null key is a key as any other.
    """
    middle = 0 if low <= 0 <= high else low if low > 0 else high
    rest = [c for c in left.columns if c not in key]
    one = left.select(*key, (F.col(lt) + middle).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[rt]).alias("_time"), F.struct(*rest).alias("_row"))
    two = right.select(*key, F.col(rt).alias("_at"), F.lit(0).alias("_side"), F.col(rt).alias("_time"), F.lit(None).cast(one.schema["_row"].dataType).alias("_row")).where("_time IS NOT NULL")
    # right rows come before left ones of the same place; the second window is the first one turned round, as a running frame looks back only
    here, back = ([F.asc("_at"), F.asc("_side")], [F.desc("_at"), F.desc("_side")])
    last = lambda order: F.last("_time", ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = one.unionByName(two).withColumn("_before", last(here)).withColumn("_after", last(back))
    return both.where("_side = 1").select(*key, "_row.*", "_before", "_after")


def _partner(left: DataFrame, right: DataFrame, key: Sequence[str], lt: str, rt: str, low: int, high: int) -> DataFrame:
    """left with `_near`: the nearest right time of low <= right - left <= high (the earlier of two as near), or null."""
    found = _bounds(left, right, key, lt, rt, low, high)
    ok = lambda t: F.when((F.col(t) - F.col(lt)).between(low, high), F.struct(F.abs(F.col(t) - F.col(lt)).alias("far"), F.col(t).alias("at")))
    return found.withColumn("_near", F.least(ok("_before"), ok("_after"))["at"]).drop("_before", "_after")


def without_partner(left: DataFrame, right: DataFrame, key: Sequence[str], lt: str, rt: str, low: int, high: int) -> DataFrame:
    """Left rows with no right row of low <= right - left <= high."""
    return _partner(left, right, key, lt, rt, low, high).where(F.col("_near").isNull()).select(*left.columns)


def with_partner(left: DataFrame, right: DataFrame, key: Sequence[str], lt: str, rt: str, low: int, high: int) -> DataFrame:
    return _partner(left, right, key, lt, rt, low, high).where(F.col("_near").isNotNull()).select(*left.columns)


def nearest(left: DataFrame, right: DataFrame, key: Sequence[str], lt: str, rt: str, low: int, high: int, extra: Sequence[str] = ()) -> DataFrame:
    """Every left row with the nearest right row of low <= right - left <= high (the earlier of two as near; of those of one time, the one
    with the least `extra`), or nulls. Rows that repeat, and nulls in any column, stay as they are."""
    found = _partner(left, right, key, lt, rt, low, high)
    if not extra:
        return found.select(*left.columns, F.col("_near").alias(rt))
    one = right.groupBy(*key, rt).agg(F.min(F.struct(*extra)).alias("_extra")).select(*[F.col(k).alias(f"_r_{k}") for k in key], F.col(rt).alias("_rt"), "_extra")
    joined = found.join(one, [F.col(k) == F.col(f"_r_{k}") for k in key] + [F.col("_near") == F.col("_rt")], "left")
    return joined.select(*left.columns, F.col("_near").alias(rt), *[F.col(f"_extra.{c}").alias(c) for c in extra])


def stitch(segments: DataFrame, events: DataFrame, day: Sequence[str], segment: str, duration: str, at: str) -> DataFrame:
    """Events with `day_at`: their time plus the durations of the segments before theirs."""
    before = ordered(day, [segment]).rowsBetween(Window.unboundedPreceding, -1)
    offset = segments.select(*day, segment, F.coalesce(F.sum(duration).over(before), F.lit(0)).alias("offset"))
    return events.join(offset, [*day, segment]).withColumn("day_at", F.col(at) + F.col("offset"))


def edge_with_cooldown(df: DataFrame, key: Sequence[str], order: str, value: str, threshold: float, cooldown: int) -> DataFrame:
    """Rows that cross the threshold upwards (the row before was below it), at least `cooldown` after the last that counted."""
    before = F.lag(value).over(ordered(key, [order]))
    return refractory.keep_spaced(df.withColumn("_before", before).where((F.col(value) > threshold) & (F.coalesce("_before", F.lit(0)) < threshold)).drop("_before"), key, order, cooldown)
