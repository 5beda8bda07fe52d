"""What tells accepted events from rejected ones: profiles about each event, many features at once, their separation and cut-offs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from signalwright.operators import arrays, report


def _gridded(at: str, fps: float, offsets: np.ndarray):
    """Over events with `_all` (frame, texture, scale_diff of the frames in reach): their columns, and the entries on the grid as `profile`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, n = b.column("_all"), len(b)
            frames, *values = near.flatten().flatten()
            frames = frames.to_numpy(zero_copy_only=False).astype(np.int64)
            whose = np.repeat(np.arange(n), near.value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((frames, whose))
            low, high = (frames.min(), frames.max()) if len(frames) else (0, 0)
            span = int(high - low) + 1
            places = whose[order] * span + (frames[order] - low)
            want = np.floor((b.column(at).fill_null(0).to_numpy(zero_copy_only=False)[:, None] + offsets[None, :]) * (fps / 10)).astype(np.int64)
            asked = (np.arange(n)[:, None] * span + (want - low)).ravel()
            lo = np.searchsorted(places, asked, "left")
            times = np.where(((want >= low) & (want <= high)).ravel(), np.searchsorted(places, asked, "right") - lo, 0)
            found = pa.array(order[np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())])
            entries = [pa.array(np.repeat(np.tile(offsets, n), times), pa.int32()), *(v.take(found) for v in values)]
            ends = np.concatenate([[0], np.cumsum(times.reshape(n, len(offsets)).sum(axis=1))]).astype(np.int32)
            profile = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(entries, names=["offset", "texture", "scale_diff"]))
            names = [c for c in b.schema.names if c != "_all"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), profile], names=[*names, "profile"])

    return run


def profiles(events: DataFrame, frames: DataFrame, key: Sequence[str], at: str, fps: float, start: int = -60, stop: int = 30, step: int = 2, back: int = 100) -> DataFrame:
    """events with `profile`, an array of (offset, texture, scale_diff): the frames on a grid of offsets about each event, and the scale's
    difference to a reference frame.

    events: key, at (tenths of a second; whole numbers, so that no step drifts); frames: key, frame, texture, patch. Offsets, and `back`, the
    way from the event to its reference (but not before 0), are tenths too. Offsets without a frame are left out; without a reference
    the difference is 0.

    Events and frames are one stream that is brought together by its key once: one window gives each event its reference, a second one the
    frames within its reach, and no point of the grid is ever a row that travels. A row holds the frames of one reach.
    """
    frame = lambda tenths: F.floor(tenths * F.lit(fps / 10)).cast("long")
    seen = F.struct(F.col("frame").cast("long").alias("frame"), F.col("texture").cast("double").alias("texture"), F.col("patch").alias("patch"))
    two = frames.dropna(subset=[*key, "frame"]).select(*key, F.col("frame").cast("long").alias("_ref"), F.col("frame").cast("long").alias("_at"), seen.alias("_seen"))
    row = F.struct(*(c for c in events.columns if c not in key)).alias("_row")
    one = events.select(*key, frame(F.greatest(F.col(at) - back, F.lit(0))).alias("_ref"), frame(F.col(at)).alias("_at"), row)
    both = one.unionByName(two, allowMissingColumns=True).repartition(*key)
    event = F.col("_row").isNotNull()
    reach = Window.partitionBy(*key).orderBy("_at").rangeBetween(math.floor(start * fps / 10) - 1, math.floor(stop * fps / 10) + 1)
    # a frame number that repeats gives as many references, and as many entries
    met = both.withColumn("_empty", F.when(event, F.collect_list("_seen.patch").over(Window.partitionBy(*key, "_ref"))))
    near = met.withColumn("_near", F.when(event, F.collect_list("_seen").over(reach))).where(event)
    refs = F.when(F.size("_empty") > 0, F.col("_empty")).otherwise(F.array(F.lit(None).cast(frames.schema["patch"].dataType)))
    diff = lambda s, e: F.coalesce(arrays.mean_difference(s["patch"], e), F.lit(0.0))
    judged = F.flatten(F.transform(refs, lambda e: F.transform("_near", lambda s: F.struct(s["frame"].alias("frame"), s["texture"].alias("texture"), diff(s, e).alias("scale_diff")))))
    own = near.select(*(c if c in key else F.col("_row")[c].alias(c) for c in events.columns), judged.alias("_all"))
    entry = StructType.fromDDL("profile array<struct<offset: int, texture: double, scale_diff: double>>")
    return own.mapInArrow(_gridded(at, fps, np.arange(start, stop + 1, step)), StructType([*events.schema.fields, *entry.fields]))


def profile(events: DataFrame, frames: DataFrame, key: Sequence[str], at: str, fps: float, start: int = -60, stop: int = 30, step: int = 2, back: int = 100) -> DataFrame:
    """The columns of events, offset, texture, scale_diff: a row for each entry of `profiles`."""
    return profiles(events, frames, key, at, fps, start, stop, step, back).select(*events.columns, F.inline("profile"))


def _featured(kept: Sequence[str], level: float, scale_level: float, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.greater(pc.list_value_length(b.column("profile")), 0))
            n = len(b)
            if not n:
                continue
            size = b.column("profile").value_lengths().to_numpy(zero_copy_only=False)
            offset, texture, diff = (x.to_numpy(zero_copy_only=False) for x in b.column("profile").flatten().flatten())  # null as NaN
            texture, diff = texture.astype(float), diff.astype(float)
            whose, start = np.repeat(np.arange(n), size), np.cumsum(size) - size
            over = texture > level
            before = np.concatenate([[False], over[:-1]])
            before[start] = False
            most = lambda x: np.fmax(np.fmax.reduceat(x, start), 0.0)
            count = lambda x: np.bincount(whose[x], minlength=n).astype(np.int64)

            def seen(when: int) -> np.ndarray:
                out, there = np.full(n, np.nan), offset == when
                np.fmax.at(out, whose[there], texture[there])
                return np.nan_to_num(out)

            final, past = seen(0), seen(-20)
            own = {"above": count(over) * step, "peak": most(texture), "final": final, "segments": count(over & ~before), "peak_scale": most(diff), "scale_above": count(diff > scale_level) * step}
            own["slope"] = np.where(past > 0, final - past, 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *map(pa.array, own.values())], names=[*kept, *own])

    return run


def features_of(profiled: DataFrame, kept: Sequence[str], level: float = 75.0, scale_level: float = 25.0, step: int = 2) -> DataFrame:
    """kept, and the features of each row whose `profile` (see `profiles`; in the order of its offsets) isn't empty: above (tenths over the
    level), peak, final (at the event), segments (stretches over the level), peak_scale, scale_above (tenths), slope (final less the texture
    two seconds before, where that is over 0)."""
    found = StructType.fromDDL("above long, peak double, final double, segments long, peak_scale double, scale_above long, slope double")
    shape = StructType([*profiled.select(*kept).schema.fields, *found.fields])
    return profiled.select(*kept, "profile").mapInArrow(_featured(kept, level, scale_level, step), shape)


def features(profiles: DataFrame, key: Sequence[str], level: float = 75.0, scale_level: float = 25.0, step: int = 2) -> DataFrame:
    """One row an event (key) of the rows of `profile`: see `features_of`."""
    entry = F.struct("offset", F.col("texture").cast("double").alias("texture"), F.col("scale_diff").cast("double").alias("scale_diff"))
    return features_of(profiles.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("profile")), key, level, scale_level, step)


def as_rows(df: DataFrame, names: Sequence[str], *kept: str) -> DataFrame:
    """kept, feature, value: a row for each of the named columns."""
    return df.select(*kept, F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names))))


def statistics(rows: DataFrame, label: str) -> DataFrame:
    """feature, label, n, mean, median, deviation, least, most of `value`. Deviations come from sums, in one pass with the rest."""
    v = F.col("value")
    n = F.count(v)
    spread = F.sqrt(F.greatest(n * F.sum(v * v) - F.sum(v) * F.sum(v), F.lit(0.0))) / n
    return rows.groupBy("feature", label).agg(n.alias("n"), (F.sum(v) / n).alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), spread.alias("deviation"), F.min(v).alias("least"), F.max(v).alias("most"))


def separations(stats: DataFrame, label: str, one: str, two: str) -> DataFrame:
    """feature, separation of two labels; no row where one of them has no values. stats: statistics()."""
    own = lambda value, x: F.max(F.when(F.col(label) == x, F.col(value)))
    both = stats.where(F.col(label).isin(one, two)).groupBy("feature").agg(own("mean", one).alias("m1"), own("deviation", one).alias("d1"), own("mean", two).alias("m2"), own("deviation", two).alias("d2"))
    return both.where("m1 IS NOT NULL AND m2 IS NOT NULL").select("feature", report.separation((F.col("m1"), F.col("d1")), (F.col("m2"), F.col("d2"))).alias("separation"))


def with_separation(stats: DataFrame, label: str, one: str, two: str) -> DataFrame:
    """stats: statistics(), with the separation of two labels by each feature; without the features that one of them has no values of. A window
    over the few rows, so that what they come from runs once."""
    own = lambda value, x: F.max(F.when(F.col(label) == x, F.col(value))).over(Window.partitionBy("feature"))
    both = stats.select("*", own("mean", one).alias("_m1"), own("deviation", one).alias("_d1"), own("mean", two).alias("_m2"), own("deviation", two).alias("_d2"))
    apart = report.separation((F.col("_m1"), F.col("_d1")), (F.col("_m2"), F.col("_d2")))
    return both.where("_m1 IS NOT NULL AND _m2 IS NOT NULL").select(*stats.columns, apart.alias("separation"))


def sweeps(rows: DataFrame, cuts: dict[str, Sequence[float]], positive: Column, negative: Column) -> DataFrame:
    """feature, cut, hits (positives at or above it), rejections (negatives below it), positives, negatives, for the cut-offs of each feature.

    A row counts once, in the step between two cut-offs that holds its value; what is above and below a cut-off are running sums over the
    steps, of which there are few.
    """
    spark = rows.sparkSession
    limits = F.create_map(*(x for f, own in cuts.items() for x in (F.lit(f), F.array(*(F.lit(float(c)) for c in sorted(own))))))
    step = F.size(F.filter(limits[F.col("feature")], lambda c: c <= F.col("value")))
    counted = rows.where(F.col("feature").isin(list(cuts)) & F.col("value").isNotNull()).groupBy("feature", step.alias("step")).agg(F.count_if(positive).alias("p"), F.count_if(negative).alias("q"))
    # step 0 is below all cut-offs, step i from the i-th on
    table = spark.createDataFrame([(f, i, None if i == 0 else float(c)) for f, own in cuts.items() for i, c in enumerate([0, *sorted(own)])], "feature string, step int, cut double")
    full = table.join(counted, ["feature", "step"], "left").na.fill(0, ["p", "q"])
    w = Window.partitionBy("feature").orderBy("step")
    all_ = Window.partitionBy("feature")
    above = F.sum("p").over(all_) - F.coalesce(F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.coalesce(F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = full.select("feature", "cut", above.alias("hits"), below.alias("rejections"), F.sum("p").over(all_).alias("positives"), F.sum("q").over(all_).alias("negatives"))
    return summed.where("cut IS NOT NULL")


def in_ranges(at: Column, ranges: Sequence[tuple[float, float]]) -> Column:
    """Whether a time lies in one of a few ranges, ends included."""
    out = F.lit(False)
    for lo, hi in ranges:
        out = out | at.between(lo, hi)
    return out


def run_table(records: DataFrame, run: str, names: Sequence[str], metrics: dict[str, Column]) -> DataFrame:
    """metric, and a column for each of the named runs: records (one row a run) turned on their side, `N/A` where a metric is null."""
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.coalesce(c.cast("string"), F.lit("N/A")).alias("cell")) for m, c in metrics.items()))
    return records.select(F.col(run).cast("string").alias("_run"), F.inline(cells)).groupBy("metric").pivot("_run", list(names)).agg(F.first("cell")).na.fill("N/A")


def share(part: Column, whole: Column) -> Column:
    """`part/whole (percent%)`, the percent rounded half up; null if either is."""
    percent = F.floor((part * 200 + whole) / (2 * whole)).cast("long")
    return F.when(whole > 0, F.concat(part.cast("string"), F.lit("/"), whole.cast("string"), F.lit(" ("), percent.cast("string"), F.lit("%)")))
