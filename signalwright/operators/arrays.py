"""Operators on image patches held as arrays of numbers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def deviation(a: Column, of: Column) -> Column:
    """Population standard deviation; `of` is the mean."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x.cast("double") - of) * (x.cast("double") - of)) / F.size(a))


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two patches."""
    # the longer one's size, as that of the difference would compute it again
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))) / F.greatest(F.size(a), F.size(b))


def crop(a: Column, width: int, x1: int, y1: int, x2: int, y2: int) -> Column:
    """A rectangle of a row-major image."""
    rows = F.transform(F.sequence(F.lit(y1), F.lit(y2 - 1)), lambda y: F.slice(a, y * width + x1 + 1, F.lit(x2 - x1)))
    return F.flatten(rows)


def signed_parts(a: Column, b: Column) -> tuple[Column, Column]:
    """What grew and what shrank from a to b, each over its largest value (1 at least)."""
    step = F.zip_with(a, b, lambda x, y: y.cast("double") - x.cast("double"))
    scaled = lambda p: F.transform(F.array(p), lambda q: F.transform(q, lambda d: d / F.greatest(F.array_max(q), F.lit(1.0))))[0]
    return scaled(F.transform(step, lambda d: F.greatest(d, F.lit(0.0)))), scaled(F.transform(step, lambda d: F.greatest(-d, F.lit(0.0))))


#: Groups that a task adds up at a time.
GROUPS = 256


def _added(n: int):
    """Partial sums: of the images that pass by, one row for each group and task (or a few, where there are more than GROUPS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[np.ndarray]] = {}
        fields = None

        def pack() -> pa.RecordBatch:
            keys = [pa.array([k[i] for k in sums], f.type) for i, f in enumerate(fields[:n])]
            own = [pa.array([s[i].tolist() for s in sums.values()], pa.list_(t)) for i, t in enumerate((pa.float64(), pa.int64()))]
            out = pa.RecordBatch.from_arrays([*keys, *own, pa.array([s[2] for s in sums.values()], pa.int64())], names=[*(f.name for f in fields[:n]), "sums", "counts", "images"])
            sums.clear()
            return out

        for b in batches:
            fields = list(b.schema)
            for *own, image in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if image is None:
                    continue
                x = np.array(image, dtype=float)  # null as NaN
                key, there = tuple(own), ~np.isnan(x)
                old = sums.get(key)
                if old is None:
                    sums[key] = [np.where(there, x, 0.0), there.astype(np.int64), 1]
                else:
                    if len(x) > len(old[0]):
                        old[0], old[1] = (np.concatenate([o, np.zeros(len(x) - len(o), o.dtype)]) for o in old[:2])
                    old[0][: len(x)] += np.where(there, x, 0.0)
                    old[1][: len(x)] += there
                    old[2] += 1
                if len(sums) > GROUPS:
                    yield pack()
        if sums:
            yield pack()

    return run


def elementwise_sums(df: DataFrame, key: Sequence[str], patch: str) -> DataFrame:
    """key, pos, total, n (samples that aren't null), images: every task adds up its images, and only the sums are shuffled, once for each
    task, group and pixel however many images there are."""
    kinds = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in key)
    parts = df.select(*key, F.col(patch).cast("array<double>").alias("_patch")).mapInArrow(_added(len(key)), f"{kinds}{', ' if kinds else ''}sums array<double>, counts array<long>, images long")
    pixels = parts.select(*key, "images", F.posexplode(F.arrays_zip("sums", "counts")).alias("pos", "_x"))
    return pixels.groupBy(*key, "pos").agg(F.sum("_x.sums").alias("total"), F.sum("_x.counts").alias("n"), F.sum("images").alias("images"))


def elementwise_mean(df: DataFrame, key: Sequence[str], patch: str) -> DataFrame:
    """key, pos, mean, n: the average image of each group."""
    return elementwise_sums(df, key, patch).select(*key, "pos", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean"), "n")


def difference_heatmap(times: DataFrame, frames: DataFrame, key: Sequence[str], at: str, frame: str, patch: str, before: int, after: int) -> DataFrame:
    """key, pos, mean, usable: the average of |after - before| over the events of each group, and how many have both frames."""
    one = frames.select(*key, F.col(frame).alias("_f1"), F.col(patch).alias("_p1"))
    two = frames.select(*key, F.col(frame).alias("_f2"), F.col(patch).alias("_p2"))
    ends = times.withColumn("_f1", F.col(at) + before).withColumn("_f2", F.col(at) + after)
    both = ends.join(one, [*key, "_f1"]).join(two, [*key, "_f2"])
    change = both.select(*key, F.zip_with("_p1", "_p2", lambda x, y: F.abs(y.cast("double") - x.cast("double"))).alias("_change"))
    return elementwise_sums(change, key, "_change").select(*key, "pos", (F.col("total") / F.col("n")).alias("mean"), F.col("images").alias("usable"))


def calmest_mean(df: DataFrame, key: list[str], patch: str, spread: Column, tie: str, k: int) -> DataFrame:
    """The average of the k patches with the least spread in each group: a reference image."""
    w = Window.partitionBy(*key).orderBy(spread, tie)
    return elementwise_mean(df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k), key, patch)


def motion_around(times: DataFrame, frames: DataFrame, key: list[str], at: str, frame: str, patch: str, before: int, after: int) -> DataFrame:
    """Each time with `motion`: the mean difference between the patches `before` and `after` frames from it; null where one is missing."""
    one = frames.select(*key, F.col(frame).alias("_f1"), F.col(patch).alias("_p1"))
    two = frames.select(*key, F.col(frame).alias("_f2"), F.col(patch).alias("_p2"))
    ends = times.withColumn("_f1", F.col(at) + before).withColumn("_f2", F.col(at) + after)
    joined = ends.join(one, [*key, "_f1"], "left").join(two, [*key, "_f2"], "left")
    return joined.withColumn("motion", mean_difference(F.col("_p1"), F.col("_p2"))).drop("_f1", "_f2", "_p1", "_p2")


def motion_profile(times: DataFrame, frames: DataFrame, key: list[str], at: str, frame: str, patch: str, start: int, stop: int, step: int) -> DataFrame:
    """key, at, offset, motion: differences from step to step between `start` and `stop` frames from each time."""
    grid = times.select(*key, at, F.explode(F.sequence(F.lit(start), F.lit(stop), F.lit(step))).alias("offset")).withColumn(frame, F.col(at) + F.col("offset"))
    seen = grid.join(frames.select(*key, frame, patch), [*key, frame])
    last = F.lag(patch).over(Window.partitionBy(*key, at).orderBy("offset"))
    return seen.withColumn("motion", mean_difference(last, F.col(patch))).where("motion IS NOT NULL").select(*key, at, "offset", "motion")


def share_of(a: Column, holds) -> Column:
    """The share of the samples for which a condition holds."""
    return F.size(F.filter(a, holds)) / F.size(a)
