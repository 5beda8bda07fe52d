"""Reports: buckets, pivots, rates, sampling, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalwright.operators.signals import ordered


def spine(df: DataFrame, key: Sequence[str], duration: str, size: int, out: str) -> DataFrame:
    """key and a row for each bucket of `size`: duration div size + 1 of them."""
    return df.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"{duration} div {size}"))).alias(out))


def count_bins(spined: DataFrame, events: DataFrame, key: Sequence[str], bin: Column, out: str, **counts: Column) -> DataFrame:
    """A row for each bucket of the spine with the counts of each condition; events beyond it don't count."""
    binned = events.withColumn(out, bin).groupBy(*key, out).agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    joined = spined.join(binned, [*key, out], "left")
    return joined.select(*key, out, *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in counts))


def clamped_bucket(at: Column, duration: Column, size: Column) -> Column:
    """The bucket of `at` among ceil(duration / size); what lies at the very end, or beyond it, is in the last one."""
    return F.greatest(F.least(F.floor(at / size), F.ceil(duration / size) - 1), F.lit(0)).cast("long")


def hour_table(df: DataFrame, key: Sequence[str], at: str, duration: str, size: int, first_hour: int, **counts: Column) -> DataFrame:
    """key, bucket, label and the counts of each condition for all ceil(duration / size) buckets of each key, empty ones too.

    `duration` is the same in all rows of a key.
    """
    spined = df.groupBy(*key).agg(F.max(duration).alias("_d")).select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_d") / size) - 1, F.lit(0)))).alias("bucket"))
    rows = count_bins(spined, df, key, clamped_bucket(F.col(at), F.col(duration), F.lit(size)), "bucket", **counts)
    return rows.withColumn("label", F.concat((F.col("bucket") + first_hour).cast("string"), F.lit(":00")))


def window_rates(df: DataFrame, key: Sequence[str], at: str, start: int, stop: int, size: int, per: int) -> DataFrame:
    """key, from, n, rate: events in windows of `size` that begin at `start`, `start` + `size`, ... before `stop`, per `per` units of the whole
    size, the last window too, which may reach beyond `stop`. Only windows with events."""
    last = start + -(-(stop - start) // size) * size
    own = df.where((F.col(at) >= start) & (F.col(at) < last)).groupBy(*key, (F.floor((F.col(at) - start) / size) * size + start).cast("long").alias("from")).agg(F.count("*").alias("n"))
    return own.select(*key, "from", "n", (F.col("n") * per / F.lit(size)).alias("rate"))


def ratio(a: Column, b: Column, none=None) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(none).cast("double"))


def peak_rate(df: DataFrame, key: Sequence[str], order: str, width: int) -> DataFrame:
    """The most events in [t, t + width] that begins at an event: those up to its end less those before its start, from running counts over
    events and ends in one order. An event without a time counts for none."""
    own = ordered(key, [order])
    starts = df.where(F.col(order).isNotNull()).select(*key, F.col(order)).withColumn("_before", F.rank().over(own) - 1)
    ends = starts.select(*key, (F.col(order) + width).alias("_at"), "_before")
    both = starts.select(*key, F.col(order).alias("_at"), F.lit(None).cast("int").alias("_before")).unionByName(ends)
    running = ordered(key, ["_at", "_before"]).rowsBetween(Window.unboundedPreceding, 0)  # events (null) come before ends of the same time
    return both.withColumn("_n", F.count_if(F.col("_before").isNull()).over(running) - F.col("_before")).groupBy(*key).agg(F.max("_n").alias("peak"))


def idle_gaps(df: DataFrame, key: Sequence[str], order: str, longer: int) -> DataFrame:
    w = ordered(key, [order])
    gaps = df.select(*key, F.lag(order).over(w).alias("idle_from"), F.col(order).alias("idle_to"))
    return gaps.where(F.col("idle_to") - F.col("idle_from") > longer)


def sample(df: DataFrame, key: Sequence[str], order: Sequence[str], target: int, keep_last: bool = False) -> DataFrame:
    """About `target` rows of each key: every max(1, n div target)-th from the first; with keep_last every ceil(n / target)-th if there
    are more than the target, and the last one."""
    w = ordered(key, order)
    n = F.count("*").over(Window.partitionBy(*key))
    rows = df.withColumn("_n", n).withColumn("_r", F.row_number().over(w) - 1)
    if keep_last:
        step = F.when(F.col("_n") > target, F.ceil(F.col("_n") / target)).otherwise(1)
        return rows.where((F.col("_r") % step == 0) | (F.col("_r") == F.col("_n") - 1)).drop("_n", "_r")
    return rows.where(F.col("_r") % F.greatest(F.lit(1), F.expr(f"_n div {target}")) == 0).drop("_n", "_r")


def ends_of(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first and the last n rows of each key."""
    w = ordered(key, order)
    rows = df.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    return rows.where((F.col("_r") <= n) | (F.col("_r") > F.col("_n") - n)).drop("_r", "_n")


def separation(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Distance of two means over their mean deviation, which counts as 0.1 at least."""
    return F.abs(a[0] - b[0]) / F.greatest((a[1] + b[1]) / 2, F.lit(0.1))


def sweep(df: DataFrame, cuts: Sequence[float], value: str, positive: Column) -> DataFrame:
    """For each cut-off: positives at or above it, and others below."""
    over = [F.col(value) >= float(c) for c in cuts]
    # two sums a cut-off in one pass, which then become rows
    counted = df.agg(*(F.count_if(o & positive).alias(f"h{i}") for i, o in enumerate(over)), *(F.count_if(~o & ~positive).alias(f"r{i}") for i, o in enumerate(over)))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(float(c)).alias("cut"), F.col(f"h{i}").alias("hits"), F.col(f"r{i}").alias("rejections")) for i, c in enumerate(cuts)))))


def with_default(df: DataFrame, config: DataFrame, key: str, default: str) -> DataFrame:
    """Each row with the configuration of its key, or with that of the default key where it has none. The configuration is a small table
    of one row a key."""
    known = df.join(config.select(F.col(key).alias("_known")), F.col(key) == F.col("_known"), "left")
    return known.withColumn("used", F.coalesce("_known", F.lit(default))).drop("_known").join(config.withColumnRenamed(key, "used"), "used")
