"""Signal operators: rolling statistics, lagged differences, thresholds. Each works on rows ordered by `order` within `key`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(key: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def last_rows(key: Sequence[str], order: Sequence[str], n: int) -> WindowSpec:
    """The latest n rows, fewer at the start."""
    return ordered(key, order).rowsBetween(-(n - 1), 0)


def rolling_mean(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, n: int, out: str) -> DataFrame:
    """Mean of the latest n rows. The sum is taken in the value's own type, so that integers give exact sums."""
    w = last_rows(key, order, n)
    return df.withColumn(out, F.sum(value).over(w).cast("double") / F.count(value).over(w))


def rolling_median(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, n: int, out: str) -> DataFrame:
    return df.withColumn(out, F.percentile(value, F.lit(0.5)).over(last_rows(key, order, n)))


def lagged_difference(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, width: int, out: str) -> DataFrame:
    """The value less the one at the start of a window of `width` rows that ends here; 0 until there are that many rows."""
    w = ordered(key, order)
    return df.withColumn(out, F.when(F.row_number().over(w) >= width, F.col(value) - F.lag(value, width - 1).over(w)).otherwise(F.lit(0.0)))


def passes(long: Column, short: Column, long_least: float, short_least: float, left: Column | None = None) -> tuple[Column, Column, Column]:
    """Whether a difference over either window is large enough; the strength; which region says so."""
    table = (long >= long_least) | (short >= short_least)
    strength = F.greatest(long, short)
    if left is None:
        return table, strength, F.when(table, F.lit("table"))
    aside = left >= short_least
    strength = F.when(aside & (left > strength), left).otherwise(strength)
    return table | aside, strength, F.when(table & aside, "both").when(table, "table").when(aside, "left")


def confidence(strength: Column, duration: Column, slide: Column, left: Column, spread: Column, ceiling: Column) -> Column:
    """A class from added points: strength, duration, motion, second region, evenness, less one at the ceiling."""

    def points(x: Column, *steps: tuple[float, float]) -> Column:
        out = F
        for least, p in steps:
            out = out.when(x >= least, F.lit(p))
        return out.otherwise(F.lit(0.0))

    score = points(strength, (40, 3.0), (30, 2.0), (22, 1.0)) + points(duration, (5, 2.0), (3, 1.0)) + points(slide, (8, 1.0), (5, 0.5))
    score = score + F.when(left > 5, 1.0).when(left > 0, 0.5).otherwise(0.0) + F.when(spread < 90, 0.5).otherwise(0.0) - F.when(ceiling, 1.0).otherwise(0.0)
    return F.when(score >= 4, "high").when(score >= 2, "medium").otherwise("low")


def valid_frames(df: DataFrame, height: Column, width: Column, mean: Column) -> DataFrame:
    """Frames that are large enough and neither black nor white; row windows downstream see only these."""
    return df.where((height >= 720) & (width >= 1280) & (mean >= 10) & (mean <= 250))
