"""Runs, latches and islands by windows: no state beyond what a window gives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalwright.operators.signals import ordered


def run_length(df: DataFrame, key: Sequence[str], order: Sequence[str], holds: Column, out: str) -> DataFrame:
    """How many rows in a row, up to this one, the condition holds."""
    holds = F.coalesce(holds, F.lit(False))
    w = ordered(key, order)
    rows = df.withColumn(f"_{out}_n", F.row_number().over(w))
    broken = F.max(F.when(~holds, F.col(f"_{out}_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, (F.col(f"_{out}_n") - F.coalesce(broken, F.lit(0))).cast("long")).drop(f"_{out}_n")


def latch(df: DataFrame, key: Sequence[str], order: Sequence[str], turns_on: Column, turns_off: Column, out: str) -> DataFrame:
    """1 from a row that turns it on to the one before that which turns it off; 0 at first."""
    last = F.last(F.when(turns_on, 1).when(turns_off, 0), ignorenulls=True)
    return df.withColumn(out, F.coalesce(last.over(ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))


def hysteresis(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, on: float, off: float, hold: int, out: str) -> DataFrame:
    """On after `hold` rows in a row above `on`; off below `off`. As off < on, the row that turns it off also breaks the run."""
    runs = run_length(df, key, order, F.col(value) > on, f"_{out}_run")
    return latch(runs, key, order, F.col(f"_{out}_run") >= hold, F.col(value) < off, out).drop(f"_{out}_run")


def break_latch(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, threshold: float, hold: int, leave: int, out: str) -> DataFrame:
    """On after `hold` rows in a row above the threshold, off after `leave` in a row below; a row on it breaks both runs."""
    runs = run_length(df, key, order, F.col(value) > threshold, f"_{out}_up")
    runs = run_length(runs, key, order, F.col(value) < threshold, f"_{out}_down")
    return latch(runs, key, order, F.col(f"_{out}_up") >= hold, F.col(f"_{out}_down") >= leave, out).drop(f"_{out}_up", f"_{out}_down")


def edges(df: DataFrame, key: Sequence[str], order: Sequence[str], state: str, out: str) -> DataFrame:
    """Only the rows where the state changes: 'rise' or 'fall'. Before the first row it is 0."""
    before = F.coalesce(F.lag(state).over(ordered(key, order)), F.lit(0))
    step = F.col(state) - before
    return df.withColumn(out, F.when(step > 0, "rise").when(step < 0, "fall")).where(F.col(out).isNotNull())


def islands(df: DataFrame, key: Sequence[str], order: Sequence[str], state: str, out: str) -> DataFrame:
    """Numbers the stretches of equal state from 1."""
    w = ordered(key, order)
    changed = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)), 0).otherwise(1)
    return df.withColumn(f"_{out}", changed).withColumn(out, F.sum(f"_{out}").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop(f"_{out}")


def gap_islands(df: DataFrame, key: Sequence[str], order: str, apart: Column, out: str, ties: Sequence[str] = ()) -> DataFrame:
    """Numbers the stretches of rows in which no row is `apart` (a condition on `_gap`, the distance to the row before)."""
    w = ordered(key, [order, *ties])
    gapped = df.withColumn("_gap", F.col(order) - F.lag(order).over(w))
    return gapped.withColumn(out, F.sum(F.when(apart, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_gap")
