"""Detectors whose state feeds back into their thresholds: one stream segment at a time, in order, as keyed Python state.

Everything that has no feedback (smoothing, differences) is computed by windows before; what runs here is a small machine over the
prepared columns of one (stream, segment), which is also the unit that restarts. Spark brings the rows of a key together and sorts them
(spilling where it must); a task then passes them by in Arrow batches and holds the state of one machine, however long the stream.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalwright.operators import events, refractory, runs, signals
from signalwright.operators.machines import SlidingMedian, by_machine


@dataclass(frozen=True)
class CutConfig:
    """Values of the precise variant; `recall()` gives the other."""

    smooth: int = 7
    long_width: int = 35
    short_width: int = 25
    long_least: float = 18.0
    short_least: float = 10.0
    strong: float = 30.0
    confirm: int = 2
    confirm_strong: int = 1
    min_gap: int = 50
    break_level: float = 235.0
    break_offset: float = 0.0
    break_hold: int = 75
    break_exit: int = 25
    baseline_rows: int = 1500
    baseline_least: int = 100
    ceiling: float = 230.0
    second_region: bool = False

    @staticmethod
    def recall() -> CutConfig:
        return CutConfig(short_least=8.0, break_offset=50.0, break_hold=100, break_exit=38, second_region=True)


def prepare(df: DataFrame, key: Sequence[str], frame: str, level: str, left: str, c: CutConfig) -> DataFrame:
    """Adds smoothed, d_long, d_short, d_left."""
    out = signals.rolling_mean(df, key, [frame], level, c.smooth, "smoothed")
    out = signals.rolling_mean(out, key, [frame], left, c.smooth, "_left")
    out = signals.lagged_difference(out, key, [frame], "smoothed", c.long_width, "d_long")
    out = signals.lagged_difference(out, key, [frame], "smoothed", c.short_width, "d_short")
    return signals.lagged_difference(out, key, [frame], "_left", c.short_width, "d_left").drop("_left")


class BreakWatch:
    """Whether the stream is in a break; with an offset, the level follows the median of what was seen outside of breaks and spikes."""

    def __init__(self, c: CutConfig):
        self.c, self.on, self.run = c, False, 0
        self.seen = SlidingMedian(c.baseline_rows)

    def level(self) -> float:
        if self.c.break_offset > 0 and len(self.seen) >= self.c.baseline_least:
            return max(self.seen.median() + self.c.break_offset, self.c.break_level - 20)
        return self.c.break_level

    def feed(self, frame: int, x: float, in_spike: bool) -> tuple[str, int] | None:
        if self.c.break_offset > 0 and not self.on and not in_spike:
            self.seen.append(x)
        level = self.level()
        self.run = self.run + 1 if (x < level if self.on else x > level) else 0
        if self.run < (self.c.break_exit if self.on else self.c.break_hold):
            return None
        self.on, self.run = not self.on, 0
        return ("break_start", frame - self.c.break_hold) if self.on else ("break_end", frame)


@dataclass
class Spike:
    start: int
    strength: float
    level: float
    motion: float
    left: float
    spread: float
    at_peaks: set[str]  # the regions that the peaks so far came from
    duration: int = 0

    @property
    def region(self) -> str:
        return next(iter(self.at_peaks)) if len(self.at_peaks) == 1 else "both"

    def grow(self, strength: float, level: float, motion: float, left: float, spread: float, region: str) -> None:
        self.duration += 1
        if strength > self.strength:
            self.strength, self.spread = strength, spread
            self.at_peaks.add(region)
        self.level, self.motion, self.left = max(self.level, level), max(self.motion, motion), max(self.left, left)


CUTS = "kind string, frame long, strength double, level double, motion double, left double, spread double, region string, duration long, open boolean"


class Cuts:
    """Spikes of one stream, fed with its rows in order: cuts, break markers and dropped candidates in `events`."""

    def __init__(self, c: CutConfig):
        self.c, self.watch, self.spike = c, BreakWatch(c), None
        self.pending, self.peak, self.last = 0, 0.0, -c.min_gap * 1000
        self.events: list[tuple] = []

    def _tell(self, kind: str, s: Spike, open_end: bool = False) -> None:
        self.events.append((kind, s.start, s.strength, s.level, s.motion, s.left, s.spread, s.region, s.duration, open_end))

    def _rest(self) -> None:
        self.spike, self.pending, self.peak = None, 0, 0.0

    def feed(self, frame: int, x: float, d_long: float, d_short: float, d_left: float, motion: float, spread: float) -> None:
        c = self.c
        if mark := self.watch.feed(frame, x, self.spike is not None):
            self.events.append((mark[0], mark[1], *[None] * 7, False))
        table = d_long >= c.long_least or d_short >= c.short_least
        aside = c.second_region and d_left >= c.short_least
        strength = max(d_long, d_short, d_left if aside else d_short)
        region = "both" if table and aside else "table" if table else "left" if aside else None
        if self.watch.on:
            if self.spike:
                self._tell("dropped_break", self.spike)
            self._rest()
        elif region is None:
            if self.spike:
                self._tell("cut", self.spike)
                self.last = self.spike.start
            self._rest()
        elif self.spike:
            self.spike.grow(strength, x, motion, d_left, spread, region)
        else:
            self.pending, self.peak = self.pending + 1, max(self.peak, strength)
            if self.pending >= (c.confirm_strong if self.peak >= c.strong else c.confirm):
                candidate = Spike(frame, self.peak, x, motion, d_left, spread, {region})
                if frame - self.last >= c.min_gap:
                    self.spike = candidate
                else:
                    self._tell("dropped_min_gap", candidate)
                    self.pending, self.peak = 0, 0.0

    def close(self) -> None:
        if self.spike:
            self._tell("cut", self.spike, True)


def run_cuts(rows: Iterable[tuple], c: CutConfig) -> list[tuple]:
    """rows: frame, smoothed, d_long, d_short, d_left, motion, spread in order. Cuts, break markers and dropped candidates."""
    machine = Cuts(c)
    for row in rows:
        machine.feed(*row)
    machine.close()
    return machine.events


def detect_cuts(df: DataFrame, key: Sequence[str], c: CutConfig = CutConfig()) -> DataFrame:
    """df: key, frame, smoothed, d_long, d_short, d_left, motion, spread (see prepare). The events of each stream with `confidence`."""
    found = by_machine(df, key, ["frame", "smoothed", "d_long", "d_short", "d_left", "motion", "spread"], lambda: Cuts(c), CUTS)
    sure = signals.confidence(F.col("strength"), F.col("duration"), F.col("motion"), F.col("left"), F.col("spread"), F.col("level") > c.ceiling)
    return found.withColumn("confidence", F.when(F.col("kind") == "cut", F.when(F.col("open"), "low").otherwise(sure)))


def settled_cuts(found: DataFrame, key: Sequence[str], echo: int = 75, ratio: float = 0.6, close: int = 62, strong: float = 30.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """found: detect_cuts. The cuts (key, frame, strength, confidence): all, those that are no echoes, those left after close pairs."""
    cuts = found.where("kind = 'cut'").select(*key, "frame", "strength", "confidence")
    sounded = events.drop_echoes(cuts, key, "frame", "strength", echo, F.lit(ratio))
    return cuts, sounded, refractory.merge_close(sounded, key, "frame", "strength", close, strong)


def cut_result(found: DataFrame, rows: DataFrame, key: Sequence[str], echo: int = 75, ratio: float = 0.6, close: int = 62, strong: float = 30.0, fps: float = 25.0) -> DataFrame:
    """The summary of each stream of `rows` (key, frame): cuts left after echoes (`echo` frames) and close pairs (`close` frames), how many
    of either went, frames in breaks and outside, cuts per active minute, mean step between cuts in seconds (both 0 where undefined).

    found: detect_cuts. A break that doesn't end lasts to the last frame.
    """
    cuts, sounded, merged = settled_cuts(found, key, echo, ratio, close, strong)
    marks = found.where(F.col("kind").isin("break_start", "break_end")).select(*key, "frame", F.expr("substr(kind, 7)").alias("kind"))
    ends = rows.groupBy(*key).agg((F.max("frame") + 1).alias("duration"))
    spent = events.break_time(events.pair_breaks(marks, key, "frame", "kind"), ends, key, "duration")
    count = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    n = F.count("*")
    steps = F.when(n > 1, (F.max("frame") - F.min("frame")) / (n - 1) / fps)
    last = merged.groupBy(*key).agg(n.alias("cuts"), F.count_if(F.col("confidence") == "high").alias("high"), steps.alias("mean_cycle"))
    joined = spent.join(count(cuts, "_raw"), list(key), "left").join(count(sounded, "_heard"), list(key), "left").join(last, list(key), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    raw, heard, left = zero("_raw"), zero("_heard"), zero("cuts")
    rate = F.when(F.col("active_time") > 0, left / (F.col("active_time") / fps) * 60).otherwise(0.0)
    return joined.select(*key, left.alias("cuts"), zero("high").alias("high"), (raw - heard).alias("echoes"), (heard - left).alias("merged"), "break_time", "active_time", rate.alias("rate"), F.coalesce("mean_cycle", F.lit(0.0)).alias("mean_cycle"))


@dataclass(frozen=True)
class ScaleConfig:
    smooth: int = 13
    on: float = 25.0
    off: float = 15.0
    hold: int = 5
    min_on: int = 15
    min_gap: int = 100
    max_loaded: int = 250
    drift: float = 1.5
    idle_rows: int = 75
    blend: float = 0.005
    jump: float = 30.0
    calm: float = 5.0
    #: Calibration: rows that pass before it, patches it gathers, how many of the calmest are averaged, and what stands in for none.
    settle: int = 25
    gather: int = 30
    calmest: int = 3
    neutral: float = 128.0


class Scale:
    """A scale seen by a camera: difference to a reference patch, which adapts when idle and is taken anew on drift and after changes of
    the light. Without a reference it calibrates itself first, and again whenever its source reconnects."""

    def __init__(self, reference: np.ndarray | None, c: ScaleConfig):
        self.c, self.last = c, -1
        self.skip, self.patches = c.settle, None if reference is not None else []
        self.reference = None if reference is None else np.array(reference, dtype=float)
        self.recent: deque[float] = deque(maxlen=c.smooth)
        self.state, self.warm, self.above, self.run, self.idle = "warmup", c.smooth, 0, 0, 0
        self.since = 0
        self.counted = -c.min_gap * 1000
        self.light: float | None = None
        self.lit = True
        self.events: list[tuple] = []

    def _tell(self, kind: str, frame: int, duration: int | None = None, reason: str | None = None) -> None:
        self.events.append((kind, frame, duration, reason))

    def _renew(self, patch: np.ndarray) -> None:
        self.reference = patch.astype(float)
        self.recent.clear()
        self.state, self.warm = "warmup", self.c.smooth

    def reconnect(self, frame: int) -> None:
        """The source came back: buffers and runs begin anew, and so does the reference. What is loaded since when, and the last cycle, stay."""
        self.recent.clear()
        self.state, self.warm, self.run = "warmup", self.c.smooth, 0
        self.skip, self.patches = self.c.settle, []
        self._tell("stream_reconnected", frame)

    def _calibrate(self, patch: np.ndarray | None) -> None:
        """Takes one row for the calibration; a row without a patch ends it, whatever there is by then."""
        if patch is not None and self.skip:
            self.skip -= 1
            return
        if patch is not None:
            self.patches.append((float(patch.std()), len(self.patches), patch))
        if patch is None or len(self.patches) == self.c.gather:
            calm = [p for *_, p in sorted(self.patches, key=lambda x: x[:2])[: self.c.calmest]]
            self.reference, self.patches = np.mean(calm, axis=0) if calm else np.full(1, self.c.neutral), None

    def light_is_steady(self, frame: int, brightness: float, patch: np.ndarray) -> bool:
        if self.light is not None:
            jump = abs(brightness - self.light)
            if jump > self.c.jump:
                if self.lit:
                    self._tell("lighting_change", frame)
                self.lit = False
                return False  # the level to compare with stays that from before the change
            if not self.lit and jump < self.c.calm:
                self.lit = True
                self._renew(patch)
                self._tell("lighting_restored", frame)
        self.light = brightness
        return self.lit

    def _count(self, frame: int, duration: int, shown: int, least: int) -> bool:
        if duration >= least and frame - self.counted >= self.c.min_gap:
            self.counted = frame
            self._tell("scale_cycle_complete", frame, shown)
            return True
        return False

    def feed(self, frame: int, brightness: float, patch: np.ndarray | None) -> float | None:
        if self.patches is not None:
            return self._calibrate(patch)
        if patch is None:
            return None
        steady = self.light_is_steady(frame, brightness, patch)
        self.recent.append(float(np.abs(patch - self.reference).mean()))
        diff = sum(self.recent) / len(self.recent)
        if steady:
            getattr(self, f"_{self.state}")(frame, diff, patch)
        return diff

    def _warmup(self, frame: int, diff: float, patch: np.ndarray) -> None:
        self.above += diff > self.c.on
        self.warm -= 1
        if self.warm > 0:
            return
        self.state = "empty"
        if diff > self.c.on:
            self.state, self.since = "loaded", max(0, frame - self.above)
            self._tell("scale_initial_loaded", frame, self.above)

    def _empty(self, frame: int, diff: float, patch: np.ndarray) -> None:
        self.idle += 1
        if self.idle > self.c.idle_rows:
            self.reference = self.reference + self.c.blend * (patch - self.reference)
        self.run = self.run + 1 if diff > self.c.on else 0
        if self.run >= self.c.hold:
            self.state, self.since, self.idle = "loaded", frame, 0
            self._tell("scale_loaded", frame)

    def _loaded(self, frame: int, diff: float, patch: np.ndarray) -> None:
        self.idle, duration = 0, frame - self.since
        if duration > self.c.max_loaded:
            if diff < self.c.on * self.c.drift:
                self._renew(patch)
                self.above = self.run = 0
                self._count(frame, duration, self.c.max_loaded, self.c.min_on + 1)
        elif diff < self.c.off:
            if not self._count(frame, duration, duration, self.c.min_on):
                self._tell("scale_false_trigger", frame, duration, "too_brief" if duration < self.c.min_on else "too_close")
            self.state, self.run = "empty", 0

    def close(self, frame: int | None = None) -> None:
        """After the last row; `frame` is the one that would follow."""
        frame = self.last + 1 if frame is None else frame
        if self.state == "loaded":
            self._count(frame, frame - self.since, frame - self.since, self.c.min_on)


SCALE_EVENTS = "kind string, frame long, duration long, reason string"


#: The kind of a control row: the source was lost and came back.
RECONNECTED = "stream_reconnected"


class _Feed(Scale):
    """A scale fed with plain rows."""

    def feed(self, frame: int, brightness: float, patch: list[float] | None, control: str | None = None) -> float | None:
        self.last = frame
        if control == RECONNECTED:
            return self.reconnect(frame)
        return super().feed(frame, brightness, None if patch is None else np.asarray(patch, dtype=float))


def detect_scale(df: DataFrame, key: Sequence[str], c: ScaleConfig = ScaleConfig(), reference: Sequence[float] | None = None, control: str | None = None) -> DataFrame:
    """df: key, frame, brightness, patch (array). The scale's events.

    reference: the patch to compare with at first; without one the scale calibrates on its own first rows. control: a column that is
    RECONNECTED in control rows. Rows without a patch end a calibration and are passed over otherwise.
    """
    start = None if reference is None else np.array(reference, dtype=float)
    return by_machine(df, key, ["frame", "brightness", "patch", *([control] if control else [])], lambda: _Feed(start, c), SCALE_EVENTS, ["frame"])


def station_result(scale: DataFrame, tables: DataFrame, key: Sequence[str], low: int, high: int) -> DataFrame:
    """key, verdict, frame, number, peak, slope, reason: every completed cycle of the scale is accepted, with the peak and slope of the nearest
    table cycle of low <= table - scale <= high; a table cycle is rejected if no scale cycle is of low <= scale - table <= high. Numbered by
    time within each verdict.

    scale: detect_scale; tables: table_cycles with the same key and frames.
    """
    done = scale.where("kind = 'scale_cycle_complete'").select(*key, "frame")
    sides = tables.select(*key, F.col("frame").alias("at"), "peak", "slope")
    accepted = events.nearest(done, sides, key, "frame", "at", low, high, ["peak", "slope"]).select(*key, F.lit("accepted").alias("verdict"), "frame", "peak", "slope", F.lit(None).cast("string").alias("reason"))
    rejected = events.without_partner(tables.select(*key, "frame", "peak", "slope"), done.withColumnRenamed("frame", "at"), key, "frame", "at", low, high)
    both = accepted.unionByName(rejected.select(*key, F.lit("rejected").alias("verdict"), "frame", "peak", "slope", F.lit("no_scale").alias("reason")))
    return both.withColumn("number", F.row_number().over(signals.ordered([*key, "verdict"], ["frame"])))


def table_cycles(df: DataFrame, key: Sequence[str], frame: str, texture: str, level: float = 75.0, hold: int = 5, least: int = 30, gap: int = 100, fps: float = 25.0) -> DataFrame:
    """Covered stretches of a table that end and are long enough, at least `gap` after the last one: frame, duration, peak, slope.

    No feedback, so this is windows and one fold. The duration counts the rows that confirmed it; the slope compares the halves of the
    last 50 rows after the confirming one.
    """
    latched = runs.hysteresis(df, key, [frame], texture, level, level, hold, "_on")
    w = signals.ordered(key, [frame])
    # the row that ends a stretch belongs to its history
    part = latched.withColumn("_was", F.coalesce(F.lag("_on").over(w), F.lit(0))).withColumn("_rise", F.when((F.col("_on") == 1) & (F.col("_was") == 0), 1).otherwise(0))
    part = part.withColumn("_cycle", F.sum("_rise").over(w.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("_on") == 1) | (F.col("_was") == 1))
    own = Window.partitionBy(*key, "_cycle")
    ranked = part.withColumn("_n", F.sum(1 - F.col("_rise")).over(own)).withColumn("_i", F.row_number().over(own.orderBy(frame)) - 2)
    used = F.least(F.col("_n"), F.lit(50))
    at = F.col("_i") - (F.col("_n") - used)
    early, late = (at >= 0) & (at < F.floor(used / 2)), at >= F.floor(used / 2)
    found = ranked.groupBy(*key, "_cycle").agg(
        F.max(F.when(F.col("_on") == 0, F.col(frame))).alias(frame),
        (F.max("_n") + hold).cast("long").alias("duration"),
        F.max(texture).alias("peak"),
        F.when(F.max("_n") >= 10, (F.avg(F.when(late & (F.col("_rise") == 0), F.col(texture))) - F.avg(F.when(early & (F.col("_rise") == 0), F.col(texture)))) / (F.max(used) / fps)).otherwise(0.0).alias("slope"),
    )
    whole = found.where(F.col(frame).isNotNull() & (F.col("duration") >= least)).drop("_cycle")
    return refractory.keep_spaced(whole, key, frame, gap)
