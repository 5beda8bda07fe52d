"""The keyed machines against plain loops, and that their time grows in proportion."""

from __future__ import annotations

import random
import statistics
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalwright.operators import detectors, events, fullday, refractory, report
from signalwright.operators.machines import Matcher, Outweighing, SlidingMedian

K = ["k"]


@pytest.mark.parametrize("width", [1, 2, 7, 600, 1500, 4000])
def test_sliding_median(width):
    rng = random.Random(width)
    own, values = SlidingMedian(width), []
    for i in range(9000):
        values.append(rng.choice([rng.uniform(0, 255), rng.randrange(5), 100.0]))
        own.append(values[-1])
        if i % 97 == 0 or i < 20:
            assert own.median() == statistics.median(values[-width:])
            assert len(own) == min(width, i + 1)


def test_sliding_median_of_rising_and_falling_values():
    own, values = SlidingMedian(1500), [float(x) for x in [*range(5000), *range(5000, 0, -1), *[7] * 3000]]
    for i, x in enumerate(values):
        own.append(x)
        if i % 301 == 0:
            assert own.median() == statistics.median(values[max(0, i - 1499) : i + 1])


def test_gated_baseline_beyond_its_bound():
    """3,000 frames: the level follows the last 1,500 that count, at over 100,000 frames a second."""
    rng = random.Random(1)
    c = detectors.CutConfig.recall()
    watch, seen = detectors.BreakWatch(c), []
    for f in range(3000):
        x, spike = rng.uniform(50, 150), rng.random() < 0.2
        watch.feed(f, x, spike)
        seen += [] if spike else [x]
    assert len(seen) > c.baseline_rows and watch.level() == max(statistics.median(seen[-c.baseline_rows :]) + c.break_offset, c.break_level - 20)
    values = [rng.uniform(50, 150) for _ in range(60_000)]
    began = time.perf_counter()
    for f, x in enumerate(values):
        watch.feed(f, x, False)
    assert 60_000 / (time.perf_counter() - began) > 100_000


def loop_sources(rows, within, at_once):
    out = []
    for i, (t, p) in enumerate(rows):
        before = [(u, q) for u, q in rows[:i] if t - u <= within and (at_once or u < t) and p < 0.6 * q]
        out.append(max(before, default=None))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 12)), max_size=60), st.integers(0, 15), st.booleans())
def test_outweighing(rows, within, at_once):
    rows.sort(key=lambda r: r[0])
    own = Outweighing(within, at_once)
    assert [own.meet(t, p, 0.6) for t, p in rows] == loop_sources(rows, within, at_once)


def loop_match(own, found, within):
    rest, out = sorted(found), []
    for t in sorted(own):
        near = min(rest, key=lambda d: (abs(d - t), d), default=None)
        if near is not None and abs(near - t) <= within:
            rest.remove(near)
            out.append((t, near))
        else:
            out.append((t, None))
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 80), max_size=40), st.lists(st.integers(0, 80), max_size=40), st.integers(0, 9))
def test_matching(own, found, within):
    machine = Matcher(within)
    for at, kind in sorted([(t, 0) for t in own] + [(t, 1) for t in found]):
        machine.feed(at, kind)
    machine.close()
    assert machine.events == loop_match(own, found, within)


def test_matching_holds_what_is_near():
    machine, most = Matcher(5), 0
    for t in range(50_000):
        machine.feed(t, 1)
        if t % 3 == 0:
            machine.feed(t, 0)
        most = max(most, len(machine.rest) - machine.start + len(machine.labels))
        machine.events.clear()
    assert most < 40


def dense(spark, n, step=3):
    """One stream of n rows, each a few steps from the next."""
    return spark.range(n).select(F.lit(0).cast("long").alias("k"), (F.col("id") * step + F.col("id") % 2).alias("t"), (F.col("id") * 7919 % 1009).alias("p"))


def seconds(df):
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


@pytest.mark.parametrize("name", ["nearest", "audit", "echoes", "match", "peak"])
def test_time_grows_with_one_stream(spark, name):
    """Four times the rows of one key take about four times as long, not sixteen: windows and neighbourhoods hold thousands of rows."""

    def run(n):
        x = dense(spark, n)
        y = dense(spark, n, 4).select("k", F.col("t").alias("u"))
        return seconds({
            "nearest": lambda: events.nearest(x, y, K, "t", "u", -20, 100),
            "audit": lambda: events.echo_audit(x, K, "t", "p", n // 4, F.lit(0.6)),
            "echoes": lambda: events.drop_echoes(x, K, "t", "p", n // 4, F.lit(0.6)),
            "match": lambda: refractory.greedy_match(x.select("k", "t"), y.withColumnRenamed("u", "t"), K, "t", 50),
            "peak": lambda: report.peak_rate(x, K, "t", n // 4),
        }[name]())

    run(1000)
    few, many = run(50_000), run(200_000)
    assert many < 8 * few + 3, (few, many)


def test_peak_rate_of_ties_and_nulls(spark):
    rng = random.Random(3)
    own = [(k, rng.choice([None, *range(30)])) for k in (None, 0, 1) for _ in range(40)]
    got = {r["k"]: r["peak"] for r in report.peak_rate(spark.createDataFrame(own, "k long, t long"), K, "t", 4).collect()}
    for k in (None, 0, 1):
        ts = [t for j, t in own if j == k and t is not None]
        assert got[k] == max(sum(t <= u <= t + 4 for u in ts) for t in ts)


def calibrated(levels, resets=(), **more):
    c = detectors.ScaleConfig(smooth=1, hold=2, min_on=3, min_gap=5, max_loaded=20, settle=2, gather=4, calmest=2, **more)
    scale = detectors._Feed(None, c)
    for f, x in enumerate(levels):
        scale.feed(f, 100.0, x, detectors.RECONNECTED if f in resets else None)
    scale.close()
    return scale


def test_scale_calibrates_itself():
    busy, calm, load = [0.0, 90.0], [50.0, 52.0], [90.0, 92.0]
    # the first two rows settle; of four gathered patches the two calmest make the reference
    scale = calibrated([busy, busy, busy, calm, calm, busy])
    assert scale.reference.tolist() == calm and scale.events == []
    levels = [busy, busy, busy, calm, calm, busy, calm, calm, *[load] * 5, calm]
    assert [e[:2] for e in calibrated(levels).events] == [("scale_loaded", 9), ("scale_cycle_complete", 13)]
    # a source that comes back while the scale is loaded: a new reference, in which the load is nothing
    back = calibrated([*levels[:10], load, *[load] * 6, *[load] * 8], resets=[10])
    assert [e[:2] for e in back.events] == [("scale_loaded", 9), ("stream_reconnected", 10)]
    assert back.reference.tolist() == load and back.state == "empty"


def test_scale_falls_back_to_gray():
    assert calibrated([[1.0, 2.0], [1.0, 2.0], None, [130.0, 126.0]]).reference.tolist() == [128.0]
    some = calibrated([[1.0, 2.0], [1.0, 2.0], [5.0, 5.0], None, None, [5.0, 5.0]])
    assert some.reference.tolist() == [5.0, 5.0] and some.state == "empty"


def test_scale_reference_follows_when_idle():
    scale = calibrated([*[[10.0, 10.0]] * 7, *[[12.0, 12.0]] * 30], idle_rows=5, blend=0.5)
    assert 11.9 < scale.reference[0] <= 12.0


def test_day_of_segments(spark):
    rows = spark.createDataFrame([(1, g, f) for g, n in ((0, 10), (2, 5)) for f in range(n)], "k long, g long, frame long")
    cuts = spark.createDataFrame([(1, 0, 3, "high"), (1, 0, 8, "low"), (1, 2, 1, "medium")], "k long, g long, frame long, confidence string")
    marks = spark.createDataFrame([(1, 0, 2, "start"), (1, 0, 4, "end"), (1, 0, 9, "start"), (1, 2, 1, "start"), (1, 2, 3, "end")], "k long, g long, frame long, kind string")
    parts = fullday.segments(rows, cuts, K, "g", 1.0)
    assert sorted(map(tuple, parts.collect())) == [(1, 0, 10, 0, 2, 0.0, 10.0), (1, 2, 5, 10, 1, 10.0, 5.0)]
    placed = [fullday.on_the_day(x, parts, K, "g", 1.0) for x in (cuts, marks)]
    assert sorted(r["frame"] for r in placed[0].collect()) == [3, 8, 11]
    (day,) = fullday.summary(*placed, parts, K, 1.0, first=8).collect()
    # the start that its segment left open stands alone, and shifts the pairs after it
    assert tuple(day) == (1, 2, 15, 3, 2, 1, 1, 1, 2, 13, 3 / 13 * 60, 4.0)
    picked = fullday.sampled(rows, K, "g", 2, 3).select("g", "frame").collect()
    assert sorted(map(tuple, picked)) == [(0, 0), (0, 6), (2, 2)]


def test_marks_of_one_frame_pair_as_in_the_sql(spark):
    """A break that begins at the frame where another ended: the start comes first, so neither pair is a start and an end."""
    parts = spark.createDataFrame([(1, 0, 20)], "k long, g long, frames long")
    marks = spark.createDataFrame([(1, 2, "start"), (1, 5, "end"), (1, 5, "start"), (1, 9, "end")], "k long, frame long, kind string")
    cuts = spark.createDataFrame([], "k long, frame long, time_sec double, confidence string")
    (day,) = fullday.summary(cuts, marks, parts, K, 1.0).collect()
    assert (day["break_time"], day["active_time"]) == (0, 20)
