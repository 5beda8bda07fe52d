"""Boundary cases of the signal operators on short sequences, and the state machines against plain loops."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalwright.functions import labels
from signalwright.operators import arrays, detectors, events, refractory, report, runs, signals
from signalwright.sources import readers
from signalwright.streaming import stream

K, FT = ["k"], ["f"]


def seq(spark, *series):
    return spark.createDataFrame([(k, f, float(v)) for k, s in enumerate(series) for f, v in enumerate(s)], "k long, f long, v double")


def column(df, name, key=0):
    return [r[name] for r in df.where(F.col("k") == key).orderBy("f").collect()]


def loop_latch(values, on, off, hold):
    out, run, state = [], 0, 0
    for v in values:
        run = run + 1 if v > on else 0
        state = 1 if run >= hold else 0 if v < off else state
        out.append(state)
    return out


def test_rolling_and_lag_at_the_start(spark):
    x = seq(spark, [1, 2, 3, 4, 5], [9])
    m = signals.rolling_mean(x, K, FT, "v", 3, "m")
    assert column(m, "m") == [1, 1.5, 2, 3, 4] and column(m, "m", 1) == [9]
    assert column(signals.lagged_difference(x, K, FT, "v", 3, "d"), "d") == [0, 0, 2, 2, 2]
    assert column(signals.rolling_median(x, K, FT, "v", 4, "m"), "m") == [1, 1.5, 2, 2.5, 3.5]


@pytest.mark.parametrize("hold", [1, 2, 3, 5])
def test_hysteresis_is_the_state_machine(spark, hold):
    rng = random.Random(hold)
    values = [[rng.choice([0, 15, 20, 25, 26, 40]) for _ in range(80)] for _ in range(4)]
    got = runs.hysteresis(seq(spark, *values), K, FT, "v", 25, 15, hold, "s")
    for k, own in enumerate(values):
        assert column(got, "s", k) == loop_latch(own, 25, 15, hold)


def test_break_latch_resets_on_equality(spark):
    x = seq(spark, [5, 5, 4, 5, 5, 5, 3, 4, 3, 3, 9, 9, 9])
    assert column(runs.break_latch(x, K, FT, "v", 4, 3, 2, "s"), "s") == [0, 0, 0, 0, 0, 1, 1, 1, 1, 0, 0, 0, 1]


def test_run_length_and_islands(spark):
    x = seq(spark, [1, 1, 0, 1, 1, 1, 0, 0, 1])
    assert column(runs.run_length(x, K, FT, F.col("v") > 0, "r"), "r") == [1, 2, 0, 1, 2, 3, 0, 0, 1]
    assert column(runs.islands(x, K, FT, "v", "i"), "i") == [1, 1, 2, 3, 3, 3, 4, 4, 5]


def loop_spaced(ts, gap):
    kept = []
    for t in ts:
        if not kept or t - kept[-1] >= gap:
            kept.append(t)
    return kept


def loop_merge(own, within, strong):
    kept = []
    for t, p in own:
        if kept and t - kept[-1][0] <= within and max(p, kept[-1][1]) > strong:
            if p > kept[-1][1]:
                kept[-1] = (t, p)
        else:
            kept.append((t, p))
    return kept


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


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9)), min_size=1, max_size=25, unique_by=lambda x: x[0]), st.lists(st.integers(0, 60), max_size=15, unique=True))
def test_folds(spark, own, found):
    own.sort()
    x = spark.createDataFrame([(0, t, p) for t, p in own], "k long, t long, p long")
    assert sorted(r["t"] for r in refractory.keep_spaced(x, K, "t", 7).collect()) == loop_spaced([t for t, _ in own], 7)
    assert sorted((r["t"], r["p"]) for r in refractory.merge_close(x, K, "t", "p", 5, 4).collect()) == loop_merge(own, 5, 4)
    y = spark.createDataFrame([(0, t) for t in found], "k long, t long")
    got = refractory.greedy_match(x.select("k", "t"), y, K, "t", 5).collect()
    assert sorted((r["label"], r["detection"]) for r in got) == loop_match([t for t, _ in own], found, 5)


def test_min_gap_at_the_limit(spark):
    x = spark.createDataFrame([(0, t) for t in (0, 50, 99, 100, 149, 150)], "k long, t long")
    assert sorted(r["t"] for r in refractory.keep_spaced(x, K, "t", 50).collect()) == [0, 50, 100, 150]


def test_echo_of_an_echo(spark):
    x = spark.createDataFrame([(0, 0, 100), (0, 5, 50), (0, 10, 25), (0, 11, 60), (0, 30, 60)], "k long, t long, p long")
    kept = events.drop_echoes(x, K, "t", "p", 10, F.lit(0.6))
    assert sorted(r["t"] for r in kept.collect()) == [0, 11, 30]
    audit = {r["t"]: r["preceding"] for r in events.echo_audit(x, K, "t", "p", 10, F.lit(0.6)).collect()}
    assert audit == {5: 0, 10: 5}


def test_intervals_and_nearest(spark):
    left = spark.createDataFrame([(0, 100), (0, 200), (0, 300), (1, 100)], "k long, t long")
    right = spark.createDataFrame([(0, 98), (0, 110), (0, 189), (0, 311), (0, 104), (0, 96)], "k long, u long")
    semi = events.with_partner(left, right, K, "t", "u", -2, 10)
    assert sorted((r["k"], r["t"]) for r in semi.collect()) == [(0, 100)]
    assert events.without_partner(left, right, K, "t", "u", -2, 10).count() == 3
    got = {(r["k"], r["t"]): r["u"] for r in events.nearest(left, right, K, "t", "u", -4, 11).collect()}
    assert got == {(0, 100): 98, (0, 200): None, (0, 300): 311, (1, 100): None}


@pytest.mark.parametrize("low,high", [(-4, 11), (3, 8), (-9, -2), (0, 0)])
def test_partners_are_those_of_all_pairs(spark, low, high):
    """Nulls, repeated rows and ties on both sides."""
    rng = random.Random(low)
    left = [(k, rng.randrange(60), rng.choice([None, "x"])) for k in (0, 1) for _ in range(30)]
    left += [left[3], (0, None, "y"), (2, 5, None)]
    right = [(k, rng.randrange(60)) for k in (0, 1) for _ in range(12)]
    right += [right[0], (1, None)]
    x, y = spark.createDataFrame(left, "k long, t long, note string"), spark.createDataFrame(right, "k long, u long")
    want = []
    for k, t, note in left:
        near = [u for j, u in right if j == k and None not in (t, u) and low <= u - t <= high]
        want.append((k, t, note, min(near, key=lambda u: (abs(u - t), u), default=None)))
    assert sorted(map(tuple, events.nearest(x, y, K, "t", "u", low, high).collect()), key=repr) == sorted(want, key=repr)
    assert sorted((tuple(r) for r in events.with_partner(x, y, K, "t", "u", low, high).collect()), key=repr) == sorted((r[:3] for r in want if r[3] is not None), key=repr)
    assert sorted((tuple(r) for r in events.without_partner(x, y, K, "t", "u", low, high).collect()), key=repr) == sorted((r[:3] for r in want if r[3] is None), key=repr)
    wide = y.withColumn("w", F.col("u") * 2)
    assert all(r["w"] == (None if r["u"] is None else 2 * r["u"]) for r in events.nearest(x, wide, K, "t", "u", low, high, ["w"]).collect())


def test_echoes_with_ties_nulls_and_repeated_rows(spark):
    rng = random.Random(4)
    own = [(0, i, rng.randrange(40), rng.choice([None, 5, 10, 20, 40])) for i in range(60)]
    x = spark.createDataFrame(own, "k long, i long, t long, p long")
    want = {}
    for _, i, t, p in own:
        before = [(u, q) for _, j, u, q in own if (u, j) < (t, i) and t - u <= 6 and None not in (p, q) and p < 0.6 * q]
        want[i] = max(before) if before else None
    kept = {r["i"] for r in events.drop_echoes(x, K, "t", "p", 6, F.lit(0.6), ["i"]).collect()}
    assert kept == {i for i, w in want.items() if w is None}
    audit = {r["i"]: (r["preceding"], r["preceding_strength"]) for r in events.echo_audit(x, K, "t", "p", 6, F.lit(0.6), ["i"]).collect()}
    assert {i: a[0] for i, a in audit.items()} == {i: w[0] for i, w in want.items() if w is not None}
    twice = x.unionByName(x)
    assert events.echo_audit(twice, K, "t", "p", 6, F.lit(0.6), ["i"]).count() >= 2 * len(audit)


def test_extras_of_repeated_times(spark):
    own, found = [(0, 10), (0, 30)], [(0, 11), (0, 11), (0, 29), (0, 50)]
    got = refractory.extras(spark.createDataFrame(own, "k long, t long"), spark.createDataFrame(found, "k long, t long"), K, "t", 5).collect()
    assert sorted(r["t"] for r in got) == [11, 50]


def test_breaks_with_an_open_end(spark):
    marks = spark.createDataFrame([(0, 5, "start"), (0, 9, "end"), (0, 20, "start")], "k long, t long, e string")
    pairs = events.pair_breaks(marks, K, "t", "e")
    ends = spark.createDataFrame([(0, 30, 25)], "k long, duration long, last_event long")
    for policy, want in (("duration", 14), ("last_event", 9), ("drop", 4)):
        assert events.break_time(pairs, ends, K, policy).first()["break_time"] == want


def test_stitching_with_an_empty_segment(spark):
    segments = spark.createDataFrame([(0, 0, 10), (0, 1, 20), (0, 2, 5)], "k long, s long, d long")
    own = spark.createDataFrame([(0, 0, 3), (0, 2, 4)], "k long, s long, t long")
    assert sorted(r["day_at"] for r in events.stitch(segments, own, K, "s", "d", "t").collect()) == [3, 34]


def test_sampling(spark):
    x = seq(spark, range(10), range(4))
    assert column(report.sample(x, K, FT, 5), "f") == [0, 2, 4, 6, 8] and column(report.sample(x, K, FT, 5), "f", 1) == [0, 1, 2, 3]
    assert column(report.sample(x, K, FT, 4, keep_last=True), "f") == [0, 3, 6, 9] and column(report.sample(x, K, FT, 3, keep_last=True), "f") == [0, 4, 8, 9]


def test_confidence_limits(spark):
    def of(*v):
        return spark.range(1).select(signals.confidence(*(F.lit(x) for x in v)).alias("c")).first()["c"]

    assert of(40.0, 5, 8.0, 6.0, 89.0, False) == "high" and of(30.0, 2, 4.0, 0.0, 90.0, False) == "medium"
    assert of(30.0, 2, 4.0, 0.0, 90.0, True) == "low" and of(21.9, 2, 4.9, 0.0, 90.0, False) == "low"


def test_labels(spark):
    row = spark.range(1).select(labels.clock(F.lit(754.9)).alias("a"), labels.camera_of(F.lit("/x/ch9/NVR_CH21_a.mp4"), ["ch21"]).alias("b"), labels.camera_of(F.lit("NVR.mp4"), ["ch21"]).alias("c")).first()
    assert tuple(row) == ("12:34", "ch21", None)
    for seconds, want in ((0, "0.0 min"), (59, "1.0 min"), (93, "1.6 min"), (3599, "60.0 min"), (3600, "1.0 hrs"), (27_360, "7.6 hrs")):
        assert spark.range(1).select(labels.duration_label(F.lit(seconds))).first()[0] == want


def test_patches(spark):
    x = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [2.0, 0.0, 3.0, 6.0])], "a array<double>, b array<double>")
    up, down = arrays.signed_parts(F.col("a"), F.col("b"))
    r = x.select(arrays.mean(F.col("a")), arrays.deviation(F.col("a"), arrays.mean(F.col("a"))), arrays.mean_difference(F.col("a"), F.col("b")), arrays.crop(F.col("a"), 2, 1, 0, 2, 2), up, down).first()
    assert r[0] == 2.5 and abs(r[1] - np.std([1, 2, 3, 4])) < 1e-12 and r[2] == 1.25 and r[3] == [2, 4]
    assert r[4] == [0.5, 0, 0, 1] and r[5] == [0, 1, 0, 0]


def test_cut_machine():
    c = detectors.CutConfig(min_gap=10)
    def rows(spec):
        return [(f, 100.0, d, 0.0, 0.0, 6.0, 50.0) for f, d in enumerate(spec)]

    # one weak row isn't confirmed; two are; one strong row is; a spike too close to the last is told and dropped; the last stays open
    spec = [0, 20, 0, 20, 20, 20, 0, 0, 35, 0] + [0] * 10 + [35, 0, 31, 0] + [0] * 8 + [40]
    got = [(r[0], r[1], r[2], r[8], r[9]) for r in detectors.run_cuts(rows(spec), c)]
    assert got == [("cut", 4, 20, 1, False), ("dropped_min_gap", 8, 35, 0, False), ("cut", 20, 35, 0, False), ("dropped_min_gap", 22, 31, 0, False), ("cut", 32, 40, 0, True)]


def test_break_watch_follows_the_median():
    c = detectors.CutConfig(break_offset=50, baseline_least=3, break_hold=2, break_exit=2, break_level=235)
    watch = detectors.BreakWatch(c)
    for f, x in enumerate([180, 190, 200, 190]):
        assert watch.feed(f, x, False) is None
    assert watch.level() == max(statistics.median([180, 190, 200, 190]) + 50, 215)
    assert watch.feed(4, 250, True) is None and watch.feed(5, 250, True) == ("break_start", 3)
    assert watch.feed(6, 100, False) is None and watch.feed(7, 100, False) == ("break_end", 7)


def scale_events(levels, light=None, gap=5):
    c = detectors.ScaleConfig(smooth=1, hold=2, min_on=3, min_gap=gap, max_loaded=20)
    scale = detectors.Scale(np.zeros(1), c)
    for f, x in enumerate(levels):
        scale.feed(f, (light or {}).get(f, 100.0), np.array([float(x)]))
    scale.close(len(levels))
    return [(k, f, d, r) for k, f, d, r in scale.events]


def test_scale_cycles():
    assert scale_events([0, 0, 30, 30, 30, 30, 30, 10, 0]) == [("scale_loaded", 3, None, None), ("scale_cycle_complete", 7, 4, None)]
    assert scale_events([0, 0, 30, 30, 30, 10])[-1] == ("scale_false_trigger", 5, 2, "too_brief")
    twice = [0, 0, *[30] * 6, 0, *[30] * 4, 0]
    assert scale_events(twice)[-1] == ("scale_cycle_complete", 13, 3, None) and scale_events(twice, gap=6)[-1] == ("scale_false_trigger", 13, 3, "too_close")
    assert scale_events([0, 0, *[30] * 6, 20, 20])[-1] == ("scale_cycle_complete", 10, 7, None)


def test_scale_drift_and_light():
    drift = scale_events([0, 0, *[30] * 30])
    assert ("scale_cycle_complete", 24, 20, None) in drift
    lights = scale_events([0] * 8, {3: 200.0, 4: 200.0, 5: 102.0})
    assert [(k, f) for k, f, _, _ in lights] == [("lighting_change", 3), ("lighting_restored", 5)]


def test_table_cycles(spark):
    values = [0, 9, 9, 9, 9, 0, 0, 9, 9, 9, 0, 0, 0, 0, 9, 9, 0, 9, 9, 9, 9]
    got = detectors.table_cycles(seq(spark, values), K, "f", "v", level=5, hold=2, least=4, gap=5, fps=1).collect()
    assert [(r["f"], r["duration"], r["peak"]) for r in got] == [(5, 5, 9.0), (10, 4, 9.0)]


def test_files_and_frames(spark, tmp_path):
    for name in ("NVR_b.bin", "NVR_a.bin", "x.txt"):
        (tmp_path / name).write_bytes(b"1")
    got = readers.segment_files(spark, str(tmp_path), "NVR_*").orderBy("segment").collect()
    assert [r["path"].rsplit("/", 1)[-1] for r in got] == ["NVR_a.bin", "NVR_b.bin"]
    (tmp_path / "d.json").write_text('{"video": "v",\n "events": [{"type": "cut", "frame": 3}, {"type": "break_start", "time_sec": 1.5}]}')
    rows = readers.event_documents(spark, str(tmp_path / "d.json")).collect()
    assert {(r["type"], r["frame"], r["time_sec"]) for r in rows} == {("cut", 3, None), ("break_start", None, 1.5)}
    frames = seq(spark, range(10), range(4)).withColumn("rate", F.when(F.col("k") == 0, 5.0).otherwise(0.0))
    meta = {r["k"]: (r["frames"], r["fps"], r["duration"]) for r in readers.source_metadata(frames, K, F.col("rate")).collect()}
    assert meta == {0: (10, 5.0, 2.0), 1: (4, 25.0, 0.16)}
    readers.write_document(frames.select("k", "f"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 14
    assert readers.render(spark.range(2), "<{{DATA}}>") == '<[{"id":0},{"id":1}]>'


def test_latch_goes_on_between_batches(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", 1, "view", float(v), "") for i, v in enumerate([0, 200, 200, 200, 50, 5, 200])]
    own = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for n, (lo, hi) in enumerate(((0, 2), (2, 4), (4, 7))):
        own.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "all" / f"events{n}.parquet"))
    source = spark.readStream.schema(stream.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "all"))
    got = stream.drain(stream.latch_edges(source, 100, 15, 2), "micro", "append").collect()
    assert {(r["event_id"], r["edge"]) for r in got} == {(2, "rise"), (5, "fall")}


@pytest.mark.parametrize("batch", [3, 10000])
def test_machines_go_on_between_batches(spark, batch):
    """Two keys and a null one, in batches smaller and larger than a stream: as one machine for each."""
    rng = random.Random(9)
    c = detectors.CutConfig(long_width=5, short_width=3, min_gap=5, break_level=94.0, break_hold=3, break_exit=2)
    own = [(k, f, rng.uniform(0, 130), *(rng.choice([0.0, 0.0, 12.0, 40.0]) for _ in range(3)), rng.uniform(0, 10), 80.0) for k in (None, 1, 2) for f in range(120)]
    want = {(k, *e) for k in (None, 1, 2) for e in detectors.run_cuts([r[1:] for r in own if r[0] == k], c)}
    shuffled = rng.sample(own, len(own))
    x = spark.createDataFrame(shuffled, "k long, frame long, smoothed double, d_long double, d_short double, d_left double, motion double, spread double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = detectors.detect_cuts(x, K, c).drop("confidence").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 30
    assert detectors.detect_cuts(x.limit(0), K, c).count() == 0


@pytest.mark.parametrize("batch", [2, 10000])
def test_spacing_and_merging_go_on_between_batches(spark, batch):
    """Ties, a null key, null times and strengths, an extra column; batches smaller and larger than a stream."""
    rng = random.Random(11)
    own = [(k, rng.randrange(90), i, rng.choice([10.0, 20.0, 40.0, 50.0, None]), rng.choice([None, "x"])) for k in (None, 1, 2) for i in range(40)]
    own += [(1, None, 99, 20.0, None)]
    spaced, merged = [], []
    for k in (None, 1, 2):
        last, kept = None, []
        for r in sorted((r for r in own if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            if r[1] is None or last is None or r[1] - last >= 7:
                spaced.append(r)
                last = last if r[1] is None else r[1]
            top = kept[-1] if kept else None
            if top and None not in (r[1], r[3], top[1], top[3]) and r[1] - top[1] <= 3 and max(r[3], top[3]) > 30:
                kept[-1] = r if r[3] > top[3] else top
            else:
                kept.append(r)
        merged += kept
    x = spark.createDataFrame(rng.sample(own, len(own)), "k long, t long, i long, p double, note string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert sorted(map(repr, map(tuple, refractory.keep_spaced(x, K, "t", 7, ["i"]).collect()))) == sorted(map(repr, spaced))
        assert sorted(map(repr, map(tuple, refractory.merge_close(x, K, "t", "p", 3, 30.0, ["i"]).collect()))) == sorted(map(repr, merged))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert refractory.merge_close(x.limit(0), K, "t", "p", 3, 30.0).count() == 0
