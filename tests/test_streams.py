"""Streams that stop and go on, rows that come late, sources that come back: against the batch forms and plain machines."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from signalwright.operators import detectors
from signalwright.sources import scratch
from signalwright.streaming import stream

HOUR = 3_600_000


def put(spark, folder, rows, schema):
    """One more file of the source."""
    spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_micros(F.col("frame") * 40_000 + 1_700_000_000_000_000)).coalesce(1).write.mode("append").parquet(str(folder))


def source(spark, folder, schema):
    return spark.readStream.schema(f"{schema}, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))


CUTS = "k long, frame long, level double, left double, motion double, spread double, control string"
CONFIG = detectors.CutConfig(long_width=5, short_width=3, min_gap=5, break_level=94.0, break_hold=3, break_exit=2, break_offset=20.0, baseline_least=10, baseline_rows=40, second_region=True)


def cut_rows(seed, k, start, stop):
    rng = random.Random(seed)
    return [(k, f, rng.randrange(16_000) / 128, rng.randrange(16_000) / 128, rng.randrange(1000) / 100, float(rng.randrange(30, 150)), None) for f in range(start, stop)]


def of_machine(rows, closed):
    machine = stream.StreamedCuts(CONFIG)
    for r in rows:
        machine.feed(*r[1:])
    if closed:
        machine.close()
    return {(rows[0][0], *e) for e in machine.events}


def test_streamed_machine_is_the_batch_detector(spark):
    rows = [r for k in (1, 2) for r in cut_rows(k, k, 0, 150)]
    x = detectors.prepare(spark.createDataFrame(rows, CUTS), ["k"], "frame", "level", "left", CONFIG)
    want = {tuple(r) for r in detectors.detect_cuts(x, ["k"], CONFIG).drop("confidence").collect()}
    assert of_machine(rows[:150], True) | of_machine(rows[150:], True) == want and len(want) > 30


def test_cuts_stop_and_go_on(spark, tmp_path):
    """Two files, then the query ends; a third and the closing row are found by a second query of the same folder."""
    rows = {k: cut_rows(k, k, 0, 150) for k in (1, 2)}
    rows[1][100] = (*rows[1][100][:6], stream.RESET)
    for lo, hi in ((0, 40), (40, 90)):
        put(spark, tmp_path / "in", [r for k in (1, 2) for r in rows[k][lo:hi][::-1]], CUTS)

    def run():
        cuts = stream.stream_cuts(source(spark, tmp_path / "in", CUTS), "k", "at", CONFIG, "1 second", HOUR)
        return stream.drain(cuts, "cuts", folder=f"file://{tmp_path}/out").collect()

    first = run()
    assert {tuple(r) for r in first} == of_machine(rows[1][:90], False) | of_machine(rows[2][:90], False)
    assert sorted(map(tuple, run()), key=repr) == sorted(map(tuple, first), key=repr)  # nothing new: nothing twice
    put(spark, tmp_path / "in", [r for k in (1, 2) for r in rows[k][90:]], CUTS)
    end = spark.createDataFrame([(-1, 0, 0.0, 0.0, 0.0, 0.0, stream.CLOSED)], CUTS).withColumn("at", F.lit(stream.FAR).cast("timestamp"))
    run()
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run()
    want = of_machine(rows[1], True) | of_machine(rows[2], True)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(e[1] == stream.RESET for e in want)


SCALE = "k long, frame long, brightness double, patch array<double>, control string"


def test_scale_reconnects_between_batches(spark, tmp_path):
    c = detectors.ScaleConfig(smooth=2, hold=2, min_on=3, min_gap=5, max_loaded=20, settle=1, gather=3, calmest=2, on=20.0, off=10.0)
    rng = random.Random(5)
    level = [rng.choice([0.0, 0.0, 60.0]) for _ in range(40)]
    rows = [(7, f, 100.0, [level[f // 4], level[f // 4] + rng.randrange(4)], stream.RESET if f in (45, 110) else None) for f in range(160)]
    for lo, hi in ((0, 46), (46, 100), (100, 160)):
        put(spark, tmp_path / "in", rows[lo:hi], SCALE)
    got = stream.drain(stream.stream_scale(source(spark, tmp_path / "in", SCALE), "k", "at", c, "1 second", HOUR), "scale").collect()
    machine = detectors._Feed(None, c)
    for r in rows:
        machine.feed(*r[1:])
    assert [tuple(r)[1:] for r in sorted(got, key=lambda r: r["frame"])] == sorted(machine.events, key=lambda e: e[1])
    batch = detectors.detect_scale(spark.createDataFrame(rows, SCALE), ["k"], c, control="control").collect()
    assert {tuple(r) for r in got} <= {tuple(r) for r in batch} and sum(r["kind"] == stream.RESET for r in got) == 2


def test_late_rows_and_idle_streams(spark, tmp_path):
    """A row before the last one fed is told as late; a key that is idle for long is over and begins anew."""
    schema = "user_id long, frame long, event_id long, value double, event_type string"
    for rows in ([(1, 10), (1, 20)], [(1, 15), (1, 30)], [(2, 5_000_000)], [(2, 5_000_100)], [(1, 9_000_000)], [(1, 9_000_001)]):
        put(spark, tmp_path / "in", [(u, f, f, 200.0, "view") for u, f in rows], schema)
    own = stream.latch_edges(source(spark, tmp_path / "in", schema), 100, 15, 2, "1 hour", 10 * HOUR)
    got = sorted((r["user_id"], r["edge"], r["event_id"]) for r in stream.drain(own, "latch").collect())
    # user 1 rose at 20, its state went with the watermark, and it rises again
    assert got == [(1, "late", 15), (1, "rise", 20), (1, "rise", 9_000_001), (2, "rise", 5_000_100)]


def test_reset_clears_the_latch(spark, tmp_path):
    schema = "user_id long, frame long, event_id long, value double, event_type string"
    rows = [(1, f, f, v, stream.RESET if v < 0 else "view") for f, v in enumerate([200.0, 200.0, -1.0, 200.0, 200.0, 5.0])]
    put(spark, tmp_path / "in", rows[:3], schema)
    put(spark, tmp_path / "in", rows[3:], schema)
    got = stream.drain(stream.latch_edges(source(spark, tmp_path / "in", schema), 100, 15, 2), "latch").collect()
    assert {(r["edge"], r["event_id"]) for r in got} == {("rise", 1), ("rise", 4), ("fall", 5)}


def test_classification_waits_for_the_watermark(spark, tmp_path):
    """A cycle without a partner comes out only when none can come any more."""
    schema = "user_id long, frame long, side string"
    minute = 1500  # frames
    put(spark, tmp_path / "in", [(1, 0, "c"), (1, 10 * minute, "c"), (2, 0, "c"), (1, minute, "s")], schema)

    def run():
        rows = source(spark, tmp_path / "in", schema)
        c, s = rows.where("side IN ('c', 'x')").select("user_id", "frame", F.col("at").alias("a")), rows.where("side IN ('s', 'x')").select("user_id", F.col("at").alias("b"))
        judged = stream.classify(c, s, "user_id", "a", "b", "-1 minutes", "5 minutes", "1 minute")
        return sorted((r["user_id"], r["frame"], r["verdict"]) for r in stream.drain(judged, "judged", folder=f"file://{tmp_path}/out").collect() if r["user_id"] > 0)

    assert run() == [(1, 0, "accepted")]
    put(spark, tmp_path / "in", [(1, 13 * minute, "s")], schema)
    put(spark, tmp_path / "in", [(-1, 14 * minute, "x")], schema)
    run()
    put(spark, tmp_path / "in", [(-1, 60 * minute, "x")], schema)
    put(spark, tmp_path / "in", [(-1, 61 * minute, "x")], schema)
    assert run() == [(1, 0, "accepted"), (1, 10 * minute, "accepted"), (2, 0, "rejected")]


def test_complete_mode_reads_the_last_batch(spark, tmp_path):
    schema = "user_id long, frame long"
    for rows in ([(1, 0), (2, 0)], [(1, 5)]):
        put(spark, tmp_path / "in", rows, schema)
    counts = source(spark, tmp_path / "in", schema).groupBy("user_id").count()
    assert sorted(map(tuple, stream.drain(counts, "counts", "complete").collect())) == [(1, 2), (2, 1)]


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master, _jsc = "spark://host:7077", spark.sparkContext._jsc

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        with pytest.raises(ValueError):
            scratch.shared_dir(Session())


def test_keys_of_one_bucket_end_each_at_their_time(spark, tmp_path, monkeypatch):
    """All keys in one bucket: each closes when the watermark has passed it, the others go on, and Spark keeps one state for them all."""
    monkeypatch.setattr(stream, "BUCKETS", 1)
    schema = "k long, frame long, level double, left double, motion double, spread double, control string"
    hour = 90_000  # frames
    rows = {k: cut_rows(k, k, 0, 60) for k in range(40)}
    for f in (0, 30):
        put(spark, tmp_path / "in", [r for k in rows for r in rows[k][f : f + 30]], schema)
    more = [(0, hour // 2 + f, *r[2:]) for f, r in enumerate(cut_rows(99, 0, 0, 40))]
    put(spark, tmp_path / "in", more, schema)
    # an hour and a bit after the first rows: all but key 0 are over
    put(spark, tmp_path / "in", [(77, hour + hour // 4, 0.0, 0.0, 0.0, 99.0, None)], schema)
    put(spark, tmp_path / "in", [(77, hour + hour // 4 + 1, 0.0, 0.0, 0.0, 99.0, None)], schema)
    got = stream.drain(stream.stream_cuts(source(spark, tmp_path / "in", schema), "k", "at", CONFIG, "1 second", HOUR), "cuts", folder=f"file://{tmp_path}/out")
    want = of_machine(rows[0] + more, False).union(*(of_machine(rows[k], True) for k in rows if k))
    assert {tuple(r) for r in got.collect()} == want and any(e[-1] for e in want)
    states = spark.read.format("statestore").load(f"file://{tmp_path}/out/state").count()
    assert states == 1
