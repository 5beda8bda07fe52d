"""Profiles, features, sweeps, heatmaps, run tables and result documents on small cases."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from signalwright.operators import arrays, diagnosis
from signalwright.sources import readers

K = ["k"]


def test_profile_and_features(spark):
    """Five frames a second, so each step of the grid is a frame; an event at 12 s, one near the start without a reference but frame 0."""
    texture = [float(60 + (f % 7) * 5) for f in range(100)]
    frames = spark.createDataFrame([(0, f, t, [t, 2 * t]) for f, t in enumerate(texture) if f != 55], "k long, frame long, texture double, patch array<double>")
    events = spark.createDataFrame([(0, 120), (0, 10)], "k long, at long")
    prof = diagnosis.profile(events, frames, K, "at", 5.0)
    rows = {(r["at"], r["offset"]): (r["texture"], r["scale_diff"]) for r in prof.collect()}
    for at in (120, 10):
        ref = texture[max(0, at - 100) // 2]
        for o in range(-60, 31, 2):
            f = (at + o) // 2
            if 0 <= f < 100 and f != 55:
                assert rows.pop((at, o)) == (texture[f], abs(texture[f] - ref) * 1.5)
    assert rows == {}
    (r,) = diagnosis.features(prof.where("at = 120"), ["k", "at"]).collect()
    own = [texture[f] for f in range(30, 76) if f != 55]
    above = [t > 75 for t in own]
    assert (r["above"], r["peak"], r["final"], r["slope"]) == (2 * sum(above), max(own), texture[60], texture[60] - texture[50])
    assert r["segments"] == sum(a and not b for a, b in zip(above, [False, *above], strict=False))
    assert diagnosis.features(prof.limit(0), ["k", "at"]).count() == 0


def test_profiles_as_by_joins(spark):
    """Frames that are missing or repeat, null textures and patches, odd rates: as joins of each point of the grid would have it."""
    rng = random.Random(3)
    rows = [(k, f, rng.choice([None, *map(float, range(60, 90))]), rng.choice([None, [float(rng.randrange(9)), 1.0]])) for k in (0, 1, None) for f in range(60) for _ in range(rng.choice([0, 1, 1, 1, 1, 2]))]
    events = [(k, at) for k in (0, 1, None, 5) for at in (0, 3, 47, 110, 235, 400)]
    frames = spark.createDataFrame(rows, "k long, frame long, texture double, patch array<double>").repartition(3)
    got = diagnosis.profile(spark.createDataFrame(events, "k long, at long"), frames, K, "at", 2.5)
    place = lambda t: int(t * 0.25 // 1)
    want = []
    for k, at in events:
        own = [r for r in rows if k is not None and r[0] == k]
        for empty in [r[3] for r in own if r[1] == place(max(at - 100, 0)) and r[3] is not None] or [None]:
            for o in range(-60, 31, 2):
                for r in own:
                    if r[1] == place(at + o):
                        want.append((k, at, o, r[2], 0.0 if empty is None or r[3] is None else (abs(r[3][0] - empty[0]) + abs(r[3][1] - empty[1])) / 2))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 300


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_no_point_of_the_grid_travels(spark):
    """One exchange brings events and frames together; features need none."""
    frames = spark.createDataFrame([(0, f, float(f), [1.0]) for f in range(9)], "k long, frame long, texture double, patch array<double>")
    events = spark.createDataFrame([(0, 20)], "k long, at long")
    assert shuffles(diagnosis.features_of(diagnosis.profiles(events, frames, K, "at", 2.5), ["k", "at"])) == 1


def test_sweeps_count_each_row_once(spark):
    rng = random.Random(1)
    rows = [(f, rng.choice([None, 1.0, 2.0, 2.5, 3.0, 9.0]), rng.choice("pqz")) for f in ("a", "b") for _ in range(200)]
    cuts = {"a": [2.0, 3.0, 100.0], "b": [0.0, 2.5], "c": [1.0]}
    got = {(r["feature"], r["cut"]): tuple(r)[2:] for r in diagnosis.sweeps(spark.createDataFrame(rows, "feature string, value double, label string"), cuts, F.col("label") == "p", F.col("label") == "q").collect()}
    for f, own in cuts.items():
        for c in own:
            mine = [(v, x) for g, v, x in rows if g == f and v is not None]
            assert got.pop((f, c)) == (sum(v >= c and x == "p" for v, x in mine), sum(v < c and x == "q" for v, x in mine), sum(x == "p" for _, x in mine), sum(x == "q" for _, x in mine))
    assert got == {}


def test_images_are_added_up_by_task(spark, monkeypatch):
    """Groups beyond what a task holds, images of different sizes, null samples and images, a null group."""
    monkeypatch.setattr(arrays, "GROUPS", 3)
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(9)]), rng.choice([None, [rng.choice([None, 1.0, 2.0, 5.0]) for _ in range(rng.choice([2, 4]))]])) for _ in range(300)]
    x = spark.createDataFrame(rows, "k long, p array<double>").repartition(5)
    got = {(r["k"], r["pos"]): (r["total"], r["n"], r["images"]) for r in arrays.elementwise_sums(x, K, "p").collect()}
    for k in (None, *range(9)):
        own = [p for j, p in rows if j == k and p is not None]
        for pos in range(max(map(len, own))):
            there = [p[pos] for p in own if pos < len(p) and p[pos] is not None]
            total, n, _ = got.pop((k, pos))
            assert (total, n) == (sum(there), len(there))
    assert got == {}
    assert arrays.elementwise_sums(x.limit(0), K, "p").count() == 0
    whole = arrays.elementwise_sums(x, [], "p").where("pos = 0").first()
    assert whole["total"] == sum(p[0] for _, p in rows if p and p[0] is not None)


def test_difference_heatmap(spark):
    frames = spark.createDataFrame([(0, f, [float(f), float(f * f)]) for f in range(10) if f != 6], "k long, f long, p array<double>")
    times = spark.createDataFrame([(0, 1), (0, 3), (0, 5), (0, 9)], "k long, at long")
    got = {r["pos"]: (r["mean"], r["usable"]) for r in arrays.difference_heatmap(times, frames, K, "at", "f", "p", -1, 2).collect()}
    # 1: 0 to 3, 3: 2 to 5, 5: 4 to 7; 9 has no frame 11
    assert got == {0: (3.0, 3), 1: (float(np.mean([9, 21, 33])), 3)}


def test_ranges_shares_and_tables(spark):
    x = spark.createDataFrame([(t,) for t in (0, 10, 11, 20, 25, 26)], "t long")
    assert sorted(r["t"] for r in x.where(diagnosis.in_ranges(F.col("t"), [(0, 10), (20, 25)])).collect()) == [0, 10, 20, 25]
    records = spark.createDataFrame([("a", 3, 8), ("b", None, 4)], "run string, hits long, total long")
    table = diagnosis.run_table(records, "run", ["a", "b", "c"], {"recall": diagnosis.share(F.col("hits"), F.col("total")), "total": F.col("total")})
    assert sorted(map(tuple, table.collect())) == [("recall", "3/8 (38%)", "N/A", "N/A"), ("total", "8", "4", "N/A")]


def test_documents_are_written_and_read(spark, tmp_path):
    totals = spark.createDataFrame([(1, 25.0, 2), (2, 25.0, 0)], "k long, fps double, total long")
    cuts = spark.createDataFrame([(1, "high", 9), (1, "low", 4)], "k long, kind string, frame long")
    docs = readers.result_documents(totals, {"events": cuts, "breaks": cuts.limit(0)}, "k", ["fps"])
    readers.write_document(docs, str(tmp_path / "docs"))
    read = readers.documents_of(spark, str(tmp_path / "docs"), docs.schema)
    assert sorted(map(str, read.collect())) == sorted(map(str, docs.collect()))
    one = {r["k"]: r for r in read.collect()}
    assert one[1]["metadata"]["fps"] == 25.0 and one[1]["summary"]["total"] == 2 and [e["frame"] for e in one[1]["events"]] == [4, 9]
    assert one[2]["events"] == [] and one[1]["breaks"] == []
    flat = readers.event_documents(spark, str(tmp_path / "docs" / "*.json")).collect()
    assert sorted((r["frame"], r["kind"]) for r in flat) == [(4, "low"), (9, "high")]
