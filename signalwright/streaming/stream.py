"""Structured Streaming forms: windows and sessions that close, classification by an interval join, detectors as keyed state.

All write in append mode: what a watermark has passed comes out once, and is forgotten. Since the last windows of a finished source would
wait for ever, a source may end with a control row of the type CLOSED, whose late time moves every watermark past the rest.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from signalwright.operators import detectors
from signalwright.sources.scratch import exists, new_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: The types of control rows: a source that came back, and the end of a source.
RESET, CLOSED = detectors.RECONNECTED, "stream_closed"
#: The time of the closing row. Its key isn't null, as joins drop null keys before their watermark sees them.
FAR = "2200-01-01 00:00:00"


def closing_row(spark: SparkSession, path: str) -> None:
    """Adds the file that ends a folder of events."""
    row = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(FAR).cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit(CLOSED).alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"))
    row.coalesce(1).write.mode("append").parquet(path)


def event_stream(spark: SparkSession, sf_dir: str, close: bool = False) -> DataFrame:
    """The events table as a stream; its times become instants of the session's zone, as watermarks need. close: the table is all there
    is, so a control row ends it."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    if close:
        path = new_path(spark, "closing")
        closing_row(spark, path)
        rows = rows.unionByName(spark.readStream.schema(EVENTS).parquet(path))
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, at: str, size: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))


def sessions(stream: DataFrame, at: str, gap: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n"))


def drain(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs the stream over what there is; the rows that it has written so far, also those of earlier runs in `folder` (in complete mode those
    of the last batch).

    `folder` (in the shared folder if not given) holds the checkpoint and the rows. Each batch is a Parquet table under its number, so a batch
    that runs again after a failure replaces its own rows; what was written is read from the folder, the driver remembers nothing.
    """
    spark = stream.sparkSession
    folder = folder or new_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    # keyed state with timers needs the store on disk
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    query.awaitTermination()
    if not exists(spark, f"{folder}/rows"):
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        last = spark.read.parquet(f"{folder}/rows").agg(F.max("batch")).first()[0]
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows/batch={last}") if last is not None else spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{folder}/rows")


def interval_join(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, low: str, high: str, late: str, how: str = "inner") -> DataFrame:
    """Pairs of two streams with low <= right - left <= high; the watermarks let Spark forget rows that can't pair any more. how: `left_outer`
    keeps left rows that found none, once the watermark has passed all that they could pair with."""
    own = right.withColumnRenamed(key, "_key").withWatermark(rt, late)
    within = F.expr(f"_key = {key} AND {rt} >= {lt} + interval {low} AND {rt} <= {lt} + interval {high}")
    return left.withWatermark(lt, late).join(own, within, how).drop("_key")


def classify(cycles: DataFrame, scale: DataFrame, key: str, ct: str, st: str, low: str, high: str, late: str) -> DataFrame:
    """The columns of `cycles` and `verdict`: accepted with each event of `scale` of low <= scale - cycle <= high (its time in `st`), else
    rejected, once no such event can come any more. A cycle with several is accepted as often; control rows are in neither."""
    found = interval_join(cycles, scale, key, ct, st, low, high, late, "left_outer").where(F.col(ct) < F.lit(FAR).cast("timestamp"))
    return found.withColumn("verdict", F.when(F.col(st).isNull(), "rejected").otherwise("accepted"))


#: Keys are dealt out to so many buckets, which Spark groups by.
BUCKETS = 2048


class Keyed:
    """A machine for each key, kept between batches: `feed(*columns)`, `close()`, `events`.

    A batch's rows of a key are fed in the order of `order` and the first column (their number is bounded by what the source gives to a
    batch). A row before the last one fed is late: it changes nothing, and its first column is told as an event of the kind `late`. A key without rows
    for `idle` is over when the watermark has passed that long: its machine closes, tells what was open, and its state goes; rows after that
    begin anew. Rows without a key take no part. The state is the machine itself, so another version of its class needs a new folder.
    What Spark groups by, and keeps a state and a timer for, is a bucket of keys: a group costs it some 20 ms a batch, whatever its rows.
    """

    STATE = "own binary"

    def __init__(self, make: Callable[[], object], columns: Sequence[str], shape: str, key: str, order: str, at: str, idle: int):
        self.make, self.columns, self.key, self.order, self.at, self.idle = make, list(columns), key, order, at, idle
        self.out = [key, *(x.split()[0] for x in shape.split(", "))]
        self.far = int(pd.Timestamp(f"{FAR[:4]}-01-01").value // 1000)

    def _rows(self, parts: Iterator[pd.DataFrame]) -> dict[object, list[tuple]]:
        """The batch's rows of each key as plain values (order, columns, time in microseconds), in order."""
        found: dict[object, list[tuple]] = {}
        for part in parts:
            time = part[self.at].to_numpy().astype("datetime64[us]").astype(np.int64).tolist()
            plain = [[None if x is None or isinstance(x, float) and x != x else x for x in part[c].tolist()] for c in (self.order, *self.columns)]
            for key, *row in zip(part[self.key].tolist(), *plain, time, strict=True):
                if row[-1] < self.far:
                    found.setdefault(key, []).append(tuple(row))
        by = 1 if self.columns[0] == self.order else 2
        for rows in found.values():
            rows.sort(key=lambda r: [(x is None, x) for x in r[:by]])
        return found

    def run(self, bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machines: dict = pickle.loads(bytes(state.get[0])) if state.exists else {}  # key: machine, last, the time of its end
        rows = {} if state.hasTimedOut else self._rows(parts)
        now, told = state.getCurrentWatermarkMs(), []
        for key, own in rows.items():
            machine, last, _ = machines.get(key) or (self.make(), None, None)
            for row in own:
                if last is not None and row[0] < last:
                    told.append((key, "late", row[1], *[None] * (len(self.out) - 3)))
                    continue
                last = row[0]
                machine.feed(*row[1:-1])
                if machine.events:
                    told += [(key, *e) for e in machine.events]
                    machine.events.clear()
            machines[key] = machine, last, max(max(r[-1] for r in own) // 1000 + self.idle, now + 1)
        for key in [k for k, (*_, end) in machines.items() if end <= now]:
            machine = machines.pop(key)[0]
            machine.close()
            told += [(key, *e) for e in machine.events]
        if machines:
            state.update((pickle.dumps(machines),))
            state.setTimeoutTimestamp(min(end for *_, end in machines.values()))
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame(told, columns=self.out, dtype=object)


def by_machine(stream: DataFrame, key: str, order: str, at: str, columns: Sequence[str], make: Callable[[], object], shape: str, late: str, idle: int) -> DataFrame:
    """Events of a machine for each key (see Keyed); `at` is the time of a row, `idle` milliseconds. The closing row meets no machine."""
    own = stream.where(F.col(key).isNotNull()).withWatermark(at, late)
    kind = dict(stream.dtypes)[key]
    keyed = Keyed(make, columns, shape, key, order, at, idle)
    rows = own.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_bucket"), key, order, at, *(c for c in columns if c != order)).groupBy("_bucket")
    return rows.applyInPandasWithState(keyed.run, f"{key} {kind}, {shape}", Keyed.STATE, "Append", GroupStateTimeout.EventTimeTimeout)


class Latch:
    """A debounced latch: on after `hold` rows in a row above `on`, off below `off`; a control row clears it."""

    def __init__(self, on: float, off: float, hold: int):
        self.on, self.off, self.hold = on, off, hold
        self.level = self.run = 0
        self.events: list[tuple] = []

    def feed(self, event_id: int, value: float, control: str | None) -> None:
        if control == RESET:
            self.level = self.run = 0
            return
        self.run = self.run + 1 if value > self.on else 0
        now = 1 if self.run >= self.hold else 0 if value < self.off else self.level
        if now != self.level:
            self.events.append(("rise" if now else "fall", event_id))
        self.level = now

    def close(self) -> None:
        pass


LATCH = "edge string, event_id long"


def latch_edges(stream: DataFrame, on: float, off: float, hold: int, late: str = "1 hour", idle: int = 86_400_000) -> DataFrame:
    """user_id, edge, event_id: rises and falls of each user's latch over `value`. Rows of the type RESET clear it and tell nothing; a user
    without rows for `idle` begins anew."""
    rows = stream if "at" in stream.columns else stream.withColumn("at", F.col("ts").cast("timestamp"))
    rows = rows.withColumn("order", F.unix_micros("at"))
    return by_machine(rows, "user_id", "order", "at", ["event_id", "value", "event_type"], lambda: Latch(on, off, hold), LATCH, late, idle)


class StreamedCuts(detectors.Cuts):
    """The cut detector over plain rows: smoothed levels and their differences come from the latest rows, which it keeps."""

    def __init__(self, c: detectors.CutConfig):
        super().__init__(c)
        self._start()

    def _start(self) -> None:
        c = self.c
        self.levels = tuple(deque(maxlen=c.smooth) for _ in range(2))
        self.means = tuple(deque(maxlen=c.long_width) for _ in range(2))

    def feed(self, frame: int, level: float, left: float, motion: float, spread: float, control: str | None = None) -> None:
        if control == RESET:
            events, self.events = self.events, []
            self.__init__(self.c)
            self.events = [*events, (RESET, frame, *[None] * 7, False)]
            return
        for x, raw, mean in zip((level, left), self.levels, self.means, strict=True):
            raw.append(x)
            mean.append(sum(raw) / len(raw))

        def step(i: int, width: int) -> float:
            mean = self.means[i]
            return mean[-1] - mean[-width] if len(mean) >= width else 0.0

        super().feed(frame, self.means[0][-1], step(0, self.c.long_width), step(0, self.c.short_width), step(1, self.c.short_width), motion, spread)


def stream_cuts(stream: DataFrame, key: str, at: str, c: detectors.CutConfig, late: str, idle: int) -> DataFrame:
    """stream: key, frame, at, level, left, motion, spread, control. The events of detect_cuts over prepare, without confidence."""
    return by_machine(stream, key, "frame", at, ["frame", "level", "left", "motion", "spread", "control"], lambda: StreamedCuts(c), detectors.CUTS, late, idle)


def stream_scale(stream: DataFrame, key: str, at: str, c: detectors.ScaleConfig, late: str, idle: int, reference: Sequence[float] | None = None) -> DataFrame:
    """stream: key, frame, at, brightness, patch, control. The events of detect_scale."""
    start = None if reference is None else list(reference)
    return by_machine(stream, key, "frame", at, ["frame", "brightness", "patch", "control"], lambda: detectors._Feed(start, c), detectors.SCALE_EVENTS, late, idle)
