"""Keyed machines: the rows of a key pass by in order, and what a machine remembers is all that a task holds.

Spark brings the rows of a key together and sorts them (spilling where it must); a task reads them in Arrow batches. A machine has
`feed(*row)`, `close()` and a list `events`, which is emptied with the batch that filled it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

_TYPES = {"boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64()}


def by_machine(df: DataFrame, key: Sequence[str], columns: Sequence[str], make: Callable[[], object], shape: str, order: Sequence[str] = ()) -> DataFrame:
    """Feeds each key's rows to a machine of its own, ordered by `order` (the first of `columns` if not given); its events, with the key.

    A null key is a key as any other. Rows that are alike in `order` come by all columns, so that the result doesn't depend on the files.
    """
    out = StructType([*df.select(*key).schema.fields, *StructType.fromDDL(shape).fields])
    first = list(order) or [columns[0]]
    rows = df.select(*key, *columns).repartition(*key).sortWithinPartitions(*key, *first, *(c for c in columns if c not in first))
    return rows.mapInArrow(_fed(len(key), make, out), out)


def _fed(n: int, make: Callable[[], object], out: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = [_TYPES.get(f.dataType.simpleString(), pa.string()) for f in out.fields[n:]]
    fields = out.names

    def pack(told: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in told], t) for i, t in enumerate([*kinds, *types])], names=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine, kinds = None, None, None
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(n)]
            told: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if machine is None or row[:n] != now:
                    if machine is not None:
                        machine.close()
                        told += [(*now, *e) for e in machine.events]
                    now, machine = row[:n], make()
                machine.feed(*row[n:])
                if machine.events:
                    told += [(*now, *e) for e in machine.events]
                    machine.events.clear()
            yield pack(told, kinds)
        if machine is not None:
            machine.close()
            yield pack([(*now, *e) for e in machine.events], kinds)

    return run


class SlidingMedian:
    """The median of the latest `width` values: sorted blocks of at most 2 * BLOCK values, so a value comes and goes by two binary searches
    and a short move, whatever the width."""

    BLOCK = 512

    def __init__(self, width: int):
        self.width = width
        self.latest: deque[float] = deque()
        self.blocks: list[list[float]] = []

    def __len__(self) -> int:
        return len(self.latest)

    def _place(self, x: float) -> int:
        """The first block whose largest value isn't below x, or the last block."""
        blocks = self.blocks
        if len(blocks) == 1:
            return 0
        return min(bisect_left(blocks, x, key=lambda b: b[-1]), len(blocks) - 1)

    def append(self, x: float) -> None:
        self.latest.append(x)
        if not self.blocks:
            self.blocks.append([x])
        else:
            i = self._place(x)
            own = self.blocks[i]
            insort(own, x)
            if len(own) > 2 * self.BLOCK:
                self.blocks[i : i + 1] = [own[: self.BLOCK], own[self.BLOCK :]]
        if len(self.latest) > self.width:
            self._forget(self.latest.popleft())

    def _forget(self, x: float) -> None:
        i = self._place(x)
        own = self.blocks[i]
        del own[bisect_left(own, x)]
        if not own:
            del self.blocks[i]

    def _at(self, k: int) -> float:
        for own in self.blocks:
            if k < len(own):
                return own[k]
            k -= len(own)
        raise IndexError

    def median(self) -> float:
        n = len(self.latest)
        return self._at(n // 2) if n % 2 else (self._at(n // 2 - 1) + self._at(n // 2)) / 2


class Outweighing:
    """Which of the events before, at most `within` ago, is the latest that outweighs one: strength < ratio * its strength.

    An event can only be the answer while no later one is as strong, so these stand in falling strength from the oldest on: a new event
    takes those off the end that it covers, time takes them off the front, and a binary search finds the answer. Without `at_once`, events of
    one time don't see each other.
    """

    def __init__(self, within: int, at_once: bool):
        self.within, self.at_once = within, at_once
        self.stack: list[tuple] = []  # (time, strength), from `start` on
        self.start = 0
        self.waiting: list[tuple] = []

    def _push(self, at, strength) -> None:
        stack = self.stack
        if len(stack) > self.start and stack[-1][0] == at and stack[-1][1] >= strength:
            return
        while len(stack) > self.start and stack[-1][1] <= strength:
            stack.pop()
        stack.append((at, strength))

    def _expire(self, before) -> None:
        stack = self.stack
        while self.start < len(stack) and stack[self.start][0] < before:
            self.start += 1
        if self.start > 1024 and 2 * self.start > len(stack):
            del stack[: self.start]
            self.start = 0

    def meet(self, at, strength, ratio) -> tuple | None:
        """(time, strength) of the event that outweighs this one, which then counts for the later ones. Events come in the order of time."""
        if at is None or strength is None:
            return None
        if self.waiting and self.waiting[0][0] != at:
            for event in self.waiting:
                self._push(*event)
            self.waiting = []
        self._expire(at - self.within)
        n = self.start if ratio is None else bisect_right(self.stack, False, self.start, key=lambda e: not strength < ratio * e[1])
        found = self.stack[n - 1] if n > self.start else None
        if self.at_once:
            self._push(at, strength)
        else:
            self.waiting.append((at, strength))
        return found


class Matcher:
    """Greedy one-to-one matching: labels in order, each takes the nearest detection that is left, at most `within` away; of two as near, the
    earlier. A label is settled once a detection comes that is too late for it, so only detections about the waiting labels are held."""

    def __init__(self, within: int):
        self.within = within
        self.labels: deque = deque()
        self.rest: list = []  # sorted, from `start` on
        self.start = 0
        self.events: list[tuple] = []

    def feed(self, at, kind: int) -> None:
        """kind: 0 a label, 1 a detection; in the order of `at`. A row without a time takes no part."""
        if at is None:
            return
        while self.labels and self.labels[0] + self.within < at:
            self._settle(self.labels.popleft())
        if kind == 0:
            self.labels.append(at)
            return
        if not self.labels:  # it can only be of use to labels from now on
            self._drop(at - self.within)
        self.rest.append(at)

    def _drop(self, before) -> None:
        rest = self.rest
        while self.start < len(rest) and rest[self.start] < before:
            self.start += 1
        if self.start > 1024 and 2 * self.start > len(rest):
            del rest[: self.start]
            self.start = 0

    def _settle(self, label) -> None:
        self._drop(label - self.within)
        rest, i = self.rest, bisect_left(self.rest, label, self.start)
        best = None
        if i > self.start:  # the first of those before it that are as near
            best = bisect_left(rest, rest[i - 1], self.start)
        if i < len(rest) and rest[i] - label <= self.within and (best is None or rest[i] - label < label - rest[best]):
            best = i
        self.events.append((label, None if best is None else rest.pop(best)))

    def close(self) -> None:
        while self.labels:
            self._settle(self.labels.popleft())
