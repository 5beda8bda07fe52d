"""Best-fit packing: a configuration linear program over the length histogram, by multiplicative weights, then rounded.

The pieces' lengths are counted by Spark into a histogram of at most `capacity` lengths, so the program that the driver solves has
a size that depends on the capacity alone, never on the number of documents. Each round prices a length by a weight that falls
as the length gets covered, and a knapsack dynamic program finds, for every length, the best configuration (a multiset of lengths that
fits one sequence and uses no more pieces than there are) with it; their average over the rounds is the fractional solution. It is rounded
down, configurations below one up to one while their pieces last; the pieces that are left make a smaller program, solved and rounded
alike, until a few per cent of the tokens are left, which go into best fillings, longest piece first. The program's dual prices bound how
few sequences there can be, so a rounding that meets the bound is known to be best. The result is a short list of (configuration, times)
rows. A piece then needs no search: its rank among the pieces of its length says which sequence it takes, and which place there.

Defined results: a null or empty text still holds its end id; a document longer than the capacity, however long, is encoded whole and
cut into pieces of the capacity and a last, shorter one; rows that repeat a doc_id, or each other, are packed each on its own, and
ties between pieces of one length go by doc_id, piece and then any order; an empty table gives no rows; other columns of the input,
whatever their names, are ignored. The string of a special token in a text is ordinary text (`encode_special_tokens`, as the
vocabularies' own description has it), never that token.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalwright.llm._common import cut, text_slices, word_encoder
from signalwright.llm._ranks import rank_within

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The documents' token ids with the end id, cut only where longer than the capacity; their lengths, starts and checksums."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = word_encoder(tokenizer).encode, int(end_id).to_bytes(4, "little")
        for batch in batches:
            ids, at = batch.column(0), 0
            for texts in text_slices(batch.column(1)):
                rows: list[list] = [[], [], [], [], []]
                for k, raw in enumerate(encode(texts)):
                    raw, doc = raw + tail, ids[at + k].as_py()
                    for n, lo in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[lo : lo + 4 * capacity]
                        for column, x in zip(rows, (doc, n, lo // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                            column.append(x)
                at += len(texts)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_up, PIECES)


@dataclass(frozen=True)
class Plan:
    """rows: for each length, which ranks go to which run of sequences; sequences: how many there are."""

    length: np.ndarray
    first_rank: np.ndarray
    first_sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int


def multiples(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(length, how many at once): with single, double, fourfold, ... pieces a 0/1 program can take any number up to what there is and fits."""
    out = []
    for v in np.flatnonzero(counts):
        most = min(int(counts[v]), capacity // int(v))
        m = 1
        while most > 0:
            out.append((int(v), min(m, most)))
            most -= m
            m *= 2
    return out


def knapsack(price: np.ndarray, items: list[tuple[int, int]], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to the capacity the greatest total price of items that fit, no item twice; and for each item the rooms at which it
    is taken, given the items before it. price: of one piece of each length."""
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(items), capacity + 1), dtype=bool)
    for k, (v, m) in enumerate(items):
        size = v * m
        here = best[size:]
        other = best[: capacity + 1 - size] + price[v] * m
        np.greater(other, here + 1e-12, out=taken[k, size:])
        np.maximum(here, other, out=here)
    return best, taken


def fillings(rooms: np.ndarray, items: list[tuple[int, int]], taken: np.ndarray, slot: dict[int, int]) -> np.ndarray:
    """The pieces of each length in the best filling of each room, for all rooms at once: the program walked back from its last item."""
    rooms = rooms.copy()
    out = np.zeros((len(rooms), len(slot)), dtype=np.int32)
    for k in range(len(items) - 1, -1, -1):
        hit = np.flatnonzero(taken[k].take(rooms))
        if len(hit):
            v, m = items[k]
            rooms[hit] -= v * m
            out[hit, slot[v]] += m
    return out


Configurations = dict[tuple[tuple[int, int], ...], float]
#: Of a solution: rounds at most at first, and later (and at least at first), how fast weights fall, how far below the best price a
#: configuration may be, and how near the bound ends it.
ROUNDS, AGAIN, RATE, NEAR, GAP = 60, 12, 0.5, 0.01, 0.002
#: Solutions of what is left at most, the share of the tokens that is left to the last fillings, and how near the bound is near enough.
PASSES, REST, ENOUGH = 24, 0.05, 0.0005


def solve(counts: np.ndarray, capacity: int, draw: np.random.Generator, rounds: int = ROUNDS, below: float = NEAR, gap: float | None = GAP) -> tuple[Configurations, float]:
    """The fractional program by multiplicative weights: the times of each configuration ((length, times), ...), so that on average the lengths
    are covered as often as they occur, and a bound that no packing can go below.

    A round prices each length by its weight. One knapsack program gives, for every length, the best configuration that holds it; those
    whose price is near the greatest one are taken, each as often as its length occurs. The weight of a length falls with what covers it,
    so the next round prefers others. Prices over the greatest price of a configuration are feasible for the dual program, so what all pieces
    cost at such prices is a lower bound; that of the first round is all tokens over the capacity, or more.
    """
    lengths = np.flatnonzero(counts)
    need = counts[lengths].astype(float)
    slot = {int(v): i for i, v in enumerate(lengths)}
    share = need * lengths / (need @ lengths)
    weight, covered = np.ones(len(lengths)), np.zeros(len(lengths))
    items = multiples(counts, capacity)
    total: Configurations = {}
    bound = 0.0
    for t in range(rounds):
        # another order each time: of equally good fillings the program finds others
        order = [items[k] for k in draw.permutation(len(items))]
        price = np.zeros(capacity + 1)
        price[lengths] = lengths / capacity * weight
        best, taken = knapsack(price, order, capacity)
        bound = max(bound, float(price[lengths] @ need) / best[capacity])
        near = np.flatnonzero(price[lengths] + best[capacity - lengths] >= best[capacity] * (1 - below))
        held = fillings(capacity - lengths[near], order, taken, slot)
        held[np.arange(len(near)), near] += 1
        fits = (held[np.arange(len(near)), near] <= counts[lengths[near]])
        near, held = near[fits], held[fits]
        if not len(near):
            continue
        times = need[near] / held[np.arange(len(near)), near]
        got = times @ held / need
        scale = 1 / got.max()
        for row, x in zip(held, times, strict=True):
            at = np.flatnonzero(row)
            c = tuple(zip(lengths[at].tolist(), row[at].tolist(), strict=True))
            total[c] = total.get(c, 0.0) + x * scale
        covered += got * scale
        if gap is not None and t + 1 >= AGAIN and sum(total.values()) * (1 - gap) <= bound * covered.mean():
            break
        weight = np.maximum(weight * np.exp(-RATE * got * scale), 1e-9)
        weight /= weight @ share
    return {c: x / max(covered.mean(), 1e-12) for c, x in total.items()}, bound


Used = dict[tuple[tuple[int, int], ...], int]


def _take(used: Used, left: np.ndarray, c: tuple[tuple[int, int], ...], most: int) -> int:
    """Places a configuration as often as `most` and what is left of its lengths allow."""
    m = most
    for v, k in c:
        m = min(m, int(left[v]) // k)
        if m <= 0:
            return 0
    used[c] = used.get(c, 0) + m
    for v, k in c:
        left[v] -= m * k
    return m


def filled(room: int, left: dict[int, int], slack: int) -> list[int]:
    """The knapsack program with a piece's length as its price and no more pieces than there are: the pieces that fill a room best.

    The sums that can be reached are the bits of a number. Longer pieces come first (left is in falling order), and it stops once a sum
    within `slack` of the room is reached, so that shorter ones stay for others.
    """
    reach, mask, goal = 1, (2 << room) - 1, max(0, room - slack)
    before: list[tuple[int, int]] = []
    for v, n in left.items():
        if n and v <= room:
            before.append((v, reach))
            for _ in range(min(n, room // v)):
                reach |= (reach << v) & mask
            if reach >> goal:
                break
    at, out = reach.bit_length() - 1, []
    for v, was in reversed(before):
        while not was >> at & 1:
            at -= v
            out.append(v)
    return out


def _filled_up(left: np.ndarray, capacity: int, slack: int) -> Used:
    """Longest piece first, each with the best filling of its sequence."""
    rest = {int(v): int(left[v]) for v in np.flatnonzero(left)[::-1]}
    used: Used = {}
    for v in list(rest):
        while rest[v]:
            rest[v] -= 1
            own = Counter([v, *filled(capacity - v, rest, slack)])
            rest[v] += 1
            m = min(rest[u] // k for u, k in own.items())
            c = tuple(sorted(own.items()))
            used[c] = used.get(c, 0) + m
            for u, k in c:
                rest[u] -= m * k
    return used


def rounded(counts: np.ndarray, capacity: int, long_first: bool = True, gap: float | None = GAP, seed: int = 0) -> tuple[Used, int, float]:
    """Whole times, how many tokens the program's configurations place, and the lower bound.

    The fractional times are rounded down; a configuration below one is rounded up to one, those that waste least first (of equal ones that
    with the longest piece, which is hard to place later, or the one with the greatest times), while its pieces last. What that leaves is a smaller program of the same kind, which is solved and rounded again, until at most REST of the tokens are
    left: these go, longest piece first, into the best fillings of their sequences.
    """
    draw = np.random.default_rng(seed)
    left = counts.astype(np.int64).copy()
    sizes = np.arange(len(counts))
    tokens = int(left @ sizes)
    used: Used = {}
    bound, slack = 0.0, 0
    for _ in range(PASSES):
        if left @ sizes <= REST * tokens:
            break
        x, least = solve(left, capacity, draw, AGAIN if used else ROUNDS, max(NEAR, slack / capacity), gap)
        bound = max(bound, least) if not used else bound
        room = {c: capacity - sum(v * k for v, k in c) for c in x}
        before = int(left.sum())
        for c in sorted(x, key=lambda c: (-x[c], c)):
            if x[c] >= 1:
                _take(used, left, c, int(x[c]))
        for c in sorted(x, key=lambda c: (room[c], -c[-1][0] if long_first else 0, -x[c], c)):
            if room[c] <= slack:
                _take(used, left, c, 1)
        if before - int(left.sum()) < 0.02 * before:
            slack = max(1, 4 * slack)
            if slack > capacity:
                break
    placed = tokens - int(left @ sizes)
    last = min((_filled_up(left, capacity, near) for near in (0, capacity // 128, capacity // 32)), key=lambda u: sum(u.values()))
    for c, m in last.items():
        used[c] = used.get(c, 0) + m
    return used, placed, bound


def best_configurations(counts: np.ndarray, capacity: int) -> tuple[Used, float, float]:
    """The rounding with the fewest sequences of three, the program's lower bound, and the share of the tokens that its configurations place. It
    ends once a rounding is at the bound, or within ENOUGH of it."""
    tokens = int(counts @ np.arange(len(counts)))
    if not tokens:
        return {}, 0.0, 1.0
    best: tuple[int, Used, float] | None = None
    bound = 0.0
    for long_first, gap in ((True, GAP), (False, GAP), (True, None)):
        used, placed, least = rounded(counts, capacity, long_first, gap)
        bound = max(bound, least)
        n = sum(used.values())
        if best is None or n < best[0]:
            best = (n, used, placed / tokens)
        if best[0] <= math.ceil(bound - 1e-6) * (1 + ENOUGH):
            break
    return best[1], bound, best[2]


def plan(counts: np.ndarray, capacity: int) -> Plan:
    """counts: how many pieces have each length, by length up to the capacity. Which rank goes where."""
    left = counts.astype(np.int64).copy()
    used: list[tuple[tuple[tuple[int, int], ...], int]] = []
    if left[capacity]:
        used.append((((capacity, 1),), int(left[capacity])))
        left[capacity] = 0
    used += best_configurations(left, capacity)[0].items()

    rows: list[tuple[int, int, int, int, int]] = []
    given = np.zeros(capacity + 1, dtype=np.int64)
    sequence = 0
    for c, m in used:
        offset = 0
        for v, each in sorted(c, reverse=True):
            rows.append((v, int(given[v]), sequence, each, offset))
            given[v] += each * m
            offset += each * v
        sequence += m
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return Plan(*(table[:, k].copy() for k in range(5)), sequences=sequence)


def pack(cut_pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """cut_pieces (with doc_id, piece, length) plus sequence_id and offset. Pieces of a length are dealt by their rank."""
    ranked = rank_within(cut_pieces, "length", ["doc_id", "piece"])
    histogram = ranked.counts()  # one row for each length: at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    own = plan(counts, capacity)
    spread = cut_pieces.sparkSession.sparkContext.broadcast(own)  # its size is bounded by the capacity and the rounds
    kept = [f for f in ranked.df.schema.fields if f.name != ranked.rank]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    rank, names = ranked.rank, schema.fieldNames()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = spread.value
        # ranks below 2^44 and lengths below 2^19 make one sortable key
        keys = (p.length << 44) | p.first_rank
        for batch in batches:
            length, r = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", rank))
            k = np.searchsorted(keys, (length << 44) | r, side="right") - 1
            inside = r - p.first_rank[k] if len(k) else r
            run, nth = (inside // p.each[k], inside % p.each[k]) if len(k) else (r, r)
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in names[:-2]}
            out["sequence_id"] = pa.array(p.first_sequence[k] + run if len(k) else r)
            out["offset"] = pa.array(p.offset[k] + nth * length if len(k) else r)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return ranked.df.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every document's pieces in as few sequences as the plan finds."""
    return pack(cut(pieces(docs, tokenizer, capacity, end_id)), capacity)
