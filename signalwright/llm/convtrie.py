"""The prefix trie of conversations, from a mergesort whose runs carry the length of each shared prefix.

A turn is the 16-byte digest of its role and text, a conversation the bytes of its turns one after another; so bytes order
conversations, and a prefix of turns comes right before what goes on from it. Spark parts the conversations into ranges of (bytes, conv_id),
drawn from samples, so copies of one conversation spread over many ranges. In a range:

* runs of bounded size are sorted. A run is cut into blocks, each row with the number of turns that it shares with the row before (LCP) and
  only the turns after them. Spark sorts the blocks of all runs by their first row, spilling where it must: that is the external storage;
* a loser tree merges the runs from this one stream of blocks, holding one block of each run. Two heads are compared by their LCPs with the
  row that left last, and only from there on where those are equal: shared turns are not compared again;
* the merged stream keeps the path of open nodes on a stack. A row closes the nodes below its LCP, which leave with their sums.

A node on the border of two ranges leaves both in part. Which ones do follows from the LCP of the ranges' end rows (two rows a range are
collected, no more), so that every sum adds up without counting twice; the ids that end at such a node go in chunks to one task
that hashes them in order, in constant memory (a SHA-256 is one sequence). The least conv_id of the parent comes by a join.

Defined results: rows without a conv_id take no part; a null role or text is empty; of equal turns (and of several null turns, which come
first) the one with the smaller digest comes first, and repeated rows are as many turns; an empty table gives no nodes; other columns are
ignored. What one task holds: a run, a block of each run, and the digests of one conversation (20 bytes a turn; its texts never meet).
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalwright.llm._common import cut

#: Bytes of a turn's digest.
TURN = 16
RUN_BYTES, BLOCK_BYTES = 32 << 20, 32 << 10
#: Conversations of one family begin as its first member does, for fewer than HEADS turns.
FAMILY, HEADS = 100, 6
EMPTY = hashlib.sha256(b"").hexdigest()
BLOCKS = "range int, run int, first binary, first_id long, last binary, last_id long, ids array<long>, lcps array<int>, tails array<binary>, sizes array<binary>"
BLOCK_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary())]
NODES = "key binary, parent binary, depth long, least long, n long, kids long, leaves long, saved long, ends string, range int, chunk long, part string"
NODE_TYPES = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.string(), pa.int32(), pa.int64(), pa.string()]


def sequences(conversations: DataFrame, head_of: Column | None = None) -> DataFrame:
    """c (conv_id), seq (its rebuilt turns' digests), sizes (code points of each turn's text).

    head_of: how many turns come from the family's first member; crc32 of the conv_id modulo HEADS if not given. A family joins at most
    FAMILY conversations, so no key of the join is hot.
    """
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("c"), F.struct(F.col("turn"), digest.alias("d"), F.length(text).alias("n")).alias("t"))
    convs = turns.groupBy("c").agg(F.array_sort(F.collect_list("t")).alias("own"))
    base = F.col("c") - F.col("c") % FAMILY
    heads = convs.where(F.col("c") == base).select(F.col("c").alias("base"), F.slice("own", 1, HEADS).alias("head"))
    h = F.crc32(F.col("c").cast("string")) % HEADS if head_of is None else head_of
    both = convs.withColumn("base", base).join(heads, "base", "left").withColumn("h", h.cast("int"))
    begin = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0))
    turns = F.concat(begin, F.slice("own", F.col("h") + 1, F.size("own")))
    whole = both.select("c", turns.alias("turns"))
    return whole.select("c", F.unhex(F.array_join(F.transform("turns", lambda t: t["d"]), "")).alias("seq"), F.transform("turns", lambda t: t["n"]).alias("sizes"))


def shared(a: bytes, b: bytes, turns: int = 0) -> int:
    """How many turns a and b share, given that they share `turns`."""
    at, end = turns * TURN, min(len(a), len(b))
    while at < end and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at // TURN


def sorted_blocks(rows: list[tuple[bytes, int, bytes]], block_bytes: int) -> Iterator[tuple]:
    """Sorts a run (seq, id, sizes) in place; its blocks from `first` on (see BLOCKS)."""
    rows.sort()
    ids, lcps, tails, sizes, held, first, before = [], [], [], [], 0, None, b""
    for seq, c, size in rows:
        lcp = shared(before, seq)
        if not ids:
            first = (seq, c)
        ids.append(c)
        lcps.append(lcp)
        tails.append(seq[lcp * TURN :] if len(ids) > 1 else b"")  # the first row stands in `first`
        sizes.append(size[lcp * 4 :] if len(ids) > 1 else size)
        held += len(tails[-1]) + len(sizes[-1]) + 12
        before = seq
        if held >= block_bytes:
            yield (*first, seq, c, ids, lcps, tails, sizes)
            ids, lcps, tails, sizes, held = [], [], [], [], 0
    if ids:
        yield (*first, before, c, ids, lcps, tails, sizes)


def _form_runs(run_bytes: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, rows = TaskContext.get().partitionId(), 0, 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            for block in sorted_blocks(rows, block_bytes):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, n, *block), BLOCK_TYPES, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])
            rows.clear()

        for batch in batches:
            for c, seq, sizes in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows.append((seq, c, struct.pack(f"<{len(sizes)}i", *sizes)))
                held += len(seq) * 5 // 4 + 64
                if held >= run_bytes:
                    yield from flush()
                    n, held = n + 1, 0
        yield from flush()

    return run


class Cursor:
    """The rows of a block, one at a time: seq, id, sizes, and lcp, the turns shared with the row that its comparisons refer to."""

    def __init__(self, first: bytes, ids: list[int], lcps: list[int], tails: list[bytes], sizes: list[bytes]):
        self.ids, self.lcps, self.tails, self.all_sizes, self.at = ids, lcps, tails, sizes, 0
        self.seq, self.id, self.sizes, self.lcp = first, ids[0], sizes[0], 0

    def advance(self) -> bool:
        self.at += 1
        if self.at == len(self.ids):
            return False
        k = self.at
        self.lcp = lcp = self.lcps[k]
        self.seq, self.id, self.sizes = self.seq[: lcp * TURN] + self.tails[k], self.ids[k], self.sizes[: lcp * 4] + self.all_sizes[k]
        return True


class LoserTree:
    """Merges cursors. Each loser keeps the turns that it shares with the row that beat it; a head that shares more turns with the row that
    left last comes first, and only where both share as many are they compared, from there on."""

    def __init__(self, cursors: list[Cursor], last: bytes):
        self.cursors, self.compared = cursors, 0
        n = self.n = len(cursors)
        for c in cursors:
            c.lcp = shared(c.seq, last)
        winners: list[int | None] = [None] * n + list(range(n))
        self.losers: list[int | None] = [None] * n
        for node in range(n - 1, 0, -1):
            winners[node], self.losers[node] = self._match(winners[2 * node], winners[2 * node + 1])
        self.top = winners[1] if n > 1 else 0

    def _match(self, i: int | None, j: int | None) -> tuple[int | None, int | None]:
        """Winner and loser; None has no rows left."""
        if i is None or j is None:
            return (j, i) if i is None else (i, j)
        a, b = self.cursors[i], self.cursors[j]
        if a.lcp != b.lcp:
            return (i, j) if a.lcp > b.lcp else (j, i)
        k = shared(a.seq, b.seq, a.lcp)
        self.compared += k - a.lcp + 1
        if (a.seq[k * TURN : (k + 1) * TURN], a.id) < (b.seq[k * TURN : (k + 1) * TURN], b.id):
            b.lcp = k
            return i, j
        a.lcp = k
        return j, i

    def replace(self) -> bool:
        """The winner's cursor goes on; False if nothing is left."""
        own = self.top
        node, winner = (own + self.n) // 2, own if self.cursors[own].advance() else None
        while node:
            winner, self.losers[node] = self._match(winner, self.losers[node])
            node //= 2
        self.top = winner
        return winner is not None

    def left(self) -> list[Cursor]:
        return [self.cursors[i] for i in {self.top, *self.losers} if i is not None]


def merged(blocks: Iterable[tuple]) -> Iterator[tuple[int, bytes, bytes, int]]:
    """Rows (id, seq, sizes, turns shared with the row before) in order, from blocks (first, first_id, ids, lcps, tails, sizes) of any
    number of runs, sorted by their first row. A block joins when its first row is due."""
    stream = iter(blocks)
    head, tree, last = next(stream, None), None, b""
    while head is not None or tree is not None:
        fresh = []
        while head is not None and (tree is None and not fresh or tree is not None and head[:2] <= (tree.cursors[tree.top].seq, tree.cursors[tree.top].id) or fresh and head[:2] <= min((c.seq, c.id) for c in fresh)):
            fresh.append(Cursor(head[0], *head[2:]))
            head = next(stream, None)
        if fresh:
            tree = LoserTree([*(tree.left() if tree else []), *fresh], last)
        own = tree.cursors[tree.top]
        yield own.id, own.seq, own.sizes, own.lcp
        last = own.seq
        if not tree.replace():
            tree = None


class Node:
    __slots__ = ("key", "depth", "least", "n", "kids", "new_kids", "leaves", "saved", "size", "old", "goes_on", "sha", "ids", "chunk")

    def __init__(self, key: bytes, depth: int, size: int, old: bool, goes_on: bool):
        self.key, self.depth, self.size, self.old, self.goes_on = key, depth, size, old, goes_on
        self.least, self.n, self.kids, self.new_kids, self.leaves, self.saved, self.sha, self.ids, self.chunk = None, 0, 0, 0, 0, 0, None, [], 0


#: Ids in one chunk of those that end at a border node.
CHUNK = 8192


class OpenPath:
    """The stack of open nodes of one range. before, after: turns shared with the rows before and after the range (None: there are none);
    ahead: the turns shared with what comes after, as bytes."""

    def __init__(self, part: int, before: int | None, after: int | None, ahead: bytes):
        self.part, self.before, self.after, self.ahead = part, before, after, ahead
        self.serial, self.stack, self.told = 0, [], []

    def _push(self, seq: bytes, sizes: bytes, depth: int, first: bool) -> None:
        old = first and self.before is not None and depth <= self.before
        goes_on = self.after is not None and depth <= self.after and self.ahead.startswith(seq[: depth * TURN])
        if old or goes_on:
            above = self.stack[-1].key if self.stack else b""
            key = hashlib.blake2b(above + seq[(depth - 1) * TURN : depth * TURN] if depth else b"", digest_size=TURN).digest()
        else:
            key = struct.pack(">IQ", self.part, self.serial)
        self.serial += 1
        self.stack.append(Node(key, depth, struct.unpack_from("<i", sizes, (depth - 1) * 4)[0] if depth else 0, old, goes_on))

    def feed(self, c: int, seq: bytes, sizes: bytes, lcp: int) -> None:
        first = not self.stack
        while len(self.stack) > lcp + 1:
            self._pop()
        for depth in range(len(self.stack), len(seq) // TURN + 1):
            self._push(seq, sizes, depth, first)
        top = self.stack[-1]
        top.n += 1
        top.least = c if top.least is None else min(c, top.least)
        if top.old or top.goes_on:
            top.ids.append(c)
            if len(top.ids) == CHUNK:
                self._tell_ids(top)
        elif top.sha is None:
            top.sha = hashlib.sha256(str(c).encode())
        else:
            top.sha.update(f",{c}".encode())

    def _tell_ids(self, x: Node) -> None:
        self.told.append((x.key, None, *[None] * 7, self.part, x.chunk, ",".join(map(str, x.ids))))
        x.ids, x.chunk = [], x.chunk + 1

    def _pop(self) -> None:
        x = self.stack.pop()
        x.leaves += not x.kids and not x.goes_on
        x.saved += (x.n - (not x.old)) * x.size
        if x.ids:
            self._tell_ids(x)
        ends = None if x.old or x.goes_on else EMPTY if x.sha is None else x.sha.hexdigest()
        above = self.stack[-1] if self.stack else None
        self.told.append((x.key, above and above.key, x.depth, x.least, x.n, x.new_kids, x.leaves, x.saved, ends, self.part, None, None))
        if above:
            above.n, above.kids, above.new_kids = above.n + x.n, above.kids + 1, above.new_kids + (not x.old)
            above.leaves, above.saved = above.leaves + x.leaves, above.saved + x.saved
            above.least = x.least if above.least is None else min(above.least, x.least)

    def close(self) -> None:
        while self.stack:
            self._pop()


def _nodes(ends: dict[int, tuple[int | None, int | None, bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: OpenPath | None = None

        def blocks() -> Iterator[tuple]:
            nonlocal path
            for batch in batches:
                for i in range(batch.num_rows):
                    part, _, first, first_id, _, _, *rest = (batch.column(k)[i].as_py() for k in range(10))
                    if path is None:
                        path = OpenPath(part, *ends[part])
                    yield (first, first_id, *rest)

        def pack() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in path.told], t) for k, t in enumerate(NODE_TYPES)], names=[x.split()[0] for x in NODES.split(", ")])
            path.told.clear()
            return out

        for c, seq, sizes, lcp in merged(blocks()):
            path.feed(c, seq, sizes, lcp)
            if len(path.told) >= 4096:
                yield pack()
        if path is not None:
            path.close()
            yield pack()

    return run


def _hash_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash a key over chunks that come in order, joined by commas."""
    now, sha = None, None
    done: list[tuple[bytes, str]] = []
    for batch in batches:
        for key, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = key, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(part.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["key", "own_ends"])
        done = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["key", "own_ends"])


def trie(rows: DataFrame, parts: int | None = None, run_bytes: int = RUN_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows: c, seq, sizes (see sequences). A row for each node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select("c", "seq", "sizes").repartitionByRange(parts, "seq", "c")
    blocks = cut(ranged.mapInArrow(_form_runs(run_bytes, block_bytes), BLOCKS))
    edges = blocks.groupBy("range").agg(F.min(F.struct("first", "first_id"))["first"].alias("first"), F.max(F.struct("last", "last_id"))["last"].alias("last"))
    known = sorted((r["range"], bytes(r["first"]), bytes(r["last"])) for r in edges.collect())
    steps = [shared(a[2], b[1]) for a, b in zip(known, known[1:], strict=False)]
    ends = {p: (steps[i - 1] if i else None, steps[i] if i < len(steps) else None, last[: steps[i] * TURN] if i < len(steps) else b"") for i, (p, _, last) in enumerate(known)}
    found = cut(blocks.sortWithinPartitions("first", "first_id").mapInArrow(_nodes(ends), NODES))

    whole = found.where("part IS NULL AND ends IS NOT NULL").select("key", "parent", "depth", "least", "n", "kids", "leaves", "saved", "ends")
    chunks = found.where("part IS NOT NULL").select("key", "part", "range", "chunk")
    hashes = chunks.repartition("key").sortWithinPartitions("key", "range", "chunk").select("key", "part").mapInArrow(_hash_in_order, "key binary, own_ends string")
    border = found.where("part IS NULL AND ends IS NULL").groupBy("key", "parent", "depth").agg(F.min("least").alias("least"), *(F.sum(x).alias(x) for x in ("n", "kids", "leaves", "saved")))
    border = border.join(hashes, "key", "left").withColumn("ends", F.coalesce("own_ends", F.lit(EMPTY))).drop("own_ends")
    nodes = whole.unionByName(border)
    above = nodes.where("kids > 0").select(F.col("key").alias("parent"), F.col("least").alias("parent_conv_id"))
    return nodes.join(above, "parent", "left").select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


#: crc32 of the bytes of a text in decimal digits, bit by bit, as a step of a list_reduce in DuckDB.
CRC_SQL = "xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split({x}, ''), lambda b: [ord(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"

SQL = f"""WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS own FROM t GROUP BY c),
h AS (SELECT c, own, {CRC_SQL.format(x="c::VARCHAR")} % {HEADS} AS h FROM o),
r AS (SELECT h.c, coalesce(b.own[:h.h], []) || h.own[h.h + 1:] AS turns FROM h LEFT JOIN o b ON b.c = h.c - h.c % {FAMILY}),
p AS (SELECT c, len(turns) AS whole, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r),
n AS (SELECT turns[:depth] AS path, depth, min(c) AS conv_id, count(*) AS n, coalesce(length(any_value(turns[depth].text)), 0) AS size, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE whole = depth), '')) AS ends FROM p GROUP BY 1, 2),
k AS (SELECT path[:depth - 1] AS path, count(*) AS kids FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k ON k.path = n.path),
u AS (SELECT path[:up] AS path, sum((kids = 0)::INT) AS leaves, sum((n - 1) * size) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, a.conv_id AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN u ON u.path = f.path LEFT JOIN f a ON f.depth > 0 AND a.depth = f.depth - 1 AND a.path = f.path[:f.depth - 1]"""
