"""SimHash near-dedup: fingerprints of word shingles, linked through one-wildcard variants of their halves.

Two fingerprints that differ in two bits at most agree, but for one bit at most, in one of their two 32-bit halves; of `most` bits, in one
of most // 2 + 1 segments. So each distinct fingerprint is listed under 64 signatures: each segment with each of its bits left out;
fingerprints that meet in a signature are verified.
A signature that more than `hot` fingerprints share isn't paired up: its members get signatures of all 64 bits with two of them
left out (2,016 each), and whoever shares one of those is within two bits, so a link to the least member of each holds the group together
without any pairs. Beyond two bits that would be too many signatures, and all pairs of a signature are verified, exactly but at the square
of its size. Links become components by alternating large-star and small-star steps, written down each, until all are stars.

Defined results: a null or empty text has fingerprint zero, which links as any other; a text of fewer words than a shingle has the
hash of them all as its only feature; a very long text is read whole, its hashes in blocks; a bit set in exactly half the hashes is 0;
rows that repeat a doc_id, or each other, each get a fingerprint; a component of null doc_ids alone has a null id; an empty table gives
no rows; other columns, whatever their names, are ignored, and `one_of_each` returns them as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalwright.llm._common import cut, fresh, sifted, stored, text_slices

BITS = 64
#: The greatest number of bits that links may differ in; its segments have eight bits.
MOST = 15


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half the hashes of the text's shingles."""
    import xxhash

    found = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) < words:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    start = np.cumsum(size + 1) - (size + 1)
    ends = (start + size)[words - 1 :]
    digest = xxhash.xxh64_intdigest
    n, ones = len(ends), np.zeros(BITS, dtype=np.int64)
    for lo in range(0, n, 1 << 16):
        spans = zip(start[lo : min(lo + (1 << 16), n)].tolist(), ends[lo : lo + (1 << 16)].tolist(), strict=True)
        hashes = np.array([digest(joined[i:j], seed) for i, j in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; `mark` tells rows of one doc_id with different texts apart."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t, words) for part in text_slices(b.column(2)) for t in part]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["doc_id", "mark", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(each, "doc_id long, mark long, fp long")


def _mixed(a: np.ndarray) -> np.ndarray:
    """A reversible 64-bit mix, so that signatures spread over partitions."""
    a = (a ^ (a >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    a = (a ^ (a >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return a ^ (a >> np.uint64(33))


def _signatures(most: int):
    """sig, fp: a segment (32 bits at most, one left out) and the place left out fill 38 bits, so signatures never collide."""
    segments = max(2, most // 2 + 1)
    first = [BITS * k // segments for k in range(segments + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(every), 1000):
                fp = every[lo : lo + 1000]
                out = []
                for start, end in zip(first, first[1:]):
                    bit = np.arange(end - start, dtype=np.uint64)
                    own = (fp >> np.uint64(start)) & np.uint64((1 << (end - start)) - 1)
                    left = own[:, None] & ~(np.uint64(1) << bit)[None, :]
                    out.append(left | ((bit + np.uint64(start))[None, :] << np.uint64(32)))
                sig = _mixed(np.concatenate(out, axis=1)).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.repeat(fp.view(np.int64), BITS))], ["sig", "fp"])

    return run


def _close(group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a group that differ in `most` bits at most, a block of rows at a time."""
    u = group.view(np.uint64)
    found = []
    step = max(1, (1 << 20) // len(u))
    for lo in range(0, len(u), step):
        i, j = np.nonzero(np.bitwise_count(u[lo : lo + step, None] ^ u[None, lo:]) <= most)
        found.append(np.stack([i, j])[:, j > i] + lo)
    a, b = np.concatenate(found, axis=1)
    return group[a], group[b]


def _pairs(most: int, hot: float):
    """Over rows sorted by signature: a, b for verified pairs; a, null for the members of a hot signature. At most `hot` are held, of 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, over = None, np.zeros(0, dtype=np.int64), False

        def rows(a: list[np.ndarray], b: list[np.ndarray], single: list[np.ndarray]) -> pa.RecordBatch:
            x = np.concatenate([*a, *single, np.zeros(0, np.int64)])
            y = np.concatenate([*b, *(np.zeros(len(s), np.int64) for s in single), np.zeros(0, np.int64)])
            none = np.arange(len(x)) >= sum(map(len, a))
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y, mask=none)], ["a", "b"])

        for batch in batches:
            sig, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(sig):
                continue
            edges = np.flatnonzero(sig[1:] != sig[:-1]) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(sig)]])
            a, b, single = [], [], []
            # groups of one row that neither continue the last batch nor may go on in the next need nothing
            many = np.flatnonzero(ends - starts > 1)
            for k in sorted({0, len(starts) - 1, *many.tolist()}):
                own = fp[starts[k] : ends[k]]
                if sig[starts[k]] == last:
                    if over:
                        single.append(own)
                        continue
                    own = np.concatenate([held, own])
                elif len(held) > 1 and not over:
                    for out, x in zip((a, b), _close(held, most), strict=True):
                        out.append(x)
                last, over, held = sig[starts[k]], len(own) > hot, own
                if over:
                    single.append(own)
                    held = held[:0]
            yield rows(a, b, single)
        if len(held) > 1 and not over:
            x, y = _close(held, most)
            yield rows([x], [y], [])

    return run


def _left_out(most: int):
    """sig, fp: all 64 bits but `most`, with their places, mixed to 64 bits; a link made of them is verified."""
    places = np.array(list(combinations(range(BITS), most)), dtype=np.uint64).reshape(math.comb(BITS, most), most)
    mask = ~np.bitwise_or.reduce(np.uint64(1) << places, axis=1)
    salt = _mixed(np.arange(1, len(mask) + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(every), 64):
                fp = every[lo : lo + 64]
                sig = _mixed((fp[:, None] & mask[None, :]) ^ salt[None, :]).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.repeat(fp.view(np.int64), len(mask)))], ["sig", "fp"])

    return run


def _to_first(most: int):
    """Over rows sorted by (signature, fingerprint): a link from each to the first of its signature, if close."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None
        for batch in batches:
            sig, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(sig):
                continue
            new = np.concatenate([[sig[0] != last], sig[1:] != sig[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
            head = np.where(at >= 0, fp[at], first if first is not None else 0)
            last, first = sig[-1], head[-1]
            near = (head != fp) & (np.bitwise_count(head.view(np.uint64) ^ fp.view(np.uint64)) <= most)
            yield pa.RecordBatch.from_arrays([pa.array(head[near]), pa.array(fp[near])], ["a", "b"])

    return run


def links(distinct: DataFrame, most: int = 2, hot: int = 64) -> DataFrame:
    """a < b: links between the distinct fingerprints (column fp) that give the same components as all pairs of `most` bits or fewer.

    Pairs outside of hot signatures are all there; within hot ones there is a path instead of each pair. With `most` over 2 none is hot.
    """
    if not 0 <= most <= MOST:
        raise ValueError(f"most = {most}: links are complete from 0 to {MOST} bits only")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out again: each fingerprint becomes 64 rows, and adaptive execution would put all of them, small as they are, in few tasks
    sigs = distinct.select("fp").repartition(n, "fp").mapInArrow(_signatures(most), "sig long, fp long")
    found = cut(sigs.repartition(n, "sig").sortWithinPartitions("sig").mapInArrow(_pairs(most, hot if most <= 2 else math.inf), "a long, b long"))
    both = found.where("b IS NOT NULL")
    if most > 2:
        return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    dense = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    wide = dense.mapInArrow(_left_out(most), "sig long, fp long").repartition(n, "sig").sortWithinPartitions("sig", "fp")
    both = both.unionByName(wide.mapInArrow(_to_first(most), "a long, b long"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: for every end of an edge (a, b), the least node that it reaches. Large-star and small-star steps by joins, each step a
    written table, until every edge leads from a root to a node of its own."""
    now = stored(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        # pairs: u, v; every v of u (all, or only the smaller ones and u itself) is led to the least of them
        # stored: with an exchange of its own on either side, Spark splits the join of a node with very many neighbours
        least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        led = pairs.join(least, "u")
        if larger:
            return led.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        return led.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))

    def unsettled(df: DataFrame) -> bool:
        """Whether a node hangs on two others, or on one and has one hanging on it."""
        ends = df.select(F.col("b").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(df.select(F.col("a").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 OR hangs = 1 AND holds = 1").limit(1).count() > 0

    while unsettled(now):
        ends = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(ends, True).where("a != b").distinct()
        now = stored(star(large.select(F.col("b").alias("u"), F.col("a").alias("v")), False).where("a != b").distinct(), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_groups(docs: DataFrame, words: int = 3, most: int = 2, hot: int = 64) -> DataFrame:
    """doc_id, mark, fp, component_id of every row: the smallest doc_id that its links reach, itself included."""
    marked = cut(fingerprints(docs, words))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = components(links(distinct, most, hot)).withColumnRenamed("node", "fp")
    whole = distinct.join(rooted, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(whole.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "mark", "fp", "component_id")


def one_of_each(docs: DataFrame, grouped: DataFrame | None = None, **options: int) -> DataFrame:
    """docs with one row of each group: the one of the smallest doc_id, and of its texts the one of the smallest hash.

    grouped: rows as of near_groups, where another rule than that of the fingerprints makes the groups. Only rows that may go or repeat are
    shuffled.
    """
    own, mark, odd = fresh(docs, "_id"), fresh(docs, "_mark"), fresh(docs, "_odd")
    grouped = near_groups(docs, **options) if grouped is None else grouped
    first = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("mark").alias("mark"))
    group = F.coalesce(F.col("component_id"), F.col("fp"))
    kept = cut(grouped.groupBy(group.alias("g"), F.col("component_id").isNull().alias("n")).agg(F.min(first).alias("f"), F.count("*").alias("rows")).select("f.id", "f.mark"))
    pairs = grouped.groupBy("doc_id", "mark").agg((F.count("*") > 1).alias("again"))
    met = pairs.join(kept, pairs["doc_id"].eqNullSafe(kept["id"]) & (pairs["mark"] == kept["mark"]), "left")
    told = cut(met.select(pairs["doc_id"].alias(own), pairs["mark"].alias(mark), kept["mark"].isNull().alias("goes"), "again").where("goes OR again"))
    keyed = sifted(docs.withColumns({own: F.col("doc_id").cast("long"), mark: F.xxhash64("text")}), odd, told, own, mark)
    gone = told.where("goes").toDF("id", "mark", "goes", "again")
    left = keyed.where(F.col(odd)).join(gone, keyed[own].eqNullSafe(gone["id"]) & (keyed[mark] == gone["mark"]), "left_anti")
    if told.where("again").limit(1).count():
        left = left.dropDuplicates([own, mark])
    return keyed.where(~F.col(odd)).select(*docs.columns).union(left.select(*docs.columns))
