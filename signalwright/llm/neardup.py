"""The near-dedup of `simhash` for texts instead of fingerprints: texts whose sets of word shingles have a Jaccard similarity of `least`
or more are linked.

A fingerprint can't find these: at a similarity of 0.8 some ten of 64 bits differ, and some 17 for short texts, so that segments with one
wildcard would have to be so short that nearly all texts meet in them. Candidates come from MinHash instead: 80 minima of a text's shingle
hashes in 20 bands of four; texts that agree in a band are candidates. A pair of similarity 0.8 agrees in no band with probability
0.00003, one of 0.85 with 5e-7. Each candidate is verified on the whole sets of 64-bit shingle hashes, so no pair below `least` is linked.
Links become components as in `simhash`.

Candidates are compared only where that can tell something: texts that are linked already, over whatever path, needn't be compared again.
First a text meets the one before it in its band's group, in an order drawn anew for each group, so that the work is in proportion to
the rows, however large the groups; a family of near copies is mostly one component then. After that, all pairs across components of a
group of up to `SMALL` texts are compared; in a larger group those outside of its largest component are queries: blocks of them meet
chunks of the group, a tile of bounded size at a time. So every candidate pair is compared or joined by a path of links: no
group is too large, and none is cut short.

Defined results: words are split at ASCII white space and lower-cased in ASCII; a text of fewer words than a shingle has them all as its only
shingle; very long texts are read whole; null texts and those without a word are copies of each other; texts of one 64-bit hash are one
text; rows that repeat a doc_id, or each other, each get their group; a component of null doc_ids alone has a null id; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalwright.llm._common import sifted, stored, text_slices
from signalwright.llm.simhash import _mixed, components

BANDS, DEPTH = 20, 4
#: Up to so many texts of a band's group are compared with each other at once.
SMALL = 32
#: About the most queries, shingles of queries, and other texts of a tile.
QUERIES, HELD, CHUNK = 256, 1 << 18, 4096
_SALTS = _mixed(np.arange(1, BANDS * DEPTH + 1, dtype=np.uint64))


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The sorted 64-bit hashes of the text's different shingles."""
    import xxhash

    found = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not found:
        return np.zeros(1, dtype="<u8")
    joined = b" ".join(found)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(joined)], dtype="<u8")
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    start = np.cumsum(size + 1) - (size + 1)
    ends = (start + size)[words - 1 :]
    digest, n = xxhash.xxh64_intdigest, len(ends)
    return np.unique(np.fromiter((digest(joined[i:j]) for i, j in zip(start[:n].tolist(), ends.tolist(), strict=True)), dtype="<u8", count=n))


def bands(own: np.ndarray) -> np.ndarray:
    """A signature for each band: its minima mixed with its number."""
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(own), 1 << 12):
        np.minimum(least, _mixed(own[lo : lo + (1 << 12), None] ^ _SALTS[None, :]).min(axis=0), out=least)
    sig = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, DEPTH).T:
        sig = _mixed(sig ^ part)
    return sig


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [bands(shingles(t, words)) for part in text_slices(b.column(2)) for t in part]
            sigs = pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, sigs)], ["doc_id", "mark", "sigs"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t, words).tobytes() for part in text_slices(b.column(1)) for t in part]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 8 for x in found], pa.int64()), pa.array(found, pa.binary())], ["mark", "n", "own"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (sig, mark) sorted by signature, in an order of each group's own: a < b, each text and the one before it in its group."""
    last_sig = last = None
    for batch in batches:
        sig, mark = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if not len(sig):
            continue
        if last is not None:
            sig, mark = np.concatenate([[last_sig], sig]), np.concatenate([[last], mark])
        same = sig[1:] == sig[:-1]
        one, two = mark[:-1][same], mark[1:][same]
        last_sig, last = sig[-1], mark[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of `least` or more."""
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= least * (len(x) + len(y) - shared)


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(k) for k in (2, 3))
            close = pa.array([similar(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), least) for x, y in zip(one, two, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(close), batch.column(1).filter(close)], ["a", "b"])

    return run


def _across(rows: DataFrame, main: DataFrame) -> DataFrame:
    """a < b: the pairs of different roots within a signature: whoever isn't of its group's largest root meets all of the group."""
    few = rows.join(main, "sig").where("root != main").select("sig", F.col("mark").alias("_m"), F.col("root").alias("_r"))
    met = few.join(rows, "sig").where("_r != root")
    return met.select(F.least("_m", "mark").alias("a"), F.greatest("_m", "mark").alias("b")).distinct()


def _tiled(rows: DataFrame, main: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a < b: the links of different roots within a signature, by tiles. rows: sig, mark, root; main: sig, main, all."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = stored(rows.join(main, "sig").where("root != main").join(sets.select("mark", "n"), "mark").select("sig", "mark", "root", "n", "all"), "queries")
    blocks = F.ceil(F.greatest(F.count("*") / QUERIES, F.sum("n") / HELD)).cast("int")
    shape = stored(few.groupBy("sig").agg(blocks.alias("blocks"), F.ceil(F.max("all") / CHUNK).cast("int").alias("chunks")), "tiles")
    some = lambda salt, of: F.pmod(F.xxhash64(F.lit(salt), "mark"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    queries = few.join(shape, "sig").select("sig", some("block", "blocks").alias("block"), every("chunks").alias("chunk"), F.lit(0).alias("role"), "mark", "root")
    members = rows.join(shape, "sig").select("sig", every("blocks").alias("block"), some("chunk", "chunks").alias("chunk"), F.lit(1).alias("role"), "mark", "root")
    tiles = queries.unionByName(members).join(sets.select("mark", "own"), "mark").select("sig", "block", "chunk", "role", "mark", "root", "own")
    ordered = tiles.repartition(n, "sig", "block", "chunk").sortWithinPartitions("sig", "block", "chunk", "role", "mark")
    return ordered.mapInArrow(_tile(least), "a long, b long").distinct()


def _tile(least: float):
    """Over rows sorted by tile, queries first: the links between queries and other texts. Only a tile's queries are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, index = None, [], None
        for batch in batches:
            a, b = [], []
            for *key, role, mark, root, own in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if key != tile:
                    tile, held, index = key, [], None
                found = np.frombuffer(own, "<u8")
                if role == 0:
                    held.append((mark, root, found))
                    continue
                if not held:  # no query has this block's number
                    continue
                if index is None:
                    every = np.concatenate([x for _, _, x in held])
                    whose = np.repeat(np.arange(len(held)), [len(x) for _, _, x in held])
                    order = np.argsort(every, kind="stable")
                    index = every[order], whose[order], np.array([len(x) for _, _, x in held]), np.array([r for _, r, _ in held])
                every, whose, sizes, roots = index
                lo, hi = np.searchsorted(every, found, "left"), np.searchsorted(every, found, "right")
                times = hi - lo
                at = np.repeat(hi - np.cumsum(times), times) + np.arange(times.sum())
                shared = np.bincount(whose[at], minlength=len(held))
                for k in np.flatnonzero((shared >= least * (sizes + len(found) - shared)) & (roots != root)):
                    a.append(min(mark, held[k][0]))
                    b.append(max(mark, held[k][0]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _compared(met: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that are links."""
    size = sets.select("mark", "n")
    sized = met.join(size.toDF("a", "_n"), "a").join(size.toDF("b", "_m"), "b").where(F.least("_n", "_m") >= F.lit(least) * F.greatest("_n", "_m")).select("a", "b")
    both = sized.join(sets.select(F.col("mark").alias("a"), F.col("own").alias("_one")), "a").join(sets.select(F.col("mark").alias("b"), F.col("own").alias("_two")), "b")
    return both.select("a", "b", "_one", "_two").mapInArrow(_verified(least), "a long, b long")


def _roots(shared: DataFrame, sets: DataFrame, least: float, hot: int) -> DataFrame:
    """mark, root: the groups of the marks of `shared` (sig, mark), by their sets (mark, n, own)."""
    n = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = shared.repartition(n, "sig").sortWithinPartitions("sig", F.xxhash64("mark", "sig")).select("sig", "mark")
    first = stored(ordered.mapInArrow(_neighbours, "a long, b long").distinct(), "met")
    links = stored(_compared(first, sets, least), "links")
    marks = shared.select("mark").distinct()
    rooted = stored(marks.join(components(links).toDF("_old", "_new"), F.col("mark") == F.col("_old"), "left").select("mark", F.coalesce("_new", "mark").alias("root")), "roots")

    rows = shared.join(rooted, "mark").select("sig", "mark", "root")
    by_root = rows.groupBy("sig", "root").agg(F.count("*").alias("c"))
    groups = by_root.groupBy("sig").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.sum("c").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    main = stored(groups.select("sig", "main", "all"), "groups")
    # stored: with an exchange of its own on either side, Spark splits the join of a large group
    left = stored(rows.join(main.select("sig", "all"), "sig"), "left")
    small, large = (left.where(c).select("sig", "mark", "root") for c in (F.col("all") <= hot, F.col("all") > hot))
    met = _across(small, main.where(F.col("all") <= hot).select("sig", "main")).join(first, ["a", "b"], "left_anti")
    more = stored(_compared(met, sets, least).unionByName(_tiled(large, main.where(F.col("all") > hot), sets, least)), "links")
    if not more.limit(1).count():
        return rooted
    tops = rooted.toDF("_x", "_root")
    ends = more.join(tops.toDF("a", "_ra"), "a").join(tops.toDF("b", "_rb"), "b").select(F.col("_ra").alias("a"), F.col("_rb").alias("b"))
    led = components(ends).toDF("_old", "_new")
    return rooted.join(led, F.col("root") == F.col("_old"), "left").select("mark", F.coalesce("_new", "root").alias("root"))


def near_groups(docs: DataFrame, words: int = 5, least: float = 0.8, hot: int = SMALL, also: DataFrame | None = None) -> DataFrame:
    """doc_id, mark, fp, component_id of every row: a hash of its text, that of its group, and the smallest doc_id that its links reach.

    also: mark, group: further candidates, as the components of another method; texts of one group meet as those of one band do, and are
    verified as they are.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    rows = stored(keyed.mapInArrow(_sketches(words), "doc_id long, mark long, sigs array<long>"), "sketches")
    sigs = rows.select(F.explode("sigs").alias("sig"), "mark")
    if also is not None:
        sigs = sigs.unionByName(also.select(F.xxhash64(F.lit("also"), "group").alias("sig"), "mark"))
    many = stored(sigs.groupBy("sig").agg(F.min("mark").alias("_lo"), F.max("mark").alias("_hi")).where("_lo < _hi").select("sig"), "bands")
    few = sifted(sigs, "_some", many, "sig").where("_some").select("sig", "mark").distinct()
    shared = stored(few.join(many, "sig", "left_semi"), "shared")
    # texts whose mark shares a band are told apart where they are, and only their sets travel; a few sets that nobody asks for do no harm
    need = shared.select("mark").distinct()
    own = sifted(keyed.select("mark", "text"), "_some", need, "mark").where("_some").select("mark", "text")
    sets = stored(own.mapInArrow(_sets(words), "mark long, n long, own binary").dropDuplicates(["mark"]), "shingles")
    rooted = _roots(shared, sets, least, hot)
    distinct = rows.groupBy("mark").agg(F.min("doc_id").alias("least"))
    whole = distinct.join(rooted, "mark", "left").select("mark", "least", F.coalesce("root", "mark").alias("fp"))
    named = whole.groupBy("fp").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "mark").join(whole.select("mark", "fp").join(named, "fp"), "mark").select("doc_id", "mark", "fp", "component_id")
