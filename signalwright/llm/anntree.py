"""Approximate nearest neighbours by largest inner product: a k-means tree, searched best bin first.

* Fit: k-means splits a bounded sample into BRANCH parts, and each part again, until a part stands for LEAF_ROWS rows of the table or there
  are MOST_LEAVES leaves. The tree is what is sent to the tasks; its size has that bound, whatever the table's.
* Index: every row goes down the tree to the nearest centre at each level. A leaf with many rows (a third of all, say) is cut into blocks.
* Search: a query keeps the children of the nodes it has opened in a priority queue, ordered by its product with the centre plus
  SLACK times the spread of the node's rows, and visits the leaves in the order in which they come out.
* Calibration: for a bounded, drawn part of the queries the true neighbours are found by reading all rows once; the number of leaves is
  widened, by LEAST_STEP or a sixteenth at a time, until the recall over these queries reaches RECALL. Then every query visits as many.

The visits are made in two rounds: what a query finds in its first leaves is a floor, and of the rows of the other leaves only those that
reach it leave their task. A query meets a block as a tile: its rows as one matrix, the queries that visit its leaf passing by in batches; where many queries visit one
leaf, they are dealt over several tiles. So no task holds more than a block, and the table's hot parts spread. Of equal vectors only the
NEAREST + 1 with the least ids can be among any query's neighbours, so the others are left out before the search: that is exact.

Defined results: vectors that are null, zero, or hold a null, NaN or infinite component take no part, nor do those without a vec_id, nor
those with another dimension than most vectors have (the least of equally frequent ones). Rows equal in vec_id and vector are one
row; vec_ids that share a vector are each a candidate; a vec_id with several vectors is several rows, each found and each searched for
itself, and none of them is a candidate for its own id. No or one row: an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalwright.llm._common import cut, stored

NEAREST = 20
#: Queries are the rows whose vec_id this divides.
EVERY = 20
#: Of the fit: rows of the sample at most, children of a node, rows of the table for a leaf, leaves at most, turns of k-means.
SAMPLE, BRANCH, LEAF_ROWS, MOST_LEAVES, TURNS = 65_536, 8, 1024, 4096, 8
#: Of the search: how much the spread of a node counts; queries of the calibration at most; recall to reach; leaves more at a time.
SLACK, TRIED, RECALL, LEAST_STEP = 1.0, 400, 0.96, 1
#: One in EARLY of the visits comes first and gives each query's floor.
EARLY = 8
#: Rows of a block, queries of a tile, queries in one product.
BLOCK, TILE, BATCH = 8192, 32_768, 256
FOUND = "query_id long, query_key long, vec_id long, score double"


@dataclass
class Tree:
    """children[i]: the nodes below node i (none: a leaf); centre and spread of each node; leaf[i]: the number of the leaf, or -1."""

    centres: np.ndarray
    spread: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centre, level by level."""
        out = np.empty(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[self.children[node]]
            nearest = _nearest(x[rows], c)
            todo += [(child, rows[nearest == i]) for i, child in enumerate(self.children[node]) if (nearest == i).any()]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[list[int]]:
        """The first `most` leaves of each query, best bin first."""
        worth = q @ self.centres.T + SLACK * np.linalg.norm(q, axis=1)[:, None] * self.spread[None, :]
        return [self._walk(-own, most) for own in worth]

    def _walk(self, cost: np.ndarray, most: int) -> list[int]:
        """cost: of each node, least first."""
        queue, out = [(cost[0], 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (cost[child], child))
            else:
                out.append(self.leaf[node])
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - (centres * centres).sum(1) / 2, axis=1)


def _k_means(x: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """The part of each row; at most k parts, none empty."""
    centres = x[draw.choice(len(x), k, replace=False)]
    for _ in range(TURNS):
        part = _nearest(x, centres)
        sums = np.zeros((k, x.shape[1]))
        np.add.at(sums, part, x)
        n = np.bincount(part, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.unique(_nearest(x, centres), return_inverse=True)[1]


def fit(sample: np.ndarray, leaves: int, seed: int = 7) -> Tree:
    """A tree of about `leaves` leaves: always the node with the most sample rows is split next. Rows that are alike stay in one leaf."""
    draw = np.random.default_rng(seed)

    def describe(x: np.ndarray) -> tuple[np.ndarray, float]:
        centre = x.mean(0)
        return centre, float(np.sqrt(((x - centre) ** 2).sum(1).mean() / x.shape[1]))

    nodes = [describe(sample)]
    children: list[list[int]] = [[]]
    heap, done = [(-len(sample), 0, sample)], 1
    while heap and done < leaves:
        _, node, x = heapq.heappop(heap)
        if len(x) < 2:
            continue
        part = _k_means(x, min(BRANCH, leaves - done + 1, len(x)), draw)
        if part.max() == 0:
            continue
        for i in range(part.max() + 1):
            own = x[part == i]
            children[node].append(len(nodes))
            nodes.append(describe(own))
            children.append([])
            heapq.heappush(heap, (-len(own), len(nodes) - 1, own))
        done += part.max()
    bottom = [i for i, below in enumerate(children) if not below]
    number = dict(zip(bottom, range(len(bottom)), strict=True))
    return Tree(np.array([c for c, _ in nodes]), np.array([s for _, s in nodes]), children, [number.get(i, -1) for i in range(len(nodes))])


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length, as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    v = F.col(vec).cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(F.size("v") > 0)
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0.0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    # dimensions are few; one row is left of them
    common = sizes.orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("v") == (common[0]["d"] if common else -1))


def candidates(rows: DataFrame, nearest: int) -> DataFrame:
    """Without the rows that can't be among any query's nearest: of equal vectors only the nearest + 1 least ids are left."""
    own = Window.partitionBy("v").orderBy("vec_id")
    ranked = rows.withColumn("_r", F.dense_rank().over(own)).where(F.col("_r") <= nearest + 1)
    return ranked.withColumn("_was", F.lag("vec_id").over(own)).where(F.col("_was").isNull() | (F.col("_was") != F.col("vec_id"))).drop("_r", "_was")


def _assign(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = tree.leaf_of(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf, pa.int32())], names=["vec_id", "v", "leaf"])

    return run


def _visit(tree: Tree, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaves = pa.array(tree.visits(_matrix(b.column(2)), most), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, leaves], names=["vec_id", "key", "v", "leaves"])

    return run


def best(scores: np.ndarray, q: np.ndarray, x: np.ndarray, own: np.ndarray, ids: np.ndarray, nearest: int, floors: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query (a row of q) the places of its best rows of x, and their products: summed the same way wherever they are found. None
    is below the query's floor."""
    scores[own[:, None] == ids[None, :]] = -np.inf
    if floors is not None:
        scores[scores < floors[:, None] - 1e-9 * np.maximum(1.0, np.abs(floors[:, None]))] = -np.inf
    for i, (s, v) in enumerate(zip(scores, q, strict=True)):
        if len(s) > nearest:
            least = np.partition(s, len(s) - nearest)[len(s) - nearest]
            near = np.flatnonzero(s >= least - 1e-9 * max(1.0, abs(least)) if np.isfinite(least) else s > -np.inf)
        else:
            near = np.flatnonzero(s > -np.inf)
        true = (x[near] * v).sum(1)
        if floors is not None:
            near, true = near[true >= floors[i]], true[true >= floors[i]]
        first = np.lexsort((ids[near], -true))[:nearest]
        yield near[first], true[first]


def _tiles(nearest: int):
    """Rows come tile by tile, the tile's rows (with no query key) before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, ids, x = None, [], np.empty(0, np.int64), None
        for b in batches:
            if not b.num_rows:
                continue
            tile = b.column(0).to_numpy()
            kind = b.column(1).to_numpy()
            vec_id, key, floor, v = b.column(2).to_numpy(), b.column(3).fill_null(0).to_numpy(), b.column(4).fill_null(-np.inf).to_numpy(), _matrix(b.column(5))
            at = 0
            while at < b.num_rows:
                end = at + int(np.argmax(np.append((tile[at:] != tile[at]) | (kind[at:] != kind[at]), True)))
                if tile[at] != now:
                    now, parts, ids, x = tile[at], [], np.empty(0, np.int64), None
                if kind[at] == 0:
                    parts.append(v[at:end])
                    ids = np.concatenate([ids, vec_id[at:end]])
                elif parts:
                    x = np.concatenate(parts) if x is None else x
                    for i in range(at, end, BATCH):
                        j = min(end, i + BATCH)
                        out: list[list[np.ndarray]] = [[], [], [], []]
                        for k, (rows, true) in enumerate(best(v[i:j] @ x.T, v[i:j], x, vec_id[i:j], ids, nearest, floor[i:j])):
                            for o, y in zip(out, (np.full(len(rows), vec_id[i + k]), np.full(len(rows), key[i + k], np.int64), ids[rows], true), strict=True):
                                o.append(y)
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["query_id", "query_key", "vec_id", "score"])
                at = end

    return run


def _first(found: DataFrame, nearest: int) -> DataFrame:
    w = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= nearest)


def _true_neighbours(indexed: DataFrame, tried: list, nearest: int) -> DataFrame:
    """The exact neighbours of a bounded list of queries (vec_id, key, v), with their leaves, by one pass over all rows; a task sends NEAREST rows a
    query, however many it reads."""
    own, keys, q = np.array([r["vec_id"] for r in tried]), np.array([r["key"] for r in tried]), np.array([r["v"] for r in tried])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a task has found so far, for each query; the worst of a full list is the floor of what comes
        found = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int32)) for _ in own]
        floors = np.full(len(own), -np.inf)
        for b in batches:
            if not b.num_rows:
                continue
            ids, x, leaf = b.column(0).to_numpy(), _matrix(b.column(1)), b.column(2).to_numpy()
            for k, (rows, true) in enumerate(best(q @ x.T, q, x, own, ids, nearest, floors)):
                if len(rows):
                    both = [np.concatenate(p) for p in zip(found[k], (true, ids[rows], leaf[rows]), strict=True)]
                    first = np.lexsort((both[1], -both[0]))[:nearest]
                    found[k] = tuple(p[first] for p in both)
                    floors[k] = found[k][0][-1] if len(first) == nearest else -np.inf
        n = [len(f[0]) for f in found]
        if sum(n):
            columns = [np.repeat(own, n), np.repeat(keys, n), *(np.concatenate([f[i] for f in found]) for i in (1, 0, 2))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "query_key", "vec_id", "score", "leaf"])

    return _first(indexed.select("vec_id", "v", "leaf").mapInArrow(run, FOUND + ", leaf int"), nearest)


def widened(tree: Tree, queries: np.ndarray, leaves_of: list[list[int]], recall: float) -> tuple[int, float]:
    """The least number of visits (by steps) at which the queries reach the recall, and that recall. leaves_of: of each one's neighbours."""
    order = [{leaf: i for i, leaf in enumerate(o)} for o in tree.visits(queries, tree.leaves)]
    ranks = np.sort(np.array([o[leaf] for o, own in zip(order, leaves_of, strict=True) for leaf in own]))
    most, reached = 0, 1.0 if not len(ranks) else 0.0
    while most < tree.leaves and reached < recall:
        most = min(tree.leaves, most + max(LEAST_STEP, most // 16))
        reached = np.searchsorted(ranks, most) / len(ranks)
    return max(1, most), float(reached)


def search(vectors: DataFrame, every: int = EVERY, nearest: int = NEAREST, recall: float = RECALL, vec: str = "embedding", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the `nearest` nearest rows found for each row whose vec_id `every` divides."""
    spark = vectors.sparkSession
    key = F.xxhash64("v")
    rows = usable(vectors, vec)
    pool = candidates(rows, nearest)
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", key.alias("key"), "v").dropDuplicates(["vec_id", "key"])
    kept = stored(pool, "anntree-rows")
    n = kept.count()
    # about SAMPLE rows, whatever n is; the rows drawn are the same each time
    near_zero = F.abs(F.xxhash64("vec_id", F.lit(11)) % 1_000_000_007)
    sample = kept.where(near_zero < int(1_000_000_007 * min(1.0, 0.97 * SAMPLE / max(1, n)))).limit(SAMPLE).select("v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = _matrix(sample.column(0).combine_chunks())
    tree = fit(x, max(1, min(MOST_LEAVES, -(-n // leaf_rows), len(x) // 4)))

    indexed = stored(kept.mapInArrow(_assign(tree), "vec_id long, v array<double>, leaf int"), "anntree-index")
    asked = cut(queries)
    total = asked.count()
    drawn = F.abs(F.xxhash64("vec_id", "key", F.lit(5)) % 1_000_000_007)
    tried = asked.where(drawn < int(1_000_000_007 * min(1.0, TRIED / max(1, total)))).limit(2 * TRIED).collect()
    true: dict[tuple, list[int]] = {}
    for r in _true_neighbours(indexed, tried, nearest).select("query_id", "query_key", "leaf").collect() if tried else []:
        true.setdefault((r[0], r[1]), []).append(r[2])
    known = [r for r in tried if (r["vec_id"], r["key"]) in true]
    most = widened(tree, np.array([r["v"] for r in known]), [true[r["vec_id"], r["key"]] for r in known], recall)[0] if known else tree.leaves

    visits = cut(asked.mapInArrow(_visit(tree, most), "vec_id long, key long, v array<double>, leaves array<int>"))
    # what is found in the first leaves is a floor for the others: of their rows only those that reach it are sent on
    early = max(1, most // EARLY)
    sizes = {r[0]: -(-r[1] // BLOCK) for r in indexed.groupBy("leaf").count().collect()}
    none = F.lit(None).cast("double")
    found = cut(_first(_searched(indexed, visits.select("vec_id", "key", "v", F.slice("leaves", 1, early).alias("leaves"), none.alias("floor")), sizes, nearest), nearest))
    if most > early:
        floors = found.where(F.col("rank") == nearest).select(F.col("query_id").alias("vec_id"), F.col("query_key").alias("key"), F.col("score").alias("floor"))
        others = visits.withColumn("leaves", F.slice("leaves", early + 1, most)).join(floors, ["vec_id", "key"], "left")
        found = _first(found.drop("rank").unionByName(_searched(indexed, others, sizes, nearest)), nearest)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _searched(indexed: DataFrame, visits: DataFrame, sizes: dict[int, int], nearest: int) -> DataFrame:
    """Tiles: a block of a leaf's rows against a part of the leaf's queries. sizes: the blocks of each leaf."""
    # two numbers a leaf: its blocks, and into how many parts its queries are dealt
    crowd = visits.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()
    plan = visits.sparkSession.createDataFrame([(r[0], sizes.get(r[0], 0), -(-r[1] // TILE)) for r in crowd], "leaf int, blocks int, turns int")
    plan = F.broadcast(plan)  # MOST_LEAVES rows at most
    spread = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    tile = lambda block, turn: ((F.col("leaf").cast("long") * 1_048_576 + block) * 1_048_576 + turn).alias("tile")
    some = F.col("blocks") * F.col("turns") > 0
    data = indexed.join(plan, "leaf").where(some).withColumn("_t", spread(F.col("turns"))).withColumn("_b", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    data = data.select(tile(F.col("_b"), F.col("_t")), F.lit(0).alias("kind"), "vec_id", F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("floor"), "v")
    asked = visits.select("vec_id", "key", "v", "floor", F.explode("leaves").alias("leaf")).join(plan, "leaf").where(some)
    asked = asked.withColumn("_b", spread(F.col("blocks"))).withColumn("_t", F.pmod(F.xxhash64("vec_id", "key"), F.col("turns")))
    asked = asked.select(tile(F.col("_b"), F.col("_t")), F.lit(1).alias("kind"), "vec_id", "key", "floor", "v")
    return data.unionByName(asked).repartition("tile").sortWithinPartitions("tile", "kind").mapInArrow(_tiles(nearest), FOUND)


def brute_force(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, nearest: int) -> dict[int, list[int]]:
    """The exact neighbours of the rows at the places `queries`, for tests and for measuring recall."""
    return {int(ids[i]): [int(ids[j]) for j in rows] for i, (rows, _) in zip(queries, best(x[queries] @ x.T, x[queries], x, ids[queries], ids, nearest), strict=True)}


def measured_recall(found: DataFrame, ids: np.ndarray, x: np.ndarray, queries: np.ndarray, nearest: int = NEAREST) -> float:
    own: dict[int, set[int]] = {}
    for r in found.collect():
        own.setdefault(r["query_id"], set()).add(r["vec_id"])
    true = brute_force(ids, x, queries, nearest)
    return sum(len(own.get(q, set()) & set(t)) for q, t in true.items()) / max(1, sum(map(len, true.values())))
