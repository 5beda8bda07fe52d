"""Nearest neighbours by the tree against brute force: recall, exact products, order, odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from signalwright.llm import anntree, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, v string, key string, leaf string, tile string, rank string"


def table(spark, ids, x):
    return spark.createDataFrame([(i if i is None else int(i), None if r is None else [None if y is None else float(y) for y in r], 0, *["x"] * 5) for i, r in zip(ids, x, strict=True)], SCHEMA).repartition(4)


def clouds(n, seed, d=16):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, d)) * 3
    return (centres[draw.integers(0, 12, n)] + draw.normal(size=(n, d))).astype(np.float32).astype(float)


def exact(out, ids, x, nearest=20):
    """Scores are the products, ranks go by score and id, and no query finds itself."""
    at = {int(i): k for k, i in enumerate(ids)}
    by: dict = {}
    for r in out.collect():
        by.setdefault(r["query_id"], []).append(r)
        assert r["score"] == pytest.approx(float(x[at[r["query_id"]]] @ x[at[r["vec_id"]]]), rel=1e-12, abs=1e-12)
        assert r["vec_id"] != r["query_id"]
    for rows in by.values():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        assert len(rows) == min(nearest, len(ids) - 1)
    return by


def test_recall_of_the_tree(spark):
    """Many leaves, few of them visited."""
    x, ids = clouds(6000, 1), np.arange(6000)
    out = anntree.search(table(spark, ids, x), leaf_rows=60).cache()
    by = exact(out, ids, x)
    assert sorted(by) == list(range(0, 6000, 20))
    assert anntree.measured_recall(out, ids, x, np.arange(0, 6000, 20)) >= 0.93


def test_widening():
    x = clouds(4000, 2)
    tree = anntree.fit(x, 80)
    assert 60 <= tree.leaves <= 90
    leaf = tree.leaf_of(x)
    assert len(set(leaf)) >= 60
    q = np.arange(0, 4000, 40)
    true = anntree.brute_force(np.arange(4000), x, q, 20)
    leaves_of = [[int(leaf[j]) for j in true[int(i)]] for i in q]
    few, some, all_ = (anntree.widened(tree, x[q], leaves_of, r) for r in (0.5, 0.9, 1.0))
    assert few[0] < some[0] <= all_[0] <= tree.leaves
    assert few[1] >= 0.5 and some[1] >= 0.9 and all_[1] == 1.0
    assert some[0] < tree.leaves // 2
    for own in tree.visits(x[q], tree.leaves):
        assert sorted(own) == list(range(tree.leaves))


def test_the_priority_queue_opens_the_best_first():
    x = clouds(3000, 3)
    tree = anntree.fit(x, 40)
    for q in x[:20]:
        worth = {n: float(q @ tree.centres[n]) + anntree.SLACK * float(np.linalg.norm(q)) * float(tree.spread[n]) for n in range(len(tree.leaf))}
        opened, out = {0}, []
        while opened:
            best = max(opened, key=lambda n: worth[n])
            opened.remove(best)
            opened |= set(tree.children[best])
            if not tree.children[best]:
                out.append(tree.leaf[best])
        assert tree.visits(q[None], tree.leaves) == [out]


@pytest.mark.parametrize("block,tile", [(50, 7), (8192, 32_768)])
def test_blocks_and_tiles_of_a_hot_leaf(spark, monkeypatch, block, tile):
    """A third of the rows are one vector and another third lie close together; leaves are cut and their queries dealt out."""
    monkeypatch.setattr(anntree, "BLOCK", block)
    monkeypatch.setattr(anntree, "TILE", tile)
    x, ids = clouds(1500, 4), np.arange(1500) * 5
    x[:500] = x[0]
    x[500:1000] = (x[500] + np.random.default_rng(5).normal(size=(500, 16)) * 1e-3).astype(np.float32)
    order = np.random.default_rng(6).permutation(1500)
    out = anntree.search(table(spark, ids[order], x[order]), leaf_rows=200, recall=1.0).cache()
    exact(out, ids, x)
    assert anntree.measured_recall(out, ids, x, np.flatnonzero(ids % 20 == 0)) >= 0.999
    copies = [r["vec_id"] for r in out.where("query_id = 40").orderBy("rank").collect() if x[r["vec_id"] // 5] @ x[0] == x[0] @ x[0]]
    assert copies == sorted(copies)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    ids = [0, 20, 40, 60, 80, 100, 1, 2, 3, None, 120, 140, 140, 20, 160]
    x = [[1, 0], [0, 1], None, [0, 0], [nan, 1], [inf, 1], [1, None], [2, 0], [0, 2], [1, 1], [], [1, 1], [-1, 1], [0, 1], [1, 2, 3]]
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in anntree.search(table(spark, ids, x)).collect()}
    # 20 twice is one row; 140 is two rows, each a query; 40, 60, 80, 100, 120, 160 and the null id take no part
    assert {g for g in got if g[0] == 0} == {(0, 1, 2, 2.0), (0, 2, 140, 1.0), (0, 3, 3, 0.0), (0, 4, 20, 0.0), (0, 5, 140, -1.0)}
    assert {g[2] for g in got if g[0] == 20} == {0, 2, 3, 140}
    assert {g[0] for g in got} == {0, 20, 140}
    assert sorted(g[1] for g in got if g[0] == 140) == [1, 1, 2, 2, 3, 3, 4, 4]
    assert anntree.search(spark.createDataFrame([], SCHEMA)).collect() == []
    assert anntree.search(table(spark, [0], [[1, 2]])).collect() == []
    assert anntree.search(table(spark, [7, 9], [[1, 2], [3, 4]])).collect() == []


def test_registered_query(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toArrow()
    ids, x = t["vec_id"].to_numpy(), np.stack(t["embedding"].to_numpy()).astype(float)
    out = queries.QUERIES["op13_nearest_neighbours"](spark, SF).cache()
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    exact(out, ids, x)
    assert anntree.measured_recall(out, ids, x, np.flatnonzero(ids % 20 == 0)) >= 0.95
