"""Links of any number of bits have the components of all pairs."""

from __future__ import annotations

import collections
import random

import pytest
from test_operators import brute_groups

from signalwright.llm import simhash


@pytest.mark.parametrize("most", [0, 1, 3, 4, 7, 11])
@pytest.mark.parametrize("hot", [3, 64])
def test_links_of_any_number_of_bits(spark, most, hot):
    rng = random.Random(most)
    prints = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        prints |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, most + 3))) for _ in range(30)}
        prints.add(center ^ sum(1 << b for b in [*range(most // 2), *range(32, 32 + most - most // 2)]))  # differs in either half
    own = list(enumerate(sorted(prints)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in own], "fp long").repartition(5)
    rooted = {r["node"] & (1 << 64) - 1: r["root"] for r in simhash.components(simhash.links(df, most=most, hot=hot)).collect()}
    want = {int(f, 16): c for _, f, c in brute_groups(own, most)}
    groups = collections.defaultdict(set)
    for _, f in own:
        groups[rooted.get(f, f - (1 << 64) if f >> 63 else f)].add(want[f])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_pairs_that_differ_two_and_two(spark):
    df = spark.createDataFrame([(0,), (0b11 | 0b11 << 32,)], "fp long")
    assert simhash.links(df, most=4).count() == 1


@pytest.mark.parametrize("most", [-1, 16])
def test_values_that_are_not_covered(spark, most):
    with pytest.raises(ValueError, match="most"):
        simhash.links(spark.createDataFrame([(0,)], "fp long"), most=most)
