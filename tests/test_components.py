"""Forests within tasks, and components of chains and hubs in few rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearkin.operators import components


def brute(edges):
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in root}


@pytest.mark.parametrize("seed", range(6))
def test_forest(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-50, 50, (2, [0, 1, 30, 60, 90, 400][seed]))
    low, high = np.minimum(a, b), np.maximum(a, b)
    x, y = components.forest(low, high)
    edges = list(zip(low.tolist(), high.tolist(), strict=True))
    got = list(zip(x.tolist(), y.tolist(), strict=True))
    want = brute(edges)
    assert sorted(got) == sorted({(r, n) for n, r in want.items() if n != r} | {(p, q) for p, q in edges if p == q})


def test_forest_of_a_chain_and_of_text():
    n = np.arange(100_000)
    order = np.random.default_rng(1).permutation(len(n))
    x, y = components.forest(n[order], n[order] + 1)
    assert (x == 0).all() and len(y) == len(n)
    x, y = components.forest(np.array(["b", "a", "c"], object), np.array(["c", "d", "c"], object))
    assert sorted(zip(x, y, strict=True)) == [("a", "d"), ("b", "c"), ("c", "c")]


@pytest.mark.parametrize("piece", [components.FOREST, 700])
def test_rounds(spark, monkeypatch, piece):
    """Pieces of any size give the same components; those of a task need few rounds."""
    monkeypatch.setattr(components, "FOREST", piece)
    rounds, plain = [], components._small_star

    def counted(*a):
        rounds.append(1)
        return plain(*a)

    monkeypatch.setattr(components, "_small_star", counted)
    n = 20_000
    chain = spark.range(0, n, 1, 7).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    hub = spark.range(1, n, 1, 5).select((F.col("id") + 10**6).alias("a"), F.lit(10**9).cast("long").alias("b"))
    loops = spark.createDataFrame([(-5, -5), (3, 3), (None, 7)], "a long, b long")
    found = components.connected_components(chain.union(hub).union(hub).union(loops)).groupBy("component").agg(F.count("*").alias("n")).collect()
    assert {tuple(r) for r in found} == {(0, n + 1), (10**6 + 1, n), (-5, 1)}
    assert len(rounds) <= (3 if piece > n else 6)
