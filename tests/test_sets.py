"""Packed sets of whole numbers, and lineage by them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.operators import graphs, sets
from tests.test_graphs import reach

ENDS = [-(1 << 63), (1 << 63) - 1, 0, 5, -7, 1 << 62]


@pytest.mark.parametrize("high", [10, 1000, 1 << 40, None])
def test_sets_come_back(high):
    r = np.random.default_rng(1)
    for _ in range(100):
        parts = [np.unique(r.integers(-high, high, r.integers(8)) if high else r.choice(np.array(ENDS), r.integers(8))) for _ in range(r.integers(7))]
        null = r.random(len(parts)) < 0.3
        flat, sizes = np.concatenate([np.zeros(0, np.int64), *parts]), np.array([len(p) for p in parts], np.int64)
        values, counts, void = sets.decoded(sets.encoded(flat, sizes, null))
        assert values.tolist() == flat.tolist() and counts.tolist() == sizes.tolist() and void.tolist() == null.tolist()
        old = [r.choice(p, r.integers(len(p) + 1), replace=False) if len(p) else p for p in parts]
        left, counts = sets.without(np.tile(flat, 1), sizes, np.concatenate([np.zeros(0, np.int64), *old]), np.array([len(p) for p in old], np.int64))
        want = [sorted(set(p.tolist()) - set(o.tolist())) for p, o in zip(parts, old, strict=True)]
        assert counts.tolist() == [len(w) for w in want] and left.tolist() == sum(want, [])


def test_dense_sets_take_a_byte_a_number():
    assert sets.encoded(np.arange(0, 400_000, 40), np.array([10_000]), np.array([False])).nbytes < 10_020


@pytest.mark.parametrize("cell, size", [(1, 1), (3, 40), (1 << 20, 1 << 21)])
def test_ancestors_of_numbers_go_as_packed_sets(spark, cell, size, monkeypatch):
    """Layers, a cycle, repeated edges, null ends and numbers of any size: what the plain walk finds, and bytes in what is stored."""
    monkeypatch.setattr(sets, "BYTES", size)
    edges = [(k * 10 + i, (k + 1) * 10 + j) for k in range(2) for i in range(10) for j in range(10)] + [(-5, 1 << 62), (1 << 62, -5), (-5, 1 << 62), (-5, -(1 << 62)), (None, 0), (29, None)]
    kinds = []
    monkeypatch.setattr(graphs, "stored", lambda df, path=None, f=graphs.stored: kinds.append(dict(df.dtypes)) or f(df, path))
    df = spark.createDataFrame(edges, "parent long, child long")
    rows = graphs.ancestor_sets(df, cell=cell).collect()
    found = [(r.node, a, r.distance) for r in rows for a in r.ancestors]
    want = dict(reach([e for e in edges if e[0] is not None]))
    want |= {(n, None): d for n, d in [(0, 1), *[(10 + j, 2) for j in range(10)], *[(20 + j, 3) for j in range(10)], (None, 4)]}
    assert len(found) == len(set(found)) and {(n, a): d for n, a, d in found} == want
    assert cell < 1 << 20 or len(rows) == len({(n, d) for n, _, d in found})
    assert {k["ancestors"] for k in kinds if "ancestors" in k} == {"binary"}
    assert graphs.ancestors(df, 1).count() == len({e for e in edges})


def test_no_edges(spark):
    assert graphs.ancestor_sets(spark.createDataFrame([], "parent long, child long")).select("node", F.size("ancestors")).collect() == []
