"""Frames against frames by blocks that grow, and numbers and picked rows that are not shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.operators import superposition as su
from orbitframe.operators.graphs import few
from orbitframe.operators.order import numbered


@pytest.fixture(scope="module")
def case(spark):
    x = np.random.default_rng(3).uniform(-5, 5, (2, 90, 4, 3))
    rows = [(k, f, a, *map(float, x[k, f, a])) for k in range(2) for f in range(90 if k else 1) for a in range(4)]
    return x, spark.createDataFrame(rows, "traj_id int, frame long, atom_id int, x double, y double, z double").repartition(2).cache()


def test_blocks_grow_with_the_trajectory(spark, case, monkeypatch):
    """A frame is copied BLOCKS times at most, until blocks hold MOST frames; results are those of all pairs."""
    x, coords = case
    monkeypatch.setattr(su, "FRAMES", 8)
    monkeypatch.setattr(su, "BLOCKS", 3)
    d = np.sqrt(((x[1][:, None] - x[1][None]) ** 2).sum((2, 3)) / 4)
    i, j = np.triu_indices(90, 1)
    found = {(r.i, r.j): r.rmsd for r in su.rmsd_matrix(coords, aligned=False).collect()}
    assert len(found) == len(i) and np.allclose([found[p] for p in zip(i, j, strict=True)], d[i, j])
    near = {(r.i, r.j) for r in su.rmsd_matrix(coords, aligned=False, cutoff=3.9).collect()}
    assert near == {p for p, r in found.items() if r <= 3.9}
    (row,) = su.rmsd_stats(coords, aligned=False).collect()
    assert row.traj_id == 1 and np.allclose([row.mean_rmsd, row.max_rmsd], [d[i, j].mean(), d[i, j].max()])
    seen = su.by_blocks(coords.filter("traj_id = 1"), lambda p, q, a, b, one: p[["traj_id"]].iloc[:1].assign(n=len(a)), "traj_id int, n long").collect()
    assert [r.n for r in seen] == [30] * 6


def test_numbers_stay_in_their_ranges(spark):
    """Keys over several ranges, many in one, and null ones; no row is shuffled for its number."""
    keys = [0] * 50 + [1, 2, 3] * 5 + [None] * 20
    rows = spark.createDataFrame([(k, (i * 37) % 101) for i, k in enumerate(keys)], "k int, at int").repartition(3)
    found = numbered(rows, "k", ["at"])
    for k in (0, 1, None):
        assert [r.frame for r in found.filter(F.col("k").eqNullSafe(F.lit(k))).orderBy("at").collect()] == list(range(keys.count(k)))
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_few_rows_are_broadcast(spark):
    plan = lambda most: spark.range(100).join(few(spark.range(9).distinct(), most), "id", "left_semi")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(9) and "broadcast" not in plan(8)
