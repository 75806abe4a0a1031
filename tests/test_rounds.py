"""Greedy clusters in rounds and alignments in stretches give what the plain loops give."""

import numpy as np
import pytest

from orbitframe.operators import sequences, superposition


@pytest.mark.parametrize("seed, share", [(1, 0.05), (2, 0.15), (3, 0.5), (4, 1.0), (5, 0.0)])
def test_greedy_clusters(spark, seed, share, monkeypatch):
    """Random graphs, two trajectories; many ties of counts."""
    rng = np.random.default_rng(seed)
    n, expected, rows = 60, {}, []
    for t in range(2):
        near = np.triu(rng.random((n, n)) < share, 1)
        rows += [(t, int(i), int(j), 0.5) for i, j in zip(*np.nonzero(near))] + [(t, int(i), int(j), 2.0) for i, j in zip(*np.nonzero(np.triu(~near, 1)))]
        near = near | near.T
        left, k = set(range(n)), 0
        while left:
            top = min(left, key=lambda i: (-sum(near[i, j] for j in left), i))
            own = {top, *(j for j in left if near[top, j])}
            expected |= {(t, j): (k, top) for j in own}
            left, k = left - own, k + 1
    writes = []
    monkeypatch.setattr(superposition, "stored", lambda df, f=superposition.stored: writes.append(1) or f(df))
    matrix = spark.createDataFrame(rows, "traj_id int, i long, j long, rmsd double")
    frames = spark.createDataFrame([(t, f) for t in range(2) for f in range(n)], "traj_id int, frame long")
    found = superposition.daura_clusters(matrix, frames, 1.0).collect()
    assert len(found) == 2 * n and {(r.traj_id, r.frame): (r.cluster, r.medoid) for r in found} == expected
    clusters = max(k for k, _ in expected.values()) + 1
    if share == 0.05:
        assert (len(writes) - 3) / 4 < clusters / 2  # rounds


def test_clusters_of_no_frames(spark):
    frames = spark.createDataFrame([], "traj_id int, frame long")
    assert superposition.daura_clusters(spark.createDataFrame([], "traj_id int, i long, j long, rmsd double"), frames, 1.0).count() == 0


def test_alignment_in_stretches():
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("ARNDC"), rng.integers(0, 60))) for _ in range(2))
        if rng.random() < 0.5:
            b = "".join(c for c in a if rng.random() < 0.85)
        assert sequences.align(a, b, 0) == sequences.align(a, b)


def test_long_alignment_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(7)
    a = "".join(rng.choice(list("ARNDCQEGHILK"), 3000))
    b = a[:1000] + a[1200:]
    tracemalloc.start()
    score, identity, _ = sequences.align(a, b, 1 << 16)
    assert tracemalloc.get_traced_memory()[1] < 3_000_000  # the table has 8.4 million cells
    tracemalloc.stop()
    assert identity > 93 and (score, identity) == sequences.align(a, b)[:2]
