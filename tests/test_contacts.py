"""Contacts by pair lists against all pairs in numpy, for atoms that drift and atoms that jump."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.operators import contacts
from orbitframe.operators.structure import contact_sets

N, CUTOFF = 14, 5.0


def moving(kind):
    rng = np.random.default_rng(5)
    start = rng.uniform(-15, 15, (2, 1, N, 3))
    steps = rng.normal(0, {"drift": 0.1, "jump": 8.0, "still": 0.0}[kind], (2, 21, N, 3))
    x = start + np.cumsum(steps, axis=1)
    x[0, :, 3] = x[0, :, 2] + [CUTOFF, 0, 0]  # exactly at the cutoff
    x[1, :, 5] = x[1, :, 4]  # the same place
    x[0, 4, 0] = [300.0, -300.0, 300.0]
    return x


@pytest.fixture(scope="module", params=["drift", "jump", "still"])
def case(request, spark):
    x = moving(request.param)
    rows = [(k, f, a, *map(float, x[k, f, a])) for k in range(2) for f in range(21) for a in range(N) if not (k == 1 and f == 9 and a == 2)]
    return request.param, x, spark.createDataFrame(rows, "traj_id int, frame long, atom_id int, x double, y double, z double").repartition(4).cache()


def sets(x):
    out = {}
    for k in range(2):
        for f in range(21):
            d = np.sqrt(((x[k, f][:, None] - x[k, f]) ** 2).sum(-1))
            out[k, f] = {(i, j): d[i, j] for i in range(N) for j in range(i + 1, N) if d[i, j] <= CUTOFF and not (k == 1 and f == 9 and 2 in (i, j))}
    return out


@pytest.mark.parametrize("block", [None, 1, 4, 50])
def test_near_pairs(case, block):
    _, x, coords = case
    found = {}
    rows = contacts.near_pairs(coords, CUTOFF, block).collect()
    for r in rows:
        found.setdefault((r.traj_id, r.frame), {})[r.i, r.j] = r.d
    want = sets(x)
    assert len(rows) == sum(map(len, want.values()))
    for key, pairs in want.items():
        assert found.get(key, {}).keys() == pairs.keys() and all(abs(found[key][p] - d) < 1e-9 for p, d in pairs.items())


def test_lists_are_short_and_cover(case):
    """A list holds every pair that comes near in its block, once, and far less than all pairs where atoms stay in place."""
    kind, x, coords = case
    assert contacts.block_for(coords, CUTOFF) == (1 if kind == "jump" else contacts.BLOCK)
    boxes = contacts.boxes(coords, 7)
    far = {(r.traj_id, r.block, r.atom_id) for r in boxes.collect() if r.span > 2 * CUTOFF}
    lists = contacts.pair_lists(boxes.filter(F.col("span") <= 2 * CUTOFF), CUTOFF).collect()
    assert len({tuple(r) for r in lists}) == len(lists)
    listed = {(r.traj_id, r.block, r.i, r.j) for r in lists}
    assert all((k, f // 7, i, j) in listed or far & {(k, f // 7, i), (k, f // 7, j)} for (k, f), pairs in sets(x).items() for i, j in pairs)
    if kind != "jump":
        assert len(lists) < 0.5 * 2 * 3 * N * (N - 1) / 2


def test_similarity(case):
    _, x, coords = case
    found = {(r.traj_id, r.frame): (r.jaccard, r.dice) for r in contacts.similarity(contacts.near_pairs(coords, CUTOFF), coords, 2).collect()}
    want = sets(x)
    assert found.keys() == want.keys()
    for (k, f), pairs in want.items():
        a, b = set(pairs), set(want[k, 2])
        assert found[k, f] == pytest.approx((len(a & b) / len(a | b) if a | b else 1.0, 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0))


@pytest.mark.parametrize("first, second", [(0, 1), (3, 9), (20, 20)])
def test_agreement(case, first, second):
    _, x, coords = case
    found = {r.traj_id: (r.agreement, r.passes) for r in contacts.agreement(contacts.near_pairs(coords, CUTOFF), coords, first, second).collect()}
    want = sets(x)
    for k in range(2):
        atoms = [{a for a in range(N) if not (k == 1 and f == 9 and a == 2)} for f in (first, second)]
        pairs = [{(i, j) for i in s for j in s if i < j} for s in atoms]
        same = sum(((p in want[k, first]) == (p in want[k, second])) for p in pairs[0] & pairs[1]) / len(pairs[0] | pairs[1])
        assert found[k] == pytest.approx((same, same >= 0.99))


def test_sets_of_two_frames(case):
    _, x, coords = case
    rows = contact_sets(contacts.near_pairs(coords.filter(F.col("frame") < 2), CUTOFF), CUTOFF, 0, 1).collect()
    want = sets(x)
    for k in range(2):
        a, b = set(want[k, 0]), set(want[k, 1])
        assert {part: {(r.i, r.j) for r in rows if r.traj_id == k and r.part == part} for part in ("shared", "first_only", "second_only")} == {"shared": a & b, "first_only": a - b, "second_only": b - a}


def test_no_rows(spark):
    none = spark.createDataFrame([], "traj_id int, frame long, atom_id int, x double, y double, z double")
    near = contacts.near_pairs(none, 5.0)
    assert near.count() == contacts.similarity(near, none).count() == contacts.agreement(near, none, 0, 1).count() == 0


def test_copies_for_cells_are_not_broadcast(spark, tmp_path):
    """Stored rows look small to the planner, and their 27 copies too."""
    from orbitframe.operators.selection import radius_join

    spark.range(50).selectExpr("0 AS traj_id", "id % 5 AS frame", "CAST(id AS INT) AS atom_id", "CAST(id AS DOUBLE) AS x", "0D AS y", "0D AS z").write.parquet(str(tmp_path / "c"))
    rows = spark.read.parquet(str(tmp_path / "c"))
    listed = contacts.pair_lists(contacts.boxes(rows, 1).filter("span <= 9"), CUTOFF)
    for found in (radius_join(rows, rows, CUTOFF, ["traj_id", "frame"]), listed):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
