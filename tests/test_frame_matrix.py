"""Deviations of all pairs of frames: few singular values, and decimals as rounding gives them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.operators import superposition as su
from orbitframe.registry import interactions


def by_singular_values(a, b):
    a, b = (c - c.mean(axis=1, keepdims=True) for c in (a, b))
    c = np.einsum("inp,jnq->ijpq", a, b)
    s = np.linalg.svd(c, compute_uv=False)
    energy = (a**2).sum((1, 2))[:, None] + (b**2).sum((1, 2))
    return np.sqrt(np.maximum(0, energy - 2 * (s[..., 0] + s[..., 1] + np.where(np.linalg.det(c) < 0, -1, 1) * s[..., 2])) / a.shape[1])


R = np.random.default_rng(8)
BASE = R.normal(size=(1, 21, 3)) * 13
CASES = {
    "random": (R.normal(size=(64, 21, 3)) * 13, 0.01),
    "one shape": (BASE + R.normal(size=(64, 21, 3)) / 2, 0.05),
    "flat": (R.normal(size=(20, 21, 3)) * [1, 1, 0], 1),
    "line": (R.normal(size=(20, 21, 3)) * [1, 0, 0], 1),
    "equal": (np.repeat(BASE, 20, 0), 1),
    "nearly equal": (BASE + R.normal(size=(20, 21, 3)) / 1e5, 1),
    "mirrored": (np.concatenate([BASE, BASE * [-1, 1, 1]] * 8), 1),
    "far": (R.normal(size=(20, 21, 3)) + 1e5, 1),
    "few atoms": (R.normal(size=(20, 3, 3)), 1),
    "two atoms": (R.normal(size=(20, 2, 3)), 1),
    "one atom": (R.normal(size=(20, 1, 3)), 1),
    "nothing": (np.zeros((20, 4, 3)), 1),
}


@pytest.mark.parametrize("name", CASES)
def test_deviations_are_those_of_singular_values(name, monkeypatch):
    x, share = CASES[name]
    want, made, svd = by_singular_values(x, x[:17]), [0], np.linalg.svd

    def counted(m, **kw):
        made[0] += m.size // 9
        return svd(m, **kw)

    monkeypatch.setattr(np.linalg, "svd", counted)
    # A frame against itself: the root of what rounding leaves.
    assert np.allclose(su.deviations(x, x[:17], True), want, rtol=1e-9, atol=1e-7 * np.abs(x).max())
    if share < 1:  # frames against themselves, and pairs with a nearly double root
        assert made[0] <= len(x[:17]) + share * want.size


def test_four_decimals_as_rounding_gives_them(spark):
    values = [0.0, -0.0, 0.00005, 0.00015, 1.00005, 2.00015, 2.675, 1e-9, 12.34565, 12.345649999999999, 99999.99995, 123456.78905, 1e300, -1.00005, float("nan"), float("inf"), None, *map(float, np.random.default_rng(2).uniform(0, 40, 500)), *[k / 20000 for k in range(500)]]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, rmsd double")
    exact, found = (dict(map(tuple, f(df, "rmsd").collect())) for f in (interactions._r4, interactions._whole4))
    assert {k: repr(v) for k, v in found.items()} == {k: repr(v) for k, v in exact.items()}
    plan = lambda name: interactions.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FLOOR" in plan("rmsd_matrix") and "FLOOR" in plan("rmsd_matrix_fit")


def test_matrix_of_no_frames(spark):
    none = spark.createDataFrame([], "traj_id int, frame long, atom_id int, x double, y double, z double")
    assert su.rmsd_matrix(none).count() == 0 and su.rmsd_matrix(none.select("*", F.lit(1).alias("w")), aligned=False).count() == 0
