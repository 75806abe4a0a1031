"""The index of bounds against distances of every frame, with missing frames and groups and buckets of a few frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.operators import segments
from orbitframe.plans import certified as c
from orbitframe.plans import pyramid
from orbitframe.sources import views

SCHEMA = "traj_id long, frame long, group_id int, atom_id int, x double, y double, z double, lx double, ly double, lz double"


def rows_of(seed=0):
    """Three trajectories whose second group drifts; frames are missing, some lack a group, one block lacks it entirely."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(3):
        drift = np.cumsum(rng.normal(0, 0.4, 230)) + 4
        for f in np.flatnonzero(rng.random(230) < 0.95).tolist():
            for a in range(3):
                if not (f % 50 == 7 or 100 <= f < 110):
                    out.append((k, f, 0, a, float(a * 0.3 + rng.random() * 0.2), 0.0, 0.0, 30.0, 30.0, 30.0))
            if f % 60 != 9:
                out.append((k, f, 1, 9, float(drift[f]), 0.5, 0.0, 30.0, 30.0, 30.0))
            out.append((k, f, 2, 10, 0.0, 0.0, 0.0, 30.0, 30.0, 30.0))
    return out


@pytest.fixture(scope="module")
def coords(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module", params=[(10, 4, 3, 40), (1, 2, 5, 17), (7, 5, 2, 1000), (10, 4, 1, 64)])
def index(request, coords):
    size, fan, depth, bucket = request.param
    return pyramid.build(coords, size, fan, depth, bucket)


@pytest.fixture(scope="module")
def truths():
    best, frames = {}, set()
    rows = rows_of()
    groups = {}
    for k, f, g, _, x, y, z, *_ in rows:
        frames.add((k, f))
        groups.setdefault((k, f, g), []).append((x, y, z))
    for k, f in frames:
        a, b = groups.get((k, f, 0)), groups.get((k, f, 1))
        if a and b:
            d = np.array(a)[:, None] - np.array(b)
            best[k, f] = float(np.sqrt(((d - 30 * np.rint(d / 30)) ** 2).sum(-1)).min())
    return {key: best.get(key) for key in frames}


@pytest.mark.parametrize("op, tau", [("<", 4.0), (">=", 3.5), ("<", 0.0), ("<", 100.0)])
def test_frame_truth(index, truths, op, tau):
    found = index and pyramid.frame_truth(index, tau, op).collect()
    want = {k: None if d is None else d < tau if op == "<" else d >= tau for k, d in truths.items()}
    assert len(found) == len(want) and {(r.traj_id, r.frame): r.truth for r in found} == want
    assert all(r.block_id == r.frame // index.size and (r.truth is not None or not r.certified) for r in found)
    if tau == 100.0:
        assert sum(r.certified for r in found) > len(found) / 2


def test_queries_on_spans(index, coords, truths):
    spans = pyramid.truth_spans(index, 4.0)
    series = pyramid.frame_truth(index, 4.0).cache()
    assert sorted(map(tuple, pyramid.witness_intervals(spans).collect())) == sorted(map(tuple, c.episodes(series).collect()))
    for kind, duration in (("EXISTS", None), ("FORALL", None), ("DURATION", 30.0), ("DURATION", 400.0), ("DURATION", 5000.0)):
        assert sorted(map(tuple, pyramid.query_verdict(spans, kind, duration).collect())) == sorted(map(tuple, c.query_verdict(series, kind, duration).collect()))
    assert {r.resolution for r in pyramid.query_verdict(spans, "DURATION", 10.0, 0.0).collect()} == {"UNRESOLVABLE_SAMPLING"}


def test_evidence(index, coords):
    plain = c.evidence_table(coords, 4.0, size=index.size)
    found = pyramid.evidence_table(index, 4.0)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, plain.select(*found.columns).collect()), key=str)


def test_refinement(index, coords):
    """Level by level as from the coordinates."""
    want, rows, size = [], coords, 16
    while size:
        level = c.block_verdicts(rows, 4.0, size=size)
        want += [(r.traj_id, size, r.block_id, round(r.lower, 9), round(r.upper, 9), r.verdict) for r in level.collect()]
        rows, size = c.prune_semi_join(rows, level, size).drop("block_id"), size // 2
    assert sorted((r.traj_id, r.size, r.block_id, round(r.lower, 9), round(r.upper, 9), r.verdict) for r in pyramid.refine_dyadic(index, 4.0).collect()) == sorted(want)


def test_levels_hold_each_other(coords, truths):
    """A block's limits lie outside those of its children, and every level covers all frames that hold both groups."""
    rows = pyramid.levels(coords, 5, 3, 3).cache()
    inner = rows.select("traj_id", (F.col("level") + 1).alias("level"), F.floor(F.col("block_id") / 3).alias("block_id"), F.col("lower").alias("l"), F.col("upper").alias("u"))
    joined = rows.join(inner, ["traj_id", "level", "block_id"])
    assert joined.filter("l < lower - 1e-9 OR u > upper + 1e-9").count() == 0 and joined.count() > 100
    assert {r[0] for r in rows.groupBy("level").agg(F.sum("n").alias("n")).select("n").collect()} == {sum(d is not None for d in truths.values())}


def test_other_buckets_are_not_read(spark, coords):
    """The plan prunes folders by the buckets of open blocks."""
    p = pyramid.build(coords, bucket=40)
    plan = pyramid.open_coords(p, pyramid.descent(p, 4.0, "<")[-1].filter("verdict IS NULL"))._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_leaves_of_64_frames_are_refused(coords):
    with pytest.raises(ValueError):
        pyramid.levels(coords, 64)


def test_spans_that_adjoin_are_joined(spark, monkeypatch):
    monkeypatch.setattr(segments, "RANGE", 8)
    spans = [(1, 0, 3), (1, 3, 30), (1, 30, 31), (1, 33, 40), (1, 40, 41), (2, 5, 6), (2, 7, 8), (2, 8, 9), (2, 16, 24), (2, 24, 32)]
    found = segments.joined(spark.createDataFrame(spans, "traj_id int, k_s long, k_e long"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 31), (1, 33, 41), (2, 5, 6), (2, 7, 9), (2, 16, 32)]


def test_views_see_rewritten_tables(spark, tmp_path):
    """A view is made again when the files of its table change."""
    made = []

    @views.once("t")
    def view(spark, sf):
        made.append(views.table(spark, sf, "t").count())
        return made[-1]

    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert view(spark, str(tmp_path)) == view(spark, str(tmp_path)) == 3
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
    assert view(spark, str(tmp_path)) == 5 and made == [3, 5]
