"""Scans over ranges against loops over whole keys, with ranges so short that everything crosses them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.operators import segments, series
from orbitframe.plans import certified


@pytest.fixture(autouse=True)
def short_ranges(monkeypatch):
    monkeypatch.setattr(segments, "RANGE", 8)


@pytest.fixture(scope="module")
def flags():
    """Series with gaps, long runs over several ranges, runs that end with ranges, no TRUE at all, nulls."""
    rng = np.random.default_rng(1)
    out = {0: dict.fromkeys(range(60), True), 1: dict.fromkeys(range(20), False), 2: {f: f < 16 or f >= 24 for f in range(40)}}
    out[3] = {f: None if f % 9 == 4 else True for f in range(50)}
    for k in range(4, 12):
        frames = np.flatnonzero(rng.random(120) < 0.93)
        out[k] = {int(f): [True, False, None][rng.choice(3, p=[0.85, 0.1, 0.05])] for f in frames}
    return out


@pytest.fixture(scope="module")
def table(spark, flags):
    rows = [(k, f, v, float(f) * 2 + k, "x") for k, s in flags.items() for f, v in s.items()]
    return spark.createDataFrame(rows, "traj_id long, frame long, truth boolean, value double, range_ string").drop("range_").repartition(7).cache()


def loops(series_, good):
    out, start, last = [], None, None
    for f in sorted(series_):
        ok = good(series_[f])
        if start is not None and (not ok or f != last + 1):
            out.append((start, last + 1))
            start = None
        if ok:
            start, last = f if start is None else start, f
    return out + ([(start, last + 1)] if start is not None else [])


def test_runs(table, flags):
    found = sorted(tuple(r) for r in certified.episodes(table).select("traj_id", "k_s", "k_e").collect())
    assert found == sorted((k, *run) for k, s in flags.items() for run in loops(s, lambda v: v is True))


@pytest.mark.parametrize("need", [1, 5, 16, 60])
def test_durations(table, flags, need):
    found = {r.traj_id: (r.longest, r.possible, r.verdict) for r in certified.duration_verdicts(table, need * 10.0, 10.0).collect()}
    for k, s in flags.items():
        longest, possible = (max((e - b for b, e in loops(s, good)), default=0) for good in (lambda v: v is True, lambda v: v is not False))
        assert found[k] == (longest, possible, True if longest >= need else False if possible < need else None)


def test_numbers_of_runs(table, flags):
    found = sorted((r.traj_id, r.n, r.length) for r in series.lifetimes(table, "truth").collect())
    assert found == sorted((k, i + 1, e - b) for k, s in flags.items() for i, (b, e) in enumerate(loops(s, lambda v: v is True)))


def random_spans(seed, n, width):
    rng = np.random.default_rng(seed)
    starts = rng.integers(0, 200, n)
    return [(int(rng.integers(0, 3)), int(s), int(s + rng.integers(1, width))) for s in starts]


@pytest.mark.parametrize("n, width", [(40, 4), (60, 12), (15, 90), (80, 3), (1, 300)])
def test_unions(spark, n, width):
    spans = random_spans(n, n, width)
    want = []
    for k in range(3):
        own = []
        for s, e in sorted(x[1:] for x in spans if x[0] == k):
            if own and s <= own[-1][1]:
                own[-1][1] = max(own[-1][1], e)
            else:
                own.append([s, e])
        want += [(k, *x) for x in own]
    found = series.merge_intervals(spark.createDataFrame(spans, "traj_id long, k_s long, k_e long"))
    assert sorted(tuple(r) for r in found.select("traj_id", "k_s", "k_e").collect()) == want


@pytest.mark.parametrize("seed, width", [(1, 3), (2, 9), (3, 40), (4, 8)])
def test_joined_spans(spark, seed, width):
    """Spans that share nothing, of any length against the ranges, adjoining or apart."""
    rng = np.random.default_rng(seed)
    spans, want = [], []
    for k in range(3):
        at, own = int(rng.integers(0, 5)), []
        for _ in range(40):
            at += int(rng.choice([0, 0, 1, 7]))
            end = at + int(rng.integers(1, width))
            spans.append((k, at, end))
            if own and own[-1][1] == at:
                own[-1][1] = end
            else:
                own.append([at, end])
            at = end
        want += [(k, *x) for x in own]
    found = segments.joined(spark.createDataFrame(spans, "traj_id long, k_s long, k_e long").repartition(5))
    assert sorted(tuple(r) for r in found.collect()) == want


@pytest.mark.parametrize("step", [-1, 1])
def test_neighbours_and_running_values(table, flags, step):
    rows = segments.running(segments.neighbours(table, ["value", "truth"], step), {"total": ("sum", F.col("value")), "top": ("max", -F.col("value"))})
    found = {(r.traj_id, r.frame): (r.near_value, r.near_truth, r.total, r.top) for r in rows.collect()}
    for k, s in flags.items():
        frames, total = sorted(s), 0.0
        for i, f in enumerate(frames):
            total += f * 2 + k
            near = frames[i + step] if 0 <= i + step < len(frames) else None
            assert found[k, f] == (None if near is None else near * 2.0 + k, None if near is None else s[near], total, -(frames[0] * 2.0 + k))


def test_running_values_hold_equal_positions_together(spark):
    rows = spark.createDataFrame([(1, 3, 5), (1, 3, None), (1, 20, 2), (1, 40, None), (2, 1, None)], "traj_id int, at int, v int")
    found = segments.running(rows, {"top": ("max", F.col("v")), "total": ("sum", F.col("v"))}, at="at")
    assert sorted((r.traj_id, r["at"], r.top, r.total) for r in found.collect() if r["at"] != 3) == [(1, 20, 5, 7), (1, 40, 5, 7), (2, 1, None, None)]
    assert {(r.top, r.total) for r in found.collect() if r["at"] == 3} == {(5, 5)}


@pytest.mark.parametrize("seed", range(4))
def test_events(spark, seed):
    a, b = ([(k, s, e) for k, s, e in random_spans(seed * 2 + i, 9, 30)] for i in (0, 1))
    tables = [spark.createDataFrame(x, "traj_id long, k_s long, k_e long") for x in (a, b)]
    before = {r.traj_id: r.verdict for r in series.event_before(*tables).collect()}
    gap = {r.traj_id: r.gap for r in series.event_gap(*tables, False).collect()}
    after = {r.traj_id: r.gap for r in series.event_gap(*tables, True).collect()}
    for k in {x[0] for x in a + b}:
        pairs = [(x, y) for x in a for y in b if x[0] == y[0] == k]
        over = any(x[1] < y[2] and y[1] < x[2] for x, y in pairs)
        assert before[k] == (True if any(x[2] <= y[1] for x, y in pairs) else None if over else False)
        assert gap.get(k) == min((max(0, y[1] - x[2], x[1] - y[2]) for x, y in pairs), default=None)
        assert after.get(k) == min((y[1] - x[2] for x, y in pairs if x[2] <= y[1]), default=None)


def test_unwrapping(spark):
    rng = np.random.default_rng(3)
    true = np.cumsum(rng.normal(0, 3, (2, 100)), axis=1)
    rows = [(k, 0, f, *[float(true[k, f] - 20 * np.rint(true[k, f] / 20))] * 3, 20.0, 20.0, 20.0) for k in range(2) for f in range(100)]
    df = spark.createDataFrame(rows, "traj_id int, atom_id int, frame long, x double, y double, z double, lx double, ly double, lz double").repartition(5)
    found = {(r.traj_id, r.frame): r.x for r in series.unwrap_time(df).collect()}
    phase = {(r.traj_id, r.frame): r.phase for r in series.unwrap_phase(df, "x", 20.0).collect()}
    for k in range(2):
        own = np.array([found[k, f] for f in range(100)])
        assert np.allclose(own, true[k] - true[k, 0] + own[0]) and np.allclose([phase[k, f] for f in range(100)], own)


def test_autocorrelation(spark):
    rng = np.random.default_rng(4)
    values = {0: rng.normal(size=61), 1: np.ones(9), 2: rng.normal(size=2)}
    df = spark.createDataFrame([(k, f, float(v)) for k, s in values.items() for f, v in enumerate(s)], "traj_id int, frame long, y double")
    found = {(r.traj_id, r.lag): r.c for r in series.autocorrelation(df, "y", 5).collect()}
    want = {}
    for k, s in values.items():
        d, v = s - s.mean(), s.var()
        for lag in range(min(len(s) // 2, 5) + 1):
            want[k, lag] = 1.0 if v == 0 else (d[: len(d) - lag] * d[lag:]).mean() / v
    assert found.keys() == want.keys() and all(abs(found[x] - want[x]) < 1e-12 for x in want)


def test_no_window_over_a_whole_trajectory(table):
    """Windows over frames are cut into ranges; those along a trajectory see a row per range, or two open runs."""
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (certified.duration_verdicts(table, 30.0, 10.0), certified.episodes(table), series.unwrap_phase(table, "value"))]
    for plan in plans:
        for line in plan.splitlines():
            if "Window [" in line and "frame" in line.split("windowspecdefinition")[-1]:
                assert "range_" in line or "cell" in line
