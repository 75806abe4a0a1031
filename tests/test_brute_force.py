"""Registered queries that SQL can hardly express, against plain numpy on the same tables."""

from collections import defaultdict, deque
from itertools import product

import numpy as np
import pytest

from orbitframe.functions import geometry as g
from orbitframe.operators import sequences, surfaces
from orbitframe.operators.structure import MASSES, VDW
from orbitframe.queries import QUERIES
from orbitframe.registry.functions import _cell_numbers
from orbitframe.sources import views

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


@pytest.fixture(scope="module")
def frames(spark):
    """traj -> array (frames, atoms, 3)."""
    rows = views.te(spark, SF).select("traj_id", "frame", "atom_id", *"xyz").toPandas().sort_values(["traj_id", "frame", "atom_id"])
    return {t: part[list("xyz")].to_numpy().reshape(-1, views.N_ATOMS, 3) for t, part in rows.groupby("traj_id")}


def rotation(p, q, w=None):
    """The rotation that brings centred p onto centred q best, and both centred."""
    w = np.ones(len(p)) if w is None else w
    p, q = (x - np.average(x, axis=0, weights=w) for x in (p, q))
    u, _, vt = np.linalg.svd((p * w[:, None]).T @ q)
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt, p, q


def fitted(p, q, w=None):
    r, p, q = rotation(p, q, w)
    return p @ r, q


def deviation(p, q, w=None):
    a, b = fitted(p, q, w)
    return np.sqrt(np.average(((a - b) ** 2).sum(axis=1), weights=w))


def onto_average(x):
    return np.array([fitted(f, x.mean(axis=0))[0] for f in x])


def test_fits(spark, frames):
    weights = np.array([MASSES["NCCO"[k % 4]] for k in range(views.N_ATOMS)])
    for r in run(spark, "rmsd_fit_weighted"):
        assert abs(r["rmsd"] - deviation(frames[r["traj_id"]][r["frame"]], frames[r["traj_id"]][0], weights)) < 2e-4
    for r in run(spark, "rmsd_matrix_fit"):
        assert abs(r["rmsd"] - deviation(frames[r["traj_id"]][r["i"]], frames[r["traj_id"]][r["j"]])) < 2e-4
    for r in run(spark, "fit_reference"):
        x = frames[r["traj_id"]]
        assert np.allclose([r[n] for n in "xyz"], fitted(x[r["frame"]], x[0])[0][r["atom_id"]], atol=2e-4)
    expected = {t: np.sqrt(onto_average(x).var(axis=0).sum(axis=1)) for t, x in frames.items()}
    for r in run(spark, "rmsf_fit"):
        assert abs(r["rmsf"] - expected[r["traj_id"]][r["atom_id"]]) < 2e-4


def test_principal_components(spark, frames):
    found = {r["traj_id"]: r for r in run(spark, "trajectory_pca")}
    places = {(r["traj_id"], r["frame"]): (r["p1"], r["p2"]) for r in run(spark, "trajectory_projections")}
    for t, x in frames.items():
        y = onto_average(x).reshape(len(x), -1)
        y -= y.mean(axis=0)
        _, s, vt = np.linalg.svd(y, full_matrices=False)
        e = s**2 / len(y)
        assert np.allclose([found[t]["first"], found[t]["second"], found[t]["share"]], [e[0], e[1], (e[0] + e[1]) / e.sum()], atol=1e-3)
        v = vt[:2] * np.sign(vt[:2][np.arange(2), np.abs(vt[:2]).argmax(axis=1)])[:, None]
        assert np.allclose([places[t, f] for f in range(len(x))], y @ v.T, atol=1e-2)


def test_daura_clusters_are_numbered_per_trajectory(spark, frames):
    expected = {}
    for t, x in frames.items():
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=3).mean(axis=2))
        left, number = set(range(len(x))), 0
        while left:
            near = {i: [j for j in left if d[i, j] <= 6.0] for i in left}
            top = min(left, key=lambda i: (-len(near[i]), i))
            for j in near[top]:
                expected[t, j] = (number, top)
            left -= set(near[top])
            number += 1
    assert {(r["traj_id"], r["frame"]): (r["cluster"], r["medoid"]) for r in run(spark, "daura_clusters")} == expected


def test_oriented_boxes(spark, frames):
    for r in run(spark, "oriented_box"):
        x = frames[r["traj_id"]][r["frame"]]
        x = x - x.mean(axis=0)
        along = x @ np.linalg.eigh(x.T @ x / len(x))[1]
        assert np.allclose([r[f"half_{k}"] for k in range(3)], np.maximum(0.2, np.ptp(along, axis=0) / 2), atol=1e-5)


def test_consensus_and_comparison(spark, frames):
    models = {t: np.array([fitted(f, x[0])[0] for f in x]) for t, x in frames.items()}
    for r in run(spark, "model_consensus"):
        x = models[r["traj_id"]]
        i, j = np.triu_indices(len(x), 1)
        d = np.sqrt(((x[i] - x[j]) ** 2).sum(axis=2).mean(axis=1))
        worst = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=3).max(axis=(0, 1)))
        assert np.allclose([r["mean_rmsd"], r["max_rmsd"]], [d.mean(), d.max()], atol=1e-4) and r["n_agreeing"] == (worst < 17.5).sum()
    pairs = np.triu_indices(views.N_ATOMS, 1)
    for r in run(spark, "structure_compare"):
        x, y = frames[r["traj_id"]][r["frame"]], frames[r["traj_id"]][0]
        d = np.sqrt(((x - y) ** 2).sum(axis=1))
        near = [np.sqrt(((z[pairs[0]] - z[pairs[1]]) ** 2).sum(axis=1)) <= 8 for z in (x, y)]
        share = {c: 100 * (d <= c).mean() for c in (0.5, 1, 2, 4, 8)}
        expected = [deviation(x, y), (1 / (1 + (d / 0.5) ** 2)).mean(), sum(share[c] for c in (1, 2, 4, 8)) / 4, sum(share[c] for c in (0.5, 1, 2, 4)) / 4, (near[0] & near[1]).sum() / (near[0] | near[1]).sum()]
        if r["frame"]:
            assert np.allclose([r[n] for n in ("rmsd", "tm", "gdt_ts", "gdt_ha", "jaccard")], expected, atol=1e-4)


def test_periodic_bounds_of_14_sided_volumes(spark, frames):
    h = np.array(_cell_numbers())
    u = np.array([[c / sum(map(abs, v)) ** 0.5 for c in v] for v in g.DIRECTIONS])
    for r in run(spark, "bounds_kdop_periodic"):
        p = frames[r["traj_id"]][r["frame"]][:4] @ u.T
        (la, ha), (lb, hb) = ((s.min(axis=0), s.max(axis=0)) for s in (p[:2], p[2:]))
        near = np.rint(((lb + hb)[:3] / 2 - (la + ha)[:3] / 2) @ np.linalg.inv(h))
        low, high = [], []
        for v in product((-1, 0, 1), repeat=3):
            shift = (near + v) @ h @ u.T
            gap = np.maximum(0, np.maximum(la - (hb - shift), lb - shift - ha))
            low.append(max(np.sqrt((gap[:3] ** 2).sum()), gap[3:].max()))
            high.append(np.sqrt((np.maximum(ha - (lb - shift), hb - shift - la)[:3] ** 2).sum()))
        assert np.allclose([r["lower"], r["upper"]], [min(low), max(min(low), min(high))], atol=1e-5), (r, min(low), min(high))


def test_cells(spark):
    sizes = {r.p_partkey: r.p_size for r in views.table(spark, SF, "part").select("p_partkey", "p_size").collect()}
    seen = set()
    for r in run(spark, "cell_checks"):
        s = sizes[r["p_partkey"]]
        a, b, c = (10 + (s * k) % 17 for k in (1, 2, 3))
        al, be, ga = (np.radians(90.0 if s % 4 == 0 else 60 + (s * k) % 70) for k in (5, 7, 11))
        cx, cy = c * np.cos(be), c * (np.cos(al) - np.cos(be) * np.cos(ga)) / np.sin(ga)
        h = np.array([[a, 0, 0], [b * np.cos(ga), b * np.sin(ga), 0], [cx, cy, np.sqrt(max(0, c * c - cx * cx - cy * cy))]])
        det = np.linalg.det(h)
        assert abs(r["volume"] - det) < 1e-4
        skewed = np.abs(h[~np.eye(3, dtype=bool)]).max() > 1e-6
        reduced = abs(h[1, 0]) <= a / 2 + 1e-6 and abs(h[2, 0]) <= a / 2 + 1e-6 and abs(h[2, 1]) <= h[1, 1] / 2 + 1e-6
        status = "DEGENERATE" if det <= 1e-12 else "NOT_REDUCED" if skewed and not reduced else "OK"
        assert (r["status"], r["rectangular"], r["reduced"]) == (status, not skewed, reduced)
        assert (r["condition"] is None) == (status == "DEGENERATE") and (status == "DEGENERATE" or abs(r["condition"] / np.linalg.cond(h) - 1) < 1e-5)
        seen.add(status)
    assert seen >= {"OK", "NOT_REDUCED"}


def plain_cavities(atoms, radius, h=0.8, least=20.0):
    pad = 1.4 + 2.0
    low = atoms.min(axis=0) - pad
    n = np.ceil((atoms.max(axis=0) + pad - low) / h).astype(int)
    at = [low[k] + (np.arange(n[k]) + 0.5) * h for k in range(3)]
    grid = np.stack(np.meshgrid(*at, indexing="ij"), axis=-1)
    free = np.ones(tuple(n), bool)
    for a in atoms:
        free &= ((grid - a) ** 2).sum(axis=-1) > radius**2

    def flood(starts, steps):
        queue = deque(starts)
        for s in starts:
            free[s] = False
        out = []
        while queue:
            c = queue.popleft()
            out.append(c)
            for d in steps:
                q = tuple(x + y for x, y in zip(c, d, strict=True))
                if all(0 <= x < m for x, m in zip(q, n, strict=True)) and free[q]:
                    free[q] = False
                    queue.append(q)
        return out

    faces = [d for d in product((-1, 0, 1), repeat=3) if sum(map(abs, d)) == 1]
    flood([tuple(c) for c in np.argwhere(free) if (c == 0).any() or (c == n - 1).any()], faces)
    found = []
    while free.any():
        group = np.array(flood([tuple(np.argwhere(free)[0])], [d for d in product((-1, 0, 1), repeat=3) if any(d)]))
        if len(group) * h**3 >= least:
            spots = low + (group + 0.5) * h
            near = np.flatnonzero((((atoms[:, None] - spots) ** 2).sum(axis=2) <= (1.4 + 2.5) ** 2).any(axis=1))
            found.append((len(group), tuple(np.round(spots.mean(axis=0), 4)), tuple(near)))
    return sorted(found, key=lambda f: (-f[0], f[1]))


def test_cavities(spark):
    rng = np.random.default_rng(3)
    structures, rows = [], []
    for t, (radius, n) in enumerate([(5.0, 150), (6.0, 260), (5.0, 20)]):
        v = rng.normal(size=(n, 3))
        structures.append(radius * v / np.linalg.norm(v, axis=1)[:, None])
    structures.append(np.concatenate([structures[0], structures[1] + [14.0, 1.0, 0.5]]))
    for t, atoms in enumerate(structures):
        rows += [(t, 0, k, *map(float, a), "K", "A", k) for k, a in enumerate(atoms)]
    df = spark.createDataFrame(rows, "traj_id int, frame long, atom_id int, x double, y double, z double, element string, chain string, residue int")
    found = defaultdict(list)
    for r in surfaces.cavities(df).orderBy("traj_id", "rank").collect():
        assert abs(r.volume - r.n_voxels * 0.8**3) < 1e-9
        found[r.traj_id].append((r.n_voxels, tuple(np.round([r.x, r.y, r.z], 4)), tuple(sorted(int(k.split(":")[1]) for k in r.lining.split(",")))))
    expected = {t: plain_cavities(a, VDW["K"]) for t, a in enumerate(structures)}
    assert {t: e for t, e in expected.items() if e} == dict(found) and sum(map(len, expected.values())) >= 3
    assert all(r["n_voxels"] * 0.8**3 >= 20 for r in run(spark, "cavities"))


def plain_alignment(a, b):
    n, m = len(a), len(b)
    table = sequences.scores(np.array([ord(c) for c in a], int).reshape(-1, 1), np.array([ord(c) for c in b], int).reshape(1, -1))
    best, step = np.zeros((n + 1, m + 1), int), np.zeros((n + 1, m + 1), int)
    for i in range(n + 1):
        for j in range(m + 1):
            if not i or not j:
                best[i, j], step[i, j] = (-10 - (i + j - 1) if i + j else 0), 1 if i else 2
                continue
            ways = [best[i - 1, j - 1] + table[i - 1, j - 1], best[i - 1, j] - (1 if step[i - 1, j] == 1 else 10), best[i, j - 1] - (1 if step[i, j - 1] == 2 else 10)]
            step[i, j] = int(np.argmax(ways))
            best[i, j] = max(ways)
    i, j, same, alike, length = n, m, 0, 0, 0
    while i or j:
        length += 1
        if step[i, j] == 0:
            same, alike = same + (a[i - 1] == b[j - 1]), alike + (table[i - 1, j - 1] > 0)
        i, j = i - (step[i, j] != 2), j - (step[i, j] != 1)
    return best[n, m], 100 * same / max(length, 1), 100 * alike / max(length, 1)


def test_alignments(spark):
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("ARNDWYVXZ"), int(rng.integers(0, 14)))) for _ in range(2))
        assert sequences.align(a, b) == pytest.approx(plain_alignment(a, b))
    assert sequences.align("HEAGAWGHEE", "HEAGAWGHEE")[1:] == (100.0, 100.0)
    items = {r.seq_id: r.seq for r in views.sq(spark, SF, "benchmark", "item_id").collect()}
    docs = {r.seq_id: r.seq for r in views.sq(spark, SF).collect()}
    words = {side: {k: set(sequences.word_hashes(s, 16, 4).tolist()) for k, s in table.items()} for side, table in (("left", docs), ("right", items))}
    expected = {(i, j) for i in docs for j in items if words["left"][i] & words["right"][j] and min(len(docs[i]), len(items[j])) >= 0.05 * max(len(docs[i]), len(items[j]))}
    found = run(spark, "sequence_alignment_pairs")
    assert {(r["left_id"], r["right_id"]) for r in found} == expected and expected
    r = min(found, key=lambda r: len(docs[r["left_id"]]))
    assert (r["score"], r["identity"], r["similarity"]) == pytest.approx(plain_alignment(docs[r["left_id"]], items[r["right_id"]]), abs=1e-5)
