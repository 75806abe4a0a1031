"""Lineage and rings against brute force."""

from itertools import permutations

import pytest

from orbitframe.operators import graphs
from orbitframe.queries import QUERIES
from orbitframe.sources import views

SF = "/root/testdata/sf0.001"


def reach(edges):
    """(node, ancestor) -> least distance, by a walk from each node."""
    up = {}
    for parent, child in edges:
        up.setdefault(child, set()).add(parent)
    out = {}
    for node in up:
        level, k = set(up[node]), 1
        while level:
            for a in level:
                out[node, a] = k
            level, k = {b for a in level for b in up.get(a, ()) if (node, b) not in out}, k + 1
    return out


@pytest.fixture(scope="module")
def lineage(spark):
    return {tuple(r) for r in views.lg(spark, SF).collect()}


def test_ancestors_and_cycles_of_any_length(spark):
    edges = [(f"n{k:02}", f"n{k + 1:02}") for k in range(21)] + [("n21", "n00"), ("n00", "n05"), ("n21", "x"), ("y", "n00"), ("z", "z")]
    df = spark.createDataFrame(edges, "parent string, child string")
    assert sorted((*k, d) for k, d in reach(edges).items()) == sorted(tuple(r) for r in graphs.ancestors(df).collect())
    assert {tuple(r) for r in graphs.cycle_edges(df).select("parent", "child").collect()} == {e for e in edges if e not in (("n21", "x"), ("y", "n00"))}


@pytest.mark.parametrize("cell", [1, 3, 1 << 20])
def test_ancestors_move_as_arrays(spark, cell):
    """Three full layers of ten nodes, a cycle and a null: a row for a node and generation, or for each cell of ancestors."""
    edges = [(f"{k}{i}", f"{k + 1}{j}") for k in range(2) for i in range(10) for j in range(10)] + [("x", "y"), ("y", "x"), ("x", "y"), (None, "00"), ("29", None)]
    rows = graphs.ancestor_sets(spark.createDataFrame(edges, "parent string, child string"), cell=cell).collect()
    found = [(r.node, a, r.distance) for r in rows for a in r.ancestors]
    want = {k: d for k, d in reach([e for e in edges if e[0]]).items()}
    want |= {(n, None): d for n, d in [("00", 1), *[(f"1{j}", 2) for j in range(10)], *[(f"2{j}", 3) for j in range(10)], (None, 4)]}
    assert len(found) == len(set(found)) and {(n, a): d for n, a, d in found} == want
    assert cell < 1 << 20 or len(rows) == len({(n, d) for n, _, d in found})


def test_lineage_ancestors_has_all_generations(spark, lineage):
    found = {(r.node, r.ancestor): r.distance for r in QUERIES["lineage_ancestors"](spark, SF).collect()}
    assert found == reach(lineage) and {n[0] for n, _ in found} == set("OPS")


def test_lineage_join_report_has_all_artifacts(spark, lineage):
    found = QUERIES["lineage_join_report"](spark, SF).select("node", "ancestor", "o_orderstatus").collect()
    assert sorted((r[0], r[1]) for r in found) == sorted(reach(lineage)) and all((r[0][0] == "O") == (r[2] is not None) for r in found)


def test_lineage_cycle_check_finds_the_reversed_edge(spark, lineage):
    parent, child = min(lineage)
    assert {tuple(r) for r in QUERIES["lineage_cycle_check"](spark, SF).select("parent", "child").collect()} == {(parent, child), (child, parent)}


def test_registered_rings_go_to_seven_atoms_and_have_types(spark, monkeypatch):
    atoms = [(k, "CCCCCNCOCCNCCCCCC"[k]) for k in range(17)]
    edges = [(k, (k + 1) % 6) for k in range(6)] + [(6 + k, 6 + (k + 1) % 4) for k in range(4)] + [(10 + k, 10 + (k + 1) % 7) for k in range(7)]
    pairs = spark.createDataFrame([(0, 0, min(e), max(e), 1.0) for e in edges], "traj_id int, frame long, i int, j int, d double")
    monkeypatch.setattr("orbitframe.registry.interactions.st.atom_pairs", lambda te: pairs)
    monkeypatch.setattr("orbitframe.registry.interactions.v.te_atoms", lambda p: spark.createDataFrame(atoms, "atom_id int, element string"))
    found = {r.atoms: (r["size"], r.kind, r.aromatic, r.heterocyclic) for r in QUERIES["rings"](spark, SF).collect()}
    assert found == {"0,1,2,3,4,5": (6, "PYRIDINE", True, True), "6,7,8,9": (4, "GENERAL_CYCLE", False, True), "10,11,12,13,14,15,16": (7, "GENERAL_CYCLE", False, True)}


def test_rings_are_all_simple_cycles(spark):
    n, edges = 8, {(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (5, 6), (0, 6), (1, 4), (6, 7)}
    joined = lambda a, b: (a, b) in edges or (b, a) in edges
    expected = {(k, ",".join(map(str, sorted(c)))) for k in range(3, 8) for c in permutations(range(n), k) if all(joined(c[i - 1], c[i]) for i in range(k))}
    df = spark.createDataFrame([(0, *e) for e in edges], "g int, i int, j int")
    assert {(r["size"], r.atoms) for r in graphs.rings(df, ["g"]).collect()} == expected
