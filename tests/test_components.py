"""Components and graph counts against a plain walk, and without broadcasts of labels."""

import random

import pytest
from pyspark.sql import functions as F

from orbitframe.operators import graphs

KEYS = ["traj_id", "frame"]


@pytest.fixture(scope="module")
def case(spark):
    """Sparse random graphs of 25 nodes in 40 frames, a path of 25 nodes, frames without edges, and one of no known trajectory."""
    r = random.Random(4)
    graphs_of = {(t, f): {tuple(sorted(r.sample(range(25), 2))) for _ in range(r.randrange(30))} for t in range(2) for f in range(20)}
    graphs_of[0, 20], graphs_of[0, 21] = {(i, i + 1) for i in range(24)}, set()
    edges = [(*k, *e) for k, es in graphs_of.items() for e in es]
    nodes = [(*k, n) for k in graphs_of for n in range(25)] + [(None, 0, 3)]
    return graphs_of, spark.createDataFrame(edges, "traj_id int, frame long, i int, j int"), spark.createDataFrame(nodes, "traj_id int, frame long, node int")


def plain(edges):
    least = list(range(25))
    for _ in least:
        for i, j in edges:
            least[i] = least[j] = min(least[i], least[j])
    return least


def test_no_label_is_broadcast(spark, case, monkeypatch):
    """Stored labels are small on disk; whatever they take there, no join of an iteration broadcasts them."""
    graphs_of, edges, nodes = case
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(graphs, "stored", lambda df, path=None, f=graphs.stored: plan(df) or f(df, path))
    found = graphs.connected_components(graphs.stored(edges), nodes, KEYS)
    want = {(*k, n): c for k, es in graphs_of.items() for n, c in enumerate(plain(es))} | {(None, 0, 3): 3}
    rows = found.collect()
    assert len(rows) == len(want) and {(r.traj_id, r.frame, r.node): r.component for r in rows} == want
    counts = graphs.contact_graph(graphs.stored(edges), found, KEYS)
    plan(counts)
    assert len(plans) > 6 and sum("SortMergeJoin" in p for p in plans) > 2 and not any("Broadcast" in p for p in plans)


def test_counts_of_graphs(spark, case):
    graphs_of, edges, nodes = case
    rows = {(r.traj_id, r.frame): r for r in graphs.contact_graph(edges, graphs.connected_components(edges, nodes, KEYS), KEYS).filter(F.col("traj_id").isNotNull()).collect()}
    for k, es in graphs_of.items():
        three = sum((a, c) in es for a, b in es for x, c in es if x == b)
        r, classes = rows.pop(k), len(set(plain(es)))
        assert (r.v, r.e, r.b0, r.triangles, r.b1) == (25, len(es), classes, three, len(es) - 25 + classes)
    assert not rows
