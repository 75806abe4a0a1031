"""Each fault of a claim, its evidence or a ledger is found, and nothing else."""

import hashlib

import pytest
from pyspark.sql import functions as F

from orbitframe.operators import graphs
from orbitframe.plans import proofs
from orbitframe.queries import QUERIES

CLAIM = {"claim_id": 1, "quantifier": "DURATION", "op": "<", "tau": 4.0, "truth": True, "resolution": "COMPLETE", "duration": 150.0, "dt": 10.0, "sampling": "sampled_frames", "boundary": "none", "model": "kdop14", "total_blocks": 4, "trajectory_sha256": "ab", "index_sha256": "cd", "manifest_sha256": "cd", "bytes_fetched": 1, "frames_decoded": 0, "atoms_analyzed": None}
CLAIM_SCHEMA = "claim_id int, quantifier string, op string, tau double, truth boolean, resolution string, duration double, dt double, sampling string, boundary string, model string, total_blocks long, trajectory_sha256 string, index_sha256 string, manifest_sha256 string, bytes_fetched long, frames_decoded long, atoms_analyzed long"
BLOCK_SCHEMA = "claim_id int, block_id long, frame_start long, frame_end long, lower double, upper double, status string"
GOOD = [(1, 0, 0, 10, 1.0, 3.0, "CERTIFIED_TRUE"), (1, 1, 10, 20, 1.0, 9.0, "EXACT_TRUE"), (1, 2, 20, 30, 5.0, 9.0, "CERTIFIED_FALSE"), (1, 3, 30, 40, 3.0, 9.0, "REFINED")]
TRUE, FALSE, MIXED = GOOD[:2], GOOD[2:3], GOOD[3:]
CASES = {
    "good": ({}, GOOD, set()),
    "short": ({"duration": 201.0}, GOOD, {"run is too short"}),
    "edge": ({"duration": 200.0}, GOOD, set()),
    "gap": ({}, [GOOD[0], (1, 1, 11, 20, 1.0, 9.0, "EXACT_TRUE")], {"run is too short"}),
    "overlap": ({}, [*GOOD, (1, 4, 15, 30, 1.0, 2.0, "EXACT_TRUE")], {"witnesses overlap"}),
    "twice": ({}, [*GOOD, GOOD[0]], {"witnesses overlap"}),
    "no witness": ({}, FALSE + MIXED, {"witness is missing"}),
    "no evidence": ({}, [], {"witness is missing"}),
    "exists": ({"quantifier": "EXISTS"}, TRUE, set()),
    "exists without": ({"quantifier": "EXISTS"}, FALSE, {"witness is missing"}),
    "not exists": ({"quantifier": "EXISTS", "truth": False, "total_blocks": 1}, FALSE, set()),
    "not exists, part": ({"quantifier": "EXISTS", "truth": False}, FALSE, {"coverage is incomplete"}),
    "not exists, but": ({"quantifier": "EXISTS", "truth": False}, GOOD, {"witness contradicts"}),
    "all": ({"quantifier": "FORALL", "total_blocks": 2}, TRUE, set()),
    "all, part": ({"quantifier": "FORALL"}, TRUE, {"coverage is incomplete"}),
    "not all": ({"quantifier": "FORALL", "truth": False}, GOOD, set()),
    "not all, but": ({"quantifier": "FORALL", "truth": False}, TRUE, {"counterexample is missing"}),
    "unknown": ({"truth": None}, [], set()),
    "weekly": ({"sampling": "weekly"}, GOOD, {"sampling is unknown"}),
    "continuous": ({"sampling": "continuous_physical"}, GOOD, {"continuous sampling cannot be settled"}),
    "continuous, open": ({"sampling": "continuous_physical", "truth": None, "resolution": "UNSUPPORTED_SEMANTICS", "duration": 2.0}, [], set()),
    "continuous, below a step": ({"sampling": "continuous_physical", "truth": None, "duration": 2.0}, [], {"continuous sampling cannot be settled"}),
    "sphere": ({"boundary": "sphere"}, GOOD, {"boundary is unknown"}),
    "obb": ({"model": "OBB"}, GOOD, {"bounding model is unknown"}),
    "op": ({"op": "=="}, GOOD, {"operator is unknown"}),
    "zeros": ({"trajectory_sha256": "0" * 64}, GOOD, {"digest is forged"}),
    "fs": ({"index_sha256": "ffff", "manifest_sha256": "ffff"}, GOOD, {"digest is forged"}),
    "other index": ({"manifest_sha256": "ce"}, GOOD, {"index is another one"}),
    "negative": ({"frames_decoded": -1}, GOOD, {"metric is negative"}),
}


def test_claims(spark):
    claims, blocks = [], []
    for i, (change, evidence, _) in enumerate(CASES.values()):
        claims.append(tuple((CLAIM | change | {"claim_id": i}).values()))
        blocks += [(i, *b[1:]) for b in evidence]
    found = {}
    tables = spark.createDataFrame(claims, CLAIM_SCHEMA), spark.createDataFrame(blocks, BLOCK_SCHEMA)
    for r in proofs.claim_violations(*tables).collect():
        found.setdefault(r.claim_id, set()).add(r.violation)
    for i, (name, (_, _, want)) in enumerate(CASES.items()):
        assert found.get(i, set()) == want, name
    assert proofs.block_violations(*tables).count() == 0


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_blocks(spark, op):
    """Bounds at the threshold count by the operator; missing bounds are 0 and infinite."""
    rows = [(0.0, 3.0, "TRUE"), (3.0, 5.0, "CERTIFIED_TRUE"), (5.0, 6.0, "FALSE"), (4.0, 6.0, "CERTIFIED_FALSE"), (1.0, 4.0, "CERTIFIED_TRUE"), (4.0, 4.0, "FALSE"), (None, None, "TRUE"), (3.0, 5.0, "REFINED")]
    claims = spark.createDataFrame([tuple((CLAIM | {"op": op}).values())], CLAIM_SCHEMA)
    blocks = spark.createDataFrame([(1, i, 0, 1, *r) for i, r in enumerate(rows)], BLOCK_SCHEMA)
    got = {r.block_id for r in proofs.block_violations(claims, blocks).collect()}
    true = {"<": lambda a, b: b < 4, "<=": lambda a, b: b <= 4, ">": lambda a, b: a > 4, ">=": lambda a, b: a >= 4}[op]
    false = {"<": lambda a, b: a >= 4, "<=": lambda a, b: a > 4, ">": lambda a, b: b <= 4, ">=": lambda a, b: b < 4}[op]
    want = set()
    for i, (a, b, s) in enumerate(rows):
        a, b = (0.0 if a is None else a), (float("inf") if b is None else b)
        if ("TRUE" in s and not true(a, b)) or ("FALSE" in s and not false(a, b)):
            want.add(i)
    assert got == want


def sha(*parts):
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def ledger_rows(n, links):
    out, previous = [], None
    for s in range(n):
        science = hashlib.sha256(f"b{s}".encode()).hexdigest()
        origin = sha(science, "ok")
        digest = sha(previous or "", science, origin)
        back = next((a for a, b in links.items() if b == s), None)
        out.append([1, s, s, f"b{s}", "ok", previous, science, origin, digest, back, links.get(s)])
        previous = digest
    return out


LEDGER = "ledger_id int, seq int, record_id int, body string, checks string, previous string, scientific string, provenance string, digest string, supersedes int, superseded_by int"


def found(spark, rows):
    return {(r.record_id, r.violation) for r in proofs.ledger_violations(spark.createDataFrame([tuple(r) for r in rows], LEDGER)).collect()}


def test_ledger(spark):
    rows = ledger_rows(6, {1: 2, 3: 5})
    assert found(spark, rows) == set()
    for column, value, want in ((3, "x", {(2, "scientific"), (2, "provenance"), (2, "digest")}), (4, "x", {(2, "provenance"), (2, "digest")}), (8, "x", {(2, "digest"), (3, "chain"), (3, "digest")}), (5, "x", {(2, "chain")}), (5, None, {(2, "chain")}), (9, 4, {(2, "supersession")}), (9, 99, {(2, "supersession")}), (3, None, {(2, "scientific"), (2, "provenance"), (2, "digest")})):
        changed = [list(r) for r in rows]
        changed[2][column] = value
        assert found(spark, changed) == want, (column, value)
    assert found(spark, rows[:2] + rows[3:]) == {(3, "chain"), (3, "digest")}
    assert found(spark, []) == set()


def test_current_records(spark):
    """A chain of 40, pointers to nowhere and on a circle."""
    links = {s: s + 1 for s in range(40)} | {45: 99, 50: 51, 51: 52, 52: 50, 53: 50}
    rows = spark.createDataFrame([tuple(r) for r in ledger_rows(60, links)], LEDGER)
    got = {r.record_id: (r.current, r.steps) for r in proofs.current_records(rows).collect()}
    for s in range(60):
        assert got[s] == ((40, 40 - s) if s <= 40 else (None, None) if 50 <= s <= 53 else (s, 0))
    assert {r.record_id for r in proofs.active_records(rows).collect()} == set(range(60)) - set(links)
    assert proofs.current_records(rows.filter(F.lit(False))).count() == 0


def test_ledgers_with_odd_digests(spark):
    """Digests that are no hexadecimal digits, capitals, an empty one before the first, and one that fits what comes before though another is named."""
    rows = ledger_rows(6, {})
    for k, column, value, want in ((0, 5, "", {(0, "chain")}), (0, 5, "0" * 64, {(0, "chain")}), (2, 5, rows[2][5].upper(), {(2, "chain")}), (2, 8, rows[2][8].upper(), {(2, "digest"), (3, "chain"), (3, "digest")}), (2, 8, "é", {(2, "digest"), (3, "chain"), (3, "digest")}), (2, 8, None, {(2, "digest"), (3, "chain"), (3, "digest")}), (2, 7, None, {(2, "provenance")})):
        changed = [list(r) for r in rows]
        changed[k][column] = value
        assert found(spark, changed) == want, (k, column, value)
    digest = lambda *parts: hashlib.sha256("|".join(parts).encode()).hexdigest()
    changed = [list(r) for r in rows]
    changed[2][8] = "é"
    changed[3][8] = digest("é", changed[3][6], changed[3][7])
    assert found(spark, changed) == {(2, "digest"), (3, "chain"), (4, "chain"), (4, "digest")}


def test_ledgers_store_no_digests_and_rounds_hold_links(spark, monkeypatch):
    kept = []

    def spy(df, path=None):
        kept.append(graphs.stored(df, path))
        return kept[-1]

    monkeypatch.setattr("orbitframe.registry.proofs.stored", spy)
    QUERIES["ledger_integrity"](spark, "/root/testdata/sf0.001")
    assert kept and not any("digest" in df.schema.simpleString() for df in kept)
    monkeypatch.setattr("orbitframe.plans.proofs.stored", spy)
    kept.clear()
    proofs.current_records(spark.createDataFrame([tuple(r) for r in ledger_rows(60, {1: 2, 2: 3, 9: 99})], LEDGER))
    assert {df.count() for df in kept} == {2}
