"""Raw sequences as users paste them, and rings by the names of their atoms."""

import pytest
from pyspark.sql import functions as F

from orbitframe.functions import text as t
from orbitframe.operators import interactions

CASES = [
    (None, ("EMPTY", None, None, 0, 0, None)),
    (" \t\n", ("EMPTY", None, None, 0, 0, None)),
    (">only a header", ("HEADER_ONLY", None, None, 0, 0, None)),
    ("> h \n  \n", ("HEADER_ONLY", None, None, 0, 0, None)),
    (">h\n  \n.", ("BAD_LETTERS", "h", None, 1, 1, "'.' at position 1")),
    ("> sp|P1 \r\nMKT\r\nayi k", ("VALID", "sp|P1", "MKTAYIK", 7, 0, None)),
    ("MKTA", ("TOO_SHORT", None, None, 4, 0, None)),
    ("MKTAY", ("VALID", None, "MKTAY", 5, 0, None)),
    ("A" * 2001, ("TOO_LONG", None, None, 2001, 0, None)),
    ("MKxBz1 -K*", ("BAD_LETTERS", None, None, 9, 6, "'x' at position 3, 'B' at position 4, 'z' at position 5, '1' at position 6, '-' at position 7 (+1 more)")),
    ("MK>TA", ("BAD_LETTERS", None, None, 5, 1, "'>' at position 3")),
]


def test_fasta(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)], "i int, raw string")
    found = {r.i: tuple(r.f) for r in df.select("i", t.validate_fasta(F.col("raw")).alias("f")).collect()}
    for i, (raw, want) in enumerate(CASES):
        assert found[i] == want, raw
    assert df.filter("i = 5").select(t.validate_fasta(F.col("raw"), headers=False)["status"]).first()[0] == "HEADER_NOT_ALLOWED"


def test_fasta_of_long_sequences(spark):
    """Bad letters of any script late in a long sequence, whose letters are not taken apart one by one."""
    cases = [("M" * 300_000 + "\u00e9" + "K" * 9 + "\U0001f600" + "\u3000\ufeff", "'\u00e9' at position 300001, '\U0001f600' at position 300011", 2), ("\x85A\n\u2005b" + "o" * 6, "'\x85' at position 1, 'b' at position 3, 'o' at position 4, 'o' at position 5, 'o' at position 6 (+3 more)", 8), ("A" * 20 + "*", "'*' at position 21", 1)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, raw string").select("i", t.validate_fasta(F.col("raw")).alias("f"))
    assert {r.i: (r.f.bad, r.f.n_bad) for r in df.collect()} == {i: c[1:] for i, c in enumerate(cases)}
    assert "split(" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("seq, want", [(None, (False, False, False)), ("", (False, False, False)), ("ac gt\nN", (True, False, True)), ("ACGU", (False, True, True)), ("ACGTU", (False, False, True)), ("ACGI", (False, False, True)), ("ACGX", (False, False, False))])
def test_nucleic(spark, seq, want):
    df = spark.createDataFrame([(seq,)], "s string")
    assert tuple(df.select(*[t.validate_nucleic(F.col("s"), m)[0].alias(m) for m in ("DNA", "RNA", "ANY")]).first()) == want


def test_rings_by_names(spark):
    hexagon = [(1.0, 0.0), (0.5, 0.866), (-0.5, 0.866), (-1.0, 0.0), (-0.5, -0.866), (0.5, -0.866)]

    def ring(residue, resname, names, z, first=0, chain="A"):
        return [(0, 0, chain, residue, resname, first + k, n, x, y, z) for k, (n, (x, y)) in enumerate(zip(names.split(), hexagon))]

    six = "CG CD1 CE1 CZ CE2 CD2"
    rows = ring(1, "PHE", six, 0.0) + [(0, 0, "A", 1, "PHE", 90, "CA", 50.0, 50.0, 50.0)] + ring(2, " tyr", six, 4.0, 10)
    rows += ring(3, "PHE", "CG CD1 CE1 CZ", 1.0, 20) + ring(4, "ALA", six, 1.0, 30) + ring(5, "HIS", "CG ND1 CE1 NE2", 8.1, 40, "B")
    rows += [(0, 0, "A", 6, "HIS", 60 + k, n, float(k), 0.0, 90.0) for k, n in enumerate("CG ND1 CE1 NE2 CD2".split())]  # on a line
    rows += ring(7, "TRP", "CD2 CE2 CZ2 CH2 CZ3 CE3", 200.0, 70) + [(0, 0, "A", 7, "TRP", 80 + k, n, 2.0 + k, 1.0 + k % 2, 200.0) for k, n in enumerate("CG CD1 NE1".split())]
    found = interactions.rings(spark.createDataFrame(rows, "traj_id int, frame long, chain string, residue int, resname string, atom_id int, name string, x double, y double, z double"))
    got = {(r.residue, r.kind): r for r in found.collect()}
    assert got.keys() == {(1, "6_MEMBERED"), (2, "6_MEMBERED"), (5, "5_MEMBERED"), (7, "6_MEMBERED"), (7, "5_MEMBERED")}
    assert (got[1, "6_MEMBERED"].x, got[1, "6_MEMBERED"].z, got[1, "6_MEMBERED"].n_atoms) == (0.0, 0.0, 6) and got[2, "6_MEMBERED"].resname == "TYR"
    pairs = [tuple(r) for r in interactions.pi_stacking(found).select("residue", "residue_b", "between_chains", "stacking").collect()]
    assert sorted(pairs) == [(1, 2, False, "parallel"), (2, 5, True, "parallel")]
