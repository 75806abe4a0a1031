"""Files as tables and back, on small literal files."""

import hashlib
import json

from pyspark.sql import functions as F

from orbitframe.operators import sequences
from orbitframe.sources import export, ingest


def atom(serial, name, resname, chain, residue, x, y, z, element, record="ATOM  "):
    return f"{record}{serial:>5} {name:<4} {resname:>3} {chain}{residue:>4}    {x:8.3f}{y:8.3f}{z:8.3f}{1:6.2f}{20:6.2f}          {element:>2}  "


PDB = "\n".join(["CRYST1   80.000   80.000   80.000  90.00  90.00  90.00 P 1", atom(1, " CA", "ALA", " ", 155, 1.5, -2.25, 3, "C"), atom(2, " O2", "LIG", "B", 1, 4, 5, 6, "O", "HETATM"), "ATOM  garbage", "CONECT    1    2    2", "CONECT    2    1    1", "CONECT    3    3", "END", ""])


def write(path, text):
    path.write_text(text)
    return str(path)


def test_pdb_round_trip(spark, tmp_path):
    path = write(tmp_path / "a.pdb", PDB)
    atoms = ingest.ingest_pdb(spark, path).filter("x is not null")
    assert [tuple(r) for r in atoms.select("serial", "name", "chain", "residue", "x", "is_hetero").orderBy("serial").collect()] == [(1, "CA", "A", 155, 1.5, False), (2, "O2", "B", 1, 4.0, True)]
    assert ingest.ingest_pdb_cell(spark, path).first().lx == 80.0
    export.export_pdb(atoms, str(tmp_path / "out"))
    again = ingest.ingest_pdb(spark, str(tmp_path / "out"))
    assert export.roundtrip_check(atoms, again).first().ok
    bonds = ingest.ingest_conect(spark, path).collect()
    assert [(b.i, b.j, b.bond_order) for b in bonds] == [(1, 2, 2)]


def test_gro(spark, tmp_path):
    text = "title\n    2\n  155ALA     CA    1   1.000   2.000   3.000\n    1LIG     O2    2   4.000   5.000   6.000\n   8.00000   8.00000   8.00000\n"
    rows = ingest.ingest_gro(spark, write(tmp_path / "a.gro", text)).orderBy("serial").collect()
    assert [(r.residue, r.name, r.x, r.z) for r in rows] == [(155, "CA", 10.0, 30.0), (1, "O2", 40.0, 60.0)]


def test_alignment_hits(spark, tmp_path):
    line = "q1\tt{k}\t{i}\t100\t3\t0\t1\t100\t1\t100\t1e-{k}\t200"
    path = write(tmp_path / "a.m8", "# comment\n" + "\n".join([line.format(k=k, i=0.3 * k) for k in (1, 2, 3)] + ["short\trow"]) + "\n")
    hits = ingest.ingest_alignment_hits(spark, path)
    assert hits.count() == 3
    names = spark.createDataFrame([("t2", "two"), ("t3", "three")], "target string, label string")
    assert {r.label for r in ingest.hits_filter_join(hits, names, 1e-2, 0.5).collect()} == {"two", "three"}


def test_pockets(spark, tmp_path):
    csv = write(tmp_path / "p.csv", "name , rank, score, center_x, center_y, center_z, residue_ids\npocket1, 1, 3.5, 1, 2, 3, A_1 A_2\n")
    row = ingest.ingest_pocket_csv(spark, csv).first()
    assert (row.pocket_id, row.score, row.z, row.residue_ids) == ("1", 3.5, 3.0, ["A_1", "A_2"])
    info = write(tmp_path / "p.txt", "Pocket 1 :\n\tScore : \t0.5\n\tVolume :\t100.0\n\nPocket 2 :\n\tScore : 0.25\n")
    found = {(r.pocket, r.key): r.value for r in ingest.ingest_pocket_info(spark, info).collect()}
    assert found == {(1, "Score"): 0.5, (1, "Volume"): 100.0, (2, "Score"): 0.25}


def test_mapping_and_features(spark, tmp_path):
    body = {"accession": "P1", "length": 10, "segments": [{"chain": "A", "unp_start": 1, "unp_end": 3, "pdb_start": 11}, {"chain": "A", "unp_start": 6, "unp_end": 7, "pdb_start": 16}]}
    mapped = ingest.ingest_mapping_json(spark, write(tmp_path / "m.json", json.dumps(body)))
    assert {(r.position, r.residue) for r in mapped.collect()} == {(1, 11), (2, 12), (3, 13), (6, 16), (7, 17)}
    assert ingest.mapping_coverage(mapped).first().coverage == 50.0
    features = spark.createDataFrame([("P1", "SITE", 2, 6)], "accession string, kind string, begin int, end int")
    assert {r.residue for r in ingest.uniprot_features_join(features, mapped).collect()} == {12, 13, 16}


def test_mapping_coverage_counts_positions_once(spark):
    """Positions named more than once, at either end of a word of 64 and below zero; sequences without positions or a length."""
    rows = [("a", 200, p) for p in (0, 63, 64, 64, 127, 128, -1, -64, -65, 63)] + [("b", 10, None), ("c", None, 5), ("d", 1, 2**31 - 1), ("d", 1, -(2**31))]
    mapped = spark.createDataFrame(rows, "accession string, length int, position int")
    found = ingest.mapping_coverage(mapped)
    assert {r.accession: r.coverage for r in found.collect()} == {"a": 4.0, "b": 0.0, "c": None, "d": 200.0}
    # No shuffle deals rows by position: a task sends a row for each 64 of them.
    assert "position" not in "".join(line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line)


def test_interaction_xml_and_provenance(spark, tmp_path):
    xml = "<report><hydrogen_bonds><hydrogen_bond id='1'><resnr>7</resnr><restype>ASP</restype><reschain>A</reschain><dist_d_a>2.9</dist_d_a></hydrogen_bond></hydrogen_bonds></report>"
    row = ingest.ingest_interaction_xml(spark, write(tmp_path / "i.xml", xml)).first()
    assert (row.resnr, row.restype, row.dist_d_a) == (7, "ASP", 2.9)
    folder = tmp_path / "inputs"
    folder.mkdir()
    for name in ("a", "b", "c"):
        (folder / name).write_text(name * 10)
    digest = hashlib.sha256(b"a" * 10).hexdigest()
    manifest = spark.createDataFrame([("a", 10, digest), ("b", 10, digest), ("d", 1, digest)], "name string, size_bytes long, sha256 string")
    assert {r.name: r.status for r in ingest.verify_provenance(spark, str(folder), manifest).collect()} == {"a": "OK", "b": "CHANGED", "c": "UNLISTED", "d": "MISSING"}


def test_csv_and_fasta(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 1), ("plain", 2), ("-x", 3)], "s string, n int")
    export.export_csv(df, str(tmp_path / "c"))
    assert {r.s for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()} == {"'=1+1", "plain", "'-x"}
    atoms = spark.createDataFrame([("t", "A", i, "ALA" if i % 2 else "XXX") for i in range(1, 71)], "traj_id string, chain string, residue int, resname string")
    assert export.export_fasta(atoms, ["traj_id"]).first().sequence == "AX" * 30 + "\n" + "AX" * 5


def test_leakage(spark):
    queries = spark.createDataFrame([(1, "ACDEFGHIKL"), (2, "AAAA"), (3, ""), (4, "ACDEFGHIKLMNPQRSTVWYACDEFGHIKL")], "seq_id long, seq string")
    training = spark.createDataFrame([(10, "ACDEFGHIKV"), (11, "TTTTT"), (12, "ACDEFGHIKL")], "train_id long, train string")

    def identity(a, b):
        return sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b)) if a and b else 0.0

    for t in (0.15, 0.3, 0.9):
        expected = {(q.seq_id, s.train_id) for q in queries.collect() for s in training.collect() if identity(q.seq, s.train) >= t}
        assert {(r.seq_id, r.train_id) for r in sequences.leakage_join(queries, training, t).collect()} == expected


def test_round_trip_of_frames_beyond_the_serial_numbers(spark, monkeypatch, tmp_path):
    """6,000 frames of 21 atoms, more than five digits can number: parts of a trajectory keep their atoms apart."""
    from orbitframe.registry import files
    from orbitframe.sources import views

    frames = spark.range(6000).select(F.lit(0).alias("traj_id"), F.col("id").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(views.N_ATOMS - 1))).alias("atom_id"))
    frames = frames.select("*", *[((F.col("frame") * 7 + F.col("atom_id") * k) % 4000 / 100.0).alias(n) for k, n in enumerate("xyz", 1)])
    monkeypatch.setattr(views, "te_full", lambda s, d: frames.join(F.broadcast(views.te_atoms(s)), "atom_id"))
    monkeypatch.setattr(files, "shared_path", lambda s: str(tmp_path / "pdb"))
    atoms = files._atoms(spark, "")
    assert atoms.agg(F.max("serial")).first()[0] <= 99_999 and atoms.select("traj_id", "part", "serial").distinct().count() == 126_000
    row = files.QUERIES["roundtrip_check"](spark, "").first()
    assert (row.n, row.n_unmatched, row.ok) == (126_000, 0, True)


def test_decimals_as_printf(spark):
    """Coordinates are written by their exact binary value, as SQL's printf does; ties go to the even digit."""
    from orbitframe.functions.text import fixed

    values = [k / 10_000 for k in range(-20_005, 20_006, 10)] + [k / 16 for k in range(-99, 99)] + [0.0, -0.0, 1e-300, -1e-9, 123456.7895, 99999.99949999999, 2.0**30 + 0.0625, -7.0005]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert [(r.v, r.s) for r in rows.select("v", fixed(F.col("v"), 3).alias("s")).collect()] == [(v, "%.3f" % v) for v in values]
    atoms = spark.createDataFrame([(1, "CA", "ALA", "A", 1, 1.0005, 0.0625, -2.0015, 1.0, 20.0, "C", False)], "serial int, name string, resname string, chain string, residue int, x double, y double, z double, occupancy double, b_factor double, element string, is_hetero boolean")
    assert export.pdb_lines(atoms).first().value[30:54] == "%8.3f%8.3f%8.3f" % (1.0005, 0.0625, -2.0015)


def test_mapping_files_are_bounded(spark, monkeypatch, tmp_path):
    """Ten times the orders make more files, and no file holds more orders."""
    from orbitframe.registry import files

    lines = lambda n: spark.range(n).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "3.0D AS l_quantity")
    monkeypatch.setattr(files, "ORDERS", 50, raising=False)
    most = []
    for n in (400, 4000):
        monkeypatch.setattr(files.v, "table", lambda s, d, name, n=n: lines(n))
        monkeypatch.setattr(files, "shared_path", lambda s, n=n: str(tmp_path / f"m{n}"))
        assert files.QUERIES["ingest_mapping_json"](spark, "").count() == 4 * n
        most.append(max(f.stat().st_size for f in (tmp_path / f"m{n}").rglob("*.txt")))
    assert most[1] < 1.5 * most[0]


def test_features_are_joined_by_stretches(spark):
    """Ranges across stretches, empty and turned ones; copies of ranges are never broadcast."""
    residues = spark.createDataFrame([("P", k) for k in range(0, 300)] + [("Q", 5)], "accession string, position int")
    features = spark.createDataFrame([("P", "a", 60, 200), ("P", "b", 63, 64), ("P", "c", 9, 8), ("Q", "d", 5, 5), ("P", "e", None, 9)], "accession string, kind string, begin int, end int")
    found = ingest.uniprot_features_join(features, residues)
    assert found.columns == ["accession", "position", "kind"]
    assert sorted(map(tuple, found.collect())) == sorted([("P", k, "a") for k in range(60, 201)] + [("P", 63, "b"), ("P", 64, "b"), ("Q", 5, "d")])
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
