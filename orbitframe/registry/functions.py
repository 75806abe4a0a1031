"""Registered scalar functions over the trajectories, sequences and further tables."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from orbitframe.functions import geometry as g
from orbitframe.functions import text as t
from orbitframe.functions.geometry import r6
from orbitframe.registry.structure import _turn, rounded
from orbitframe.sources import views as v
from orbitframe.sources.views import sql

ANGLES = (80.0, 95.0, 110.0)


def _four(p, d):
    """Four atoms of each frame side by side."""
    rows = v.te(p, d).filter("atom_id < 4").groupBy("traj_id", "frame").pivot("atom_id", [0, 1, 2, 3]).agg(F.first(F.struct(*"xyz")))
    return rows.select("traj_id", "frame", *[F.col(str(i)).alias(f"p{i}") for i in range(4)])


def _p(i):
    return g.vec(f"p{i}.")


def _box():
    return g.const(20.0, 20.0, 20.0)


def _cell():
    return g.cell_matrix(g.const(20.0, 18.0, 22.0), g.const(*ANGLES))


def _frames(*columns):
    return lambda p, d: rounded(_four(p, d).select("traj_id", "frame", *[c() if callable(c) else c for c in columns]))


def _two(f, n):
    return [F.get(F.array(*f), F.lit(k)).alias(m) for k, m in enumerate(n)]


def _half():
    """Boxes around atoms 0..1 and 2..3."""
    sides = []
    for a, b in ((0, 1), (2, 3)):
        low, high = (tuple(f(x, y) for x, y in zip(_p(a), _p(b), strict=True)) for f in (F.least, F.greatest))
        sides += [g.scale(g.add(low, high), 0.5), g.scale(g.sub(high, low), 0.5)]
    return sides


def _wrapped(p, d):
    h = _cell()
    s = g.to_fractional(g.vec(), h)
    w = g.to_cartesian(tuple(c - F.floor(c) for c in s), h)
    return rounded(v.te(p, d).select("traj_id", "frame", "atom_id", *[c.alias(f"s{n}") for c, n in zip(s, "xyz", strict=True)], *[c.alias(f"w{n}") for c, n in zip(w, "xyz", strict=True)]))


def _abc():
    return tuple(map(F.col, ("a", "b", "c"))), tuple(map(F.col, ("al", "be", "ga")))


def _dims(p, d):
    """Cells of all kinds: rectangular, skewed, not reduced, impossible."""
    size = F.col("p_size")
    angle = lambda k: F.when(size % 4 == 0, 90.0).otherwise((60 + (size * k) % 70).cast("double"))
    return v.table(p, d, "part").select("p_partkey", *[(10 + (size * k) % 17).cast("double").alias(n) for k, n in ((1, "a"), (2, "b"), (3, "c"))], *[angle(k).alias(n) for k, n in ((5, "al"), (7, "be"), (11, "ga"))])


def _cells(p, d):
    det = g.determinant(g.cell_matrix(*_abc()))
    return rounded(_dims(p, d).select("p_partkey", det.alias("volume"), F.when(det <= 1e-9, "DEGENERATE").otherwise("OK").alias("status")))


def _fractional(p, d):
    s = g.to_fractional(g.vec(), _cell())
    return rounded(v.te(p, d).select("traj_id", "frame", "atom_id", *[c.alias(f"s{n}") for c, n in zip(s, "xyz", strict=True)]))


def _cartesian(p, d):
    r = g.to_cartesian(g.scale(g.vec(), 0.1), _cell())
    return rounded(v.te(p, d).select("traj_id", "frame", "atom_id", *[c.alias(f"r{n}") for c, n in zip(r, "xyz", strict=True)]))


def _kdops():
    """Projections of atoms 0 and 1, and of 2 and 3: least, greatest, least, greatest."""
    sides = [[g.projections(_p(i)) for i in pair] for pair in ((0, 1), (2, 3))]
    return [F.array(*[f(x, y) for x, y in zip(*side, strict=True)]) for side in sides for f in (F.least, F.greatest)]


METHOD_TEXTS = ["X-ray diffraction", "Cryo-EM", "solution nmr", "Solid-state NMR", "neutron", "electron crystallography", "AlphaFold model", "unclear"]


def _refined(p, d):
    """Parts as structures of eight kinds of methods, with a number of their price."""
    texts = F.array(*map(F.lit, METHOD_TEXTS))
    method = t.classify_method(F.get(texts, (F.col("p_partkey") % 8).cast("int")), F.when(F.col("p_size") == 50, "designed"))
    return v.table(p, d, "part").select("p_partkey", "p_size", method.alias("method"), F.format_string("%.4f", F.col("p_retailprice") / 50).alias("number"))


def _codes():
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    structure = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("pdb_0000"), F.lpad(k, 4, "0"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("a"), F.lpad(k, 3, "0"))).otherwise(F.concat(k, F.lit("-"), n))
    protein = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("af-p"), F.lpad(k, 6, "0"), F.lit("-2-f1"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("q"), F.lpad(k, 5, "0"))).otherwise(n)
    return {"structure": structure, "protein": protein, "archive": F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("ma-x-"), k)).otherwise(F.concat(F.lit("MA-"), k))}


def _identity(p, d):
    """Each document against one benchmark item, by the rest of its id."""
    items = v.numbered(v.sq(p, d, "benchmark", "item_id").withColumn("one", F.lit(0)), "one", ["seq_id"], "k").select("k", F.col("seq").alias("seq_b"))
    n = v.table(p, d, "benchmark").count()
    rows = v.sq(p, d).withColumn("k", F.col("seq_id") % max(n, 1))
    return rounded(rows.join(items, "k").select("seq_id", t.sequence_identity(F.col("seq"), F.col("seq_b")).alias("identity")))


def _raw_sequence():
    """Texts as raw protein sequences: with a header line, as they are, their amino letters only, a header alone, the first words' letters."""
    amino, k = F.regexp_replace("text", f"[^{t.AMINO_LETTERS}{t.AMINO_LETTERS.lower()}]+", ""), F.col("doc_id") % 6
    named = F.concat(F.lit(" > document "), F.col("doc_id").cast("string"))
    return F.when(k == 0, F.concat(named, F.lit(" \n"), amino)).when(k == 1, F.col("text")).when(k == 2, amino).when(k == 3, named).when(k == 4, F.concat(named, F.lit("\n"), F.col("text"))).otherwise(F.substring(amino, 1, (F.col("doc_id") % 37).cast("int")))


def _nucleic(docs):
    """Texts cut down to the letters of one alphabet, or left as they are, under every mode."""
    k = F.col("doc_id") % 4
    kept = F.regexp_replace("text", "[^ACGTNacgtn \n]", "")
    raw = F.when(k == 0, kept).when(k == 1, F.translate(kept, "tT", "uU")).when(k == 2, F.regexp_replace("text", "[^ACGTUINacgtuin \n]", "")).otherwise(F.col("text"))
    rows = docs.select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", *[t.validate_nucleic(F.col("raw"), m)[0].alias(m.lower()) for m in t.NUCLEIC], F.sha2(t.validate_nucleic(F.col("raw"))[1], 256).alias("clean_sha256"))


QUERIES = {
    "dist": _frames(lambda: g.dist(_p(0), _p(1)).alias("d")),
    "mic_ortho": _frames(lambda: g.mic_dist(_p(0), _p(3), _box()).alias("d")),
    "mic_triclinic": _frames(lambda: g.mic_triclinic(g.sub(_p(0), _p(3)), _cell()).alias("d")),
    "cell_from_dims": _cells,
    "wrap": _wrapped,
    "angle": _frames(lambda: g.angle(_p(0), _p(1), _p(2)).alias("a")),
    "angle_series_stats": lambda p, d: rounded(_four(p, d).withColumn("a", g.angle(_p(0), _p(1), _p(2))).groupBy("traj_id").agg(F.avg("a").alias("mean"), F.stddev_pop("a").alias("sd"), F.min("a").alias("min"), F.max("a").alias("max"))),
    "dihedral": _frames(lambda: g.dihedral(*map(_p, range(4))).alias("a")),
    "normal_angle": _frames(lambda: g.normal_angle(g.plane_normal(_p(0), _p(1), _p(2)), g.plane_normal(_p(1), _p(2), _p(3))).alias("a")),
    "bounds_aabb_ortho": lambda p, d: rounded(_four(p, d).select("traj_id", "frame", *_two(g.box_bounds(*_half(), _box()), ("lower", "upper")))),
    "bounds_aabb_open": lambda p, d: rounded(_four(p, d).select("traj_id", "frame", *_two(g.box_bounds(*_half()), ("lower", "upper")))),
    "bounds_aabb_triclinic": lambda p, d: rounded(_four(p, d).select("traj_id", "frame", *_two(g.box_bounds_triclinic(*_half(), _cell()), ("lower", "upper")))),
    "center_in_box": lambda p, d: rounded(v.te(p, d).select("traj_id", "frame", "atom_id", *[(F.col(n) - F.avg(n).over(_by_frame()) + 10).alias(n) for n in "xyz"])),
    "kleene": lambda p, d: v.ev(p, d).select("traj_id", "frame", F.when(F.col("frame") % 3 != 0, F.col("flag_a")).alias("a"), F.when(F.col("frame") % 4 != 0, F.col("flag_b")).alias("b")).select("traj_id", "frame", (F.col("a") & F.col("b")).alias("both"), (F.col("a") | F.col("b")).alias("either"), (~F.col("a")).alias("no_a")),
    "canonical_keys": lambda p, d: v.te_full(p, d).select("traj_id", "frame", "atom_id", t.atom_key("chain", "residue", "name").alias("atom"), t.bond_key(t.atom_key("chain", "residue", "name"), F.lit("B:1:CA")).alias("bond")),
    "reverse_complement": lambda p, d: v.table(p, d, "documents").select("doc_id", F.sha2(t.reverse_complement(F.regexp_replace("text", "[^A-Za-z ]", "")), 256).alias("digest")),
    "validate_sequence": lambda p, d: v.sq(p, d).select("seq_id", *[c.alias(n) for c, n in zip(t.validate_sequence(F.col("seq")), ("status", "n_bad"), strict=True)]),
    "validate_fasta": lambda p, d: v.table(p, d, "documents").select("doc_id", t.validate_fasta(_raw_sequence()).alias("found")).select("doc_id", "found.*"),
    "validate_nucleic": lambda p, d: _nucleic(v.table(p, d, "documents")),
    "modular_periodicity": lambda p, d: rounded(v.sq(p, d).select("seq_id", t.periodicity(F.col("seq")).alias("share")).withColumn("periodic", F.col("share") > 0.35)),
    "polynomial_residue_hash": lambda p, d: v.sq(p, d).select("seq_id", t.polynomial_hash(F.col("seq")).alias("hash")),
    "design_space_size": lambda p, d: rounded(v.sq(p, d).select("seq_id", (F.length("seq") * F.log10(F.lit(20.0))).alias("log10_size"))),
    "sequence_identity": _identity,
    "export_csv": lambda p, d: v.table(p, d, "events").select("event_id", t.csv_safe(F.col("props")).alias("props"), t.csv_safe(F.concat(F.when(F.col("event_id") % 3 == 0, "=").otherwise(""), "event_type")).alias("kind")),
    "canonical_digest": lambda p, d: v.table(p, d, "customer").select("c_custkey", t.canonical_digest("c_custkey", "c_name", "c_nationkey").alias("digest")),
    "index_commitment": lambda p, d: v.table(p, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.sha2(F.concat_ws("|", "l_linenumber", "l_partkey"), 256).alias("h")))).alias("hs")).select("l_orderkey", F.sha2(F.array_join(F.transform("hs", lambda x: x["h"]), ""), 256).alias("commitment")),
    "coordinate_digest": lambda p, d: v.te(p, d).groupBy("traj_id", "frame").agg(F.array_sort(F.collect_list(F.struct("atom_id", F.concat_ws(",", *[F.round(F.col(n) * 1000).cast("long") for n in "xyz"]).alias("s")))).alias("xs")).select("traj_id", "frame", F.sha2(F.array_join(F.transform("xs", lambda x: x["s"]), ";"), 256).alias("digest")),
    "parse_resolution": lambda p, d: rounded(_refined(p, d).select("p_partkey", "method", t.parse_resolution(F.concat(F.lit("about "), "number", F.lit(" A")), F.col("method")).alias("resolution"))),
    "parse_rfactor": lambda p, d: rounded(_refined(p, d).select("p_partkey", t.parse_rfactor(F.concat("number", F.lit("%")), F.col("method")).alias("r_work"), t.parse_rfactor(F.when(F.col("p_size") % 3 > 0, (30 - F.col("p_size") / 4).cast("string")), F.col("method")).alias("r_free"), (1985 + F.col("p_size")).alias("year")).withColumn("note", t.rfactor_note(*map(F.col, ("r_work", "r_free", "year"))))),
    "normalize_identifiers": lambda p, d: v.table(p, d, "supplier").select("s_suppkey", *[t.normalize_accession(F.concat(F.lit(" "), c, F.lit(" ")), F.lit(k)).alias(k) for k, c in _codes().items()]),
    "classify_mutation": lambda p, d: v.te_full(p, d).groupBy("traj_id", t.classify_mutation(F.col("element"), F.lit("C"), F.col("is_hetero")).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    "assembly_label": lambda p, d: v.table(p, d, "orders").join(v.table(p, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select("o_orderkey", t.oligomer_label(F.col("n")).alias("label"), t.assembly_origin(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("by pisa "), "o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, F.lit("author"))).alias("origin"), t.stoichiometry(F.col("n")).alias("stoichiometry")),
    "trajectory_claims": lambda p, d: v.table(p, d, "customer").select("c_custkey", F.array_join(t.unverifiable_claims(F.col("c_nationkey") % 5 == 0, F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, ""), F.when(F.col("c_custkey") % 7 < 4, "NPT"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal")).when(F.col("c_custkey") % 4 == 1, F.lit(float("nan"))), F.when(F.col("c_custkey") % 11 > 2, F.col("c_custkey") % 2 == 0)), ",").alias("claims")),
    "trajectory_authenticity": lambda p, d: v.table(p, d, "customer").select("c_custkey", t.trajectory_authenticity(F.col("c_nationkey") % 5 == 0, F.when(F.col("c_nationkey") % 3 == 0, "").when(F.col("c_nationkey") % 3 == 1, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal")).when(F.col("c_custkey") % 4 == 1, F.lit(float("nan"))), F.when(F.col("c_custkey") % 4 == 2, 1.0)).alias("kind")),
    "cell_checks": lambda p, d: rounded(_dims(p, d).select("p_partkey", *[c.alias(n) for n, c in g.cell_checks(g.cell_matrix(*_abc())).items()])),
    "to_fractional": _fractional,
    "to_cartesian": _cartesian,
    "plane_normal": lambda p, d: rounded(_four(p, d).select("traj_id", "frame", *[c.alias(f"n{n}") for c, n in zip(g.plane_normal(_p(0), _p(1), _p(2)), "xyz", strict=True)])),
    "bounds_kdop_periodic": lambda p, d: rounded(_four(p, d).select("traj_id", "frame", *_two(g.kdop_bounds_periodic(*_kdops(), _cell()), ("lower", "upper")))),
    "kdop_contains": lambda p, d: _four(p, d).select("traj_id", "frame", g.kdop_contains(*_kdops()[:2], g.projections(g.scale(g.add(_p(0), _p(1)), 0.5))).alias("middle"), g.kdop_contains(*_kdops()[:2], g.projections(_p(2))).alias("other"), r6(g.aabb_volume(*_kdops()[:2])).alias("volume")),
    "export_result_json": lambda p, d: v.table(p, d, "customer").select(F.from_json(F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")), "c_custkey long, c_name string, c_acctbal double").alias("r")).select("r.*"),
}


def _by_frame():
    return Window.partitionBy("traj_id", "frame")


def _pt(i, n):
    return f"p{i}{n}"


FOUR = ", R AS (SELECT traj_id, frame, " + ", ".join(f"max({n}) FILTER (atom_id = {i}) AS p{i}{n}" for i in range(4) for n in "xyz") + " FROM TE WHERE atom_id < 4 GROUP BY 1, 2)"


def _d(a, b, box=None):
    diff = [f"(p{a}{n} - p{b}{n})" for n in "xyz"]
    return "sqrt(" + " + ".join(f"({x} - 20 * round_even({x} / 20, 0))**2" if box else f"{x}**2" for x in diff) + ")"


def _ang(a, b, c):
    u, w = [f"(p{a}{n} - p{b}{n})" for n in "xyz"], [f"(p{c}{n} - p{b}{n})" for n in "xyz"]
    dot = lambda p, q: "(" + "+".join(f"{i}*{j}" for i, j in zip(p, q, strict=True)) + ")"
    return f"degrees(acos(greatest(-1, least(1, {dot(u, w)} / (sqrt({dot(u, u)}) * sqrt({dot(w, w)}))))))"


def _bb(k, box):
    low, high = [], []
    for n in "xyz":
        ca, cb = f"((p0{n} + p1{n}) / 2)", f"((p2{n} + p3{n}) / 2)"
        both = f"(abs(p0{n} - p1{n}) / 2 + abs(p2{n} - p3{n}) / 2)"
        d = f"abs(({ca} - {cb}) - 20 * round_even(({ca} - {cb}) / 20, 0))" if box else f"abs({ca} - {cb})"
        low.append(f"greatest(0, {d} - {both})**2")
        high.append(f"least({d} + {both}, 10)**2" if box else f"({d} + {both})**2")
    return f"sqrt({' + '.join((low, high)[k])})"


LETTERS = "regexp_replace(seq, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g')"
def _cell_numbers():
    """Edge vectors of _cell() as numbers."""
    (a, b, c), (al, be, ga) = (20.0, 18.0, 22.0), map(math.radians, ANGLES)
    cx, cy = c * math.cos(be), c * (math.cos(al) - math.cos(be) * math.cos(ga)) / math.sin(ga)
    return (a, 0.0, 0.0), (b * math.cos(ga), b * math.sin(ga), 0.0), (cx, cy, math.sqrt(c * c - cx * cx - cy * cy))


H = [[f"({v!r}::DOUBLE)" for v in row] for row in _cell_numbers()]


def _frac(x, y, z):
    """The fractional coordinates, from the last one up, as H is triangular."""
    sz = f"(({z}) / {H[2][2]})"
    sy = f"((({y}) - {sz} * {H[2][1]}) / {H[1][1]})"
    return f"((({x}) - {sy} * {H[1][0]} - {sz} * {H[2][0]}) / {H[0][0]})", sy, sz


def _cart(s):
    return [" + ".join(f"({s[i]}) * {H[i][k]}" for i in range(3)) for k in range(3)]


def _least(terms):
    return f"least({', '.join(terms)})"


def _images():
    """Box bounds of atoms 0..1 and 2..3 for each of 27 images of the second box."""
    for v in g.SHIFTS:
        shift = [sum(v[i] * _cell_numbers()[i][k] for i in range(3)) for k in range(3)]
        low, high = [], []
        for n, t in zip("xyz", shift, strict=True):
            d = f"abs((p0{n} + p1{n}) / 2 - (p2{n} + p3{n}) / 2 - ({t!r}::DOUBLE))"
            both = f"(abs(p0{n} - p1{n}) / 2 + abs(p2{n} - p3{n}) / 2)"
            low.append(f"greatest(0, {d} - {both})**2")
            high.append(f"({d} + {both})**2")
        yield f"sqrt({' + '.join(low)})", f"sqrt({' + '.join(high)})"


def _normal(a, b, c):
    u, w = [f"(p{b}{n} - p{a}{n})" for n in "xyz"], [f"(p{c}{n} - p{a}{n})" for n in "xyz"]
    n = [f"({u[1]}*{w[2]} - {u[2]}*{w[1]})", f"({u[2]}*{w[0]} - {u[0]}*{w[2]})", f"({u[0]}*{w[1]} - {u[1]}*{w[0]})"]
    size = f"sqrt({' + '.join(f'{x}**2' for x in n)})"
    return [f"({x} / CASE WHEN {size} > 1e-12 THEN {size} ELSE 1 END)" for x in n]


_NEAR = _frac(*[f"p0{n} - p3{n}" for n in "xyz"])
_DIRS = ["{p}x", "{p}y", "{p}z", "({p}x + {p}y + {p}z) / sqrt(3)", "({p}x + {p}y - {p}z) / sqrt(3)", "({p}x - {p}y + {p}z) / sqrt(3)", "(-{p}x + {p}y + {p}z) / sqrt(3)"]


def _inside(point):
    return " AND ".join(f"{d.format(p=point)} BETWEEN least({d.format(p='p0')}, {d.format(p='p1')}) - 1e-9 AND greatest({d.format(p='p0')}, {d.format(p='p1')}) + 1e-9" for d in _DIRS)


METHOD = "CASE WHEN p_size = 50 THEN 'DE_NOVO_DESIGN' ELSE CASE p_partkey % 8 WHEN 0 THEN 'X_RAY_DIFFRACTION' WHEN 1 THEN 'ELECTRON_MICROSCOPY' WHEN 2 THEN 'SOLUTION_NMR' WHEN 3 THEN 'SOLID_STATE_NMR' WHEN 4 THEN 'NEUTRON_DIFFRACTION' WHEN 5 THEN 'ELECTRON_CRYSTALLOGRAPHY' WHEN 6 THEN 'COMPUTED_PREDICTION' ELSE 'UNKNOWN' END END"
ORACLE_SQL = {
    "dist": sql("TE", f"{FOUR} SELECT traj_id, frame, round({_d(0, 1)}, 6) AS d FROM R"),
    "mic_ortho": sql("TE", f"{FOUR} SELECT traj_id, frame, round({_d(0, 3, True)}, 6) AS d FROM R"),
    "mic_triclinic": sql("TE", f"{FOUR}, S AS (SELECT traj_id, frame, " + ", ".join(f"{c} - round_even({c}, 0) AS s{n}" for c, n in zip(_NEAR, "xyz", strict=True)) + " FROM R) SELECT traj_id, frame, round(" + _least(["sqrt(" + " + ".join(f"({c})**2" for c in _cart([f"s{n} + {i}" for n, i in zip("xyz", v, strict=True)])) + ")" for v in g.SHIFTS]) + ", 6) AS d FROM S"),
    "cell_from_dims": """SELECT p_partkey, round(det, 6) + 0.0 AS volume, CASE WHEN det <= 1e-9 THEN 'DEGENERATE' ELSE 'OK' END AS status FROM (SELECT p_partkey, a * b * sin(ga) * sqrt(greatest(0, c * c - (c * cos(be))**2 - (c * (cos(al) - cos(be) * cos(ga)) / sin(ga))**2)) AS det
        FROM (SELECT p_partkey, (10 + p_size % 17)::DOUBLE AS a, (10 + (p_size * 2) % 17)::DOUBLE AS b, (10 + (p_size * 3) % 17)::DOUBLE AS c, radians(CASE WHEN p_size % 4 = 0 THEN 90 ELSE 60 + (p_size * 5) % 70 END) AS al, radians(CASE WHEN p_size % 4 = 0 THEN 90 ELSE 60 + (p_size * 7) % 70 END) AS be, radians(CASE WHEN p_size % 4 = 0 THEN 90 ELSE 60 + (p_size * 11) % 70 END) AS ga FROM part))""",
    "wrap": sql("TE", ", S AS (SELECT *, " + ", ".join(f"{c} AS s{n}" for c, n in zip(_frac("x", "y", "z"), "xyz", strict=True)) + " FROM TE) SELECT traj_id, frame, atom_id, " + ", ".join(f"round(s{n}, 6) + 0.0 AS s{n}, round({c}, 6) + 0.0 AS w{n}" for n, c in zip("xyz", _cart([f"s{n} - floor(s{n})" for n in "xyz"]), strict=True)) + " FROM S"),
    "to_fractional": sql("TE", "SELECT traj_id, frame, atom_id, " + ", ".join(f"round({c}, 6) + 0.0 AS s{n}" for c, n in zip(_frac("x", "y", "z"), "xyz", strict=True)) + " FROM TE"),
    "to_cartesian": sql("TE", "SELECT traj_id, frame, atom_id, " + ", ".join(f"round({c}, 6) + 0.0 AS r{n}" for c, n in zip(_cart(["x * 0.1::DOUBLE", "y * 0.1::DOUBLE", "z * 0.1::DOUBLE"]), "xyz", strict=True)) + " FROM TE"),
    "plane_normal": sql("TE", f"{FOUR} SELECT traj_id, frame, " + ", ".join(f"round({c}, 6) + 0.0 AS n{n}" for c, n in zip(_normal(0, 1, 2), "xyz", strict=True)) + " FROM R"),
    "normal_angle": sql("TE", f"{FOUR} SELECT traj_id, frame, round(degrees(acos(least(1, abs({' + '.join(f'{a}*{b}' for a, b in zip(_normal(0, 1, 2), _normal(1, 2, 3), strict=True))})))), 6) AS a FROM R"),
    "bounds_aabb_triclinic": sql("TE", f"{FOUR} SELECT traj_id, frame, round({_least([a for a, _ in _images()])}, 6) AS lower, round({_least([b for _, b in _images()])}, 6) AS upper FROM R"),
    "kdop_contains": sql("TE", f"{FOUR}, M AS (SELECT *, (p0x + p1x) / 2 AS mx, (p0y + p1y) / 2 AS my, (p0z + p1z) / 2 AS mz FROM R) SELECT traj_id, frame, {_inside('m')} AS middle, {_inside('p2')} AS other, round(abs(p0x - p1x) * abs(p0y - p1y) * abs(p0z - p1z), 6) AS volume FROM M"),
    "coordinate_digest": sql("TE", "SELECT traj_id, frame, sha256(string_agg(" + " || ',' || ".join(f"(round({n} * 1000, 0)::BIGINT)::VARCHAR" for n in "xyz") + ", ';' ORDER BY atom_id)) AS digest FROM TE GROUP BY 1, 2"),
    "angle": sql("TE", f"{FOUR} SELECT traj_id, frame, round({_ang(0, 1, 2)}, 6) AS a FROM R"),
    "angle_series_stats": sql("TE", f"{FOUR} SELECT traj_id, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS sd, round(min(a), 6) AS min, round(max(a), 6) AS max FROM (SELECT traj_id, {_ang(0, 1, 2)} AS a FROM R) GROUP BY 1"),
    "dihedral": sql("TE", f"{FOUR} SELECT traj_id, frame, round({_turn('p0', 'p1', 'p2', 'p3')}, 6) + 0.0 AS a FROM R"),
    "bounds_aabb_ortho": sql("TE", f"{FOUR} SELECT traj_id, frame, round({_bb(0, True)}, 6) AS lower, round({_bb(1, True)}, 6) AS upper FROM R"),
    "bounds_aabb_open": sql("TE", f"{FOUR} SELECT traj_id, frame, round({_bb(0, False)}, 6) AS lower, round({_bb(1, False)}, 6) AS upper FROM R"),
    "center_in_box": sql("TE", "SELECT traj_id, frame, atom_id, " + ", ".join(f"round({n} - avg({n}) OVER (PARTITION BY traj_id, frame) + 10, 6) + 0.0 AS {n}" for n in "xyz") + " FROM TE"),
    "kleene": sql("EV", "SELECT traj_id, frame, a AND b AS both, a OR b AS either, NOT a AS no_a FROM (SELECT traj_id, frame, CASE WHEN frame % 3 <> 0 THEN flag_a END AS a, CASE WHEN frame % 4 <> 0 THEN flag_b END AS b FROM EV)").replace("AS both", 'AS "both"'),
    "canonical_keys": sql("TF", "SELECT traj_id, frame, atom_id, k AS atom, least(k, 'B:1:CA') || '|' || greatest(k, 'B:1:CA') AS bond FROM (SELECT *, chain || ':' || residue || ':' || name AS k FROM TF)"),
    "reverse_complement": "SELECT doc_id, sha256(reverse(translate(regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))) AS digest FROM documents",
    "validate_sequence": sql("SQ", f"SELECT seq_id, CASE WHEN length(seq) < 5 THEN 'TOO_SHORT' WHEN length(seq) > 2000 THEN 'TOO_LONG' WHEN length({LETTERS}) > 0 THEN 'BAD_LETTERS' ELSE 'VALID' END AS status, length({LETTERS})::INTEGER AS n_bad FROM SQ"),
    "validate_fasta": rf"""
        WITH r AS (SELECT doc_id, doc_id % 6 AS k, text, regexp_replace(text, '[^{t.AMINO_LETTERS}{t.AMINO_LETTERS.lower()}]', '', 'g') AS amino, ' > document ' || doc_id AS named FROM documents),
        x AS (SELECT doc_id, regexp_replace(coalesce(CASE k WHEN 0 THEN named || E' \n' || amino WHEN 1 THEN text WHEN 2 THEN amino WHEN 3 THEN named WHEN 4 THEN named || E'\n' || text ELSE substr(amino, 1, doc_id % 37) END, ''), '^[{t.WHITE}]+|[{t.WHITE}]+$', '', 'g') AS t FROM r),
        y AS (SELECT doc_id, t, t[1] = '>' AS titled, instr(t, E'\n') AS e FROM x),
        z AS (SELECT doc_id, t = '' AS empty, titled, CASE WHEN titled AND e > 0 THEN regexp_replace(substr(t, 2, e - 2), '^[{t.WHITE}]+|[{t.WHITE}]+$', '', 'g') END AS header,
            regexp_replace(CASE WHEN titled AND e > 0 THEN substr(t, e + 1) WHEN titled THEN '' ELSE t END, '[{t.WHITE}]', '', 'g') AS body FROM y),
        b AS (SELECT *, length(body) AS n_residues, length(regexp_replace(body, '[{t.AMINO_ANY}]', '', 'g')) AS n_bad, list_filter(list_transform(list_filter(string_split(body, ''), lambda c: c <> ''),
            lambda c, i: CASE WHEN NOT regexp_matches(c, '^[{t.AMINO_ANY}]$') THEN chr(39) || c || chr(39) || ' at position ' || i END), lambda m: m IS NOT NULL) AS named FROM z),
        s AS (SELECT *, CASE WHEN empty THEN 'EMPTY' WHEN titled AND header IS NULL THEN 'HEADER_ONLY' WHEN n_residues = 0 THEN 'NO_RESIDUES' WHEN n_bad > 0 THEN 'BAD_LETTERS' WHEN n_residues < 5 THEN 'TOO_SHORT' WHEN n_residues > 2000 THEN 'TOO_LONG' ELSE 'VALID' END AS status FROM b)
        SELECT doc_id, status, header, CASE WHEN status = 'VALID' THEN upper(body) END AS sequence, n_residues::INTEGER AS n_residues, n_bad::INTEGER AS n_bad,
            CASE WHEN n_bad > 0 THEN array_to_string(named[1:5], ', ') || CASE WHEN n_bad > 5 THEN ' (+' || (n_bad - 5) || ' more)' ELSE '' END END AS bad FROM s""",
    "validate_nucleic": rf"""
        WITH r AS (SELECT doc_id, doc_id % 4 AS k, text, regexp_replace(text, E'[^ACGTNacgtn \n]', '', 'g') AS kept FROM documents),
        c AS (SELECT doc_id, upper(regexp_replace(replace(coalesce(CASE k WHEN 0 THEN kept WHEN 1 THEN translate(kept, 'tT', 'uU') WHEN 2 THEN regexp_replace(text, E'[^ACGTUINacgtuin \n]', '', 'g') ELSE text END, ''), 'ß', 'SS'), '[{t.WHITE}]+', '', 'g')) AS clean FROM r)
        SELECT doc_id, {", ".join(f"regexp_matches(clean, '^[{letters}]+$') AS {m.lower()}" for m, letters in t.NUCLEIC.items())}, sha256(clean) AS clean_sha256 FROM c""",
    "modular_periodicity": sql("SQ", "SELECT seq_id, round(share, 6) AS share, share > 0.35 AS periodic FROM (SELECT seq_id, CASE WHEN length(seq) > 7 THEN len(list_filter(list_zip(string_split(seq, '')[1:length(seq)-7], string_split(seq, '')[8:]), lambda x: x[1] = x[2])) / (length(seq) - 7) ELSE 0.0 END AS share FROM SQ)"),
    "sequence_identity": sql("SQ SB", ", B AS (SELECT row_number() OVER (ORDER BY seq_id) - 1 AS k, seq AS b FROM SB) SELECT seq_id, round(CASE WHEN least(length(seq), length(b)) > 0 THEN len(list_filter(list_zip(string_split(seq, '')[1:least(length(seq), length(b))], string_split(b, '')[1:least(length(seq), length(b))]), lambda x: x[1] = x[2])) / greatest(length(seq), length(b)) ELSE 0 END, 6) AS identity FROM SQ JOIN B ON k = seq_id % (SELECT count(*) FROM SB)"),
    "polynomial_residue_hash": sql("SQ", "SELECT seq_id, list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split(seq, ''), lambda x: x <> ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (h * 31 + x) % 2147483647) AS hash FROM SQ"),
    "design_space_size": sql("SQ", "SELECT seq_id, round(length(seq) * log10(20.0), 6) AS log10_size FROM SQ"),
    "export_csv": "SELECT event_id, CASE WHEN regexp_matches(props, '^[=+\\-@\\t\\r]') THEN '''' || props ELSE props END AS props, CASE WHEN event_id % 3 = 0 THEN '''=' || event_type ELSE event_type END AS kind FROM events",
    "canonical_digest": "SELECT c_custkey, sha256('{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || c_nationkey || '}') AS digest FROM customer",
    "index_commitment": "SELECT l_orderkey, sha256(string_agg(sha256(l_linenumber || '|' || l_partkey), '' ORDER BY l_linenumber, l_partkey)) AS commitment FROM lineitem GROUP BY 1",
    "parse_resolution": f"SELECT p_partkey, {METHOD} AS method, CASE WHEN {METHOD} IN ('X_RAY_DIFFRACTION', 'ELECTRON_MICROSCOPY', 'NEUTRON_DIFFRACTION', 'ELECTRON_CRYSTALLOGRAPHY') AND p_retailprice / 50 > 0 AND p_retailprice / 50 < 30 THEN round(round(p_retailprice / 50, 4), 2) END AS resolution FROM part",
    "parse_rfactor": f"""SELECT *, CASE WHEN r_free < r_work THEN 'ATYPICAL' WHEN r_free IS NOT NULL AND r_work IS NOT NULL THEN 'VALID' WHEN r_free IS NULL AND year < 1992 THEN 'PREDATES_R_FREE' WHEN r_free IS NULL THEN 'NOT_RECORDED' ELSE 'VALID' END AS note FROM (
        SELECT p_partkey, CASE WHEN m AND w BETWEEN 0 AND 1 THEN round(w, 4) END AS r_work, CASE WHEN m AND p_size % 3 > 0 AND f BETWEEN 0 AND 1 THEN round(f, 4) END AS r_free, 1985 + p_size AS year
        FROM (SELECT p_partkey, p_size, {METHOD} IN ('X_RAY_DIFFRACTION', 'NEUTRON_DIFFRACTION') AS m, CASE WHEN q > 1 THEN q / 100 ELSE q END AS w, CASE WHEN z > 1 THEN z / 100 ELSE z END AS f FROM (SELECT p_partkey, p_size, round(p_retailprice / 50, 4) AS q, 30 - p_size / 4 AS z FROM part)))""",
    "normalize_identifiers": """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN lpad(s_suppkey::VARCHAR, 4, '0') WHEN 1 THEN 'A' || lpad(s_suppkey::VARCHAR, 3, '0') END AS structure,
        CASE s_suppkey % 3 WHEN 0 THEN 'P' || lpad(s_suppkey::VARCHAR, 6, '0') || '-2' WHEN 1 THEN 'Q' || lpad(s_suppkey::VARCHAR, 5, '0') END AS protein, CASE WHEN s_suppkey % 2 = 0 THEN 'ma-x-' || s_suppkey END AS archive FROM supplier""",
    "classify_mutation": sql("TF", "SELECT traj_id, CASE WHEN is_hetero THEN 'EXPRESSION_TAG' WHEN element = 'C' THEN 'WILD_TYPE' ELSE 'NATURAL_VARIANT' END AS kind, count(*) AS n FROM TF GROUP BY 1, 2"),
    "assembly_label": "SELECT l_orderkey AS o_orderkey, CASE count(*) WHEN 2 THEN 'dimer' WHEN 4 THEN 'tetramer' WHEN 6 THEN 'hexamer' ELSE 'monomer' END AS label, CASE WHEN l_orderkey % 3 = 0 THEN 'software' ELSE 'author' END AS origin, CASE WHEN count(*) > 1 THEN 'A' || count(*) ELSE 'A' END AS stoichiometry FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    "trajectory_claims": "SELECT c_custkey, array_to_string(list_filter([CASE WHEN r AND b AND c_custkey % 3 = 0 THEN 'FORCE_FIELD' END, CASE WHEN r AND b AND c_custkey % 7 < 4 THEN 'ENSEMBLE' END, CASE WHEN r AND c_custkey % 4 <> 0 THEN 'TEMPERATURE' END], lambda x: x IS NOT NULL), ',') AS claims FROM (SELECT c_custkey, c_nationkey % 5 <> 0 AS r, c_custkey % 11 > 2 AND c_custkey % 2 = 0 AS b FROM customer)",
    "trajectory_authenticity": "SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN 'SYNTHETIC_COORDINATE_TRAJECTORY' WHEN c_nationkey % 3 = 1 AND c_custkey % 4 IN (0, 2) THEN 'REAL_MD_SIMULATION' ELSE 'UNKNOWN' END AS kind FROM customer",
    "export_result_json": "SELECT c_custkey, c_name, c_acctbal FROM customer",
}
