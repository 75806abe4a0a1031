"""Registered per-frame and per-atom analytics over the multi-atom trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.functions.geometry import r6
from orbitframe.operators import contacts as con
from orbitframe.operators import selection as sel
from orbitframe.operators import structure as s
from orbitframe.sources import views as v
from orbitframe.sources.views import sql


def rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names or [n for n, t in df.dtypes if t == "double"]})


def _pairs(spark, d, box=False):
    return s.atom_pairs(v.te(spark, d), box)


def _matched(spark, d):
    return s.against(v.te(spark, d), v.te(spark, d).filter("frame = 0"), ["traj_id", "atom_id"]).withColumn("d", s.g.dist(s.g.vec(), s.g.vec(suffix="_r")))


def _charge():
    return F.when(F.col("element") == "N", 0.3).when(F.col("element") == "O", -0.5).otherwise(0.1)


def _matrix(spark, d):
    """Distances between CA atoms as a matrix of errors, the upper triangle shifted a little."""
    ca = v.te_full(spark, d).filter("name = 'CA'").select("traj_id", "frame", "residue", *"xyz")
    b = ca.select("traj_id", "frame", F.col("residue").alias("j"), *[F.col(n).alias(f"{n}_b") for n in "xyz"])
    e = s.g.dist(s.g.vec(), s.g.vec(suffix="_b")) + F.when(F.col("residue") < F.col("j"), 0.013 * F.col("j")).otherwise(0.0)
    return ca.join(b, ["traj_id", "frame"]).select("traj_id", "frame", F.col("residue").alias("i"), "j", e.alias("e"))


def _series(spark, d):
    a = v.ev(spark, d).select("traj_id", "frame", "value")
    b = a.filter("frame % 7 <> 3").withColumn("value", F.col("value") + F.when(F.col("traj_id") % 3 == 0, 0.5).when(F.col("traj_id") % 3 == 1, 0.05).otherwise(0.0) * (F.col("frame") % 2))
    return s.series_align(a, b)


def _requests(spark):
    rows = [(1, "distance", 0, 5, 0, 0), (2, "angle", 0, 1, 2, 0), (3, "dihedral", 0, 1, 2, 3), (4, "distance", 0, 99, 0, 0)]
    return spark.createDataFrame(rows, "request_id int, kind string, a int, b int, c int, d int")


def _te_requests(spark, d):
    frames = v.te(spark, d).select("traj_id", "frame").distinct()
    return s.measure_batch(frames.crossJoin(F.broadcast(_requests(spark))), v.te(spark, d), ["traj_id", "frame"])


CUT = 8.0
QUERIES = {
    "rmsd_series": lambda p, d: rounded(s.rmsd_series(v.te(p, d))),
    "rmsf_atom": lambda p, d: rounded(s.rmsf_atom(v.te(p, d))),
    "rg_series": lambda p, d: rounded(s.rg_series(v.te_full(p, d))),
    "diffusion_estimate": lambda p, d: rounded(s.rg_series(v.te_full(p, d)).select("traj_id", "frame", (0.774 * F.col("rg")).alias("rh"), (1.380649e-23 * 298.15 / (6 * 3.141592653589793 * 0.00089 * (0.774 * F.col("rg")) * 1e-10) * 1e10).alias("d_1e10"))),
    "centroid": lambda p, d: rounded(s.centroids(v.te_full(p, d), ["traj_id", "frame", "chain"])),
    "average_structure": lambda p, d: rounded(s.average_structure(v.te(p, d))),
    "contact_count_series": lambda p, d: sel.radius_join(*[v.te(p, d).select("traj_id", "frame", "atom_id", *"xyz")] * 2, 4.5, ["traj_id", "frame"]).filter("atom_id < atom_id_b AND d < 4.5").groupBy("traj_id", "frame").agg(F.count(F.lit(1)).alias("n")),
    "contact_map": lambda p, d: rounded(s.contact_map(_pairs(p, d, True), CUT)),
    "static_contact_map": lambda p, d: rounded(con.near_pairs(v.te(p, d).filter("frame = 0"), CUT, 1).filter("j - i >= 3")),
    "contact_occupancy": lambda p, d: rounded(s.contact_occupancy(_pairs(p, d), CUT)),
    "coordinate_evolution": lambda p, d: rounded(s.coordinate_evolution(v.te(p, d), 0, 1)),
    "tm_score": lambda p, d: rounded(s.tm_score(_matched(p, d), ["traj_id", "frame"])),
    "gdt_scores": lambda p, d: rounded(s.gdt_scores(_matched(p, d), ["traj_id", "frame"])),
    "trimmed_rmsd": lambda p, d: rounded(s.trimmed_rmsd(_matched(p, d), ["traj_id", "frame"])),
    "distance_rmsd": lambda p, d: rounded(s.distance_rmsd(_pairs(p, d))),
    "contact_similarity": lambda p, d: rounded(con.similarity(con.near_pairs(v.te(p, d), CUT), v.te(p, d))),
    "contact_intersect_except": lambda p, d: s.contact_sets(con.near_pairs(v.te(p, d).filter("frame < 2"), CUT, 1), CUT, 0, 1),
    "end_to_end": lambda p, d: rounded(s.end_to_end(v.te_full(p, d))),
    "bfactor_stats": lambda p, d: rounded(s.bfactor_stats(v.te_full(p, d), ["traj_id", "chain"])),
    "occupancy_stats": lambda p, d: rounded(s.occupancy_stats(v.te_full(p, d), ["traj_id", "chain"])),
    "confidence_summary": lambda p, d: rounded(s.confidence_summary(v.ev(p, d), ["traj_id"], "value")),
    "confidence_band": lambda p, d: v.ev(p, d).select("traj_id", "frame", s.confidence_band(F.col("value")).alias("band")),
    "pae_summary": lambda p, d: rounded(s.pae_summary(_matrix(p, d), ["traj_id", "frame"])),
    "pae_interchain": lambda p, d: rounded(s.pae_interchain(_matrix(p, d), ["traj_id", "frame"], (1, 3), (4, 5))),
    "series_align": lambda p, d: rounded(_series(p, d)),
    "discrepancy_report": lambda p, d: rounded(s.discrepancy_report(_series(p, d), 0.1)),
    "discrepancy_sasa_rmsd": lambda p, d: rounded(s.discrepancy_report(_series(p, d), 0.02, relative=True)),
    "mismatch_head": lambda p, d: rounded(_series(p, d).filter(F.abs(F.col("value_a") - F.col("value_b")) > 0.1).orderBy("traj_id", "frame").limit(50)),
    "three_way_comparison": lambda p, d: rounded(s.discrepancy_report(_series(p, d), 0.1).withColumn("pair", F.lit("a-b")).unionByName(s.discrepancy_report(_series(p, d).withColumn("value_a", F.col("value_a") + 0.2), 0.1).withColumn("pair", F.lit("c-b"))).unionByName(s.discrepancy_report(_series(p, d).withColumn("value_b", F.col("value_a") + 0.2), 0.1).withColumn("pair", F.lit("a-c")))),
    "contact_agreement": lambda p, d: rounded(con.agreement(con.near_pairs(v.te(p, d).filter("frame < 2"), CUT, 1), v.te(p, d), 0, 1)),
    "series_contract_check": lambda p, d: s.series_contract(v.ev(p, d).select("traj_id", "value"), 60),
    "coulomb_potential": lambda p, d: rounded(s.coulomb_potential(v.te_full(p, d), _charge(), [(0, 0, 0), (5, 0, 0), (0, 5, 0), (0, 0, 5)])),
    "dipole_moment": lambda p, d: rounded(s.dipole_moment(v.te_full(p, d), _charge())),
    "geometry_summary": lambda p, d: rounded(s.geometry_summary(v.te_full(p, d), con.near_pairs(v.te(p, d), CUT), CUT)),
    "dataset_capabilities": lambda p, d: s.dataset_capabilities(v.te_full(p, d), sel.classify_residue(F.col("resname"))),
    "component_bounds": lambda p, d: rounded(s.component_bounds(v.te_full(p, d), ["traj_id", "frame", "residue"])),
    "frame_aabb": lambda p, d: rounded(s.component_bounds(v.te(p, d), ["traj_id", "frame"])),
    "traj_aabb": lambda p, d: rounded(s.component_bounds(v.te(p, d), ["traj_id"])),
    "child_bounds_check": lambda p, d: s.child_bounds_check(s.component_bounds(v.te_full(p, d), ["traj_id", "frame", "residue"]), s.component_bounds(v.te(p, d), ["traj_id", "frame"]), ["traj_id", "frame"]),
    "atom_correspondence": lambda p, d: rounded(_matched(p, d).select("traj_id", "frame", "atom_id", "d")),
    "missing_atoms": lambda p, d: s.missing_atoms(v.te_full(p, d).filter("NOT (atom_id % 6 = 1 AND frame % 2 = 0)"), p.createDataFrame([(r, n) for r in ("ALA", "GLY", "PRO", "CYS", "ASP") for n in ("N", "CA", "C", "O")], "resname string, name string"), ["traj_id", "frame", "residue"]),
    "missing_residues": lambda p, d: s.missing_residues(v.te(p, d).select("traj_id").distinct().withColumn("residue", F.explode(F.sequence(F.lit(0), F.lit(8)))), v.te_full(p, d).filter("residue <> 3"), "traj_id"),
    "nearest_match": lambda p, d: rounded(s.nearest_match(v.pk(p, d), "m1", "m0")),
    "rank_pockets": lambda p, d: v.pk(p, d).select("structure_id", "pocket_id", F.row_number().over(s.Window.partitionBy("structure_id").orderBy(F.col("volume").desc(), "pocket_id")).cast("long").alias("rank")),
    "measure_batch": lambda p, d: rounded(_te_requests(p, d)),
    "top_displacements": lambda p, d: rounded(_matched(p, d).join(F.broadcast(v.te_atoms(p)), "atom_id").groupBy("traj_id", "frame", "residue").agg(F.avg("d").alias("d")).orderBy(F.col("d").desc(), "traj_id", "frame", "residue").limit(50)),
}

P = "P AS (SELECT a.traj_id, a.frame, a.atom_id AS i, b.atom_id AS j, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) AS d FROM TE a JOIN TE b ON a.traj_id = b.traj_id AND a.frame = b.frame AND a.atom_id < b.atom_id)"
PB = "P AS (SELECT a.traj_id, a.frame, a.atom_id AS i, b.atom_id AS j, sqrt(" + "+".join(f"(a.{n}-b.{n}-20*round_even((a.{n}-b.{n})/20, 0))**2" for n in "xyz") + ") AS d FROM TE a JOIN TE b ON a.traj_id = b.traj_id AND a.frame = b.frame AND a.atom_id < b.atom_id)"
M = "M AS (SELECT a.traj_id, a.frame, a.atom_id, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) AS d FROM TE a JOIN TE b ON a.traj_id = b.traj_id AND a.atom_id = b.atom_id AND b.frame = 0)"
PAE = "PM AS (SELECT a.traj_id, a.frame, a.residue AS i, b.residue AS j, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) + CASE WHEN a.residue < b.residue THEN 0.013 * b.residue ELSE 0 END AS e FROM TF a JOIN TF b ON a.traj_id = b.traj_id AND a.frame = b.frame AND a.name = 'CA' AND b.name = 'CA')"
SR = "SR AS (SELECT e.traj_id, e.frame, e.value AS value_a, CASE WHEN e.frame % 7 <> 3 THEN e.value + CASE e.traj_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.05 ELSE 0 END::DOUBLE * (e.frame % 2) END AS value_b FROM EV e)"
MASS = "CASE element WHEN 'N' THEN 14.007 WHEN 'C' THEN 12.011 ELSE 15.999 END::DOUBLE"
Q = "CASE element WHEN 'N' THEN 0.3 WHEN 'O' THEN -0.5 ELSE 0.1 END::DOUBLE"


def _bounds(keys, source):
    ends = ", ".join(f"{e}({n}) AS {e}_{n}" for n in "xyz" for e in ("min", "max"))
    side = [f"(max_{n} - min_{n})" for n in "xyz"]
    names = ", ".join(f"round({e}_{n}, 6) + 0.0 AS {e}_{n}" for n in "xyz" for e in ("min", "max"))
    return f"SELECT {keys}, {names}, round({' * '.join(side)}, 6) AS volume, round(sqrt({' + '.join(f'{x}**2' for x in side)}), 6) AS diagonal FROM (SELECT {keys}, {ends} FROM {source} GROUP BY {keys})"


def _report(limit, a="value_a", b="value_b", extra=""):
    return f"""SELECT traj_id, round(max_delta, 6) AS max_delta, round(mean_delta, 6) AS mean_delta, n_mismatch, n_unmatched, CASE WHEN max_delta <= lim THEN 'WITHIN_TOLERANCE' WHEN max_delta <= 5 * lim THEN 'EXPECTED_METHODOLOGICAL_DIFFERENCE' ELSE 'GENUINE_DISCREPANCY' END AS kind{extra} FROM (
        SELECT traj_id, max(abs(a - b)) AS max_delta, avg(abs(a - b)) AS mean_delta, count(*) FILTER (abs(a - b) > lim) AS n_mismatch, count(*) FILTER (a IS NULL OR b IS NULL) AS n_unmatched, max(lim) AS lim
        FROM (SELECT traj_id, {a} AS a, {b} AS b, {limit} AS lim FROM SR) GROUP BY 1)"""


def _minus(p, q):
    return [f"({q}{n} - {p}{n})" for n in "xyz"]


def _dot(p, q):
    return "(" + " + ".join(f"{i}*{j}" for i, j in zip(p, q, strict=True)) + ")"


def _between(a, b):
    d = _minus(f"p{a}", f"p{b}")
    return f"sqrt({_dot(d, d)})"


def _bend(a, b, c):
    u, w = _minus(f"p{b}", f"p{a}"), _minus(f"p{b}", f"p{c}")
    return f"degrees(acos(greatest(-1, least(1, {_dot(u, w)} / (sqrt({_dot(u, u)}) * sqrt({_dot(w, w)}))))))"


def _turn(a, b, c, d):
    """The dihedral about b-c from prefixes of columns."""

    def cross(p, q):
        return [f"({p[1]}*{q[2]} - {p[2]}*{q[1]})", f"({p[2]}*{q[0]} - {p[0]}*{q[2]})", f"({p[0]}*{q[1]} - {p[1]}*{q[0]})"]

    u, w, x = _minus(a, b), _minus(b, c), _minus(c, d)
    n1, n2 = cross(u, w), cross(w, x)
    return f"degrees(atan2({_dot(cross(n1, n2), w)} / sqrt({_dot(w, w)}), {_dot(n1, n2)}))"


ORACLE_SQL = {
    "rmsd_series": sql("TE", f", {M} SELECT traj_id, frame, round(sqrt(avg(d*d)), 6) AS rmsd FROM M GROUP BY 1, 2"),
    "rmsf_atom": sql("TE", "SELECT traj_id, atom_id, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS rmsf FROM TE GROUP BY 1, 2"),
    "rg_series": sql("TF", f"SELECT traj_id, frame, round(sqrt(avg(x*x+y*y+z*z) - avg(x)**2 - avg(y)**2 - avg(z)**2), 6) AS rg, round(sqrt(sum(m*(x*x+y*y+z*z))/sum(m) - (sum(m*x)/sum(m))**2 - (sum(m*y)/sum(m))**2 - (sum(m*z)/sum(m))**2), 6) AS rg_mass FROM (SELECT *, {MASS} AS m FROM TF) GROUP BY 1, 2"),
    "diffusion_estimate": sql("TE", "SELECT traj_id, frame, round(rh, 6) AS rh, round(1.380649e-23 * 298.15 / (6 * 3.141592653589793 * 0.00089 * rh * 1e-10) * 1e10, 6) AS d_1e10 FROM (SELECT traj_id, frame, 0.774 * sqrt(avg(x*x+y*y+z*z) - avg(x)**2 - avg(y)**2 - avg(z)**2) AS rh FROM TE GROUP BY 1, 2)"),
    "centroid": sql("TF", "SELECT traj_id, frame, chain, " + ", ".join(f"round(avg({n}), 6) + 0.0 AS c{n}, round(sum(m*{n})/sum(m), 6) + 0.0 AS m{n}" for n in "xyz") + f" FROM (SELECT *, {MASS} AS m FROM TF) GROUP BY 1, 2, 3"),
    "average_structure": sql("TE", "SELECT traj_id, atom_id, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z FROM TE GROUP BY 1, 2"),
    "contact_count_series": sql("TE", f", {P} SELECT traj_id, frame, count(*) AS n FROM P WHERE d < 4.5 GROUP BY 1, 2"),
    "contact_map": sql("TE", f", {PB} SELECT traj_id, i, j, round(avg(d), 6) AS mean_d, round(avg((d <= 8)::INTEGER), 6) AS frequency FROM P GROUP BY 1, 2, 3"),
    "static_contact_map": sql("TE", f", {P} SELECT traj_id, frame, i, j, round(d, 6) AS d FROM P WHERE frame = 0 AND d <= 8 AND j - i >= 3"),
    "contact_occupancy": sql("TE", f", {P} SELECT *, CASE WHEN occupancy >= 0.7 THEN 'persistent' WHEN occupancy < 0.3 THEN 'transient' ELSE 'intermediate' END AS kind FROM (SELECT traj_id, i, j, round(avg((d <= 8)::INTEGER), 6) AS occupancy, round(min(d), 6) AS min_d, round(max(d), 6) AS max_d, round(avg(d), 6) AS mean_d FROM P GROUP BY 1, 2, 3)"),
    "coordinate_evolution": sql("TE", f", {M} SELECT traj_id, round(max(d), 6) AS max_d, round(avg(d), 6) AS mean_d, round(sqrt(avg(d*d)), 6) AS rms_d, count(*) FILTER (d > 1e-4) AS n_moved, max(d) <= 1e-4 AS static FROM M WHERE frame = 1 GROUP BY 1"),
    "tm_score": sql("TE", f", {M} SELECT traj_id, frame, round(avg(1 / (1 + (d / 0.5)**2)), 6) AS tm, avg(1 / (1 + (d / 0.5)**2)) > 0.5 AS same_fold FROM M GROUP BY 1, 2"),
    "gdt_scores": sql("TE", f", {M} SELECT traj_id, frame, round(25.0 * (avg((d <= 1)::INTEGER) + avg((d <= 2)::INTEGER) + avg((d <= 4)::INTEGER) + avg((d <= 8)::INTEGER)), 6) AS gdt_ts, round(25.0 * (avg((d <= 0.5)::INTEGER) + avg((d <= 1)::INTEGER) + avg((d <= 2)::INTEGER) + avg((d <= 4)::INTEGER)), 6) AS gdt_ha FROM M GROUP BY 1, 2"),
    "trimmed_rmsd": sql("TE", f", {M} SELECT traj_id, frame, round(sqrt(avg(d*d)), 6) AS rmsd_trimmed, count(*) AS n_kept FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, frame ORDER BY d, atom_id) AS r, count(*) OVER (PARTITION BY traj_id, frame) AS n FROM M) WHERE r <= n * 95 // 100 GROUP BY 1, 2"),
    "distance_rmsd": sql("TE", f", {P} SELECT p.traj_id, p.frame, round(sqrt(avg((p.d - q.d)**2)), 6) AS drmsd FROM P p JOIN P q ON p.traj_id = q.traj_id AND p.i = q.i AND p.j = q.j AND q.frame = 0 GROUP BY 1, 2"),
    "contact_similarity": sql("TE", f", {P} SELECT traj_id, frame, round(CASE WHEN e = 0 THEN 1.0 ELSE b / e END::DOUBLE, 6) AS jaccard, round(CASE WHEN t = 0 THEN 1.0 ELSE 2 * b / t END::DOUBLE, 6) AS dice FROM (SELECT p.traj_id, p.frame, count(*) FILTER (p.d <= 8 AND q.d <= 8) AS b, count(*) FILTER (p.d <= 8 OR q.d <= 8) AS e, count(*) FILTER (p.d <= 8) + count(*) FILTER (q.d <= 8) AS t FROM P p JOIN P q ON p.traj_id = q.traj_id AND p.i = q.i AND p.j = q.j AND q.frame = 0 GROUP BY 1, 2)"),
    "contact_intersect_except": sql("TE", f", {P}, A AS (SELECT traj_id, i, j FROM P WHERE frame = 0 AND d <= 8), B AS (SELECT traj_id, i, j FROM P WHERE frame = 1 AND d <= 8) SELECT *, 'shared' AS part FROM (SELECT * FROM A INTERSECT SELECT * FROM B) UNION ALL SELECT *, 'first_only' FROM (SELECT * FROM A EXCEPT SELECT * FROM B) UNION ALL SELECT *, 'second_only' FROM (SELECT * FROM B EXCEPT SELECT * FROM A)"),
    "end_to_end": sql("TF", ", E AS (SELECT traj_id, frame, chain, " + ", ".join(f"arg_min({n}, residue) AS a{n}, arg_max({n}, residue) AS b{n}" for n in "xyz") + " FROM TF WHERE name = 'CA' GROUP BY 1, 2, 3) SELECT traj_id, frame, chain, round(sqrt((ax-bx)**2+(ay-by)**2+(az-bz)**2), 6) AS d FROM E").replace("by)**2", "by_)**2").replace("AS by,", "AS by_,"),
    "bfactor_stats": sql("TF", "SELECT traj_id, chain, round(avg(b_factor), 6) AS mean, median(b_factor) AS median, min(b_factor) AS min, max(b_factor) AS max, round(avg(b_factor), 6) AS mean_backbone, NULL::DOUBLE AS mean_side, 0::BIGINT AS n_negative FROM TF GROUP BY 1, 2"),
    "occupancy_stats": sql("TF", "SELECT traj_id, chain, round(avg(occupancy), 6) AS mean, count(*) FILTER (occupancy >= 0.999) AS n_full, count(*) FILTER (occupancy < 0.999) AS n_partial, 0::BIGINT AS n_zero FROM TF GROUP BY 1, 2"),
    "confidence_summary": sql("EV", "SELECT traj_id, round(avg(c), 6) AS mean, round(median(c), 6) AS median, round(min(c), 6) AS min, round(max(c), 6) AS max, count(*) FILTER (c > 90) AS n_very_high, count(*) FILTER (c >= 70 AND c <= 90) AS n_confident, count(*) FILTER (c >= 50 AND c < 70) AS n_low, count(*) FILTER (c < 50) AS n_very_low, round(avg((c < 50)::INTEGER), 6) AS disordered FROM (SELECT traj_id, CASE WHEN max(value) OVER (PARTITION BY traj_id) <= 1 THEN value * 100 ELSE value END AS c FROM EV) GROUP BY 1"),
    "confidence_band": sql("EV", "SELECT traj_id, frame, CASE WHEN value > 90 THEN 'very_high' WHEN value >= 70 THEN 'confident' WHEN value >= 50 THEN 'low' ELSE 'very_low' END AS band FROM EV"),
    "pae_summary": sql("TF", f", {PAE} SELECT p.traj_id, p.frame, count(*) AS n, count(*) = count(DISTINCT p.i) * count(DISTINCT p.j) AS square, round(avg(p.e), 6) AS mean, round(min(p.e), 6) AS min, round(max(p.e), 6) AS max, count(*) FILTER (p.e < 0) AS n_negative, count(*) FILTER (abs(p.e - q.e) > 0.05) AS n_asymmetric FROM PM p JOIN PM q ON p.traj_id = q.traj_id AND p.frame = q.frame AND p.i = q.j AND p.j = q.i GROUP BY 1, 2"),
    "pae_interchain": sql("TF", f", {PAE} SELECT traj_id, frame, round(avg(e), 6) AS mean, round(min(e), 6) AS min, round(max(e), 6) AS max, avg(e) < 10 AS well_positioned FROM PM WHERE i BETWEEN 1 AND 3 AND j BETWEEN 4 AND 5 GROUP BY 1, 2"),
    "series_align": sql("EV", f", {SR} SELECT traj_id, frame, round(value_a, 6) + 0.0 AS value_a, round(value_b, 6) + 0.0 AS value_b FROM SR"),
    "discrepancy_report": sql("EV", f", {SR} {_report('0.1::DOUBLE')}"),
    "discrepancy_sasa_rmsd": sql("EV", f", {SR} {_report('avg(abs(value_b)) OVER (PARTITION BY traj_id) * 0.02')}"),
    "mismatch_head": sql("EV", f", {SR} SELECT traj_id, frame, round(value_a, 6) AS value_a, round(value_b, 6) AS value_b FROM SR WHERE abs(value_a - value_b) > 0.1 ORDER BY 1, 2 LIMIT 50"),
    "three_way_comparison": sql("EV", f", {SR} " + _report("0.1::DOUBLE", extra=", 'a-b' AS pair") + " UNION ALL " + _report("0.1::DOUBLE", a="value_a + 0.2", extra=", 'c-b'") + " UNION ALL " + _report("0.1::DOUBLE", b="value_a + 0.2", extra=", 'a-c'")),
    "contact_agreement": sql("TE", f", {P} SELECT traj_id, round(a, 6) AS agreement, a >= 0.99 AS passes FROM (SELECT p.traj_id, avg(((p.d <= 8) = (q.d <= 8))::INTEGER) AS a FROM P p JOIN P q ON p.traj_id = q.traj_id AND p.i = q.i AND p.j = q.j AND p.frame = 0 AND q.frame = 1 GROUP BY 1)"),
    "series_contract_check": sql("EV", "SELECT traj_id, 'wrong length' AS violation FROM EV GROUP BY 1 HAVING count(*) <> 60"),
    "coulomb_potential": sql("TF", f"SELECT traj_id, frame, p::INTEGER AS probe, round(sum(14.3996 / 78.5 * {Q} / greatest(0.5, sqrt((x-px)**2+(y-py)**2+(z-pz)**2))), 6) + 0.0 AS potential FROM TF, (VALUES (0,0,0,0),(1,5,0,0),(2,0,5,0),(3,0,0,5)) AS v(p, px, py, pz) GROUP BY 1, 2, 3"),
    "dipole_moment": sql("TF", ", S AS (SELECT traj_id, frame, " + ", ".join(f"4.8032 * (sum(q*{n}) - sum(q) * avg({n})) AS m{n}" for n in "xyz") + f" FROM (SELECT *, {Q} AS q FROM TF) GROUP BY 1, 2) SELECT traj_id, frame, round(mx, 6) + 0.0 AS mx, round(my, 6) + 0.0 AS my, round(mz, 6) + 0.0 AS mz, round(sqrt(mx*mx+my*my+mz*mz), 6) AS dipole FROM S"),
    "geometry_summary": sql("TF", f", {P}, C AS (SELECT traj_id, frame, count(*) AS n FROM P WHERE d <= 8 GROUP BY 1, 2) SELECT t.traj_id, t.frame, count(*) AS n_atoms, count(DISTINCT residue) AS n_residues, round(max(x)-min(x), 6) AS extent_x, round(max(y)-min(y), 6) AS extent_y, round(max(z)-min(z), 6) AS extent_z, coalesce(max(n), 0) AS n_contacts FROM TF t LEFT JOIN C c USING (traj_id, frame) GROUP BY 1, 2"),
    "dataset_capabilities": sql("TE", "SELECT traj_id, true AS has_protein, false AS has_nucleic, false AS has_ligand, false AS has_solvent, false AS has_ion, max(frame) > 0 AS is_trajectory FROM TE GROUP BY 1"),
    "component_bounds": sql("TF", _bounds("traj_id, frame, residue", "TF")),
    "frame_aabb": sql("TE", _bounds("traj_id, frame", "TE")),
    "traj_aabb": sql("TE", _bounds("traj_id", "TE")),
    "child_bounds_check": sql("TF", "SELECT traj_id, frame, true AS contained, count(DISTINCT residue) AS n_children FROM TF GROUP BY 1, 2"),
    "atom_correspondence": sql("TE", f", {M} SELECT traj_id, frame, atom_id, round(d, 6) AS d FROM M"),
    "missing_atoms": sql("TF", "SELECT traj_id, frame, residue, string_agg(name, ',' ORDER BY name) AS missing FROM (SELECT t.traj_id, t.frame, t.residue, n.name FROM (SELECT DISTINCT traj_id, frame, residue FROM TF WHERE NOT (atom_id % 6 = 1 AND frame % 2 = 0)) t, (VALUES ('N'),('CA'),('C'),('O')) n(name)) q WHERE NOT EXISTS (SELECT 1 FROM TF x WHERE x.traj_id = q.traj_id AND x.frame = q.frame AND x.residue = q.residue AND x.name = q.name AND NOT (atom_id % 6 = 1 AND x.frame % 2 = 0)) GROUP BY 1, 2, 3"),
    "missing_residues": sql("TF", "SELECT traj_id, r::INTEGER AS residue, CASE WHEN r < 1 THEN 'n_term' WHEN r > 6 THEN 'c_term' ELSE 'internal' END AS place FROM (SELECT DISTINCT traj_id FROM TF), (VALUES (0), (3), (7), (8)) v(r)"),
    "nearest_match": sql("PK", """, N AS (SELECT a.structure_id, a.pocket_id, b.pocket_id AS match_id, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) AS d, len(list_intersect(a.residue_ids, b.residue_ids)) / len(list_distinct(list_concat(a.residue_ids, b.residue_ids))) AS jaccard, a.volume - b.volume AS volume_delta FROM PK a JOIN PK b ON a.structure_id = b.structure_id AND a.method = 'm1' AND b.method = 'm0'),
        B AS (SELECT *, row_number() OVER (PARTITION BY structure_id, pocket_id ORDER BY d, match_id) AS r FROM N WHERE d <= 4)
        SELECT p.structure_id, p.pocket_id, match_id, round(d, 6) AS d, round(jaccard, 6) AS jaccard, round(volume_delta, 6) + 0.0 AS volume_delta, coalesce(jaccard >= 0.3 OR d <= 2.5, false) AS consensus FROM PK p LEFT JOIN B b ON b.structure_id = p.structure_id AND b.pocket_id = p.pocket_id AND r = 1 WHERE method = 'm1'"""),
    "rank_pockets": sql("PK", "SELECT structure_id, pocket_id, row_number() OVER (PARTITION BY structure_id ORDER BY volume DESC, pocket_id) AS rank FROM PK"),
    "measure_batch": sql("TE", ", " + ", ".join(f"Q{i} AS (SELECT traj_id, frame, x AS p{i}x, y AS p{i}y, z AS p{i}z FROM TE WHERE atom_id = {i})" for i in (0, 1, 2, 3, 5)) + f", W AS (SELECT * FROM Q0 JOIN Q1 USING (traj_id, frame) JOIN Q2 USING (traj_id, frame) JOIN Q3 USING (traj_id, frame) JOIN Q5 USING (traj_id, frame)) SELECT traj_id, frame, 1 AS request_id, 'distance' AS kind, round({_between(0, 5)}, 6) AS value FROM W UNION ALL SELECT traj_id, frame, 2, 'angle', round({_bend(0, 1, 2)}, 6) FROM W UNION ALL SELECT traj_id, frame, 3, 'dihedral', round({_turn('p0', 'p1', 'p2', 'p3')}, 6) + 0.0 FROM W UNION ALL SELECT traj_id, frame, 4, 'distance', NULL FROM W"),
    "top_displacements": sql("TE", f", {M} SELECT traj_id, frame, (atom_id // 4 + 1)::INTEGER AS residue, round(avg(d), 6) AS d FROM M GROUP BY 1, 2, 3 ORDER BY avg(d) DESC, 1, 2, 3 LIMIT 50"),
}
