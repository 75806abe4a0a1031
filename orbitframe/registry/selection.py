"""Registered scans, selections and checks over the multi-atom trajectories and the catalogue-like tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.functions.geometry import r6
from orbitframe.operators import selection as s
from orbitframe.sources import views as v
from orbitframe.sources.views import sql

ID = ["traj_id", "frame", "atom_id"]


def _pick(condition):
    return lambda spark, d: v.te_full(spark, d).filter(condition()).select(*ID, r6(F.col("x")).alias("x"))


def _sql(condition: str) -> str:
    return sql("TF", f"SELECT traj_id, frame, atom_id, round(x, 6) + 0.0 AS x FROM TF WHERE {condition}")


PROTEIN = "resname IN ('" + "','".join(s.AMINO_ACIDS) + "')"
QUERIES = {
    "load_coords": lambda spark, d: v.te(spark, d).filter((F.col("frame") >= 5) & (F.col("frame") < 30)).join(F.broadcast(v.te_atoms(spark).filter("group_id = 0").select("atom_id")), "atom_id").select(*ID, *[r6(F.col(n)).alias(n) for n in "xyz"]),
    "traj_metadata": lambda spark, d: s.traj_metadata(v.te(spark, d)).withColumns({n: r6(F.col(n)) for n in ("dt_ps", "lx", "ly", "lz", "span_ns")}),
    "sel_chain": _pick(lambda: s.sel_chain("A")),
    "sel_resname": _pick(lambda: s.sel_resname("ala, gly")),
    "sel_name": _pick(lambda: s.sel_name("ca")),
    "sel_resid": _pick(lambda: s.sel_resid("2-4")),
    "sel_class": _pick(lambda: s.sel_class("backbone")),
    "sel_colon_key": _pick(lambda: s.sel_colon_key("A:GLY:2:CA") | s.sel_colon_key("PRO:3:N")),
    "sel_boolean": _pick(lambda: s.sel_boolean([[s.sel_chain("A"), s.sel_chain("B")], [s.sel_name("N"), s.sel_resid("3")]])),
    "sel_within": lambda spark, d: s.sel_within(v.te_full(spark, d), F.col("chain") == "B", 6.0, ["traj_id", "frame"]).select(*ID),
    "radius_join": lambda spark, d: s.radius_join(*[v.te(spark, d).select(*ID, *"xyz")] * 2, 6.0, ["traj_id", "frame"]).filter("atom_id < atom_id_b").select(*ID, "atom_id_b", r6(F.col("d")).alias("d")),
    "sel_nonempty_guard": lambda spark, d: s.nonempty_guard(v.te_full(spark, d), s.sel_resname("LIG")).withColumn("sel", F.lit("none")).unionByName(s.nonempty_guard(v.te_full(spark, d), s.sel_chain("B")).withColumn("sel", F.lit("some"))),
    "slice_frames": lambda spark, d: s.slice_frames(v.te(spark, d), 3, 40, 5).select(*ID),
    "altloc_canonical": lambda spark, d: s.altloc_canonical(v.te_full(spark, d).withColumn("altloc", F.get(F.array(F.lit("B"), F.lit("A"), F.lit("")), F.col("atom_id") % 3)), ["traj_id", "frame", "residue"]).select(*ID, "altloc"),
    "classify_residue": lambda spark, d: v.te_full(spark, d).groupBy("traj_id", s.classify_residue(F.col("resname")).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    "classify_amino_acid": lambda spark, d: v.te_full(spark, d).withColumn("code", s.one_letter(F.col("resname"))).groupBy("traj_id", "code", s.amino_class(F.col("code")).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    "classify_nucleotide": lambda spark, d: s.classify_nucleotide(v.te_full(spark, d).withColumn("name", F.when(F.col("name") == "O", "O2'").otherwise(F.concat("name", F.lit("1'")))), ["traj_id", "frame", "residue"]),
    "validate_coords": lambda spark, d: s.validate_coords(v.te(spark, d), v.N_ATOMS),
    "annotation_filter": lambda spark, d: v.te_full(spark, d).filter((F.col("chain") == "A") & F.array_contains(F.array(F.lit(2), F.lit(4)), F.col("residue"))).select(*ID),
    "catalog_search": lambda spark, d: s.catalog_search(v.table(spark, d, "part"), "Ring", ["p_name", "p_brand", "p_type"]).select("p_partkey"),
    "catalog_rank": lambda spark, d: s.catalog_rank(v.table(spark, d, "part"), F.col("p_brand"), {"Brand#2": 1, "Brand#17": 2}, [F.col("p_size"), F.col("p_retailprice").desc(), F.col("p_partkey")]).select("p_partkey", "weight", F.col("rank").cast("long").alias("rank")),
    "catalog_counts": lambda spark, d: v.table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large")),
    "capability_matrix": lambda spark, d: v.table(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("capability"), "p_brand").groupBy("capability").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands")),
    "catalog_scorecard": lambda spark, d: v.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") < 10, 3).when(F.col("p_size") < 30, 2).otherwise(1).alias("tier"), F.when(F.col("p_retailprice") > 1500, 2).otherwise(1).alias("cost")).withColumn("score", F.col("tier") * 2 + F.col("cost")),
    "selection_algebra": lambda spark, d: v.te_full(spark, d).filter(s.sel_chain("A")).select(*ID).union(v.te_full(spark, d).filter(s.sel_name("CA")).select(*ID)).distinct().intersect(v.te_full(spark, d).filter(s.sel_resid("3-6")).select(*ID)),
    "best_hit": lambda spark, d: v.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_extendedprice", "l_partkey")).alias("best_part"), F.max("l_extendedprice").alias("best_score")),
}
ORACLE_SQL = {
    "load_coords": sql("TF", "SELECT traj_id, frame, atom_id, round(x,6)+0.0 AS x, round(y,6)+0.0 AS y, round(z,6)+0.0 AS z FROM TF WHERE frame >= 5 AND frame < 30 AND group_id = 0"),
    "traj_metadata": sql("TE", "SELECT traj_id, n_frames, dt_ps, lx, ly, lz, false AS variable_cell, n_frames * dt_ps / 1000 AS span_ns FROM (SELECT traj_id, count(DISTINCT frame) AS n_frames, (max(t_ps) - min(t_ps)) / greatest(count(DISTINCT frame) - 1, 1) AS dt_ps, avg(lx) AS lx, avg(ly) AS ly, avg(lz) AS lz FROM TE GROUP BY 1)"),
    "sel_chain": _sql("chain = 'A'"),
    "sel_resname": _sql("resname IN ('ALA', 'GLY')"),
    "sel_name": _sql("name = 'CA'"),
    "sel_resid": _sql("residue BETWEEN 2 AND 4"),
    "sel_class": _sql(f"{PROTEIN} AND name IN ('N', 'CA', 'C', 'O')"),
    "sel_colon_key": _sql("(chain = 'A' AND resname = 'GLY' AND residue = 2 AND name = 'CA') OR (resname = 'PRO' AND residue = 3 AND name = 'N')"),
    "sel_boolean": _sql("chain IN ('A', 'B') AND (name = 'N' OR residue = 3)"),
    "sel_within": sql("TF", "SELECT DISTINCT a.traj_id, a.frame, a.atom_id FROM TF a JOIN TF b ON a.traj_id = b.traj_id AND a.frame = b.frame AND b.chain = 'B' WHERE sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) <= 6"),
    "radius_join": sql("TE", "SELECT * FROM (SELECT a.traj_id, a.frame, a.atom_id, b.atom_id AS atom_id_b, round(sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2), 6) AS d, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) AS e FROM TE a JOIN TE b ON a.traj_id = b.traj_id AND a.frame = b.frame AND a.atom_id < b.atom_id) q WHERE e <= 6").replace("SELECT * FROM (SELECT a.traj_id, a.frame, a.atom_id, b", "SELECT traj_id, frame, atom_id, atom_id_b, d FROM (SELECT a.traj_id, a.frame, a.atom_id, b"),
    "sel_nonempty_guard": sql("TF", "SELECT 0::BIGINT AS n_atoms, 'INVALID_SELECTION' AS status, 'none' AS sel UNION ALL SELECT n, CASE WHEN n > 5000 THEN 'TOO_MANY_ATOMS' ELSE 'OK' END, 'some' FROM (SELECT count(*) AS n FROM TF WHERE chain = 'B')"),
    "slice_frames": sql("TE", "SELECT traj_id, frame, atom_id FROM TE WHERE frame >= 3 AND frame < 40 AND (frame - 3) % 5 = 0"),
    "altloc_canonical": sql("TF", "SELECT traj_id, frame, atom_id, altloc FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, frame, residue ORDER BY CASE altloc WHEN '' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, altloc, atom_id) AS r FROM (SELECT *, ['B','A',''][atom_id % 3 + 1] AS altloc FROM TF)) WHERE r = 1"),
    "classify_residue": sql("TF", "SELECT traj_id, 'protein' AS kind, count(*) AS n FROM TF GROUP BY 1"),
    "classify_amino_acid": sql("TF", "SELECT traj_id, code, CASE WHEN code IN ('A','P','G') THEN 'hydrophobic' WHEN code = 'C' THEN 'polar' ELSE 'negative' END AS kind, count(*) AS n FROM (SELECT traj_id, CASE resname WHEN 'ALA' THEN 'A' WHEN 'GLY' THEN 'G' WHEN 'PRO' THEN 'P' WHEN 'CYS' THEN 'C' ELSE 'D' END AS code FROM TF) GROUP BY 1, 2, 3"),
    "classify_nucleotide": sql("TF", "SELECT traj_id, frame, residue, CASE WHEN bool_or(name = 'O') THEN 'ribose' ELSE 'indeterminate' END AS sugar FROM TF GROUP BY 1, 2, 3"),
    "validate_coords": sql("TE", "SELECT traj_id, frame, count(*) AS n, count(*) FILTER (NOT (isfinite(x) AND isfinite(y) AND isfinite(z))) AS n_bad, min(lx) > 0 AND min(ly) > 0 AND min(lz) > 0 AS box_ok, count(*) = 21 AS atoms_ok FROM TE GROUP BY 1, 2"),
    "annotation_filter": sql("TF", "SELECT traj_id, frame, atom_id FROM TF WHERE chain = 'A' AND residue IN (2, 4)"),
    "catalog_search": "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')",
    "catalog_rank": "SELECT p_partkey, w::INTEGER AS weight, row_number() OVER (ORDER BY w, p_size, p_retailprice DESC, p_partkey) AS rank FROM (SELECT *, CASE p_brand WHEN 'Brand#2' THEN 1 WHEN 'Brand#17' THEN 2 ELSE 99 END AS w FROM part)",
    "catalog_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS n_large FROM orders GROUP BY 1, 2",
    "capability_matrix": "SELECT capability, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM (SELECT unnest(string_split(p_type, ' ')) AS capability, p_brand FROM part) GROUP BY 1",
    "catalog_scorecard": "SELECT p_partkey, tier, cost, (tier * 2 + cost)::INTEGER AS score FROM (SELECT p_partkey, (CASE WHEN p_size < 10 THEN 3 WHEN p_size < 30 THEN 2 ELSE 1 END)::INTEGER AS tier, (CASE WHEN p_retailprice > 1500 THEN 2 ELSE 1 END)::INTEGER AS cost FROM part)",
    "selection_algebra": sql("TF", "SELECT traj_id, frame, atom_id FROM TF WHERE (chain = 'A' OR name = 'CA') AND residue BETWEEN 3 AND 6"),
    "best_hit": "SELECT l_orderkey, l_partkey AS best_part, l_extendedprice AS best_score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey DESC) AS r FROM lineitem) WHERE r = 1",
}
