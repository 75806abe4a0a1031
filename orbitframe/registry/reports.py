"""Registered composed jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.operators import interactions as i
from orbitframe.operators import reports as r
from orbitframe.registry.interactions import BC, LR, VD, _hb, _near
from orbitframe.registry.series import DI, REGION, _next
from orbitframe.registry.structure import rounded
from orbitframe.sources import views as v
from orbitframe.sources.views import sql

FR = ["traj_id", "frame"]


def _bases(p, d):
    """Atoms with residues 1 and 5 as G and C."""
    return v.te_full(p, d).withColumn("resname", F.when(F.col("residue") == 1, "G").when(F.col("residue") == 5, "U").otherwise("A"))


def _chain(p):
    return p.createDataFrame([(a, a + 1) for a in range(v.N_ATOMS - 1)], "i int, j int")


QUERIES = {
    "oriented_box": lambda p, d: rounded(r.oriented_box(v.te(p, d), FR)),
    "hbond_staged": lambda p, d: rounded(r.hbond_staged(v.te(p, d), 0, 3, 7, 8.0, 60.0)),
    "base_pairs": lambda p, d: r.base_pairs(_bases(p, d), 0.5, 8.0),
    "pose_validation": lambda p, d: r.pose_validation(i.bond_candidates(v.te_full(p, d), 3.0), v.te_full(p, d), F.expr("chain = 'B'"), 3.5, 1.0, 3.0),
    "model_consensus": lambda p, d: rounded(r.model_consensus(v.te(p, d), 17.5), "mean_rmsd", "max_rmsd"),
    "quality_report": lambda p, d: rounded(r.quality_report(v.te_full(p, d))),
    "structure_compare": lambda p, d: rounded(r.structure_compare(v.te(p, d))),
    "unwrap_bonded": lambda p, d: rounded(r.unwrap_bonded(v.te(p, d), _chain(p), 0, FR)),
}
ORACLE_SQL = {
    "hbond_staged": sql("TE", f", {_hb(8, 60)} SELECT traj_id, frame, round(d, 6) AS d, round(angle, 6) AS angle FROM HB WHERE bonded"),
    "base_pairs": sql("TF", f", TB AS (SELECT * REPLACE (CASE residue WHEN 1 THEN 'G' WHEN 5 THEN 'U' ELSE 'A' END AS resname) FROM TF WHERE element IN ('N', 'O')), {_near('TB', 8, 'a.residue < b.residue', ' AND d >= 0.5')}, Q AS (SELECT *, CASE WHEN resname || resname_b IN ('AU', 'UA') THEN 2 WHEN resname || resname_b IN ('GU', 'UG') THEN 1 END AS need FROM NP WHERE NOT (chain = chain_b AND residue_b - residue < 3)) SELECT traj_id, frame, residue, residue_b, count(*) AS n FROM Q WHERE need IS NOT NULL GROUP BY 1, 2, 3, 4, need HAVING count(*) >= need"),
    "pose_validation": sql("TF", f", {BC}, {_near('TF', 3, LR)}, O AS (SELECT traj_id, frame, count(*) FILTER (abs(d - 3.5) > 1.0) AS n_bonds_off FROM BC GROUP BY 1, 2), C AS (SELECT traj_id, frame, count(*) AS n FROM NP GROUP BY 1, 2) SELECT traj_id, frame, n_bonds_off, coalesce(n, 0) AS n_close, n_bonds_off = 0 AND coalesce(n, 0) = 0 AS valid FROM O LEFT JOIN C USING (traj_id, frame)"),
    "quality_report": sql("TF", f"{DI}, O AS (SELECT traj_id, frame, 100.0 * avg((region = 'OUTLIER')::INTEGER) AS outlier_percent FROM (SELECT traj_id, frame, {REGION} AS region FROM DI WHERE phi IS NOT NULL AND psi IS NOT NULL) GROUP BY 1, 2){_next('C', 'N')}, N AS (SELECT traj_id, frame, count(*) FILTER (d > 2.5) AS n_breaks FROM B WHERE next IS NOT NULL GROUP BY 1, 2), {_near('TF', 3.2)}, K AS (SELECT traj_id, frame, count(*) AS n_clashes FROM (SELECT *, ({VD('element')} + {VD('element_b')})::DOUBLE - d AS o FROM NP) WHERE o > 0.4 AND NOT (residue_b - residue = 1 AND name = 'C' AND name_b = 'N') GROUP BY 1, 2), S AS (SELECT traj_id, frame, count(*) AS n_atoms, avg(b_factor) AS mean_b, avg(occupancy) AS mean_occupancy FROM TF GROUP BY 1, 2) SELECT traj_id, frame, n_atoms, round(mean_b, 6) AS mean_b, round(mean_occupancy, 6) AS mean_occupancy, coalesce(n_breaks, 0) AS n_breaks, round(outlier_percent, 6) AS outlier_percent, coalesce(n_clashes, 0) AS n_clashes FROM S LEFT JOIN N USING (traj_id, frame) LEFT JOIN O USING (traj_id, frame) LEFT JOIN K USING (traj_id, frame)"),
    "unwrap_bonded": sql("TE", ", J AS (SELECT *, " + ", ".join(f"coalesce(round_even(({n} - lag({n}) OVER w) / 20, 0), 0) AS s{n}" for n in "xyz") + " FROM TE WINDOW w AS (PARTITION BY traj_id, frame ORDER BY atom_id)) SELECT traj_id, frame, atom_id, " + ", ".join(f"round({n} - 20 * sum(s{n}) OVER w, 6) + 0.0 AS {n}" for n in "xyz") + " FROM J WINDOW w AS (PARTITION BY traj_id, frame ORDER BY atom_id)"),
}
