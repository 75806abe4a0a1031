"""Registered surface, sequence-pair and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.operators import sequences as q
from orbitframe.operators import structure as st
from orbitframe.operators import surfaces as sf
from orbitframe.registry.structure import rounded
from orbitframe.sources import export as x
from orbitframe.sources import views as v
from orbitframe.sources.views import sql


def _pairs(p, d):
    """Documents and benchmark items that share a word of letters."""
    return q.related_pairs(v.sq(p, d), v.sq(p, d, "benchmark", "item_id"), ratio=0.05)


def _canonical(p, d):
    """Letters of benchmark items, some after an M, against their letters from the second or first on, numbered from 100, with holes."""
    items = v.sq(p, d, "benchmark", "item_id").select(F.col("seq_id").alias("key"), "seq").filter(F.length("seq") > 1)
    canonical = items.select("key", F.when(F.col("key") % 2 == 0, F.concat(F.lit("M"), "seq")).otherwise(F.col("seq")).alias("seq"))
    residues = items.select("key", F.posexplode(F.split("seq", "")).alias("k", "code")).filter("code <> ''")
    seen = ~((F.col("k") % 10 < 2) & (F.col("k") % 30 < 10))
    return q.canonical_alignment(canonical, residues.select("key", (F.col("k") + 100).alias("number"), F.when(F.col("k") % 7 == 3, "X").otherwise(F.col("code")).alias("code"), seen.alias("seen")))


QUERIES = {
    "sasa_atoms": lambda p, d: rounded(sf.sasa_atoms(v.te_full(p, d))),
    "sasa_rollup": lambda p, d: rounded(sf.sasa_rollup(sf.sasa_atoms(v.te_full(p, d)), v.te_atoms(p))),
    "rsa": lambda p, d: rounded(sf.rsa(sf.sasa_atoms(v.te_full(p, d)), v.te_atoms(p))),
    "vdw_volume": lambda p, d: rounded(sf.vdw_volume(v.te_full(p, d))),
    "sequence_alignment_pairs": lambda p, d: rounded(q.sequence_alignment_pairs(_pairs(p, d))),
    "canonical_alignment": lambda p, d: rounded(_canonical(p, d)[1]),
    "canonical_positions": lambda p, d: _canonical(p, d)[0],
    "canonical_missing": lambda p, d: _canonical(p, d)[2],
    "leakage_join": lambda p, d: rounded(q.leakage_join(v.sq(p, d), v.sq(p, d, "benchmark", "item_id").toDF("train_id", "train"), 0.15)),
    "entity_summary": lambda p, d: st.entity_summary(v.table(p, d, "lineitem"), ["l_orderkey"], "l_suppkey", "l_linenumber"),
    "export_fasta": lambda p, d: x.export_fasta(v.te_full(p, d), ["traj_id"]),
    "export_pdb": lambda p, d: x.pdb_lines(v.te_full(p, d).withColumn("serial", F.col("atom_id") + 1)).select("value"),
}
_POINTS = "[" + ", ".join(f"[{x!r}, {y!r}, {z!r}]" for x, y, z in sf.unit_points()) + "]"
_SASA = f""", A AS (SELECT traj_id, frame, atom_id, x, y, z, (CASE element WHEN 'C' THEN 1.7 WHEN 'N' THEN 1.55 ELSE 1.52 END)::DOUBLE + 1.4 AS r FROM TF),
    S AS (SELECT traj_id, frame, atom_id, r, k, x + r * p[1] AS sx, y + r * p[2] AS sy, z + r * p[3] AS sz FROM (SELECT *, unnest({_POINTS}::DOUBLE[][]) AS p, unnest(range({sf.POINTS})) AS k FROM A)),
    HID AS (SELECT DISTINCT s.traj_id, s.frame, s.atom_id, k FROM S s JOIN A b ON s.traj_id = b.traj_id AND s.frame = b.frame AND s.atom_id <> b.atom_id WHERE (sx - b.x)**2 + (sy - b.y)**2 + (sz - b.z)**2 < b.r * b.r),
    SA AS (SELECT traj_id, frame, atom_id, avg((h.k IS NULL)::INTEGER) * 4 * pi() * any_value(r)**2 AS sasa FROM S LEFT JOIN HID h USING (traj_id, frame, atom_id, k) GROUP BY 1, 2, 3)"""


def _shell(p, d):
    """The vectors of a label as potassium atoms on a sphere: one structure per label."""
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    size = F.sqrt(e[0] ** 2 + e[1] ** 2 + e[2] ** 2)
    return v.table(p, d, "embeddings").select(F.col("label").alias("traj_id"), F.lit(0).cast("long").alias("frame"), F.col("vec_id").alias("atom_id"), *[(5.0 * c / size).alias(n) for c, n in zip(e, "xyz", strict=True)], F.lit("K").alias("element"), F.lit("A").alias("chain"), F.col("vec_id").alias("residue"))


QUERIES["cavities"] = lambda p, d: rounded(sf.cavities(_shell(p, d)))
_CANON = """, I AS (SELECT seq_id AS key, seq FROM SB WHERE length(seq) > 1), CL AS (SELECT key, seq, key % 2 = 0 OR (substr(seq, 1, 1) = 'M' AND substr(seq, 1, 1) = substr(seq, 2, 1)) AS cleaved, CASE WHEN key % 2 = 0 THEN 'M' || seq ELSE seq END AS full_ FROM I),
    RS AS (SELECT key, cleaved, full_, k + 100 AS number, CASE WHEN k % 7 = 3 THEN 'X' ELSE seq[k + 1] END AS code, NOT (k % 10 < 2 AND k % 30 < 10) AS seen, k, length(seq) AS n FROM (SELECT *, unnest(range(length(seq))) AS k FROM CL)),
    PO AS (SELECT *, k + 1 + cleaved::INTEGER AS position FROM RS), AL AS (SELECT * FROM PO WHERE position <= length(full_))"""
ORACLE_SQL = {
    "canonical_alignment": sql("SB", _CANON + " SELECT key, 100 - (1 + any_value(cleaved)::INTEGER) AS numbering_offset, any_value(cleaved) AS initiator_cleaved, count(*) AS n_aligned, round(avg((code = full_[position])::INTEGER), 6) AS identity FROM AL GROUP BY 1"),
    "canonical_positions": sql("SB", _CANON + " SELECT key, position, number FROM AL"),
    "canonical_missing": sql("SB", _CANON + ", G AS (SELECT key, k, n, k - row_number() OVER (PARTITION BY key ORDER BY k) AS run FROM RS WHERE NOT seen) SELECT key, min(k) + 100 AS first, max(k) + 100 AS last, count(*) AS length, CASE WHEN min(k) = 0 OR max(k) = any_value(n) - 1 THEN 'TERMINAL_FLEXIBILITY' ELSE 'UNRESOLVED_DENSITY' END AS reason FROM G GROUP BY key, run"),
    "leakage_join": sql("SQ SB", "SELECT seq_id, train_id, round(identity, 6) AS identity FROM (SELECT a.seq_id, b.seq_id AS train_id, CASE WHEN least(length(a.seq), length(b.seq)) > 0 THEN len(list_filter(list_zip(string_split(a.seq, '')[1:least(length(a.seq), length(b.seq))], string_split(b.seq, '')[1:least(length(a.seq), length(b.seq))]), lambda x: x[1] = x[2])) / greatest(length(a.seq), length(b.seq)) ELSE 0 END AS identity FROM SQ a JOIN SB b ON least(length(a.seq), length(b.seq)) >= 0.15 * greatest(length(a.seq), length(b.seq))) WHERE identity >= 0.15"),
    "entity_summary": "SELECT l_orderkey, count(*) AS n_entities, sum(n)::BIGINT AS n_chains, CASE WHEN count(*) > 1 THEN 'heteromer' WHEN max(n) > 1 THEN 'homomer' ELSE 'monomer' END AS kind FROM (SELECT l_orderkey, l_suppkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "vdw_volume": sql("TF", """, A AS (SELECT traj_id, frame, x, y, z, (CASE element WHEN 'C' THEN 1.7 WHEN 'N' THEN 1.55 ELSE 1.52 END)::DOUBLE AS r FROM TF),
        X AS (SELECT *, unnest(range(floor((x - r) / 0.5)::BIGINT, floor((x + r) / 0.5)::BIGINT + 1)) AS ix FROM A), Y AS (SELECT *, unnest(range(floor((y - r) / 0.5)::BIGINT, floor((y + r) / 0.5)::BIGINT + 1)) AS iy FROM X), Z AS (SELECT *, unnest(range(floor((z - r) / 0.5)::BIGINT, floor((z + r) / 0.5)::BIGINT + 1)) AS iz FROM Y),
        V AS (SELECT traj_id, frame, count(DISTINCT (ix, iy, iz)) * 0.125::DOUBLE AS volume FROM Z WHERE sqrt(((ix + 0.5) * 0.5 - x)**2 + ((iy + 0.5) * 0.5 - y)**2 + ((iz + 0.5) * 0.5 - z)**2) <= r GROUP BY 1, 2)
        SELECT traj_id, frame, volume, round(volume / ((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z))), 6) AS packing_fraction FROM V JOIN TE USING (traj_id, frame) GROUP BY 1, 2, 3"""),
    "sasa_atoms": sql("TF", f"{_SASA} SELECT traj_id, frame, atom_id, round(sasa, 6) + 0.0 AS sasa FROM SA"),
    "sasa_rollup": sql("TF", f"{_SASA}, J AS (SELECT * FROM SA JOIN ATOMS USING (atom_id)) SELECT traj_id, frame, chain, residue, round(sum(sasa), 6) AS sasa FROM J GROUP BY GROUPING SETS ((traj_id, frame, chain, residue), (traj_id, frame, chain), (traj_id, frame))"),
    "rsa": sql("TF", f"{_SASA}, J AS (SELECT traj_id, frame, residue, resname, sum(sasa) AS sasa, greatest(0, least(1, sum(sasa) / any_value(CASE resname WHEN 'ALA' THEN 129 WHEN 'GLY' THEN 104 WHEN 'PRO' THEN 159 WHEN 'CYS' THEN 167 ELSE 193 END))) AS rsa FROM SA JOIN ATOMS USING (atom_id) GROUP BY 1, 2, 3, 4) SELECT traj_id, frame, residue, resname, round(sasa, 6) AS sasa, round(rsa, 6) AS rsa, CASE WHEN rsa < 0.1 THEN 'buried' WHEN rsa >= 0.25 THEN 'exposed' ELSE 'intermediate' END AS kind FROM J"),
    "export_pdb": sql("TF", "SELECT (CASE WHEN is_hetero THEN 'HETATM' ELSE 'ATOM  ' END) || lpad((atom_id + 1)::VARCHAR, 5, ' ') || ' ' || rpad(' ' || name, 4, ' ') || ' ' || lpad(resname, 3, ' ') || ' ' || chain || lpad(residue::VARCHAR, 4, ' ') || '    ' || " + " || ".join(f"lpad(printf('%.3f', {n}), 8, ' ')" for n in "xyz") + " || lpad(printf('%.2f', occupancy), 6, ' ') || lpad(printf('%.2f', b_factor), 6, ' ') || repeat(' ', 10) || lpad(element, 2, ' ') || '  ' AS value FROM TF"),
    "export_fasta": sql("TF", "SELECT traj_id, chain, string_agg(CASE resname WHEN 'ALA' THEN 'A' WHEN 'GLY' THEN 'G' WHEN 'PRO' THEN 'P' WHEN 'CYS' THEN 'C' ELSE 'D' END, '' ORDER BY residue) AS sequence FROM (SELECT DISTINCT traj_id, chain, residue, resname FROM TF) GROUP BY 1, 2"),
}
