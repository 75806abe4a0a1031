"""Registered interaction, superposition, graph and lineage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.operators import contacts as con
from orbitframe.operators import graphs as gr
from orbitframe.operators import interactions as i
from orbitframe.operators import series as se
from orbitframe.operators import sets
from orbitframe.operators import structure as st
from orbitframe.operators import superposition as su
from orbitframe.registry.series import _next
from orbitframe.registry.structure import CUT, P, _dot, _minus, rounded
from orbitframe.sources import views as v
from orbitframe.sources.views import sql

FR = ["traj_id", "frame"]
LIG = "chain = 'B'"


def _r4(df, *names):
    return df.withColumns({n: F.round(F.col(n), 4) + F.lit(0.0) for n in names})


def _whole4(df, name):
    """_r4 for as many rows as there are pairs of frames: by whole numbers, and decimals only for negative, large and unknown values and next
    to a half."""
    at = F.col(name) * 10000
    plain = F.col(name).between(0, 1e5) & (F.abs(at - F.floor(at) - 0.5) > 1e-6)
    return df.withColumn(name, F.when(plain, F.floor(at + 0.5) / F.lit(10000.0)).otherwise(F.round(F.col(name), 4) + F.lit(0.0)))


def _salted(p, d):
    """Atoms with residue 2 as LYS and residue 4 as GLU."""
    return v.te_full(p, d).withColumn("resname", F.when(F.col("residue") == 2, "LYS").when(F.col("residue") == 4, "GLU").otherwise(F.col("resname")))


def _contacts(p, d):
    """Contacts of atoms with names of side chains in two residues, zinc as the last atom, and hydrogens half way from atom N to atom CA."""
    name = F.when((F.col("residue") == 2) & (F.col("name") == "N"), "NZ").when((F.col("residue") == 4) & (F.col("name") == "O"), "OE1").otherwise(F.col("name"))
    atoms = _salted(p, d).withColumns({"name": name, "element": F.when(F.col("atom_id") == 20, "ZN").otherwise(F.col("element"))})
    pairs = atoms.filter("name IN ('N', 'NZ', 'CA')").groupBy(*FR, "residue").agg(F.min("atom_id").alias("atom_id"), *[F.avg(n).alias(f"h{n}") for n in "xyz"])
    return i.classify_contacts(atoms, 4.5, pairs.filter("residue % 2 = 0").drop("residue"))


def _sulfur(p, d):
    return v.te_full(p, d).withColumns({"resname": F.lit("CYS"), "name": F.when(F.col("name") == "O", "SG").otherwise(F.col("name"))})


#: The 21 atoms as a phenylalanine, a tryptophan and a histidine, with a backbone atom in the first and in the second.
RING_ATOMS = [("PHE", 1, "A", "N CG CD1 CD2 CE1 CE2 CZ"), ("TRP", 2, "A", "CA CG CD1 NE1 CE2 CD2 CZ2 CH2 CZ3"), ("HIS", 2, "B", "CG ND1 CE1 NE2 CD2")]
RING_ROWS = [(k, *row) for k, row in enumerate((name, r, n, chain) for r, n, chain, names in RING_ATOMS for name in names.split())]


def _side_chains(p, d):
    """The trajectories at a fifth of their size, under the names of aromatic side chains."""
    names = p.createDataFrame(RING_ROWS, "atom_id int, name string, resname string, residue int, chain string")
    return v.te(p, d).select(*FR, "atom_id", *[(F.col(n) * 0.2).alias(n) for n in "xyz"]).join(F.broadcast(names), "atom_id")


def _donors(p, d):
    """A metal as the last atom, water in residue 4, a hetero group in residue 3, and names of side chains in residue 2."""
    r = F.col("residue")
    return v.te_full(p, d).withColumns({"resname": F.when(r == 4, "HOH").otherwise(F.col("resname")), "is_hetero": r == 3, "name": F.when(r.isin(2, 3), F.concat(F.col("name"), F.lit("D1"))).otherwise(F.col("name"))})


def _bonds(p, d):
    return v.te_full(p, d)


def _edges(p, d):
    return con.near_pairs(v.te(p, d), CUT).select(*FR, "i", "j")


def _template(p):
    return p.createDataFrame([(r, a, b) for r in ("ALA", "GLY", "PRO", "CYS", "ASP") for a, b in (("N", "CA"), ("CA", "C"), ("C", "O"))], "resname string, name_a string, name_b string")


def _components(p, d, edges=None):
    return gr.connected_components(_edges(p, d) if edges is None else edges, v.te(p, d).select(*FR, F.col("atom_id").alias("node")), FR)


def _contact_graph(p, d):
    edges = gr.stored(_edges(p, d))
    return gr.contact_graph(edges, _components(p, d, edges), FR)


def _shifted(p, d):
    """Frames against the first, for fitted deviations."""
    return st.against(v.te(p, d), v.te(p, d).filter("frame = 0"), ["traj_id", "atom_id"])


def _backbone(p, d):
    return se.neighbours(v.te_full(p, d), "CA", "CA").groupBy(*FR).agg(F.count_if(~F.col("d").between(3.2, 4.3)).alias("n_implausible"))


def _customers(edges):
    return edges.filter("ancestor LIKE 'C%'")


def _with_reversed(edges):
    """The edges and the least one of them reversed."""
    least = edges.agg(F.min(F.struct("parent", "child")).alias("e")).filter("e is not null")
    return edges.unionByName(least.select(F.col("e.child").alias("parent"), F.col("e.parent").alias("child")))


def _lineage_report(p, d):
    """Status and digest of each pair. Sets of ancestors become pairs after the join, and those of nodes that are no orders are not moved."""
    found, order = gr.packed_ancestors(v.lg_codes(p, d)).drop("distance"), F.coalesce(F.pmod("node", F.lit(4)) == v.KINDS.index("O"), F.lit(False))
    orders = v.table(p, d, "orders").select((F.col("o_orderkey").cast("long") * 4 + v.KINDS.index("O")).alias("node"), "o_orderstatus")
    rows = found.filter(order).join(orders, "node", "left").unionByName(found.filter(~order), allowMissingColumns=True)
    rows = sets.unpacked(rows, "ancestors").select(v.lg_name("node").alias("node"), F.explode("ancestors").alias("code"), "o_orderstatus").withColumn("ancestor", v.lg_name("code"))
    return rows.select("node", "ancestor", "o_orderstatus", F.sha2(F.concat_ws("|", "node", "ancestor"), 256).alias("digest"))


QUERIES = {
    "classify_contacts": lambda p, d: rounded(_contacts(p, d).select(*FR, "atom_id", "atom_id_b", "d", "kind")),
    "interaction_fingerprint": lambda p, d: i.interaction_fingerprint(_salted(p, d), F.expr(LIG)),
    "salt_bridges": lambda p, d: rounded(i.salt_bridges(_salted(p, d)).select(*FR, "atom_id", "atom_id_b", "d")),
    "disulfide_pairs": lambda p, d: rounded(i.disulfide_pairs(_sulfur(p, d), 1.0, 4.0).select(*FR, "atom_id", "atom_id_b", "d")),
    "binding_site": lambda p, d: rounded(i.binding_site(v.te_full(p, d), F.expr(LIG), 6.0)),
    "proximity_rank": lambda p, d: i.binding_site(v.te_full(p, d), F.expr(LIG), 5.0).select(*FR, "residue", "rank"),
    "metal_donors": lambda p, d: rounded(i.metal_donors(_donors(p, d), F.expr("atom_id = 20"), 0.5, 6.0)),
    "metal_coordination": lambda p, d: rounded(i.metal_coordination(v.te_full(p, d), F.expr("atom_id = 20"), 0.5, 6.0)),
    "ligand_instances": lambda p, d: rounded(v.te_full(p, d).filter(LIG).groupBy(*FR, "residue").agg(F.count(F.lit(1)).alias("n_atoms"), *[F.avg(n).alias(n) for n in "xyz"])),
    "ligand_pocket_lining": lambda p, d: rounded(i.binding_site(v.te_full(p, d), F.expr(LIG), 4.5).groupBy(*FR).agg(F.count(F.lit(1)).alias("n_residues"), (1.35 * F.count(F.lit(1)) * 4 / 3 * 3.141592653589793 * 1.7**3).alias("volume"))),
    "aromatic_rings": lambda p, d: rounded(i.rings(_side_chains(p, d)).drop("nx", "ny", "nz")),
    "pi_stacking": lambda p, d: rounded(i.pi_stacking(i.rings(_side_chains(p, d)))),
    "steric_clashes": lambda p, d: rounded(i.steric_clashes(v.te_full(p, d)).select(*FR, "atom_id", "atom_id_b", "overlap")),
    "docking_clashes": lambda p, d: i.steric_clashes(v.te_full(p, d)).filter("chain <> chain_b").groupBy(*FR).agg(F.count(F.lit(1)).alias("n")),
    "plausibility": lambda p, d: i.plausibility(v.te_full(p, d), _backbone(p, d)),
    "bond_candidates": lambda p, d: rounded(i.bond_candidates(v.te_full(p, d), 3.0)),
    "template_bonds": lambda p, d: i.template_bonds(v.te_full(p, d), _template(p)),
    "bond_union": lambda p, d: i.bond_union([i.template_bonds(v.te_full(p, d), _template(p)), i.bond_candidates(v.te_full(p, d), 3.0)]),
    "valence_audit": lambda p, d: i.valence_audit(i.template_bonds(v.te_full(p, d), _template(p)), v.te_atoms(p).select("atom_id", "element"), {"C": 1, "N": 3, "O": 2}),
    "molecular_graph_summary": lambda p, d: i.bond_union([i.template_bonds(v.te_full(p, d), _template(p)), i.bond_candidates(v.te_full(p, d), 3.0)]).groupBy(*FR, "source").agg(F.count(F.lit(1)).alias("n")),
    "hbond_series": lambda p, d: rounded(i.hbond_series(v.te(p, d), 0, 3, 7)),
    "hbond_occupancy": lambda p, d: rounded(i.hbond_occupancy(i.hbond_series(v.te(p, d), 0, 3, 7, 15.0, 60.0))),
    "rmsd_fit": lambda p, d: _r4(su.rmsd_fit(_shifted(p, d), FR).filter("frame > 0"), "rmsd"),
    "fit_reference": lambda p, d: _r4(su.fit_reference(v.te(p, d)), *"xyz"),
    "rmsd_matrix": lambda p, d: _whole4(su.rmsd_matrix(v.te(p, d), aligned=False), "rmsd"),
    "rmsd_matrix_fit": lambda p, d: _whole4(su.rmsd_matrix(v.te(p, d)), "rmsd"),
    "rmsf_fit": lambda p, d: _r4(su.rmsf_fit(v.te(p, d)), "rmsf"),
    "consensus_spans": lambda p, d: su.consensus_spans(v.te(p, d), 17.5),
    "daura_clusters": lambda p, d: su.daura_clusters(su.rmsd_matrix(v.te(p, d), aligned=False, cutoff=6.0), v.te(p, d).select(*FR).distinct(), 6.0),
    "trajectory_pca": lambda p, d: _r4(su.trajectory_pca(v.te(p, d))[0], "first", "second", "share"),
    "trajectory_projections": lambda p, d: _r4(su.trajectory_pca(v.te(p, d))[1], "p1", "p2"),
    "rmsd_fit_weighted": lambda p, d: _r4(su.rmsd_fit(st.against(v.te_full(p, d), v.te(p, d).filter("frame = 0"), ["traj_id", "atom_id"]), FR, st.mass()).filter("frame > 0"), "rmsd"),
    "connected_components": lambda p, d: _components(p, d).withColumn("component", F.col("component").cast("int")),
    "contact_graph": lambda p, d: rounded(_contact_graph(p, d)),
    "rings": lambda p, d: gr.ring_types(gr.rings(st.atom_pairs(v.te(p, d)).filter("d <= 4").select(*FR, "i", "j"), FR), v.te_atoms(p), FR),
    "lineage_children": lambda p, d: v.lg(p, d).groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")),
    "lineage_sources": lambda p, d: gr.roots(v.lg(p, d)),
    "lineage_ancestors": lambda p, d: gr.ancestors(v.lg_codes(p, d)).select(v.lg_name("node").alias("node"), v.lg_name("ancestor").alias("ancestor"), "distance"),
    "lineage_cycle_check": lambda p, d: gr.cycle_edges(_with_reversed(v.lg(p, d))),
    "lineage_join_report": _lineage_report,
}
ANCESTORS = ", A AS (SELECT child AS node, parent AS ancestor, 1 AS distance FROM LG UNION SELECT a.node, l.parent, a.distance + 1 FROM A a JOIN LG l ON l.child = a.ancestor)"
D = "sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2)"
TS = "TS AS (SELECT * REPLACE (CASE residue WHEN 2 THEN 'LYS' WHEN 4 THEN 'GLU' ELSE resname END AS resname) FROM TF)"


def _recursive(body):
    return sql("LG", body).replace("WITH ", "WITH RECURSIVE ", 1)


def _near(source, radius, where="a.atom_id < b.atom_id AND a.residue <> b.residue", extra=""):
    cols = ", ".join(f"a.{c}, b.{c} AS {c}_b" for c in ("atom_id", "residue", "resname", "name", "element", "chain"))
    return f"NP AS (SELECT * FROM (SELECT a.traj_id, a.frame, {cols}, {D} AS d FROM {source} a JOIN {source} b ON a.traj_id = b.traj_id AND a.frame = b.frame AND {where}) WHERE d <= {radius}{extra})"


POLAR = "IN ('N','O','F','S')"
CAT, ANI = "IN ('ARG','LYS','HIS')", "IN ('ASP','GLU')"
COV = lambda c: f"CASE {c} WHEN 'C' THEN 0.76 WHEN 'N' THEN 0.71 ELSE 0.66 END"
VD = lambda c: f"CASE {c} WHEN 'C' THEN 1.7 WHEN 'N' THEN 1.55 ELSE 1.52 END"
LR = "a.chain <> 'B' AND b.chain = 'B'"
BS = "BS AS (SELECT traj_id, frame, residue, min(d) AS min_d, count(DISTINCT atom_id) AS n_atoms, bool_or(chain <> chain_b) AS inter_chain FROM NP GROUP BY 1, 2, 3)"
TB = "TB AS (SELECT a.traj_id, a.frame, a.atom_id AS i, b.atom_id AS j FROM TF a JOIN TF b ON a.traj_id = b.traj_id AND a.frame = b.frame AND a.residue = b.residue AND b.atom_id = a.atom_id + 1)"
BC = f"BC AS (SELECT * FROM (SELECT a.traj_id, a.frame, a.atom_id AS i, b.atom_id AS j, {D} AS d, {COV('a.element')} + {COV('b.element')} + 3.0 AS reach FROM TF a JOIN TF b ON a.traj_id = b.traj_id AND a.frame = b.frame AND a.residue = b.residue AND a.atom_id < b.atom_id) WHERE d BETWEEN 0.4 AND reach)"
BU = "BU AS (SELECT traj_id, frame, i, j, min(s)::INTEGER AS source FROM (SELECT traj_id, frame, i, j, 0 AS s FROM TB UNION ALL SELECT traj_id, frame, i, j, 1 FROM BC) GROUP BY 1, 2, 3, 4)"


def _mic(p, q):
    return [f"(({p}.{n} - {q}.{n}) - 20 * round_even(({p}.{n} - {q}.{n}) / 20, 0))" for n in "xyz"]


def _hb(cutoff, least):
    u, w = _mic("a", "h"), _mic("c", "h")
    dot = lambda x, y: "(" + " + ".join(f"{s}*{t}" for s, t in zip(x, y, strict=True)) + ")"
    return f"HB AS (SELECT *, d < {cutoff} AND angle >= {least} AS bonded FROM (SELECT h.traj_id, h.frame, sqrt({' + '.join(f'({s} - {t})**2' for s, t in zip(u, w, strict=True))}) AS d, degrees(acos(greatest(-1, least(1, {dot(u, w)} / (sqrt({dot(u, u)}) * sqrt({dot(w, w)})))))) AS angle FROM TE a JOIN TE h ON a.traj_id = h.traj_id AND a.frame = h.frame AND a.atom_id = 0 AND h.atom_id = 3 JOIN TE c ON c.traj_id = h.traj_id AND c.frame = h.frame AND c.atom_id = 7))"


_u, _w = [f"(a.{n} - h{n})" for n in "xyz"], [f"(b.{n} - h{n})" for n in "xyz"]
_arms = f"degrees(acos(greatest(-1, least(1, {_dot(_u, _w)} / (sqrt({_dot(_u, _u)}) * sqrt({_dot(_w, _w)})))))) AS angle"


def _ring_sql():
    """Centres and normals of aromatic rings by the names of their atoms, the normal from the first three by id."""
    at = ", ".join(f"max({n}) FILTER (k = {i}) AS q{i}{n}" for i in (1, 2, 3) for n in "xyz")
    u, w = _minus("q1", "q2"), _minus("q1", "q3")
    n = [f"({u[1]}*{w[2]} - {u[2]}*{w[1]})", f"({u[2]}*{w[0]} - {u[0]}*{w[2]})", f"({u[0]}*{w[1]} - {u[1]}*{w[0]})"]
    names = ", ".join(f"({a}, '{name}', '{r}', {k}, '{c}')" for a, name, r, k, c in RING_ROWS)
    kinds = ", ".join(f"('{r}', '{kind}', '{name}', {least})" for r, kind, listed, least in i.AROMATIC_RINGS for name in listed)
    return f"""RA AS (SELECT traj_id, frame, a.*, x * 0.2 AS x, y * 0.2 AS y, z * 0.2 AS z FROM TE JOIN (VALUES {names}) a(atom_id, name, resname, residue, chain) USING (atom_id)),
        RK AS (SELECT RA.*, kind, least, row_number() OVER (PARTITION BY traj_id, frame, chain, residue, kind ORDER BY atom_id) AS k FROM RA JOIN (VALUES {kinds}) t(resname, kind, name, least) USING (resname, name)),
        RQ AS (SELECT traj_id, frame, chain, residue, resname, kind, count(*) AS n_atoms, round(avg(x), 3) AS x, round(avg(y), 3) AS y, round(avg(z), 3) AS z, {at} FROM RK GROUP BY ALL HAVING count(*) >= any_value(least)),
        RN AS (SELECT *, {', '.join(f'{c} AS m{a}' for c, a in zip(n, 'xyz', strict=True))} FROM RQ)"""


_CROSS = [(a, b) for a in "xyz" for b in "xyz"]
#: Fitted deviation of frames from the first: the singular values of the covariance, by the roots of its Gram matrix's cubic.
FIT = f""", M AS (SELECT p.traj_id, p.frame, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz FROM TE p JOIN TE q ON p.traj_id = q.traj_id AND p.atom_id = q.atom_id AND q.frame = 0 AND p.frame > 0),
    F1 AS (SELECT traj_id, frame, count(*) AS n, {' + '.join(f'sum({s}{a}*{s}{a}) - sum({s}{a})**2 / count(*)' for s in 'pq' for a in 'xyz')} AS energy, {', '.join(f'sum(p{a}*q{b}) - sum(p{a})*sum(q{b}) / count(*) AS c{a}{b}' for a, b in _CROSS)} FROM M GROUP BY 1, 2),
    F2 AS (SELECT *, {', '.join(f'{" + ".join(f"c{k}{a}*c{k}{b}" for k in "xyz")} AS g{a}{b}' for a, b in ('xx', 'yy', 'zz', 'xy', 'xz', 'yz'))}, cxx*(cyy*czz - cyz*czy) - cxy*(cyx*czz - cyz*czx) + cxz*(cyx*czy - cyy*czx) AS det FROM F1),
    F3 AS (SELECT *, (gxx + gyy + gzz) / 3 AS m FROM F2), F4 AS (SELECT *, sqrt(((gxx-m)**2 + (gyy-m)**2 + (gzz-m)**2 + 2*(gxy**2 + gxz**2 + gyz**2)) / 6) AS k FROM F3),
    F5 AS (SELECT *, acos(greatest(-1, least(1, ((gxx-m)*((gyy-m)*(gzz-m) - gyz*gyz) - gxy*(gxy*(gzz-m) - gyz*gxz) + gxz*(gxy*gyz - (gyy-m)*gxz)) / (2*k**3)))) / 3 AS phi FROM F4),
    F6 AS (SELECT *, sqrt(m + 2*k*cos(phi)) AS s1, sqrt(greatest(0, m + 2*k*cos(phi + 4*pi()/3))) AS s2 FROM F5)"""
EDGES = f"{P}, E AS (SELECT traj_id, frame, i, j FROM P WHERE d <= 8)"
CC = "U AS (SELECT traj_id, frame, i, j FROM E UNION ALL SELECT traj_id, frame, j, i FROM E), R AS (SELECT traj_id, frame, atom_id AS node, atom_id AS reach FROM TE UNION SELECT r.traj_id, r.frame, r.node, u.j FROM R r JOIN U u ON r.traj_id = u.traj_id AND r.frame = u.frame AND r.reach = u.i), CCO AS (SELECT traj_id, frame, node, min(reach) AS component FROM R GROUP BY 1, 2, 3)"
ORACLE_SQL = {
    "classify_contacts": sql("TF", f""", {TS}, TC AS (SELECT * REPLACE (CASE WHEN residue = 2 AND name = 'N' THEN 'NZ' WHEN residue = 4 AND name = 'O' THEN 'OE1' ELSE name END AS name, CASE WHEN atom_id = 20 THEN 'ZN' ELSE element END AS element) FROM TS),
        HY AS (SELECT traj_id, frame, min(atom_id) AS atom_id, avg(x) AS hx, avg(y) AS hy, avg(z) AS hz FROM TC WHERE name IN ('N', 'NZ', 'CA') AND residue % 2 = 0 GROUP BY traj_id, frame, residue), {_near('TC', 4.5)},
        NH AS (SELECT n.*, hx IS NOT NULL AS known, {_arms} FROM NP n JOIN TC a USING (traj_id, frame, atom_id) JOIN TC b ON b.traj_id = n.traj_id AND b.frame = n.frame AND b.atom_id = n.atom_id_b LEFT JOIN HY h ON h.traj_id = n.traj_id AND h.frame = n.frame AND h.atom_id = n.atom_id)
        SELECT traj_id, frame, atom_id, atom_id_b, round(d, 6) AS d, CASE WHEN d <= 2.8 AND (element = 'ZN' OR element_b = 'ZN') THEN CASE WHEN element IN ('N', 'O') OR element_b IN ('N', 'O') THEN 'metal' ELSE 'proximity' END
        WHEN d <= 4 AND ((name = 'NZ' AND name_b = 'OE1') OR (name = 'OE1' AND name_b = 'NZ')) THEN 'salt_bridge' WHEN d <= 3.5 AND element IN ('N', 'O') AND element_b IN ('N', 'O') AND NOT known THEN 'hbond_putative' WHEN d <= 3.5 AND element IN ('N', 'O') AND element_b IN ('N', 'O') AND angle >= 120 THEN 'hbond_explicit'
        WHEN name = 'CA' AND name_b = 'CA' THEN 'hydrophobic' ELSE 'proximity' END AS kind FROM NH"""),
    "interaction_fingerprint": sql("TF", f", {TS}, {_near('TS', 4.5, LR)} SELECT traj_id, frame, residue, bool_or(d <= 3.5 AND element {POLAR} AND element_b {POLAR}) AS hbond, bool_or(element = 'C' AND element_b = 'C') AS hydrophobic, bool_or(d <= 4 AND (resname {CAT} OR resname {ANI})) AS salt_bridge, count(*) AS n_pairs FROM NP GROUP BY 1, 2, 3"),
    "pi_stacking": sql("TE", f""", {_ring_sql()}, PS AS (SELECT a.traj_id, a.frame, a.chain, a.residue, a.kind, b.chain AS chain_b, b.residue AS residue_b, b.kind AS kind_b, a.chain <> b.chain AS between_chains, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) AS d,
            degrees(acos(least(1, abs(a.mx*b.mx + a.my*b.my + a.mz*b.mz) / (sqrt(a.mx**2 + a.my**2 + a.mz**2) * sqrt(b.mx**2 + b.my**2 + b.mz**2))))) AS angle
            FROM RN a JOIN RN b ON a.traj_id = b.traj_id AND a.frame = b.frame AND (a.chain, a.residue, a.kind) < (b.chain, b.residue, b.kind) AND (a.chain, a.residue) <> (b.chain, b.residue)),
        Q AS (SELECT *, CASE WHEN d <= 4.5 AND angle <= 30 THEN 'parallel' WHEN angle BETWEEN 60 AND 90 THEN 't_shape' END AS stacking FROM PS WHERE d <= 5.5)
        SELECT * REPLACE (round(d, 6) AS d, round(angle, 6) AS angle) FROM Q WHERE stacking IS NOT NULL"""),
    "rmsd_fit": sql("TE", f"{FIT} SELECT traj_id, frame, round(sqrt(greatest(0, (energy - 2 * (s1 + s2 + det / (s1 * s2))) / n)), 4) + 0.0 AS rmsd FROM F6"),
    "rings": sql("TE", f""", {P}, E AS (SELECT traj_id, frame, i, j FROM P WHERE d <= 4), U AS (SELECT traj_id, frame, i, j FROM E UNION ALL SELECT traj_id, frame, j, i FROM E),
        W AS (SELECT traj_id, frame, [i, j] AS p FROM U WHERE i < j UNION ALL SELECT w.traj_id, w.frame, list_append(w.p, u.j) FROM W w JOIN U u ON u.traj_id = w.traj_id AND u.frame = w.frame AND u.i = w.p[-1] WHERE len(w.p) < 7 AND u.j > w.p[1] AND NOT list_contains(w.p, u.j)),
        C AS (SELECT DISTINCT w.traj_id, w.frame, len(p)::INTEGER AS size, list_sort(p) AS p FROM W w JOIN U u ON u.traj_id = w.traj_id AND u.frame = w.frame AND u.i = w.p[-1] AND u.j = w.p[1] WHERE len(p) > 2 AND p[2] < p[-1]),
        K AS (SELECT *, len(list_filter(p, lambda a: a % 4 IN (1, 2))) AS c, len(list_filter(p, lambda a: a % 4 = 0)) AS n, len(list_filter(p, lambda a: a % 4 = 3)) AS o FROM C),
        T AS (SELECT *, CASE WHEN size = 6 AND c = 6 THEN 'BENZENE' WHEN size = 6 AND c = 5 AND n = 1 THEN 'PYRIDINE' WHEN size = 6 AND c = 4 AND n = 2 THEN 'PYRIMIDINE' WHEN size = 5 AND c = 4 AND n = 1 THEN 'PYRROLE' WHEN size = 5 AND c = 3 AND n = 2 THEN 'IMIDAZOLE' WHEN size = 5 AND c = 4 AND o = 1 THEN 'FURAN' ELSE 'GENERAL_CYCLE' END AS kind FROM K)
        SELECT traj_id, frame, size, array_to_string(p, ',') AS atoms, kind, kind <> 'GENERAL_CYCLE' AS aromatic, n + o > 0 AS heterocyclic FROM T""").replace("WITH ", "WITH RECURSIVE ", 1),
    "salt_bridges": sql("TF", f", {TS}, {_near('TS', 4)} SELECT traj_id, frame, atom_id, atom_id_b, round(d, 6) AS d FROM NP WHERE (resname {CAT} AND element = 'N' AND resname_b {ANI} AND element_b = 'O') OR (resname_b {CAT} AND element_b = 'N' AND resname {ANI} AND element = 'O')"),
    "disulfide_pairs": sql("TF", f", {_near('TF', 4)} SELECT traj_id, frame, atom_id, atom_id_b, round(d, 6) AS d FROM NP WHERE name = 'O' AND name_b = 'O' AND d >= 1"),
    "binding_site": sql("TF", f", {_near('TF', 6, LR)}, {BS} SELECT traj_id, frame, residue, round(min_d, 6) AS min_d, n_atoms, inter_chain, row_number() OVER (PARTITION BY traj_id, frame ORDER BY min_d, residue) AS rank FROM BS"),
    "proximity_rank": sql("TF", f", {_near('TF', 5, LR)}, {BS} SELECT traj_id, frame, residue, row_number() OVER (PARTITION BY traj_id, frame ORDER BY min_d, residue) AS rank FROM BS"),
    "metal_donors": sql("TF", f", {_near('TF', 6, 'a.atom_id = 20 AND b.atom_id <> 20', ' AND d > 0.5')} SELECT traj_id, frame, atom_id AS metal, atom_id_b AS atom_id, round(d, 6) AS d, CASE WHEN residue_b = 4 THEN 'SOLVENT_WATER' WHEN residue_b <> 2 AND residue_b <> 3 AND name_b IN ('O', 'N') THEN 'PROTEIN_BACKBONE' WHEN residue_b = 3 THEN 'LIGAND_HETEROATOM' ELSE 'PROTEIN_SIDECHAIN' END AS donor, row_number() OVER (PARTITION BY traj_id, frame, atom_id ORDER BY d, atom_id_b)::INTEGER AS place FROM NP WHERE element_b IN ('N','O','S','CL','F')"),
    "metal_coordination": sql("TF", f", {_near('TF', 6, 'a.atom_id = 20 AND b.atom_id <> 20', ' AND d > 0.5')} SELECT traj_id, frame, atom_id, count(*) AS n, round(avg(d), 6) AS mean_d, CASE WHEN count(*) = 4 THEN 'tetrahedral' WHEN count(*) IN (5, 6) THEN 'octahedral' ELSE 'other' END AS geometry FROM NP WHERE element_b IN ('N','O','S','CL','F') GROUP BY 1, 2, 3"),
    "ligand_instances": sql("TF", "SELECT traj_id, frame, residue, count(*) AS n_atoms, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z FROM TF WHERE chain = 'B' GROUP BY 1, 2, 3"),
    "ligand_pocket_lining": sql("TF", f", {_near('TF', 4.5, LR)} SELECT traj_id, frame, count(DISTINCT residue) AS n_residues, round(1.35 * count(DISTINCT residue) * 4.0::DOUBLE / 3 * 3.141592653589793 * 4.913, 6) AS volume FROM NP GROUP BY 1, 2"),
    "aromatic_rings": sql("TE", f", {_ring_sql()} SELECT traj_id, frame, chain, residue, resname, kind, n_atoms, x + 0.0 AS x, y + 0.0 AS y, z + 0.0 AS z FROM RN"),
    "steric_clashes": sql("TF", f", {_near('TF', 3.2)} SELECT traj_id, frame, atom_id, atom_id_b, round(o, 6) AS overlap FROM (SELECT *, ({VD('element')} + {VD('element_b')})::DOUBLE - d AS o FROM NP) WHERE o > 0.4 AND NOT (residue_b - residue = 1 AND name = 'C' AND name_b = 'N')"),
    "docking_clashes": sql("TF", f", {_near('TF', 3.2)} SELECT traj_id, frame, count(*) AS n FROM (SELECT *, ({VD('element')} + {VD('element_b')})::DOUBLE - d AS o FROM NP) WHERE o > 0.4 AND chain <> chain_b AND NOT (residue_b - residue = 1 AND name = 'C' AND name_b = 'N') GROUP BY 1, 2"),
    "plausibility": sql("TF", f"{_next('CA', 'CA')}, {_near('TF', 2.2)}, N AS (SELECT traj_id, frame, count(*) AS c FROM NP GROUP BY 1, 2), K AS (SELECT traj_id, frame, count(*) FILTER (NOT d BETWEEN 3.2 AND 4.3) AS n_implausible FROM B WHERE next IS NOT NULL GROUP BY 1, 2) SELECT traj_id, frame, coalesce(c, 0) AS n_close, n_implausible, CASE WHEN coalesce(c, 0) + n_implausible = 0 THEN 'PLAUSIBLE' WHEN coalesce(c, 0) + n_implausible <= 3 THEN 'SUSPECT' ELSE 'UNPHYSICAL' END AS status FROM K LEFT JOIN N USING (traj_id, frame)"),
    "bond_candidates": sql("TF", f", {BC} SELECT traj_id, frame, i, j, round(d, 6) AS d FROM BC"),
    "template_bonds": sql("TF", f", {TB} SELECT * FROM TB"),
    "bond_union": sql("TF", f", {TB}, {BC}, {BU} SELECT * FROM BU"),
    "valence_audit": sql("TF", f", {TB}, V AS (SELECT traj_id, frame, a AS atom_id, count(*) AS valence FROM (SELECT traj_id, frame, i AS a FROM TB UNION ALL SELECT traj_id, frame, j FROM TB) GROUP BY 1, 2, 3) SELECT traj_id, frame, atom_id, valence, element, valence <= CASE element WHEN 'C' THEN 1 WHEN 'N' THEN 3 ELSE 2 END AS ok FROM V JOIN ATOMS USING (atom_id)"),
    "molecular_graph_summary": sql("TF", f", {TB}, {BC}, {BU} SELECT traj_id, frame, source, count(*) AS n FROM BU GROUP BY 1, 2, 3"),
    "hbond_series": sql("TE", f", {_hb(3.5, 120)} SELECT traj_id, frame, round(d, 6) AS d, round(angle, 6) AS angle, bonded FROM HB"),
    "hbond_occupancy": sql("TE", f", {_hb(15, 60)} SELECT traj_id, round(avg(bonded::INTEGER), 6) AS occupancy, round(avg(d) FILTER (bonded), 6) AS mean_d, round(avg(angle) FILTER (bonded), 6) AS mean_angle, avg(bonded::INTEGER) >= 0.5 AS persistent FROM HB GROUP BY 1"),
    "rmsd_matrix": sql("TE", "SELECT a.traj_id, a.frame AS i, b.frame AS j, round(sqrt(avg((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2)), 4) AS rmsd FROM TE a JOIN TE b ON a.traj_id = b.traj_id AND a.atom_id = b.atom_id AND a.frame < b.frame GROUP BY 1, 2, 3"),
    "consensus_spans": sql("TE", f", W AS (SELECT a.traj_id, a.atom_id, max({D}) < 17.5 AS c FROM TE a JOIN TE b ON a.traj_id = b.traj_id AND a.atom_id = b.atom_id AND a.frame < b.frame GROUP BY 1, 2) SELECT traj_id, c AS close, min(atom_id) AS first, max(atom_id) AS last FROM (SELECT *, atom_id - row_number() OVER (PARTITION BY traj_id, c ORDER BY atom_id) AS run FROM W) GROUP BY traj_id, c, run"),
    "connected_components": sql("TE", f", {EDGES}, {CC} SELECT * FROM CCO").replace("WITH ", "WITH RECURSIVE ", 1),
    "contact_graph": sql("TE", f", {EDGES}, {CC}, T AS (SELECT a.traj_id, a.frame, count(*) AS t FROM E a JOIN E b ON a.traj_id = b.traj_id AND a.frame = b.frame AND a.j = b.i JOIN E c ON c.traj_id = a.traj_id AND c.frame = a.frame AND c.i = a.i AND c.j = b.j GROUP BY 1, 2), M AS (SELECT traj_id, frame, count(*) AS e FROM E GROUP BY 1, 2), K AS (SELECT traj_id, frame, count(*) AS v, count(DISTINCT component) AS b0 FROM CCO GROUP BY 1, 2) SELECT traj_id, frame, v, b0, coalesce(e, 0) AS e, coalesce(t, 0) AS triangles, round(2.0 * coalesce(e, 0) / (v * (v - 1)), 6) AS density, coalesce(e, 0) - v + b0 AS b1 FROM K LEFT JOIN M USING (traj_id, frame) LEFT JOIN T USING (traj_id, frame)").replace("WITH ", "WITH RECURSIVE ", 1),
    "lineage_children": sql("LG", "SELECT parent, count(*) AS n_children FROM LG GROUP BY 1"),
    "lineage_sources": sql("LG", "SELECT DISTINCT parent AS node FROM LG WHERE parent NOT IN (SELECT child FROM LG)"),
    "lineage_ancestors": _recursive(f"{ANCESTORS} SELECT node, ancestor, min(distance)::INTEGER AS distance FROM A GROUP BY 1, 2"),
    "lineage_cycle_check": _recursive(", E AS (SELECT * FROM LG UNION SELECT * FROM (SELECT child AS parent, parent AS child FROM LG ORDER BY LG.parent, LG.child LIMIT 1)), U AS (SELECT child AS node, parent AS ancestor FROM E UNION SELECT u.node, e.parent FROM U u JOIN E e ON e.child = u.ancestor) SELECT DISTINCT parent, child FROM E WHERE parent = child OR (parent, child) IN (SELECT (node, ancestor) FROM U)"),
    "lineage_join_report": _recursive(f"{ANCESTORS} SELECT DISTINCT node, ancestor, o_orderstatus, sha256(node || '|' || ancestor) AS digest FROM A LEFT JOIN orders ON node = 'O' || o_orderkey"),
}
