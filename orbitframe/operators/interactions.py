"""Interactions between atoms and residues, bonds and structure audits, all on grid joins or joins within residues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.functions import geometry as g
from orbitframe.operators.selection import AMINO_ACIDS, radius_join
from orbitframe.operators.structure import COVALENT, FRAME, VDW, lookup, widest

COLUMNS = ["atom_id", "residue", "resname", "name", "element", "chain", *"xyz"]
#: Charged residues.
CATIONS, ANIONS = ["ARG", "LYS", "HIS"], ["ASP", "GLU"]
#: Residue, kind of ring, names of its atoms, and how many of them must be there.
AROMATIC_RINGS = [
    ("PHE", "6_MEMBERED", "CG CD1 CD2 CE1 CE2 CZ".split(), 5),
    ("TYR", "6_MEMBERED", "CG CD1 CD2 CE1 CE2 CZ".split(), 5),
    ("TRP", "6_MEMBERED", "CD2 CE2 CZ2 CH2 CZ3 CE3".split(), 5),
    ("TRP", "5_MEMBERED", "CG CD1 NE1 CE2 CD2".split(), 4),
    ("HIS", "5_MEMBERED", "CG ND1 CE1 NE2 CD2".split(), 4),
]
METALS = "FE FE2 FE3 ZN MG CA MN CU CU1 CU2 NI CO CD PB HG PT SR BA MO V W".split()
COORDINATING = ["N", "O", "S", "CL", "F"]
CATION_ATOMS = "NZ NH1 NH2 NE ND1 NE2".split()
ANION_ATOMS = "OD1 OD2 OE1 OE2 OXT O1P O2P O3P O1A O2A O1D O2D".split()
BONDING = ["N", "O", "S"]
POLAR = ["N", "O", "F", "S"]


def near_pairs(atoms: DataFrame, radius: float) -> DataFrame:
    """Pairs of atoms of different residues within the radius, each once."""
    rows = atoms.select(*FRAME, *COLUMNS)
    return radius_join(rows, rows, radius, FRAME).filter((F.col("atom_id") < F.col("atom_id_b")) & (F.col("residue") != F.col("residue_b")))


def contact_kind(angle: Column | None = None) -> Column:
    """The first rule that fits a pair with columns of both atoms: metal, salt bridge, hydrogen bond, hydrophobic, else proximity.

    angle: degrees at the hydrogen between both atoms, null where no hydrogen is known. A known one makes the bond explicit from 120
    degrees on, and none below; without one the bond is putative."""
    e, f, d = F.col("element"), F.col("element_b"), F.col("d")

    def of(names: list[str], *columns: str) -> list[Column]:
        return [g.any_of([F.col(f"{c}{side}").isin(names) for c in columns]) for side in ("", "_b")]

    metal = of(METALS, "element", "resname")
    cation = [r & n for r, n in zip(of(CATIONS, "resname"), of(CATION_ATOMS, "name"), strict=True)]
    anion = of(ANION_ATOMS, "name")
    coordinated = F.when(metal[0], f.isin(COORDINATING)).otherwise(e.isin(COORDINATING))
    carbon = [(c == "C") & F.col(f"name{side}").startswith("C") & ~((F.col(f"name{side}") == "C") & F.col(f"resname{side}").isin([*AMINO_ACIDS])) for c, side in ((e, ""), (f, "_b"))]
    bond = F.when(angle.isNull(), "hbond_putative").when(angle >= 120, "hbond_explicit") if angle is not None else F.lit("hbond_putative")
    return F.coalesce(
        F.when((metal[0] | metal[1]) & (d <= 2.8), F.when(coordinated, "metal").otherwise("proximity")),
        F.when((d <= 4.0) & ((cation[0] & anion[1]) | (cation[1] & anion[0])), "salt_bridge"),
        F.when((d <= 3.5) & e.isin(BONDING) & f.isin(BONDING), bond),
        F.when((d <= 4.5) & carbon[0] & carbon[1], "hydrophobic"),
        F.lit("proximity"),
    )


def classify_contacts(atoms: DataFrame, radius: float = 4.5, hydrogens: DataFrame | None = None) -> DataFrame:
    """Near pairs with their kind. hydrogens: (frame keys, atom_id of the atom that bears it, hx, hy, hz), one per atom at most."""
    near = near_pairs(atoms, radius)
    if hydrogens is None:
        return near.withColumn("kind", contact_kind())
    coords = [atoms.select(*FRAME, F.col("atom_id").alias(f"atom_id{side}"), *[F.col(n).alias(f"{n}{mark}") for n in "xyz"]) for side, mark in (("", "_1"), ("_b", "_2"))]
    near = near.drop("x", "y", "z", "x_b", "y_b", "z_b").join(coords[0], [*FRAME, "atom_id"]).join(coords[1], [*FRAME, "atom_id_b"]).join(hydrogens, [*FRAME, "atom_id"], "left")
    angle = F.when(F.col("hx").isNotNull(), g.angle(g.vec(suffix="_1"), g.vec("h"), g.vec(suffix="_2")))
    return near.withColumn("kind", contact_kind(angle)).drop("hx", "hy", "hz")


def interaction_fingerprint(atoms: DataFrame, ligand: Column) -> DataFrame:
    """Per frame and receptor residue, which interactions with the ligand there are."""
    rows = atoms.select(*FRAME, *COLUMNS)
    near = radius_join(rows.filter(~ligand), rows.filter(ligand), 4.5, FRAME)
    e, f, d = F.col("element"), F.col("element_b"), F.col("d")
    bits = {"hbond": (d <= 3.5) & e.isin(POLAR) & f.isin(POLAR), "hydrophobic": (e == "C") & (f == "C"), "salt_bridge": (d <= 4.0) & F.col("resname").isin(CATIONS + ANIONS)}
    return near.groupBy(*FRAME, "residue").agg(*[F.bool_or(c).alias(k) for k, c in bits.items()], F.count(F.lit(1)).alias("n_pairs"))


def salt_bridges(atoms: DataFrame) -> DataFrame:
    rows = near_pairs(atoms, 4.0)
    one, two = F.col("resname").isin(CATIONS) & F.col("element").isin("N"), F.col("resname_b").isin(ANIONS) & F.col("element_b").isin("O")
    other = F.col("resname_b").isin(CATIONS) & F.col("element_b").isin("N") & F.col("resname").isin(ANIONS) & F.col("element").isin("O")
    return rows.filter((one & two) | other)


def disulfide_pairs(atoms: DataFrame, low: float = 1.9, high: float = 2.2) -> DataFrame:
    return near_pairs(atoms.filter((F.col("resname") == "CYS") & (F.col("name") == "SG")), high).filter(F.col("d") >= low)


def binding_site(atoms: DataFrame, ligand: Column, radius: float = 4.0) -> DataFrame:
    """Residues around a ligand: least distance, contacts and rank by distance."""
    rows = atoms.select(*FRAME, *COLUMNS)
    near = radius_join(rows.filter(~ligand), rows.filter(ligand), radius, FRAME)
    out = near.groupBy(*FRAME, "residue").agg(F.min("d").alias("min_d"), F.count_distinct("atom_id").alias("n_atoms"), F.bool_or(F.col("chain") != F.col("chain_b")).alias("inter_chain"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*FRAME).orderBy("min_d", "residue")).cast("long"))


def metal_coordination(atoms: DataFrame, metal: Column, low: float = 0.5, high: float = 2.8) -> DataFrame:
    rows = atoms.select(*FRAME, *COLUMNS)
    near = radius_join(rows.filter(metal), rows.filter(~metal & F.col("element").isin("N", "O", "S", "CL", "F")), high, FRAME).filter(F.col("d") > low)
    out = near.groupBy(*FRAME, "atom_id").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_d"))
    return out.withColumn("geometry", F.when(F.col("n") == 4, "tetrahedral").when(F.col("n").isin(5, 6), "octahedral").otherwise("other"))


def metal_donors(atoms: DataFrame, metal: Column, low: float = 0.5, high: float = 2.8) -> DataFrame:
    """traj_id, frame, metal (its atom_id), atom_id, d, donor, place (1 for the nearest): the atoms that coordinate a metal and what they belong
    to: water, the backbone, a hetero group, or else a side chain. atoms need is_hetero."""
    rows = atoms.select(*FRAME, *COLUMNS, "is_hetero")
    near = radius_join(rows.filter(metal).select(*FRAME, F.col("atom_id").alias("metal"), *"xyz"), rows.filter(~metal & F.upper(F.trim("element")).isin(*COORDINATING)), high, FRAME).filter(F.col("d") > low)
    donor = F.when(F.col("resname_b").isin("HOH", "WAT"), "SOLVENT_WATER").when(F.col("name_b").isin("O", "N"), "PROTEIN_BACKBONE").when(F.col("is_hetero_b"), "LIGAND_HETEROATOM").otherwise("PROTEIN_SIDECHAIN")
    place = F.row_number().over(Window.partitionBy(*FRAME, "metal").orderBy("d", "atom_id_b"))
    return near.select(*FRAME, "metal", F.col("atom_id_b").alias("atom_id"), "d", donor.alias("donor"), place.alias("place"))


def rings(atoms: DataFrame) -> DataFrame:
    """traj_id, frame, chain, residue, resname, kind, n_atoms, x, y, z, nx, ny, nz: centre, to three decimals, and unit normal of each aromatic
    ring, by the names of its atoms; tryptophan has two. The normal is that of the first three ring atoms by id; a ring whose first
    three lie on a line has none and is left out, as is one of which too many atoms are missing."""
    resname = F.upper(F.trim("resname"))
    of = F.array_compact(F.array(*[F.when((resname == r) & F.col("name").isin(names), F.struct(F.lit(kind).alias("kind"), F.lit(least).alias("least"))) for r, kind, names, least in AROMATIC_RINGS]))
    rows = atoms.select(*FRAME, "chain", "residue", resname.alias("resname"), "atom_id", *"xyz", F.explode(of).alias("of"))
    at = F.slice(F.array_sort(F.collect_list(F.struct("atom_id", *"xyz"))), 1, 3)
    rows = rows.groupBy(*FRAME, "chain", "residue", "resname", "of").agg(at.alias("a"), F.count(F.lit(1)).alias("n_atoms"), *[F.round(F.avg(n), 3).alias(n) for n in "xyz"]).filter(F.col("n_atoms") >= F.col("of.least"))
    p = [tuple(F.get("a", F.lit(i))[n] for n in "xyz") for i in range(3)]
    normal = [c.alias(f"n{n}") for c, n in zip(g.plane_normal(*p), "xyz", strict=True)]
    return rows.select(*FRAME, "chain", "residue", "resname", F.col("of.kind").alias("kind"), "n_atoms", *"xyz", *normal).filter("nx * nx + ny * ny + nz * nz > 0.5")


def pi_stacking(found: DataFrame, reach: float = 5.5, parallel: float = 4.5) -> DataFrame:
    """Pairs of rings of different residues: parallel within the shorter distance and 30 degrees, T-shaped within the longer one and 60 to
    90 degrees; residues of another chain are marked."""
    one = F.struct("chain", "residue", "kind")
    found = found.withColumn("ring", one)
    near = radius_join(found, found, reach, FRAME).filter((F.col("ring") < F.col("ring_b")) & ((F.col("chain") != F.col("chain_b")) | (F.col("residue") != F.col("residue_b"))))
    near = near.withColumn("angle", g.normal_angle(g.vec("n"), g.vec("n", "_b")))
    stacking = F.when((F.col("d") <= parallel) & (F.col("angle") <= 30), "parallel").when(F.col("angle").between(60, 90), "t_shape")
    ends = ["chain", "residue", "kind"]
    return near.withColumn("stacking", stacking).filter("stacking IS NOT NULL").select(*FRAME, *ends, *[f"{n}_b" for n in ends], (F.col("chain") != F.col("chain_b")).alias("between_chains"), "d", "angle", "stacking")


def steric_clashes(atoms: DataFrame, overlap: float = 0.4) -> DataFrame:
    """Pairs of atoms of different residues that overlap; the peptide bond is no clash."""
    near = near_pairs(atoms, 2 * widest(atoms, VDW, 1.7) - overlap)
    depth = lookup(F.col("element"), VDW, 1.7) + lookup(F.col("element_b"), VDW, 1.7) - F.col("d")
    bond = (F.col("residue_b") - F.col("residue") == 1) & (F.col("name") == "C") & (F.col("name_b") == "N")
    return near.withColumn("overlap", depth).filter((F.col("overlap") > overlap) & ~bond)


def plausibility(atoms: DataFrame, backbone: DataFrame) -> DataFrame:
    """Per frame from implausible CA steps (backbone: n_implausible) and pairs under 2.2 angstrom."""
    close = near_pairs(atoms, 2.2).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n_close"))
    rows = backbone.join(close, FRAME, "left").fillna(0, ["n_close"])
    bad = F.col("n_close") + F.col("n_implausible")
    return rows.select(*FRAME, "n_close", "n_implausible", F.when(bad == 0, "PLAUSIBLE").when(bad <= 3, "SUSPECT").otherwise("UNPHYSICAL").alias("status"))


def bond_candidates(atoms: DataFrame, slack: float = 0.4, least: float = 0.4) -> DataFrame:
    """Pairs inside a residue at bonding distance."""
    a = atoms.select(*FRAME, "residue", F.col("atom_id").alias("i"), F.col("element").alias("e"), *"xyz")
    b = atoms.select(*FRAME, "residue", F.col("atom_id").alias("j"), F.col("element").alias("e_b"), *[F.col(n).alias(f"{n}_b") for n in "xyz"])
    reach = lookup(F.col("e"), COVALENT, 0.77) + lookup(F.col("e_b"), COVALENT, 0.77) + slack
    rows = a.join(b, [*FRAME, "residue"]).filter("i < j").withColumn("d", g.dist(g.vec(), g.vec(suffix="_b")))
    return rows.filter(F.col("d").between(F.lit(least), reach)).select(*FRAME, "i", "j", "d")


def template_bonds(atoms: DataFrame, template: DataFrame) -> DataFrame:
    """Bonds inside residues from a template (resname, name_a, name_b)."""
    keys = [*FRAME, "residue"]
    a = atoms.select(*keys, "resname", F.col("name").alias("name_a"), F.col("atom_id").alias("i"))
    b = atoms.select(*keys, F.col("name").alias("name_b"), F.col("atom_id").alias("j"))
    return a.join(template, ["resname", "name_a"]).join(b, [*keys, "name_b"]).select(*FRAME, "i", "j")


def bond_union(sources: list[DataFrame]) -> DataFrame:
    """One row per bond; of several sources the first wins."""
    rows = None
    for rank, df in enumerate(sources):
        part = df.select(*FRAME, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.lit(rank).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*FRAME, "i", "j").agg(F.min("source").alias("source"))


def valence_audit(bonds: DataFrame, elements: DataFrame, most: dict[str, int]) -> DataFrame:
    """Bonds per atom against the most that its element has."""
    ends = bonds.select(*FRAME, F.explode(F.array("i", "j")).alias("atom_id")).groupBy(*FRAME, "atom_id").agg(F.count(F.lit(1)).alias("valence"))
    return ends.join(elements, "atom_id").withColumn("ok", F.col("valence") <= lookup(F.col("element"), most, 8))


def hbond_series(atoms: DataFrame, donor: int, hydrogen: int, acceptor: int, cutoff: float = 3.5, least: float = 120.0) -> DataFrame:
    """A donor-hydrogen-acceptor triple per frame, under the minimum image about the hydrogen."""
    cell = F.first(F.struct("lx", "ly", "lz"))
    rows = atoms.filter(F.col("atom_id").isin(donor, hydrogen, acceptor)).groupBy(*FRAME).pivot("atom_id", [donor, hydrogen, acceptor]).agg(F.first(F.struct(*"xyz")))
    boxes = atoms.groupBy(*FRAME).agg(cell.alias("box"))
    rows = rows.join(boxes, FRAME)
    p = [tuple(F.col(f"`{i}`.{n}") for n in "xyz") for i in (donor, hydrogen, acceptor)]
    box = tuple(F.col(f"box.l{n}") for n in "xyz")
    to_d, to_a = g.mic_ortho(g.sub(p[0], p[1]), box), g.mic_ortho(g.sub(p[2], p[1]), box)
    zero = g.const(0, 0, 0)
    rows = rows.select(*FRAME, g.dist(to_d, to_a).alias("d"), g.angle(to_d, zero, to_a).alias("angle"))
    return rows.withColumn("bonded", (F.col("d") < cutoff) & (F.col("angle") >= least))


def hbond_occupancy(series: DataFrame) -> DataFrame:
    b = F.col("bonded")
    return series.groupBy("traj_id").agg(F.avg(b.cast("double")).alias("occupancy"), F.avg(F.when(b, F.col("d"))).alias("mean_d"), F.avg(F.when(b, F.col("angle"))).alias("mean_angle"), (F.avg(b.cast("double")) >= 0.5).alias("persistent"))
