"""Atom selections as Column predicates, frame slices, residue classes, coordinate checks and catalogue searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.functions import geometry as g
from orbitframe.operators.order import numbered

# Residue and atom names.
AMINO_ACIDS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
MODIFIED_AMINO_ACIDS = "MSE SEC PYL UNK ASX GLX XLE PCA HYP MLY FME SEP TPO PTR CSO CME OCS KCX LLP TYS".split()
DNA = "DA DC DG DT DI DAMP DCMP DGMP DTMP THY".split()
RNA = "RA RC RG RU U URA PSU H2U 4SU DHU OMU".split()
NUCLEOTIDES = [*DNA, *RNA, *"A C G I ADE CYT GUA".split(), *"5MC OMC 5MU PSU H2U 1MA 2MG 7MG M2G OMG A2M YYG 4SU DHU CH 1MG 2MA 6MA 6MI RIA MIA UR3 4PC QUO MNU".split()]
SOLVENT = "HOH WAT H2O DOD TIP TIP3 SOL H3O OH".split()
IONS = "ZN MG CA NA CL FE FE2 MN K CU CU1 NI CO CD PB HG PT SR BA BR IOD LI CS".split()
BUFFERS = "PO4 SO4 CIT ACT EDO PEG DMS GOL FMT TRS MES HEPES BME DTT MPD PGE PG4 EPE".split()
GLYCANS = "NAG MAN BMA FUC GAL GLC SIA NDG FUL A2G".split()
COFACTORS = "HEM HEA HEB HEC NAD NAP NADP FAD FMN ATP ADP AMP ANP GTP GDP SAM SAH COA ACO PLP TPP THF BTN F420 PQQ MGD".split()
BACKBONE = ["N", "CA", "C", "O"]
ACID_CLASS = {"hydrophobic": list("AVLIMFWPG"), "polar": list("STNQYC"), "positive": list("KRH"), "negative": list("DE")}


def sel_chain(chains: str) -> Column:
    return F.col("chain").isin([c.strip() for c in chains.split(",")])


def sel_resname(names: str) -> Column:
    return F.upper("resname").isin([c.strip().upper() for c in names.split(",")])


def sel_name(names: str) -> Column:
    return F.upper("name").isin([c.strip().upper() for c in names.split(",")])


def sel_resid(span: str) -> Column:
    """A residue number or an inclusive range a-b."""
    low, _, high = span.partition("-")
    return F.col("residue").between(int(low), int(high or low))


def sel_class(kind: str) -> Column:
    protein, nucleic = F.col("resname").isin([*AMINO_ACIDS]), F.col("resname").isin(NUCLEOTIDES)
    return {"protein": protein, "nucleic": nucleic, "backbone": protein & F.col("name").isin(BACKBONE), "ligand": ~protein & ~nucleic & ~F.col("resname").isin(SOLVENT)}[kind]


def sel_colon_key(key: str) -> Column:
    """CHAIN:RESNAME:RESSEQ:ATOM, or RESNAME:RESID:NAME of any chain."""
    parts = key.split(":")
    names = ("chain", "resname", "residue", "name") if len(parts) == 4 else ("resname", "residue", "name")
    if len(parts) != len(names):
        raise ValueError(f"{key} has neither three nor four parts")
    return reduce(lambda a, b: a & b, (F.col(n).cast("string") == p for n, p in zip(names, parts, strict=True)))


def sel_boolean(terms: list[list[Column]]) -> Column:
    """AND of ORs."""
    return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, t) for t in terms))


def cell_keys(r: g.Vec, size: float) -> list[Column]:
    return [F.floor(p / size).cast("long") for p in r]


def radius_join(left: DataFrame, right: DataFrame, radius: float, keys: list[str], prefixes: tuple[str, str] = ("", "")) -> DataFrame:
    """Pairs of rows with equal keys within the radius: each left row goes to its cell of a grid of that width, each right row
    to the 27 around its own, so that the range join is an equi-join. d is the distance; right columns carry the suffix _b. Spark takes
    the copies for as large as the rows they come from, so the join is told to merge: no side is broadcast."""
    offsets = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(s, "ijk", strict=True)]) for s in g.SHIFTS])
    a = left.withColumns({f"c{n}": c for n, c in zip("xyz", cell_keys(g.vec(), radius), strict=True)})
    b = right.withColumns({f"c{n}": c for n, c in zip("xyz", cell_keys(g.vec(), radius), strict=True)}).withColumn("o", F.explode(offsets))
    b = b.select(*[F.col(k).alias(k) for k in keys], *[(F.col(f"c{n}") + F.col(f"o.{m}")).alias(f"c{n}") for n, m in zip("xyz", "ijk", strict=True)], *[F.col(c).alias(f"{c}_b") for c in right.columns if c not in keys])
    joined = a.join(b.hint("merge"), [*keys, "cx", "cy", "cz"]).drop("cx", "cy", "cz")
    return joined.withColumn("d", g.dist(g.vec(), g.vec(suffix="_b"))).filter(F.col("d") <= radius)


def sel_within(rows: DataFrame, near: Column, radius: float, keys: list[str]) -> DataFrame:
    """Rows within the radius of any row of the sub-selection, that selection included."""
    hits = radius_join(rows, rows.filter(near).select(*keys, *"xyz"), radius, keys).select(*keys, "atom_id").distinct()
    return rows.join(hits, [*keys, "atom_id"], "left_semi")


def nonempty_guard(atoms: DataFrame, selection: Column, most: int = 5000) -> DataFrame:
    """The number of selected atoms and whether a query may use the selection."""
    return atoms.agg(F.count_if(selection).alias("n_atoms")).withColumn("status", F.when(F.col("n_atoms") == 0, "INVALID_SELECTION").when(F.col("n_atoms") > most, "TOO_MANY_ATOMS").otherwise("OK"))


def slice_frames(rows: DataFrame, start: int = 0, stop: int | None = None, stride: int = 1) -> DataFrame:
    keep = (F.col("frame") >= start) & ((F.col("frame") - start) % max(1, stride) == 0)
    return rows.filter(keep if stop is None else keep & (F.col("frame") < stop))


def altloc_canonical(atoms: DataFrame, keys: list[str], altloc: str = "altloc", order: str = "atom_id") -> DataFrame:
    """One atom per key: a blank location first, then A, then by letter."""
    rank = F.when(F.col(altloc) == "", 0).when(F.col(altloc) == "A", 1).otherwise(2)
    return atoms.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, altloc, order))).filter("r = 1").drop("r")


def classify_residue(resname: Column, polymer: Column | None = None) -> Column:
    """The first list that has the residue. I is a nucleotide in a polymer and else an ion; what no list has is a ligand, or in a
    polymer a nucleotide by its name or custom."""
    name, polymer = F.trim(F.upper(F.coalesce(resname, F.lit("")))), F.lit(False) if polymer is None else polymer
    rules = [(SOLVENT, "solvent"), (BUFFERS, "buffer"), (GLYCANS, "ligand"), (["I"], None), (IONS, "ion"), (COFACTORS, "cofactor"), (NUCLEOTIDES, "nucleic"), ([*AMINO_ACIDS, *MODIFIED_AMINO_ACIDS], "protein")]
    found = [F.when(name.isin(names), F.lit(kind) if kind else F.when(polymer, "nucleic").otherwise("ion")) for names, kind in rules]
    return F.coalesce(*found, F.when(polymer, F.when(name.rlike("^D.?$"), "nucleic").otherwise("custom")), F.lit("ligand"))


def one_letter(resname: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for kv in AMINO_ACIDS.items() for x in kv])
    return F.coalesce(F.try_element_at(codes, F.upper(resname)), F.lit("X"))


def amino_class(code: Column) -> Column:
    return F.coalesce(*[F.when(code.isin(v), k) for k, v in ACID_CLASS.items()], F.lit("unknown"))


def classify_nucleotide(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """Ribose if an O2' is there, deoxyribose if only the ring is, otherwise unclear; per residue."""
    ring = F.count_if(F.col("name").isin("C1'", "C2'", "C3'", "C4'")) == 4
    return atoms.groupBy(*keys).agg(F.when(F.bool_or(F.col("name") == "O2'"), "ribose").when(ring, "deoxyribose").otherwise("indeterminate").alias("sugar"))


def validate_coords(coords: DataFrame, n_atoms: int) -> DataFrame:
    """Per frame: rows, rows without finite coordinates, whether the number of atoms fits, whether the cell is positive."""
    bad = g.any_of([F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf")) for n in "xyz"])
    box = g.any_of([F.min(f"l{n}") > 0 for n in "xyz"], lambda a, b: a & b)
    return coords.groupBy("traj_id", "frame").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_bad"), box.alias("box_ok")).withColumn("atoms_ok", F.col("n") == n_atoms)


def traj_metadata(coords: DataFrame) -> DataFrame:
    """Frames, step, length in ns, and whether the cell varies."""
    frames = coords.groupBy("traj_id", "frame").agg(F.first("t_ps").alias("t"), *[F.min(f"l{n}").alias(f"l{n}") for n in "xyz"])
    varies = g.any_of([F.max(f"l{n}") - F.min(f"l{n}") > 1e-4 for n in "xyz"])
    n = F.count(F.lit(1))
    return frames.groupBy("traj_id").agg(n.alias("n_frames"), ((F.max("t") - F.min("t")) / F.greatest(n - 1, F.lit(1))).alias("dt_ps"), *[F.avg(f"l{n}").alias(f"l{n}") for n in "xyz"], varies.alias("variable_cell")).withColumn("span_ns", F.col("n_frames") * F.col("dt_ps") / 1000)


def catalog_search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text, in any case, in one of the columns."""
    return rows.filter(g.any_of([F.contains(F.lower(c), F.lit(text.lower())) for c in columns]))


def catalog_rank(rows: DataFrame, source: Column, weights: dict[str, int], then: list[Column]) -> DataFrame:
    """A rank from 1 by source weight, then further columns; ranges of the order are counted by themselves."""
    weight = F.coalesce(*[F.when(source == k, w) for k, w in weights.items()], F.lit(99))
    found = numbered(rows.withColumns({"weight": weight, "one_": F.lit(0)}), "one_", [F.col("weight"), *then], "rank")
    return found.withColumn("rank", F.col("rank") + 1).drop("one_")
