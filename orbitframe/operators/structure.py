"""Per-frame and per-atom analytics: deviations, contacts, similarity scores, summaries, differences between series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.functions import geometry as g

FRAME = ["traj_id", "frame"]
#: Standard atomic masses, and a carbon for what is not listed.
MASSES = {"H": 1.008, "C": 12.011, "N": 14.007, "O": 15.999, "S": 32.06, "P": 30.974}
#: Van der Waals and covalent radii in angstrom.
VDW = {
    "H": 1.2, "D": 1.2, "HE": 1.4, "C": 1.7, "N": 1.55, "O": 1.52, "F": 1.47, "NE": 1.54, "P": 1.8, "S": 1.8, "CL": 1.75, "AR": 1.88,
    "AS": 1.85, "SE": 1.9, "BR": 1.85, "KR": 2.02, "TE": 2.06, "I": 1.98, "XE": 2.16, "LI": 1.82, "BE": 1.53, "B": 1.92, "NA": 2.27, "MG": 1.73,
    "AL": 1.84, "SI": 2.1, "K": 2.75, "CA": 2.31, "RB": 3.03, "SR": 2.49, "CS": 3.43, "BA": 2.68, "SC": 2.11, "TI": 2.15, "V": 2.05, "CR": 2.05,
    "MN": 2.05, "FE": 1.8, "CO": 1.8, "NI": 1.63, "CU": 1.4, "ZN": 1.39, "GA": 1.87, "GE": 2.11, "Y": 2.32, "ZR": 2.23, "NB": 2.18, "MO": 2.17,
    "TC": 2.16, "RU": 2.13, "RH": 2.1, "PD": 1.63, "AG": 1.72, "CD": 1.58, "IN": 1.93, "SN": 2.17, "SB": 2.06, "PT": 1.75, "AU": 1.66, "HG": 1.55,
    "TL": 1.96, "PB": 2.02, "BI": 2.07, "U": 1.86,
}
COVALENT = {
    "H": 0.31, "HE": 0.28, "LI": 1.28, "BE": 0.96, "B": 0.84, "C": 0.76, "N": 0.71, "O": 0.66, "F": 0.57, "NE": 0.58, "NA": 1.66, "MG": 1.41,
    "AL": 1.21, "SI": 1.11, "P": 1.07, "S": 1.05, "CL": 1.02, "AR": 1.06, "K": 2.03, "CA": 1.76, "SC": 1.7, "TI": 1.6, "V": 1.53, "CR": 1.39,
    "MN": 1.39, "FE": 1.32, "CO": 1.26, "NI": 1.24, "CU": 1.32, "ZN": 1.22, "GA": 1.22, "GE": 1.2, "AS": 1.19, "SE": 1.2, "BR": 1.2, "KR": 1.16,
    "RB": 2.2, "SR": 1.95, "Y": 1.9, "ZR": 1.75, "NB": 1.64, "MO": 1.54, "TC": 1.47, "RU": 1.46, "RH": 1.42, "PD": 1.39, "AG": 1.45, "CD": 1.44,
    "IN": 1.42, "SN": 1.39, "SB": 1.39, "TE": 1.38, "I": 1.39, "XE": 1.4, "CS": 2.44, "BA": 2.15, "LA": 2.07, "CE": 2.04, "PR": 2.03, "ND": 2.01,
    "PM": 1.99, "SM": 1.98, "EU": 1.98, "GD": 1.96, "TB": 1.94, "DY": 1.92, "HO": 1.92, "ER": 1.89, "TM": 1.9, "YB": 1.87, "LU": 1.87, "HF": 1.75,
    "TA": 1.7, "W": 1.62, "RE": 1.51, "OS": 1.44, "IR": 1.41, "PT": 1.36, "AU": 1.36, "HG": 1.32, "TL": 1.45, "PB": 1.46, "BI": 1.48, "PO": 1.4,
    "AT": 1.5, "RN": 1.5, "U": 1.96,
}


def lookup(key: Column, values: dict, default: float) -> Column:
    """The value of a key in a constant map: generated code stays short for tables of any length."""
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, key), F.lit(float(default)))


def widest(atoms: DataFrame, values: dict, default: float) -> float:
    """The greatest value among the elements that occur, so that no search reaches further than it must."""
    return atoms.agg(F.max(lookup(F.col("element"), values, default))).first()[0] or default


def mass(element: str = "element") -> Column:
    return lookup(F.col(element), MASSES, 12.011)


def squared(a: g.Vec, b: g.Vec) -> Column:
    d = g.sub(a, b)
    return g.dot(d, d)


def against(coords: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """coords with the reference's coordinates as x_r, y_r, z_r; the reference has one row per key."""
    return coords.join(reference.select(*keys, *[F.col(n).alias(f"{n}_r") for n in "xyz"]), keys)


def rmsd_series(coords: DataFrame, frame: int = 0) -> DataFrame:
    """Deviation of every frame from one frame, without fit."""
    rows = against(coords, coords.filter(F.col("frame") == frame), ["traj_id", "atom_id"])
    return rows.groupBy(*FRAME).agg(F.sqrt(F.avg(squared(g.vec(), g.vec(suffix="_r")))).alias("rmsd"))


def average_structure(coords: DataFrame) -> DataFrame:
    return coords.groupBy("traj_id", "atom_id").agg(*[F.avg(n).alias(n) for n in "xyz"])


def rmsf_atom(coords: DataFrame) -> DataFrame:
    return coords.groupBy("traj_id", "atom_id").agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rmsf"))


def weighted_centre(weight: Column) -> list[Column]:
    return [F.sum(weight * F.col(n)) / F.sum(weight) for n in "xyz"]


def rg_series(coords: DataFrame) -> DataFrame:
    """Radius of gyration by geometry and by mass, from weighted moments in one pass."""

    def radius(w: Column) -> Column:
        c = weighted_centre(w)
        return F.sqrt(F.greatest(F.lit(0.0), F.sum(w * g.dot(g.vec(), g.vec())) / F.sum(w) - g.dot(tuple(c), tuple(c))))

    return coords.groupBy(*FRAME).agg(radius(F.lit(1.0)).alias("rg"), radius(mass()).alias("rg_mass"))


def centroids(coords: DataFrame, keys: list[str]) -> DataFrame:
    plain, heavy = weighted_centre(F.lit(1.0)), weighted_centre(mass())
    return coords.groupBy(*keys).agg(*[c.alias(f"c{n}") for c, n in zip(plain, "xyz", strict=True)], *[c.alias(f"m{n}") for c, n in zip(heavy, "xyz", strict=True)])


def atom_pairs(coords: DataFrame, box: bool = False) -> DataFrame:
    """All pairs i < j of a frame with their distance d, for statistics over all pairs; contacts come from pair lists."""
    a = coords.select(*FRAME, F.col("atom_id").alias("i"), *"xyz", *(["lx", "ly", "lz"] if box else []))
    b = coords.select(*FRAME, F.col("atom_id").alias("j"), *[F.col(n).alias(f"{n}_b") for n in "xyz"])
    d = g.mic_dist(g.vec(), g.vec(suffix="_b"), g.vec("l")) if box else g.dist(g.vec(), g.vec(suffix="_b"))
    return a.join(b, FRAME).filter("i < j").select(*FRAME, "i", "j", d.alias("d"))


def contact_map(pairs: DataFrame, cutoff: float) -> DataFrame:
    """Per pair the mean distance and the share of frames in contact."""
    return pairs.groupBy("traj_id", "i", "j").agg(F.avg("d").alias("mean_d"), F.avg((F.col("d") <= cutoff).cast("double")).alias("frequency"))


def contact_occupancy(pairs: DataFrame, cutoff: float) -> DataFrame:
    near = (F.col("d") <= cutoff).cast("double")
    out = pairs.groupBy("traj_id", "i", "j").agg(F.avg(near).alias("occupancy"), F.min("d").alias("min_d"), F.max("d").alias("max_d"), F.avg("d").alias("mean_d"))
    return out.withColumn("kind", F.when(F.col("occupancy") >= 0.7, "persistent").when(F.col("occupancy") < 0.3, "transient").otherwise("intermediate"))


def coordinate_evolution(coords: DataFrame, first: int, second: int) -> DataFrame:
    """Displacements between two frames."""
    rows = against(coords.filter(F.col("frame") == second), coords.filter(F.col("frame") == first), ["traj_id", "atom_id"]).withColumn("d", g.dist(g.vec(), g.vec(suffix="_r")))
    return rows.groupBy("traj_id").agg(F.max("d").alias("max_d"), F.avg("d").alias("mean_d"), F.sqrt(F.avg(F.col("d") ** 2)).alias("rms_d"), F.count_if(F.col("d") > 1e-4).alias("n_moved"), (F.max("d") <= 1e-4).alias("static"))


def tm_score(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """From matched atoms with distance d: the template modelling score with its length-dependent scale."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    scale = F.when(n <= 21, 0.5).otherwise(F.greatest(F.lit(0.5), 1.24 * F.cbrt(n - 15) - 1.8))
    rows = pairs.withColumn("t", 1 / (1 + (F.col("d") / scale) ** 2))
    return rows.groupBy(*keys).agg(F.avg("t").alias("tm")).withColumn("same_fold", F.col("tm") > 0.5)


def gdt_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    share = {c: 100.0 * F.avg((F.col("d") <= c).cast("double")) for c in (0.5, 1.0, 2.0, 4.0, 8.0)}
    mean = lambda cuts: reduce(lambda a, b: a + b, (share[c] for c in cuts)) / len(cuts)
    return pairs.groupBy(*keys).agg(mean([1.0, 2.0, 4.0, 8.0]).alias("gdt_ts"), mean([0.5, 1.0, 2.0, 4.0]).alias("gdt_ha"))


def trimmed_rmsd(pairs: DataFrame, keys: list[str], percent: int = 95) -> DataFrame:
    """Over the closest floor(n * percent / 100) pairs."""
    rows = pairs.withColumns({"r": F.row_number().over(Window.partitionBy(*keys).orderBy("d", "atom_id")), "n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    return rows.filter(F.col("r") <= F.floor(F.col("n") * percent / 100)).groupBy(*keys).agg(F.sqrt(F.avg(F.col("d") ** 2)).alias("rmsd_trimmed"), F.count(F.lit(1)).alias("n_kept"))


def distance_rmsd(pairs: DataFrame, first: int = 0) -> DataFrame:
    """Root mean square difference of each frame's distance matrix from one frame's."""
    ref = pairs.filter(F.col("frame") == first).select("traj_id", "i", "j", F.col("d").alias("d_r"))
    return pairs.join(ref, ["traj_id", "i", "j"]).groupBy(*FRAME).agg(F.sqrt(F.avg((F.col("d") - F.col("d_r")) ** 2)).alias("drmsd"))


def contact_sets(pairs: DataFrame, cutoff: float, first: int, second: int) -> DataFrame:
    """Contacts of both frames, of the first only and of the second only."""
    sets = [pairs.filter((F.col("frame") == f) & (F.col("d") <= cutoff)).select("traj_id", "i", "j") for f in (first, second)]
    parts = {"shared": sets[0].intersect(sets[1]), "first_only": sets[0].exceptAll(sets[1]), "second_only": sets[1].exceptAll(sets[0])}
    return reduce(DataFrame.unionByName, (df.withColumn("part", F.lit(k)) for k, df in parts.items()))


def end_to_end(coords: DataFrame) -> DataFrame:
    """Distance from the first to the last CA of each chain."""
    at = F.struct(*"xyz")
    ends = coords.filter(F.col("name") == "CA").groupBy(*FRAME, "chain").agg(F.min_by(at, "residue").alias("a"), F.max_by(at, "residue").alias("b"))
    return ends.select(*FRAME, "chain", g.dist(g.vec("a."), g.vec("b.")).alias("d"))


def bfactor_stats(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """Over values of 0 or more; negative ones are counted."""
    b = F.when(F.col("b_factor") >= 0, F.col("b_factor"))
    main = F.col("name").isin("N", "CA", "C", "O")
    return atoms.groupBy(*keys).agg(F.avg(b).alias("mean"), F.percentile(b, F.lit(0.5)).alias("median"), F.min(b).alias("min"), F.max(b).alias("max"), F.avg(F.when(main, b)).alias("mean_backbone"), F.avg(F.when(~main, b)).alias("mean_side"), F.count_if(F.col("b_factor") < 0).alias("n_negative"))


def occupancy_stats(atoms: DataFrame, keys: list[str]) -> DataFrame:
    o = g.clamp(F.col("occupancy"), 0.0, 1.0)
    return atoms.groupBy(*keys).agg(F.avg(o).alias("mean"), F.count_if(o >= 0.999).alias("n_full"), F.count_if((o > 0.001) & (o < 0.999)).alias("n_partial"), F.count_if(o <= 0.001).alias("n_zero"))


def confidence_band(c: Column) -> Column:
    return F.when(c > 90, "very_high").when(c >= 70, "confident").when(c >= 50, "low").otherwise("very_low")


def confidence_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Statistics and band shares of a confidence on 0..100; a scale of 0..1 is recognised by its maximum."""
    top = F.max(value).over(Window.partitionBy(*keys))
    c = F.when(top <= 1, F.col(value) * 100).otherwise(F.col(value))
    rows = rows.withColumn("c", c).withColumn("band", confidence_band(F.col("c")))
    return rows.groupBy(*keys).agg(F.avg("c").alias("mean"), F.percentile("c", F.lit(0.5)).alias("median"), F.min("c").alias("min"), F.max("c").alias("max"), *[F.count_if(F.col("band") == b).alias(f"n_{b}") for b in ("very_high", "confident", "low", "very_low")], F.avg((F.col("c") < 50).cast("double")).alias("disordered"))


def pae_summary(matrix: DataFrame, keys: list[str], tolerance: float = 0.05) -> DataFrame:
    """Checks and statistics of a matrix (i, j, e): square, finite, not negative, symmetric within the tolerance."""
    other = matrix.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), F.col("e").alias("e_t"))
    rows = matrix.join(other, [*keys, "i", "j"], "left")
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(n.alias("n"), (n == F.count_distinct("i") * F.count_distinct("j")).alias("square"), F.avg("e").alias("mean"), F.min("e").alias("min"), F.max("e").alias("max"), F.count_if(F.col("e") < 0).alias("n_negative"), F.count_if(F.abs(F.col("e") - F.col("e_t")) > tolerance).alias("n_asymmetric"))


def pae_interchain(matrix: DataFrame, keys: list[str], first: tuple[int, int], second: tuple[int, int]) -> DataFrame:
    rows = matrix.filter(F.col("i").between(*first) & F.col("j").between(*second))
    return rows.groupBy(*keys).agg(F.avg("e").alias("mean"), F.min("e").alias("min"), F.max("e").alias("max")).withColumn("well_positioned", F.col("mean") < 10)


def series_align(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two (traj_id, frame, value) series side by side; frames of one side only keep a null."""
    return a.withColumnRenamed("value", "value_a").join(b.withColumnRenamed("value", "value_b"), FRAME, "full_outer")


def discrepancy_report(aligned: DataFrame, tolerance: float, relative: bool = False, expected: float = 5.0) -> DataFrame:
    """Differences per trajectory and their class: within the tolerance, within `expected` times it, or genuine."""
    rows = aligned.withColumn("delta", F.abs(F.col("value_a") - F.col("value_b")))
    limit = F.avg(F.abs("value_b")).over(Window.partitionBy("traj_id")) * tolerance if relative else F.lit(tolerance)
    rows = rows.withColumn("limit", limit)
    out = rows.groupBy("traj_id").agg(F.max("delta").alias("max_delta"), F.avg("delta").alias("mean_delta"), F.count_if(F.col("delta") > F.col("limit")).alias("n_mismatch"), F.count_if(F.col("value_a").isNull() | F.col("value_b").isNull()).alias("n_unmatched"), F.max("limit").alias("limit"))
    kind = F.when(F.col("max_delta") <= F.col("limit"), "WITHIN_TOLERANCE").when(F.col("max_delta") <= expected * F.col("limit"), "EXPECTED_METHODOLOGICAL_DIFFERENCE").otherwise("GENUINE_DISCREPANCY")
    return out.withColumn("kind", kind).drop("limit")


def series_contract(rows: DataFrame, n_frames: int) -> DataFrame:
    """Violations of a series per trajectory, none for a good one."""
    bad = rows.groupBy("traj_id").agg(F.count_if(F.col("value").isNull() | F.isnan("value")).alias("n_bad"), F.count(F.lit(1)).alias("n"))
    kinds = F.array(F.when(F.col("n_bad") > 0, "not finite"), F.when(F.col("n") != n_frames, "wrong length"))
    return bad.select("traj_id", F.explode(F.array_compact(kinds)).alias("violation"))


def coulomb_potential(coords: DataFrame, charge: Column, probes: list[tuple[float, float, float]], epsilon: float = 78.5) -> DataFrame:
    """Potential at each of a few probes."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("probe"), *[F.lit(float(c)).alias(f"{n}_p") for c, n in zip(p, "xyz", strict=True)]) for i, p in enumerate(probes)]))
    rows = coords.withColumn("q", charge).withColumn("p", at)
    r = g.dist(g.vec(), g.vec("p.", "_p"))
    return rows.groupBy(*FRAME, "p.probe").agg(F.sum(14.3996 / epsilon * F.col("q") / F.greatest(F.lit(0.5), r)).alias("potential"))


def dipole_moment(coords: DataFrame, charge: Column) -> DataFrame:
    """Charge-weighted displacement from the centroid, in debye."""
    rows = coords.withColumn("q", charge)
    parts = [4.8032 * (F.sum(F.col("q") * F.col(n)) - F.sum("q") * F.avg(n)) for n in "xyz"]
    return rows.groupBy(*FRAME).agg(*[p.alias(f"m{n}") for p, n in zip(parts, "xyz", strict=True)]).withColumn("dipole", g.norm(g.vec("m")))


def geometry_summary(coords: DataFrame, pairs: DataFrame, cutoff: float) -> DataFrame:
    extents = [(F.max(n) - F.min(n)).alias(f"extent_{n}") for n in "xyz"]
    rows = coords.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n_atoms"), F.count_distinct("residue").alias("n_residues"), *extents)
    return rows.join(pairs.filter(F.col("d") <= cutoff).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n_contacts")), FRAME, "left").fillna(0, ["n_contacts"])


def dataset_capabilities(coords: DataFrame, kind: Column) -> DataFrame:
    return coords.withColumn("k", kind).groupBy("traj_id").agg(*[F.bool_or(F.col("k") == k).alias(f"has_{k}") for k in ("protein", "nucleic", "ligand", "solvent", "ion")], (F.max("frame") > 0).alias("is_trajectory"))


def component_bounds(coords: DataFrame, keys: list[str]) -> DataFrame:
    """Box of each group of atoms, its volume and its diagonal."""
    ends = [f(n).alias(f"{e}_{n}") for n in "xyz" for f, e in ((F.min, "min"), (F.max, "max"))]
    sides = tuple(F.col(f"max_{n}") - F.col(f"min_{n}") for n in "xyz")
    return coords.groupBy(*keys).agg(*ends).withColumns({"volume": sides[0] * sides[1] * sides[2], "diagonal": g.norm(sides)})


def child_bounds_check(children: DataFrame, parents: DataFrame, keys: list[str], epsilon: float = 1e-7) -> DataFrame:
    """Whether every child box lies in its parent box and is not inverted."""
    parent = parents.select(*keys, *[F.col(f"{e}_{n}").alias(f"p{e}_{n}") for n in "xyz" for e in ("min", "max")])
    inside = g.any_of([(F.col(f"min_{n}") >= F.col(f"pmin_{n}") - epsilon) & (F.col(f"max_{n}") <= F.col(f"pmax_{n}") + epsilon) & (F.col(f"min_{n}") <= F.col(f"max_{n}")) for n in "xyz"], lambda a, b: a & b)
    return children.join(parent, keys).groupBy(*keys).agg(F.bool_and(inside).alias("contained"), F.count(F.lit(1)).alias("n_children"))


def missing_atoms(atoms: DataFrame, template: DataFrame, keys: list[str]) -> DataFrame:
    """Template atoms (resname, name) that a residue lacks."""
    expected = atoms.select(*keys, "resname").distinct().join(template, "resname")
    return expected.join(atoms.select(*keys, "name"), [*keys, "name"], "left_anti").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("missing"))


def missing_residues(sequence: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Sequence positions (key, residue) without coordinates, by where they lie."""
    ends = observed.groupBy(key).agg(F.min("residue").alias("lo"), F.max("residue").alias("hi"))
    gone = sequence.join(observed.select(key, "residue").distinct(), [key, "residue"], "left_anti")
    return gone.join(ends, key, "left").select(key, "residue", F.when(F.col("residue") < F.col("lo"), "n_term").when(F.col("residue") > F.col("hi"), "c_term").when(F.col("lo").isNull(), "absent").otherwise("internal").alias("place"))


def nearest_match(pockets: DataFrame, first: str, second: str, reach: float = 4.0) -> DataFrame:
    """For each pocket of one method the nearest of the other within reach, by a grid join, with the overlap of their residues."""
    from orbitframe.operators.selection import radius_join

    sides = [pockets.filter(F.col("method") == m).drop("method") for m in (first, second)]
    near = radius_join(*sides, reach, ["structure_id"])
    best = near.groupBy("structure_id", "pocket_id").agg(F.min_by(F.struct("d", "pocket_id_b", "residue_ids", "residue_ids_b", "volume", "volume_b"), F.struct("d", "pocket_id_b")).alias("m"))
    jaccard = F.size(F.array_intersect("m.residue_ids", "m.residue_ids_b")) / F.size(F.array_union("m.residue_ids", "m.residue_ids_b"))
    out = sides[0].select("structure_id", "pocket_id").join(best, ["structure_id", "pocket_id"], "left")
    return out.select("structure_id", "pocket_id", F.col("m.pocket_id_b").alias("match_id"), F.col("m.d").alias("d"), jaccard.alias("jaccard"), (F.col("m.volume") - F.col("m.volume_b")).alias("volume_delta"), F.coalesce((jaccard >= 0.3) | (F.col("m.d") <= 2.5), F.lit(False)).alias("consensus"))


def measure_batch(requests: DataFrame, atoms: DataFrame, keys: list[str]) -> DataFrame:
    """Distances, angles and dihedrals for requests (request_id, kind, a, b, c, d): the ends are joined once each."""
    rows = requests
    for end in "abcd":
        rows = rows.join(atoms.select(*keys, F.col("atom_id").alias(end), F.struct(*"xyz").alias(f"p{end}")), [*([k for k in keys if k in rows.columns]), end], "left")
    p = {e: g.vec(f"p{e}.") for e in "abcd"}
    value = F.when(F.col("kind") == "distance", g.dist(p["a"], p["b"])).when(F.col("kind") == "angle", g.angle(p["a"], p["b"], p["c"])).otherwise(g.dihedral(p["a"], p["b"], p["c"], p["d"]))
    return rows.select("request_id", *keys, "kind", value.alias("value"))


def entity_summary(rows: DataFrame, keys: list[str], entity: str, chain: str) -> DataFrame:
    """Entities and chains per structure: one entity of several chains is a homomer, several entities are a heteromer."""
    per = rows.groupBy(*keys, entity).agg(F.count_distinct(chain).alias("n"))
    kind = F.when(F.count(F.lit(1)) > 1, "heteromer").when(F.max("n") > 1, "homomer").otherwise("monomer")
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_entities"), F.sum("n").alias("n_chains"), kind.alias("kind"))
