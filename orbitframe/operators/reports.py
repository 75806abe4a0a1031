"""Composed jobs: oriented boxes, staged hydrogen bonds, base pairs, pose checks, consensus of models, reports per structure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.functions import geometry as g
from orbitframe.operators import contacts
from orbitframe.operators import interactions as i
from orbitframe.operators import series as se
from orbitframe.operators import structure as st
from orbitframe.operators import superposition as su
from orbitframe.operators.graphs import shared_path, stored
from orbitframe.operators.selection import radius_join
from orbitframe.operators.structure import FRAME
from orbitframe.plans import certified as c

#: Complementary bases, with the least number of near atom pairs.
BASE_PAIRS = [("A", "U", 2), ("U", "A", 2), ("G", "C", 2), ("C", "G", 2), ("DA", "DT", 2), ("DT", "DA", 2), ("DG", "DC", 2), ("DC", "DG", 2), ("G", "U", 1), ("U", "G", 1)]


def oriented_box(coords: DataFrame, keys: list[str], least: float = 0.2) -> DataFrame:
    """Half sizes along the principal axes: the six covariances per key come from one aggregation, only they see Python."""
    pairs = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    stats = coords.groupBy(*keys).agg(*[F.covar_pop(a, b).alias(f"{a}{b}") for a, b in pairs], *[F.avg(n).alias(f"c{n}") for n in "xyz"])
    kinds = ", ".join(f"{k} {stats.schema[k].dataType.simpleString()}" for k in keys)

    def axes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.empty((len(b), 3, 3))
            for (p, q), (r, s) in zip(pairs, [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)], strict=True):
                m[:, r, s] = m[:, s, r] = b[f"{p}{q}"]
            v = np.linalg.eigh(m)[1]
            out = b[[*keys, "cx", "cy", "cz"]].copy()
            for k in range(3):
                for j, n in enumerate("xyz"):
                    out[f"a{k}{n}"] = v[:, j, k]
            yield out

    names = [*(f"c{n}" for n in "xyz"), *(f"a{k}{n}" for k in range(3) for n in "xyz")]
    frames = stats.mapInPandas(axes, f"{kinds}, " + ", ".join(f"{n} double" for n in names))
    rows = coords.join(frames, keys)
    at = [g.dot(g.sub(g.vec(), g.vec("c")), g.vec(f"a{k}")) for k in range(3)]
    return rows.groupBy(*keys).agg(*[F.greatest(F.lit(least), (F.max(p) - F.min(p)) / 2).alias(f"half_{k}") for k, p in enumerate(at)])


def hbond_staged(coords: DataFrame, donor: int, hydrogen: int, acceptor: int, cutoff: float, least: float, size: int = c.BLOCK) -> DataFrame:
    """Frames with the hydrogen bond: blocks whose donor and acceptor stay further apart than the cutoff are never looked at."""
    ends = coords.filter(F.col("atom_id").isin(donor, acceptor)).withColumn("group_id", F.when(F.col("atom_id") == donor, 0).otherwise(1))
    far = c.block_verdicts(ends, cutoff, "<", size).filter(~F.col("verdict")).select("traj_id", "block_id")
    near = c.in_blocks(coords, size).join(far, ["traj_id", "block_id"], "left_anti").drop("block_id")
    return i.hbond_series(near, donor, hydrogen, acceptor, cutoff, least).filter("bonded").select(*FRAME, "d", "angle")


def base_pairs(atoms: DataFrame, low: float = 2.5, high: float = 3.4) -> DataFrame:
    """Residues of complementary bases with enough near polar atoms; neighbours in one strand are left out."""
    polar = atoms.filter(F.col("element").isin("N", "O")).select(*FRAME, "atom_id", "residue", "resname", "chain", *"xyz")
    near = radius_join(polar, polar, high, FRAME).filter((F.col("d") >= low) & (F.col("residue") < F.col("residue_b")) & ~((F.col("chain") == F.col("chain_b")) & (F.col("residue_b") - F.col("residue") < 3)))
    need = F.coalesce(*[F.when((F.col("resname") == a) & (F.col("resname_b") == b), n) for a, b, n in BASE_PAIRS])
    return near.withColumn("need", need).filter("need is not null").groupBy(*FRAME, "residue", "residue_b").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).filter("n >= need").drop("need")


def pose_validation(bonds: DataFrame, atoms: DataFrame, ligand: Column, length: float, slack: float = 0.25, close: float = 1.8) -> DataFrame:
    """Per frame: bonds (i, j, d) off their length, contacts of ligand and receptor that are too near, and the verdict."""
    off = bonds.groupBy(*FRAME).agg(F.count_if(F.abs(F.col("d") - length) > slack).alias("n_bonds_off"))
    rows = atoms.select(*FRAME, "atom_id", *"xyz")
    flagged = atoms.select(*FRAME, "atom_id", ligand.alias("lig"))
    tagged = rows.join(flagged, [*FRAME, "atom_id"])
    near = radius_join(tagged.filter(~F.col("lig")), tagged.filter("lig"), close, FRAME).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n_close"))
    out = off.join(near, FRAME, "left").fillna(0, ["n_close"])
    return out.withColumn("valid", (F.col("n_bonds_off") == 0) & (F.col("n_close") == 0))


def model_consensus(coords: DataFrame, limit: float) -> DataFrame:
    """Per trajectory, frames taken as models fitted to the first: mean deviation of pairs and the number of residues that agree."""
    fitted = stored(su.fit_reference(coords))
    mean = su.rmsd_stats(fitted, aligned=False)
    spans = su.consensus_spans(fitted, limit).groupBy("traj_id").agg(F.sum(F.when(F.col("close"), F.col("last") - F.col("first") + 1).otherwise(0)).alias("n_agreeing"))
    return mean.join(spans, "traj_id")


def quality_report(atoms: DataFrame) -> DataFrame:
    """One row per frame: temperature factors, breaks, implausible backbone steps, outliers and clashes."""
    stats = atoms.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n_atoms"), F.avg("b_factor").alias("mean_b"), F.avg("occupancy").alias("mean_occupancy"))
    breaks = se.neighbours(atoms, "C", "N").groupBy(*FRAME).agg(F.count_if(F.col("d") > 2.5).alias("n_breaks"))
    phi = se.backbone_dihedrals(atoms)
    region = se.ramachandran(F.col("phi"), F.col("psi"), F.col("resname"), F.col("n_name"))[1]
    # Residues without both angles count as null: a filter would write the angles out once more.
    known = F.when(F.col("phi").isNotNull() & F.col("psi").isNotNull(), (region == "OUTLIER").cast("double"))
    outliers = phi.groupBy(*FRAME).agg((100.0 * F.avg(known)).alias("outlier_percent"))
    clashes = i.steric_clashes(atoms).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n_clashes"))
    return stats.join(breaks, FRAME, "left").join(outliers, FRAME, "left").join(clashes, FRAME, "left").fillna(0, ["n_clashes", "n_breaks"])


def structure_compare(coords: DataFrame, first: int = 0) -> DataFrame:
    """Every frame against one: fitted deviation, template modelling score, distance-test scores, contact overlap."""
    rows = st.against(coords, coords.filter(F.col("frame") == first), ["traj_id", "atom_id"]).withColumn("d", g.dist(g.vec(), g.vec(suffix="_r")))
    out = su.rmsd_fit(rows, FRAME)
    for part in (st.tm_score(rows, FRAME), st.gdt_scores(rows, FRAME), contacts.similarity(contacts.near_pairs(coords, 8.0), coords, first)):
        out = out.join(part, FRAME)
    return out


def unwrap_bonded(coords: DataFrame, bonds: DataFrame, root: int, keys: list[str]) -> DataFrame:
    """Moves each atom next to its parent in a walk over the bonds (i, j) from the root, by whole boxes.

    The walk is the same in every frame, so it is found once, over the atoms; the frames then take as many joins as the logarithm of
    its depth."""
    both = stored(bonds.select("i", "j").unionByName(bonds.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    steps = shared_path(coords.sparkSession)
    start = both.select(F.lit(root).cast(both.schema["i"].dataType).alias("atom_id")).limit(1).select("atom_id", F.lit(None).cast(both.schema["i"].dataType).alias("parent"), F.lit(0).alias("level"))
    walk, level = stored(start, steps), 0
    while True:
        reached = walk.filter(F.col("level") == level).select(F.col("atom_id").alias("i")).join(both, "i").groupBy(F.col("j").alias("atom_id")).agg(F.min("i").alias("parent"))
        level += 1
        walk = stored(reached.join(walk.select("atom_id"), "atom_id", "left_anti").withColumn("level", F.lit(level)), steps)
        if walk.filter(F.col("level") == level).isEmpty():
            break
    # Jumps to the parent are whole boxes, so they add up along the way to the root; ways are joined to ways, twice as long each time.
    boxes = [f"b{n}" for n in "xyz"]
    parents = coords.select(*keys, F.col("atom_id").alias("parent"), *[F.col(n).alias(f"p{n}") for n in "xyz"])
    rows = coords.join(walk.select("atom_id", "parent"), "atom_id").join(parents, [*keys, "parent"], "left")
    ways = stored(rows.select(*keys, "atom_id", "parent", *[F.coalesce(F.rint((F.col(n) - F.col(f"p{n}")) / F.col(f"l{n}")), F.lit(0.0)).alias(f"b{n}") for n in "xyz"]))
    while level > 1:
        further = ways.select(*keys, F.col("atom_id").alias("parent"), F.col("parent").alias("next"), *[F.col(b).alias(f"{b}_p") for b in boxes])
        ways = stored(ways.join(further, [*keys, "parent"], "left").select(*keys, "atom_id", F.col("next").alias("parent"), *[(F.col(b) + F.coalesce(F.col(f"{b}_p"), F.lit(0.0))).alias(b) for b in boxes]))
        level = (level + 1) // 2
    return coords.join(ways.drop("parent"), [*keys, "atom_id"]).select(*keys, "atom_id", *[(F.col(n) - F.col(f"l{n}") * F.col(f"b{n}")).alias(n) for n in "xyz"])
