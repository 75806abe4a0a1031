"""Contacts within a cutoff by pair lists: bounds of atoms over blocks of frames say once per block which pairs can come near.

An atom's box over a block is put into the cells of a grid that it covers, and, widened by the cutoff, into those around it. Two atoms that
share a cell and whose boxes lie within the cutoff form a listed pair, taken in the first cell they share, so that no pair is made twice.
All frames of the block use the list; distances are computed for listed pairs only. Where atoms move far between frames a block is one frame,
and the list is the answer. No frame makes all its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.functions import geometry as g
from orbitframe.operators.selection import radius_join

FRAME = ["traj_id", "frame"]
#: Frames that share a pair list where atoms move little.
BLOCK = 8


def block_for(coords: DataFrame, cutoff: float, most: int = BLOCK) -> int:
    """`most` if nine of ten atoms span less than half the cutoff in as many frames, over all of the table, else 1."""
    spans = boxes(coords, most).agg(F.avg((F.col("span") <= cutoff / 2).cast("double"))).first()[0]
    return most if spans is not None and spans >= 0.9 else 1


def boxes(coords: DataFrame, block: int) -> DataFrame:
    """traj_id, block, atom_id, the ends x0, x1, ... of each atom's box, and its longest side."""
    ends = [f(n).alias(f"{n}{e}") for n in "xyz" for f, e in ((F.min, "0"), (F.max, "1"))]
    out = coords.groupBy("traj_id", F.floor(F.col("frame") / block).alias("block"), "atom_id").agg(*ends)
    return out.withColumn("span", F.greatest(*[F.col(f"{n}1") - F.col(f"{n}0") for n in "xyz"]))


def _cells(low: dict[str, Column], high: dict[str, Column], width: float) -> Column:
    """The cells that a box covers, as structs cx, cy, cz."""
    spans = {n: F.sequence(F.floor(low[n] / width).cast("long"), F.floor(high[n] / width).cast("long")) for n in "xyz"}
    return F.flatten(F.transform(spans["x"], lambda x: F.flatten(F.transform(spans["y"], lambda y: F.transform(spans["z"], lambda z: F.struct(x.alias("cx"), y.alias("cy"), z.alias("cz")))))))


def pair_lists(found: DataFrame, cutoff: float) -> DataFrame:
    """traj_id, block, i, j (i < j) of the atoms whose boxes over the block lie within the cutoff. A box covers few cells if its sides are
    no longer than a few cutoffs."""
    low, high = ({n: F.col(f"{n}{e}") for n in "xyz"} for e in "01")
    first = [F.floor(low[n] / cutoff).cast("long").alias(f"f{n}") for n in "xyz"]
    near = [F.floor((low[n] - cutoff) / cutoff).cast("long").alias(f"f{n}_b") for n in "xyz"]
    names = [f"{n}{e}" for n in "xyz" for e in "01"]
    a = found.select("traj_id", "block", F.col("atom_id").alias("i"), *names, *first, F.inline(_cells(low, high, cutoff)))
    wide = _cells({n: low[n] - cutoff for n in "xyz"}, {n: high[n] + cutoff for n in "xyz"}, cutoff)
    b = found.select("traj_id", "block", F.col("atom_id").alias("j"), *[F.col(n).alias(f"{n}_b") for n in names], *near, F.inline(wide))
    # Spark takes the boxes' copies for as large as the boxes, and would broadcast them.
    rows = a.join(b.hint("merge"), ["traj_id", "block", "cx", "cy", "cz"]).filter("i < j")
    once = g.any_of([F.col(f"c{n}") == F.greatest(f"f{n}", f"f{n}_b") for n in "xyz"], lambda p, q: p & q)
    gap = tuple(F.greatest(F.lit(0.0), F.col(f"{n}0") - F.col(f"{n}1_b"), F.col(f"{n}0_b") - F.col(f"{n}1")) for n in "xyz")
    # A little more than the cutoff, since the exact distance is rounded in another order.
    return rows.filter(once & (g.norm(gap) <= cutoff * (1 + 1e-12))).select("traj_id", "block", "i", "j")


def near_pairs(coords: DataFrame, cutoff: float, block: int | None = None) -> DataFrame:
    """traj_id, frame, i, j, d of the pairs i < j of a frame's atoms within the cutoff. Atoms whose box over a block is longer than two
    cutoffs are kept out of its list, and looked for around their place in each frame."""
    block = block or block_for(coords, cutoff)
    found, of_block = boxes(coords, block), ["traj_id", "block"]
    rows = coords.select(*FRAME, F.floor(F.col("frame") / block).alias("block"), "atom_id", *"xyz")
    far = F.col("span") > 2 * cutoff
    listed = pair_lists(found.filter(~far), cutoff)
    a = rows.withColumnRenamed("atom_id", "i").join(listed, [*of_block, "i"])
    b = rows.select(*FRAME, F.col("atom_id").alias("j"), *[F.col(n).alias(f"{n}_b") for n in "xyz"])
    near = a.join(b, [*FRAME, "j"]).select(*FRAME, "i", "j", g.dist(g.vec(), g.vec(suffix="_b")).alias("d")).filter(F.col("d") <= cutoff)
    if block == 1:  # a box is a point
        return near
    marked = rows.join(found.select(*of_block, "atom_id", far.alias("far")), [*of_block, "atom_id"]).drop("block")
    wide = radius_join(marked.filter("far").drop("far"), marked, cutoff, FRAME).filter("atom_id < atom_id_b OR (atom_id > atom_id_b AND NOT far_b)")
    return near.unionByName(wide.select(*FRAME, F.least("atom_id", "atom_id_b").alias("i"), F.greatest("atom_id", "atom_id_b").alias("j"), "d"))


def similarity(near: DataFrame, frames: DataFrame, first: int = 0) -> DataFrame:
    """Jaccard and Dice of each frame's contacts and one frame's; 1 where both are empty. Trajectories without that frame have no row.
    near: contacts; frames: traj_id, frame of all frames."""
    frames = frames.select(*FRAME).distinct()
    ref = near.filter(F.col("frame") == first).select("traj_id", "i", "j", F.lit(1).alias("r"))
    own = near.join(ref, ["traj_id", "i", "j"], "left").groupBy(*FRAME).agg(F.count(F.lit(1)).alias("own"), F.count("r").alias("both"))
    size = frames.filter(F.col("frame") == first).select("traj_id").join(ref.groupBy("traj_id").agg(F.count("r").alias("size")), "traj_id", "left")
    rows = frames.join(size, "traj_id").join(own, FRAME, "left").fillna(0, ["size", "own", "both"])
    either = F.col("own") + F.col("size") - F.col("both")
    total = F.col("own") + F.col("size")
    return rows.select(*FRAME, F.when(either == 0, 1.0).otherwise(F.col("both") / either).alias("jaccard"), F.when(total == 0, 1.0).otherwise(2 * F.col("both") / total).alias("dice"))


def agreement(near: DataFrame, atoms: DataFrame, first: int, second: int) -> DataFrame:
    """Share of the pairs of either frame's atoms on whose contact both frames agree, from the contacts alone: pairs of atoms that both
    frames hold agree unless one frame only has the contact. 99 % passes. atoms: traj_id, frame, atom_id."""
    both = atoms.filter(F.col("frame").isin(first, second)).groupBy("traj_id", "atom_id").agg(F.bool_or(F.col("frame") == first).alias("one"), F.bool_or(F.col("frame") == second).alias("two"))
    pairs = lambda c: F.count_if(c) * (F.count_if(c) - 1) / 2
    shared = F.col("one") & F.col("two")
    sizes = both.groupBy("traj_id").agg(pairs(shared).alias("common"), (pairs(F.col("one")) + pairs(F.col("two")) - pairs(shared)).alias("whole"))
    odd = near.filter(F.col("frame").isin(first, second)).groupBy("traj_id", "i", "j").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < len({first, second}))
    for end in "ij":
        odd = odd.join(both.filter(shared).select("traj_id", F.col("atom_id").alias(end)), ["traj_id", end], "left_semi")
    rows = sizes.join(odd.groupBy("traj_id").agg(F.count(F.lit(1)).alias("odd")), "traj_id", "left").filter("whole > 0")
    share = (F.col("common") - F.coalesce("odd", F.lit(0))) / F.col("whole")
    return rows.select("traj_id", share.alias("agreement"), (share >= 0.99).alias("passes"))
