"""Surfaces and volumes by points and voxels, exploded next to atoms and joined on a grid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.functions import geometry as g
from orbitframe.operators.graphs import connected_components, stored
from orbitframe.operators.selection import radius_join
from orbitframe.operators.structure import FRAME, VDW, lookup, widest

PROBE, POINTS = 1.4, 128
#: Reference areas of residues, in square angstrom.
REFERENCE_AREA = {
    "ALA": 129.0, "ARG": 274.0, "ASN": 195.0, "ASP": 193.0, "CYS": 167.0, "GLN": 225.0, "GLU": 223.0, "GLY": 104.0, "HIS": 224.0, "ILE": 197.0,
    "LEU": 201.0, "LYS": 236.0, "MET": 224.0, "PHE": 240.0, "PRO": 159.0, "SER": 155.0, "THR": 172.0, "TRP": 285.0, "TYR": 263.0, "VAL": 174.0,
}


def unit_points(n: int = POINTS) -> list[tuple[float, float, float]]:
    """Points spread over the sphere by the golden angle."""
    out = []
    for k in range(n):
        y = 1 - 2 * (k + 0.5) / n
        r = math.sqrt(1 - y * y)
        a = math.pi * (3 - math.sqrt(5)) * k
        out.append((r * math.cos(a), y, r * math.sin(a)))
    return out


def sasa_atoms(atoms: DataFrame, points: int = POINTS) -> DataFrame:
    """Accessible area per atom: the share of its sphere's points that lie in no neighbour's sphere."""
    rows = atoms.select(*FRAME, "atom_id", (lookup(F.col("element"), VDW, 1.7) + PROBE).alias("r"), *"xyz")
    near = radius_join(rows, rows, 2 * (widest(atoms, VDW, 1.7) + PROBE), FRAME).filter((F.col("atom_id") != F.col("atom_id_b")) & (F.col("d") < F.col("r") + F.col("r_b")))
    around = near.groupBy(*FRAME, "atom_id").agg(F.collect_list(F.struct(F.col("x_b").alias("x"), F.col("y_b").alias("y"), F.col("z_b").alias("z"), F.col("r_b").alias("r"))).alias("near"))
    sphere = F.array(*[F.struct(*[F.lit(c).alias(n) for c, n in zip(p, "xyz", strict=True)]) for p in unit_points(points)])
    spots = rows.join(around, [*FRAME, "atom_id"], "left").withColumn("p", F.explode(sphere))
    at = tuple(F.col(n) + F.col("r") * F.col(f"p.{n}") for n in "xyz")

    def covers(b):
        d = tuple(c - b[n] for c, n in zip(at, "xyz", strict=True))
        return g.dot(d, d) < b["r"] * b["r"]

    free = ~F.coalesce(F.exists("near", covers), F.lit(False))
    return spots.groupBy(*FRAME, "atom_id").agg((F.avg(free.cast("double")) * 4 * math.pi * F.first("r") ** 2).alias("sasa"))


def sasa_rollup(areas: DataFrame, atoms: DataFrame) -> DataFrame:
    """Areas by residue, chain and in all."""
    return areas.join(atoms.select("atom_id", "chain", "residue").distinct(), "atom_id").rollup(*FRAME, "chain", "residue").agg(F.sum("sasa").alias("sasa")).filter("frame is not null")


def rsa(areas: DataFrame, atoms: DataFrame) -> DataFrame:
    """Share of each amino acid's reference area; other residues have none and are left out."""
    rows = areas.join(atoms.select("atom_id", "residue", "resname").distinct(), "atom_id").groupBy(*FRAME, "residue", "resname").agg(F.sum("sasa").alias("sasa"))
    rows = rows.filter(F.col("resname").isin([*REFERENCE_AREA]))
    share = g.clamp(F.col("sasa") / lookup(F.col("resname"), REFERENCE_AREA, 1.0), 0.0, 1.0)
    return rows.withColumn("rsa", share).withColumn("kind", F.when(F.col("rsa") < 0.1, "buried").when(F.col("rsa") >= 0.25, "exposed").otherwise("intermediate"))


def vdw_voxels(atoms: DataFrame, h: float = 0.5) -> DataFrame:
    """Distinct voxels whose centre lies in an atom."""
    r = lookup(F.col("element"), VDW, 1.7)
    rows = atoms.select(*FRAME, *"xyz", r.alias("r"))
    spans = {f"i{n}": F.explode(F.sequence(F.floor((F.col(n) - F.col("r")) / h).cast("long"), F.floor((F.col(n) + F.col("r")) / h).cast("long"))) for n in "xyz"}
    for name, c in spans.items():
        rows = rows.withColumn(name, c)
    centre = tuple((F.col(f"i{n}") + 0.5) * h for n in "xyz")
    return rows.filter(g.dist(centre, g.vec()) <= F.col("r")).select(*FRAME, "ix", "iy", "iz").distinct()


def vdw_volume(atoms: DataFrame, h: float = 0.5) -> DataFrame:
    """Volume of the atoms and its share of their centres' box."""
    rows = vdw_voxels(atoms, h).groupBy(*FRAME).agg((F.count(F.lit(1)) * h**3).alias("volume"))
    sides = [F.max(n) - F.min(n) for n in "xyz"]
    box = atoms.groupBy(*FRAME).agg((sides[0] * sides[1] * sides[2]).alias("box"))
    return rows.join(box, FRAME).select(*FRAME, "volume", F.when(F.col("box") > 0, F.col("volume") / F.col("box")).otherwise(0.0).alias("packing_fraction"))


def cavities(atoms: DataFrame, h: float = 0.8, probe: float = PROBE, least: float = 20.0) -> DataFrame:
    """Enclosed free voxels by cavity: those that no walk over faces reaches from the border of the grid around the atoms, grouped
    over faces, edges and corners. Per cavity of at least `least` cubic angstrom: voxels, volume, centre and lining residues.

    The grid starts at the atoms' least coordinates less a margin. Free voxels are runs between atoms along x: the fill from the
    border and the grouping join runs with runs of neighbouring lines, not voxels with voxels, and end with connected components.
    A run is told by its line (iy, iz) and its number in it. A frame without cavities has no row.
    """
    pad = probe + 2.0
    edges = [F.min(n).alias(f"o{n}") for n in "xyz"], [F.max(n).alias(f"e{n}") for n in "xyz"]
    grid = atoms.groupBy(*FRAME).agg(*edges[0], *edges[1])
    grid = grid.select(*FRAME, *[(F.col(f"o{n}") - pad).alias(f"o{n}") for n in "xyz"], *[F.ceil((F.col(f"e{n}") - F.col(f"o{n}") + 2 * pad) / h).cast("long").alias(f"n{n}") for n in "xyz"])
    r = lookup(F.col("element"), VDW, 1.7)
    rows = atoms.select(*FRAME, *"xyz", r.alias("r")).join(grid, FRAME)
    for n in "yz":
        at = F.col(n) - F.col(f"o{n}")
        rows = rows.withColumn(f"i{n}", F.explode(F.sequence(F.ceil((at - F.col("r")) / h - 0.5), F.floor((at + F.col("r")) / h - 0.5))))
    # An atom covers one run of voxels of each line that it meets.
    rest = F.col("r") ** 2 - sum(((F.col(f"o{n}") + (F.col(f"i{n}") + 0.5) * h - F.col(n)) ** 2 for n in "yz"), F.lit(0.0))
    reach = F.sqrt(F.greatest(rest, F.lit(0.0)))
    at = F.col("x") - F.col("ox")
    line = [*FRAME, "iy", "iz"]
    covered = rows.filter(rest >= 0).select(*line, F.ceil((at - reach) / h - 0.5).alias("a"), F.floor((at + reach) / h - 0.5).alias("b")).filter("a <= b")
    lines = grid.select("*", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("iy")).select("*", F.explode(F.sequence(F.lit(0), F.col("nz") - 1)).alias("iz"))
    spans = covered.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    rows = lines.join(spans, line, "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>")))
    # Free runs lie between the furthest end so far and the next start.
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("free"))

    def step(acc, s):
        gap = F.struct((acc["end"] + 1).alias("a"), (s["a"] - 1).alias("b"))
        return F.struct(F.greatest(acc["end"], s["b"]).alias("end"), F.when(s["a"] > acc["end"] + 1, F.concat(acc["free"], F.array(gap))).otherwise(acc["free"]).alias("free"))

    last = F.array(F.struct(F.col("nx").alias("a"), F.col("nx").alias("b")))
    free = F.aggregate(F.concat(F.col("spans"), last), start, step, lambda acc: acc["free"])
    border = (F.col("iy") == 0) | (F.col("iz") == 0) | (F.col("iy") == F.col("ny") - 1) | (F.col("iz") == F.col("nz") - 1)
    runs = rows.select(*FRAME, "iy", "iz", border.alias("border"), "nx", F.inline(free)).filter("a <= b")
    id_ = F.concat_ws(":", "iy", "iz", "a")
    runs = stored(runs.select(*line, "a", "b", id_.alias("node"), (F.col("border") | (F.col("a") == 0) | (F.col("b") == F.col("nx") - 1)).alias("border")))

    def touching(of: DataFrame, sides: list[tuple[int, int]], slack: int) -> DataFrame:
        """Pairs of runs in neighbouring lines that overlap, or come within `slack` of it."""
        step = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in sides]))
        other = of.select(*FRAME, "iy", "iz", F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("node").alias("j"))
        mine = of.withColumn("s", step).select(*FRAME, (F.col("iy") + F.col("s.p")).alias("iy"), (F.col("iz") + F.col("s.q")).alias("iz"), "a", "b", F.col("node").alias("i"))
        return mine.join(other, line).filter((F.col("a") <= F.col("b2") + slack) & (F.col("a2") <= F.col("b") + slack)).select(*FRAME, "i", "j")

    by_faces = connected_components(touching(runs, [(0, 1), (1, 0)], 0), runs, FRAME)
    outside = by_faces.join(runs.filter("border").select(*FRAME, "node"), [*FRAME, "node"]).select(*FRAME, "component").distinct()
    inner = stored(runs.join(by_faces.join(outside, [*FRAME, "component"], "left_anti").select(*FRAME, "node"), [*FRAME, "node"], "left_semi"))
    groups = connected_components(touching(inner, [(0, 1), (1, 0), (1, 1), (1, -1)], 1), inner, FRAME)
    voxels = F.col("b") - F.col("a") + 1
    found = inner.join(groups, [*FRAME, "node"]).join(grid, FRAME)
    mids = {"x": F.col("ox") + (F.col("a") + F.col("b") + 1) / 2 * h, "y": F.col("oy") + (F.col("iy") + 0.5) * h, "z": F.col("oz") + (F.col("iz") + 0.5) * h}
    sizes = found.groupBy(*FRAME, "component").agg(F.sum(voxels).alias("n_voxels"), *[(F.sum(voxels * c) / F.sum(voxels)).alias(n) for n, c in mids.items()])
    sizes = sizes.withColumn("volume", F.col("n_voxels") * h**3).filter(F.col("volume") >= least)
    spots = found.join(sizes.select(*FRAME, "component"), [*FRAME, "component"], "left_semi").select(*FRAME, "component", F.explode(F.sequence("a", "b")).alias("ix"), "iy", "iz", "ox", "oy", "oz")
    spots = spots.select(*FRAME, "component", *[(F.col(f"o{n}") + (F.col(f"i{n}") + 0.5) * h).alias(n) for n in "xyz"])
    lining = radius_join(spots, atoms.select(*FRAME, "chain", "residue", *"xyz"), probe + 2.5, FRAME).select(*FRAME, "component", F.concat_ws(":", "chain_b", "residue_b").alias("r"))
    lining = lining.groupBy(*FRAME, "component").agg(F.array_join(F.array_sort(F.collect_set("r")), ",").alias("lining"))
    rank = F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.col("volume").desc(), "x", "y", "z"))
    return sizes.join(lining, [*FRAME, "component"], "left").withColumn("rank", rank).drop("component")
