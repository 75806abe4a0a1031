"""Episodes, intervals and statistics of series: runs, merges, lifetimes, sampling, correlation, drift, unwrapping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.functions import geometry as g
from orbitframe.operators import segments
from orbitframe.plans.certified import episodes


def merge_intervals(spans: DataFrame) -> DataFrame:
    """Unions of overlapping and adjoining (traj_id, k_s, k_e)."""
    return segments.unions(spans)


def lifetimes(series: DataFrame, flag: str) -> DataFrame:
    """Lengths of the runs, numbered in order."""
    rows = segments.running(episodes(series, flag), {"n": ("sum", F.lit(1))}, at="k_s")
    return rows.select("traj_id", F.col("n").cast("int").alias("n"), (F.col("k_e") - F.col("k_s")).alias("length"))


def time_steps(series: DataFrame, *names: str) -> DataFrame:
    """traj_id, the named columns and dt, the time to the next frame; null at the last one."""
    rows = segments.neighbours(series.select("traj_id", "frame", "t_ps", *names), ["t_ps"], 1)
    return rows.select("traj_id", *names, (F.col("near_t_ps") - F.col("t_ps")).alias("dt"))


def frame_intervals(series: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Profile of the time steps. All lie near their mean if the extremes do."""
    out = time_steps(series).filter("dt is not null").groupBy("traj_id").agg(F.avg("dt").alias("mean_dt"), F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt"))
    return out.withColumn("uniform", (F.col("max_dt") - F.col("mean_dt") <= tolerance) & (F.col("mean_dt") - F.col("min_dt") <= tolerance))


def time_weighted_occupancy(series: DataFrame, flag: str) -> DataFrame:
    """Share of time in contact; of frames where no step is positive."""
    rows = time_steps(series, flag).withColumn("dt", F.when(F.col("dt") > 0, F.col("dt")))
    total = F.sum("dt")
    return rows.groupBy("traj_id").agg(F.when(total > 0, F.coalesce(F.sum(F.when(F.col(flag), F.col("dt"))), F.lit(0.0)) / total).otherwise(F.avg(F.col(flag).cast("double"))).alias("occupancy"))


def unwrap_time(coords: DataFrame) -> DataFrame:
    """Removes box jumps between frames: a running sum of whole boxes, so the recurrence needs no loop."""
    keys = ["traj_id", "atom_id"]
    rows = segments.neighbours(coords, list("xyz"), -1, keys)
    jumps = {f"s{n}": ("sum", F.coalesce(F.rint((F.col(n) - F.col(f"near_{n}")) / F.col(f"l{n}")), F.lit(0.0))) for n in "xyz"}
    return segments.running(rows, jumps, keys).select("traj_id", "frame", "atom_id", *[(F.col(n) - F.col(f"l{n}") * F.col(f"s{n}")).alias(n) for n in "xyz"])


def unwrap_frame(coords: DataFrame) -> DataFrame:
    """Puts each frame's atoms next to its first atom."""
    w = Window.partitionBy("traj_id", "frame").orderBy("atom_id")

    def near(n: str) -> Column:
        first = F.first(n).over(w)
        d = F.col(n) - first
        return first + d - F.col(f"l{n}") * F.rint(d / F.col(f"l{n}"))

    return coords.select("traj_id", "frame", "atom_id", *[near(n).alias(n) for n in "xyz"])


def unwrap_phase(series: DataFrame, value: str, period: float = 360.0) -> DataFrame:
    rows = segments.neighbours(series, [value], -1)
    jump = F.coalesce(F.rint((F.col(value) - F.col(f"near_{value}")) / period), F.lit(0.0))
    return segments.running(rows, {"jump": ("sum", jump)}).withColumn("phase", F.col(value) - period * F.col("jump")).drop("jump", f"near_{value}")


def autocorrelation(series: DataFrame, value: str, most: int = 200) -> DataFrame:
    """C(lag) for lags up to half the series, `most` at most. A range of frames also takes the first `most` frames of the next one,
    so that each pair of frames meets in the earlier one's range; there a lag is a product of shifted arrays. A range must be longer
    than `most`."""
    series = series.select("traj_id", "frame", F.col(value).cast("double").alias("y"))
    shape = series.groupBy("traj_id").agg(F.avg("y").alias("m"), F.var_pop("y").alias("v"), F.count(F.lit(1)).alias("n"))
    kind = series.schema["traj_id"].dataType.simpleString()
    size = segments.RANGE
    own = F.floor(F.col("frame") / size)
    halo = F.when(F.col("frame") % size < most, own - 1)
    rows = series.join(shape, "traj_id").select("traj_id", "frame", (F.col("y") - F.col("m")).alias("y"), F.least(F.floor(F.col("n") / 2), F.lit(most)).alias("last"), F.explode(F.array_compact(F.array(own, halo))).alias("range_"))

    def products(key: tuple, rows: pa.Table) -> pa.Table:
        start, last = key[1].as_py() * size, rows["last"][0].as_py()
        at = rows["frame"].to_numpy() - start
        width = int(at.max()) + 1
        y, there = np.zeros(width), np.zeros(width)
        y[at], there[at] = rows["y"].to_numpy(), 1
        lags = range(last + 1)
        ends = [max(0, min(size, width - k)) for k in lags]
        total = [float(y[:e] @ y[k : k + e]) for k, e in zip(lags, ends)]
        n = [int(there[:e] @ there[k : k + e]) for k, e in zip(lags, ends)]
        return pa.table({"traj_id": pa.repeat(key[0], len(lags)), "lag": pa.array(lags, pa.int32()), "total": pa.array(total, pa.float64()), "pairs": pa.array(n, pa.int64())})

    found = rows.groupBy("traj_id", "range_").applyInArrow(products, f"traj_id {kind}, lag int, total double, pairs long")
    found = found.groupBy("traj_id", "lag").agg((F.sum("total") / F.sum("pairs")).alias("c"), F.sum("pairs").alias("pairs")).filter("pairs > 0")
    return found.join(shape, "traj_id").select("traj_id", "lag", F.when(F.col("v") > 0, F.col("c") / F.col("v")).otherwise(1.0).alias("c"))


def effective_sample_size(correlation: DataFrame, counts: DataFrame, floor: float = 0.05) -> DataFrame:
    """Integrated correlation time up to the first lag at or under the floor, inefficiency and effective number of frames."""
    w = Window.partitionBy("traj_id")
    stop = F.min(F.when((F.col("lag") > 0) & (F.col("c") <= floor), F.col("lag"))).over(w)
    rows = correlation.withColumn("stop", F.coalesce(stop, F.lit(1 << 30)))
    tau = rows.groupBy("traj_id").agg(F.coalesce(F.sum(F.when((F.col("lag") > 0) & (F.col("lag") < F.col("stop")), F.col("c"))), F.lit(0.0)).alias("tau"))
    out = tau.join(counts, "traj_id").withColumn("g", F.greatest(F.lit(1.0), 1 + 2 * F.col("tau")))
    return out.withColumn("n_eff", F.greatest(F.lit(1), F.least(F.col("n"), F.floor(F.col("n") / F.col("g")))).cast("long"))


def block_sizes(n: int) -> list[int]:
    """2, then half as much again rounded up, up to a quarter of the series, ten at most."""
    out, size = [], 2
    while size <= n // 4 and len(out) < 10:
        out.append(size)
        size = -(-size * 3 // 2)
    return out


def block_averaging(series: DataFrame, value: str, longest: int) -> DataFrame:
    """Standard error of block means per block size; sizes beyond a quarter of a trajectory don't apply to it."""
    rows = segments.counted(series.select("traj_id", "frame", value)).withColumn("size", F.explode(F.array(*map(F.lit, block_sizes(longest)))))
    rows = rows.filter(F.col("size") <= F.floor(F.col("n") / 4)).withColumn("b", F.floor(F.col("frame") / F.col("size")))
    rows = rows.filter((F.col("b") + 1) * F.col("size") <= F.col("n"))
    means = rows.groupBy("traj_id", "size", "b").agg(F.avg(value).alias("m"))
    return means.groupBy("traj_id", "size").agg(F.count(F.lit(1)).alias("n_blocks"), (F.stddev_samp("m") / F.sqrt(F.count(F.lit(1)))).alias("sem"))


def drift_convergence(series: DataFrame, value: str) -> DataFrame:
    """Slope over the last half of the frames, and whether the drift is small against the spread."""
    rows = segments.counted(series.select("traj_id", "frame", value)).filter(F.col("frame") >= F.floor(F.col("n") / 2))
    out = rows.groupBy("traj_id").agg(F.regr_slope(value, "frame").alias("slope"), F.stddev_pop(value).alias("sd"), F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    drift = F.abs(F.col("slope")) * F.col("m")
    return out.select("traj_id", "slope", "sd", F.when(F.col("n") < 10, "INSUFFICIENT").when((drift < F.col("sd")) | (F.abs("slope") < 1e-3), "STATIONARY").otherwise("DRIFTING").alias("status"))


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """traj_id of the trajectories where an episode of a and one of b share a frame. In the order of starts, an episode meets an
    earlier one of the other side if that side's reach so far lies beyond its start."""
    sides = [x.select("traj_id", "k_s", F.when(F.lit(mine), F.col("k_e")).alias("a_e"), F.when(F.lit(not mine), F.col("k_e")).alias("b_e")) for x, mine in ((a, True), (b, False))]
    rows = segments.running(sides[0].unionByName(sides[1]), {"reach_a": ("max", F.col("a_e")), "reach_b": ("max", F.col("b_e"))}, at="k_s")
    other = F.when(F.col("a_e").isNotNull(), F.col("reach_b")).otherwise(F.col("reach_a"))
    return rows.filter(other > F.col("k_s")).select("traj_id").distinct()


def event_before(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether some episode of a ends before one of b starts; unknown if only overlapping pairs are there; false for an empty side."""
    first = a.groupBy("traj_id").agg(F.min("k_e").alias("a_e"))
    last = b.groupBy("traj_id").agg(F.max("k_s").alias("b_s"))
    rows = first.join(last, "traj_id", "full_outer").join(overlapping(a, b).withColumn("overlap", F.lit(True)), "traj_id", "left")
    return rows.select("traj_id", F.when(F.col("a_e") <= F.col("b_s"), True).when(F.col("overlap"), None).otherwise(False).alias("verdict"))


def event_gap(a: DataFrame, b: DataFrame, ordered: bool) -> DataFrame:
    """Least number of frames between an episode of a and one of b, after it if ordered. No pairs are made: the starts of b and
    the ends of a are put in one order, and a running maximum gives each start of b the last end of a before it."""
    ends = a.select("traj_id", F.col("k_e").alias("at"), F.col("k_e").alias("end_a"), F.lit(None).cast("long").alias("start_b"))
    starts = b.select("traj_id", F.col("k_s").alias("at"), F.lit(None).cast("long").alias("end_a"), F.col("k_s").alias("start_b"))
    rows = segments.running(ends.unionByName(starts), {"before": ("max", F.col("end_a"))}, at="at")
    gap = rows.groupBy("traj_id").agg(F.min(F.col("start_b") - F.col("before")).alias("gap"))
    if ordered:
        return gap
    over = overlapping(a, b).withColumn("gap", F.lit(0).cast("long"))
    return gap.unionByName(event_gap(b, a, True)).unionByName(over).groupBy("traj_id").agg(F.min("gap").alias("gap"))


def backbone_dihedrals(coords: DataFrame) -> DataFrame:
    """phi, psi and omega per residue from the neighbours in its chain; null at the ends."""
    keys = ["traj_id", "frame", "chain"]
    at = {n: F.max(F.when(F.col("name") == n, F.struct(*"xyz"))).alias(n) for n in ("N", "CA", "C")}
    rows = coords.groupBy(*keys, "residue").agg(F.first("resname").alias("resname"), *at.values())
    w = Window.partitionBy(*keys).orderBy("residue")
    rows = rows.withColumns({"pC": F.lag("C").over(w), "nN": F.lead("N").over(w), "nCA": F.lead("CA").over(w), "p_res": F.lag("residue").over(w), "n_res": F.lead("residue").over(w), "n_name": F.lead("resname").over(w)})
    p = {n: g.vec(f"{n}.") for n in ("N", "CA", "C", "pC", "nN", "nCA")}

    def made(a: str, b: str, c: str, d: str) -> Column:
        whole = g.any_of([F.col(n).isNotNull() for n in (a, b, c, d)], lambda x, y: x & y)
        return F.when(whole, g.dihedral(p[a], p[b], p[c], p[d]))

    return rows.select(*keys, "residue", "resname", "n_name", made("pC", "N", "CA", "C").alias("phi"), made("N", "CA", "C", "nN").alias("psi"), made("CA", "C", "nN", "nCA").alias("omega"))


def secondary_structure(phi: Column, psi: Column) -> Column:
    """The regions of helix, strand and left-handed turn."""
    helix = phi.between(-140, -30) & psi.between(-80, -10)
    strand = phi.between(-180, -80) & (psi.between(80, 180) | psi.between(-180, -160))
    turn = phi.between(30, 90) & psi.between(10, 80)
    return F.when(phi.isNull() | psi.isNull(), "unassigned").when(helix, "helix").when(strand, "strand").when(turn, "turn").otherwise("coil")


def ramachandran(phi: Column, psi: Column, resname: Column, after: Column) -> tuple[Column, Column]:
    """(class of residue, region). The regions of both kinds."""
    kind = F.when(resname == "GLY", "GLYCINE").when(resname == "PRO", "PROLINE").when(after == "PRO", "PRE_PROLINE").otherwise("GENERAL")
    glycine = ((phi <= 0) & psi.between(-80, 60)) | ((phi >= 0) & psi.between(-60, 80))
    core = (phi.between(-120, -30) & psi.between(-70, -10)) | (phi.between(-180, -50) & (psi.between(80, 180) | psi.between(-180, -160)))
    wide = (phi.between(30, 90) & psi.between(20, 80)) | (phi.between(-180, 0) & psi.between(-100, 180))
    region = F.when(core, "FAVORED").when(wide, "ALLOWED").otherwise("OUTLIER")
    return kind, F.when(kind == "GLYCINE", F.when(glycine, "FAVORED").otherwise("ALLOWED")).otherwise(region)


def neighbours(coords: DataFrame, name: str, after: str) -> DataFrame:
    """Per residue the distance from one of its atoms to one of the next residue's in the chain."""
    keys = ["traj_id", "frame", "chain"]
    at = lambda n: F.max(F.when(F.col("name") == n, F.struct(*"xyz")))
    rows = coords.groupBy(*keys, "residue").agg(at(name).alias("p"), at(after).alias("q"))
    w = Window.partitionBy(*keys).orderBy("residue")
    rows = rows.withColumns({"next": F.lead("residue").over(w), "r": F.lead("q").over(w)}).filter("next is not null")
    return rows.select(*keys, "residue", "next", g.dist(g.vec("p."), g.vec("r.")).alias("d"))


def observed_sequence(sequence: DataFrame, observed: DataFrame) -> DataFrame:
    """Per key the sequence with '-' where coordinates are missing, and the number of missing residues: (key, residue, letter)."""
    rows = sequence.join(observed.select("key", "residue").distinct().withColumn("seen", F.lit(True)), ["key", "residue"], "left")
    shown = F.when(F.col("seen"), F.col("letter")).otherwise("-")
    return rows.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("residue", shown.alias("s")))), lambda x: x["s"]), "").alias("shown"), F.count_if(F.col("seen").isNull()).alias("n_missing"))
