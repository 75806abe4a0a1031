"""Threshold queries over distances, certified by block bounds.

Blocks of frames are summarised by the bounding volumes of both groups in one aggregation, without a join. Bounds on the distance
decide most blocks; exact distances are computed only for frames of undecided blocks, found by a semi-join on the block. A null
verdict means UNKNOWN, so SQL's three-valued logic is the query's logic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.functions import geometry as g
from orbitframe.operators import segments
from orbitframe.operators.graphs import few, stored

BLOCK = 10
OPS = ("<", "<=", ">", ">=")
LENGTH_UNITS = {"angstrom": 1.0, "nm": 10.0}


def threshold(value: float, unit: str = "angstrom") -> float:
    """The threshold in angstrom; refuses what is no distance."""
    if unit not in LENGTH_UNITS:
        raise ValueError(f"{unit} is not a unit of length")
    out = float(value) * LENGTH_UNITS[unit]
    if not 0 <= out < float("inf"):
        raise ValueError("a threshold is a finite distance of 0 or more")
    return out


def compare(value: Column, op: str, tau: float) -> Column:
    if op not in OPS:
        raise ValueError(f"operator {op} is not one of {OPS}")
    return {"<": value < tau, "<=": value <= tau, ">": value > tau, ">=": value >= tau}[op]


def decide(low: Column, high: Column, op: str, tau: float) -> Column:
    """TRUE, FALSE or null from bounds."""
    sure, never = {"<": (high < tau, low >= tau), "<=": (high <= tau, low > tau), ">": (low > tau, high <= tau), ">=": (low >= tau, high < tau)}[op]
    return F.when(sure, True).when(never, False)


def in_blocks(coords: DataFrame, size: int = BLOCK) -> DataFrame:
    return coords.withColumn("block_id", F.floor(F.col("frame") / size))


def block_aabb(coords: DataFrame, size: int = BLOCK) -> DataFrame:
    """Boxes per trajectory, group and block, with the block's frames and the extremes of the cell."""
    ends = [f(n).alias(f"{name}_{n}") for n in "xyz" for f, name in ((F.min, "min"), (F.max, "max"))]
    cell = [f(n).alias(f"{n}{tail}") for n in ("lx", "ly", "lz") for f, tail in ((F.min, ""), (F.max, "_max"))]
    return in_blocks(coords, size).groupBy("traj_id", "group_id", "block_id").agg(F.min("frame").alias("frame_start"), (F.max("frame") + 1).alias("frame_end"), *ends, *cell)


def block_kdop14(coords: DataFrame, size: int = BLOCK) -> DataFrame:
    """Extents along seven directions, as two arrays per trajectory, group and block."""
    rows = in_blocks(coords, size).withColumns({f"p{i}": p for i, p in enumerate(g.projections(g.vec()))})
    return rows.groupBy("traj_id", "group_id", "block_id").agg(F.min("frame").alias("frame_start"), (F.max("frame") + 1).alias("frame_end"), F.array(*[F.min(f"p{i}") for i in range(7)]).alias("lows"), F.array(*[F.max(f"p{i}") for i in range(7)]).alias("highs"))


def block_pairs(bounds: DataFrame, first: int = 0, second: int = 1) -> DataFrame:
    """The bounds of two groups side by side, as structs a and b."""
    keys = ["traj_id", "block_id"]
    fields = [c for c in bounds.columns if c not in (*keys, "group_id")]
    sides = [bounds.filter(F.col("group_id") == k).select(*keys, F.struct(*fields).alias(n)) for k, n in ((first, "a"), (second, "b"))]
    return sides[0].join(sides[1], keys)


def axes(model: str) -> list[str]:
    return [f"p{i}" for i in range(7)] if model == "kdop" else list("xyz")


def pair_boxes(coords: DataFrame, size: int = BLOCK, model: str = "aabb", periodic: bool = True, first: int = 0, second: int = 1, frames: bool = False) -> DataFrame:
    """Per trajectory and block the extents of both groups and of the cell, in one aggregation. With frames, also begin, end
    and the frames themselves, of any group: as the bits of `mask`, with those that hold both groups in `both`, or as the array `frames`
    for blocks of 64 frames and more."""
    names, rows = axes(model), in_blocks(coords, size)
    if model == "kdop":
        rows = rows.withColumns(dict(zip(names, g.projections(g.vec()), strict=True)))
    mine = {"a": F.col("group_id") == first, "b": F.col("group_id") == second}
    ends = [f(F.when(c, F.col(n))).alias(f"{e}_{side}{n}") for side, c in mine.items() for n in names for f, e in ((F.min, "min"), (F.max, "max"))]
    cell = [f(F.when(mine["a"], F.col(n))).alias(f"{n}{tail}") for n in ("lx", "ly", "lz") for f, tail in ((F.min, ""), (F.max, "_max"))] if periodic and model == "aabb" else []
    start = F.when(mine["a"], F.col("frame"))
    # The frames of a block are bits of one number while they fit, which is one more sum of the same pass.
    bits = F.bit_or(F.expr(f"shiftleft(1L, CAST(frame % {size} AS INT))"))
    both = [F.coalesce(F.bit_or(F.when(m, F.expr(f"shiftleft(1L, CAST(frame % {size} AS INT))"))), F.lit(0).cast("long")) for m in mine.values()]
    held = [bits.alias("mask"), both[0].bitwiseAND(both[1]).alias("both")] if size < 64 else [F.collect_set("frame").alias("frames")]
    every = [F.min("frame").alias("begin"), (F.max("frame") + 1).alias("end"), *held] if frames else []
    return rows.groupBy("traj_id", "block_id").agg(F.min(start).alias("frame_start"), (F.max(start) + 1).alias("frame_end"), *ends, *cell, *every)


def box_limits(boxes: DataFrame, model: str = "aabb", periodic: bool = True) -> tuple[Column, Column]:
    """(lower, upper) of the distance between the groups, from the columns of pair_boxes. Null where a group is missing; a cell that
    varies leaves the distance open."""
    names = axes(model)

    def side(n: str, e: str) -> list[Column]:
        return [F.col(f"{e}_{n}{m}") for m in names]

    if model == "kdop":
        low, high = g.kdop_bounds(*[F.array(*side(n, e)) for n in "ab" for e in ("min", "max")])
        varies = F.lit(False)
    else:
        both = [(g.scale(g.add(side(n, "min"), side(n, "max")), 0.5), g.scale(g.sub(side(n, "max"), side(n, "min")), 0.5)) for n in "ab"]
        low, high = g.box_bounds(*both[0], *both[1], tuple(F.col(f"l{n}") for n in "xyz") if periodic else None)
        varies = g.any_of([F.col(f"l{n}_max") - F.col(f"l{n}") > 1e-4 for n in "xyz"]) if periodic else F.lit(False)
    there = F.col(f"min_a{names[0]}").isNotNull() & F.col(f"min_b{names[0]}").isNotNull()
    return F.when(there & varies, 0.0).when(there, low), F.when(there & ~varies, high)


def frames_of(size: int) -> Column:
    """The frames of a block of `size` frames, from its mask."""
    at = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.getbit("mask", k) == 1)
    return F.transform(at, lambda k: F.col("block_id") * size + k)


def block_bounds(coords: DataFrame, size: int = BLOCK, model: str = "aabb", periodic: bool = True, first: int = 0, second: int = 1, frames: bool = False) -> DataFrame:
    """traj_id, block_id, frame_start, frame_end of the first group, lower, upper: one aggregation holds the bounds of both groups.
    A block without one of the groups has null bounds. With frames, also the block's frames, of any group."""
    boxes = pair_boxes(coords, size, model, periodic, first, second, frames)
    lower, upper = box_limits(boxes, model, periodic)
    held = [] if not frames else [F.col("frames")] if size >= 64 else [frames_of(size).alias("frames")]
    return boxes.select("traj_id", "block_id", "frame_start", "frame_end", lower.alias("lower"), upper.alias("upper"), *held)


def with_verdict(bounds: DataFrame, tau: float, op: str = "<") -> DataFrame:
    return bounds.withColumn("verdict", decide(F.col("lower"), F.col("upper"), op, tau))


def block_verdicts(coords: DataFrame, tau: float, op: str = "<", size: int = BLOCK, model: str = "aabb", periodic: bool = True, first: int = 0, second: int = 1) -> DataFrame:
    """traj_id, block_id, frame_start, frame_end, lower, upper, verdict of the blocks that hold both groups. A cell that varies leaves
    its blocks undecided."""
    return with_verdict(block_bounds(coords, size, model, periodic, first, second).filter("lower is not null"), tau, op)


def pair_min_distance(coords: DataFrame, first: int = 0, second: int = 1, periodic: bool = True) -> DataFrame:
    """Per frame the least distance between two groups."""
    keys = ["traj_id", "frame"]
    a = coords.filter(F.col("group_id") == first).select(*keys, *(F.col(n).alias(f"a{n}") for n in "xyz"), "lx", "ly", "lz")
    b = coords.filter(F.col("group_id") == second).select(*keys, *(F.col(n).alias(f"b{n}") for n in "xyz"))
    d = g.sub(g.vec("a"), g.vec("b"))
    return a.join(b, keys).groupBy(*keys).agg(F.min(g.norm(g.mic_ortho(d, g.vec("l")) if periodic else d)).alias("d_min"))


def pair_min_by_frame(coords: DataFrame, first: int = 0, second: int = 1, periodic: bool = True) -> DataFrame:
    """The same for rows of few frames, whose coordinates are read and shuffled once: a frame's atoms become two arrays. Frames that lack
    a group stay, with null."""
    at = F.struct(*"xyz", "lx", "ly", "lz")
    sides = [F.collect_list(F.when(F.col("group_id") == k, at)).alias(n) for k, n in ((first, "a"), (second, "b"))]
    rows = coords.groupBy("traj_id", "frame").agg(*sides).select("traj_id", "frame", F.explode_outer("a").alias("a"), "b").select("traj_id", "frame", "a", F.explode_outer("b").alias("b"))
    d = g.sub(g.vec("a."), g.vec("b."))
    return rows.groupBy("traj_id", "frame").agg(F.min(g.norm(g.mic_ortho(d, g.vec("a.l")) if periodic else d)).alias("d_min"))


def prune_semi_join(coords: DataFrame, verdicts: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows of frames whose block is undecided."""
    return in_blocks(coords, size).join(few(verdicts.filter("verdict is null").select("traj_id", "block_id")), ["traj_id", "block_id"], "left_semi")


def exact_frames(coords: DataFrame, verdicts: DataFrame, tau: float, op: str = "<", size: int = BLOCK) -> DataFrame:
    found = pair_min_distance(prune_semi_join(coords, verdicts, size))
    return found.withColumn("truth", compare(F.col("d_min"), op, tau))


def frame_truth(coords: DataFrame, tau: float, op: str = "<", size: int = BLOCK, model: str = "aabb", periodic: bool = True) -> DataFrame:
    """The truth of every frame, from its block's verdict or else by distance. The few rows of blocks are stored; the coordinates are
    read twice, for the bounds and for the frames of undecided blocks."""
    blocks = stored(with_verdict(block_bounds(coords, size, model, periodic, frames=True), tau, op))
    exact = exact_frames(coords, blocks, tau, op, size).select("traj_id", "frame", "truth")
    open_ = blocks.filter("verdict is null").select("traj_id", "block_id", F.explode("frames").alias("frame")).join(exact, ["traj_id", "frame"], "left")
    sure = blocks.filter("verdict is not null").select("traj_id", "block_id", F.explode("frames").alias("frame"), F.col("verdict").alias("truth"))
    columns = ["traj_id", "frame", "block_id", "truth"]
    return sure.select(*columns, F.lit(True).alias("certified")).unionByName(open_.select(*columns, F.lit(False).alias("certified")))


def episodes(series: DataFrame, flag: str = "truth") -> DataFrame:
    """Maximal half-open runs of TRUE frames."""
    return segments.runs(series, F.col(flag))


def exists_(truth: Column) -> Column:
    return F.when(F.bool_or(truth), True).when(F.count_if(truth.isNull()) == 0, False)


def forall_(truth: Column) -> Column:
    return F.when(~F.coalesce(F.bool_and(truth), F.lit(True)), False).when(F.count_if(truth.isNull()) == 0, True)


def needed_frames(duration: float, dt: float) -> int:
    return max(1, -int(-(duration - 1e-9) // dt))


def duration_verdicts(series: DataFrame, duration: float, dt: float, flag: str = "truth", continuous: bool = False) -> DataFrame:
    """Per trajectory whether a run of TRUE lasts long enough: verdict (null if only a run over UNKNOWN might) and resolution."""
    trajectories = series.select("traj_id").distinct()
    if not 0 < dt < float("inf"):
        return trajectories.withColumns({"longest": F.lit(0).cast("long"), "possible": F.lit(0).cast("long"), "verdict": F.lit(None).cast("boolean"), "resolution": F.lit("UNRESOLVABLE_SAMPLING")})
    need = needed_frames(duration, dt)
    # Both kinds of runs in one pass: a frame counts for "possible" unless it is FALSE, for "longest" only if it is TRUE.
    kinds = ["longest", "possible"]
    marked = series.withColumn("kind", F.explode(F.array_compact(F.array(F.when(F.col(flag), kinds[0]), F.when(F.coalesce(F.col(flag), F.lit(True)), kinds[1])))))
    lengths = segments.runs(marked, F.lit(True), ["traj_id", "kind"]).groupBy("traj_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("k_e") - F.col("k_s"))).alias(k) for k in kinds])
    out = trajectories.join(lengths, "traj_id", "left").select("traj_id", *[F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in kinds])
    if continuous and duration < dt:
        return out.withColumns({"verdict": F.lit(None).cast("boolean"), "resolution": F.lit("UNSUPPORTED_SEMANTICS")})
    verdict = F.when(F.col("longest") >= need, True).when(F.col("possible") < need, False)
    return out.withColumn("verdict", verdict).withColumn("resolution", F.when(F.col("verdict").isNull(), "NEEDS_REFINEMENT").otherwise("COMPLETE"))


def query_verdict(series: DataFrame, quantifier: str = "EXISTS", duration: float | None = None, dt: float = 10.0) -> DataFrame:
    if quantifier == "DURATION":
        if duration is None:
            raise ValueError("DURATION needs a duration")
        return duration_verdicts(series, duration, dt).select("traj_id", "verdict", "resolution")
    fold = {"EXISTS": exists_, "FORALL": forall_}[quantifier]
    out = series.groupBy("traj_id").agg(fold(F.col("truth")).alias("verdict"), F.count(F.lit(1)).alias("n"))
    return out.select("traj_id", "verdict", F.when(F.col("n") == 0, "NO_EVIDENCE").when(F.col("verdict").isNull(), "NEEDS_REFINEMENT").otherwise("COMPLETE").alias("resolution"))


def evidence_table(coords: DataFrame, tau: float, op: str = "<", size: int = BLOCK, dt: float = 10.0) -> DataFrame:
    """One row per block: bounds, times in ns, status CERTIFIED_TRUE, CERTIFIED_FALSE, EXACT_TRUE, EXACT_FALSE or REFINED."""
    verdicts = stored(block_verdicts(coords, tau, op, size))
    return evidence_rows(verdicts, exact_frames(coords, verdicts, tau, op, size).withColumn("block_id", F.floor(F.col("frame") / size)), dt)


def evidence_rows(verdicts: DataFrame, exact: DataFrame, dt: float) -> DataFrame:
    """Evidence from blocks and from the truths of the frames of open ones (traj_id, block_id, truth)."""
    exact = exact.groupBy("traj_id", "block_id").agg(F.bool_and("truth").alias("every"), F.bool_or("truth").alias("some"))
    status = F.when(F.col("verdict"), "CERTIFIED_TRUE").when(~F.col("verdict"), "CERTIFIED_FALSE").when(F.col("every"), "EXACT_TRUE").when(~F.col("some"), "EXACT_FALSE").otherwise("REFINED")
    return verdicts.join(exact, ["traj_id", "block_id"], "left").select("traj_id", "block_id", "frame_start", "frame_end", "lower", "upper", (F.col("frame_start") * dt / 1000).alias("t_start_ns"), (F.col("frame_end") * dt / 1000).alias("t_end_ns"), "verdict", status.alias("status"))


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """Blocks by status per trajectory, and the shares of blocks and frames that need no exact distance."""

    def of(*status: str) -> Column:
        return F.count_if(F.col("status").isin(*status))

    n, sure = F.count(F.lit(1)), of("CERTIFIED_TRUE", "CERTIFIED_FALSE")
    frames = F.col("frame_end") - F.col("frame_start")
    counts = {f"n_{s.lower()}": of(s) for s in ("CERTIFIED_TRUE", "CERTIFIED_FALSE", "EXACT_TRUE", "EXACT_FALSE", "REFINED")}
    return evidence.groupBy("traj_id").agg(n.alias("n_blocks"), *[c.alias(k) for k, c in counts.items()], (100.0 * sure / n).alias("pruned_percent"), (1 - F.sum(F.when(F.col("verdict").isNull(), frames).otherwise(0)) / F.sum(frames)).alias("io_pruned"))


def verify_evidence(evidence: DataFrame, tau: float, op: str = "<") -> DataFrame:
    """Violations, none if the evidence holds: a verdict that its bounds don't imply, bounds out of order, gaps and overlaps."""
    implied = decide(F.col("lower"), F.col("upper"), op, tau)
    rows = segments.neighbours(evidence.withColumn("implied", implied), ["frame_end"], -1, at="frame_start").withColumnRenamed("near_frame_end", "before")
    broken = {
        "verdict not implied": ~F.col("verdict").eqNullSafe(F.col("implied")),
        "bounds out of order": F.col("lower") > F.col("upper"),
        "negative bound": F.col("lower") < 0,
        "gap": F.col("frame_start") > F.col("before"),
        "overlap": F.col("frame_start") < F.col("before"),
        "first block missing": F.col("before").isNull() & (F.col("frame_start") != 0),
    }
    kinds = F.array(*[F.when(c, F.lit(k)) for k, c in broken.items()])
    return rows.select("traj_id", "block_id", F.explode(F.array_compact(kinds)).alias("violation"))


def batch_screen(coords: DataFrame, queries: DataFrame, size: int = BLOCK) -> DataFrame:
    """Counts of blocks by verdict for a table of (query_id, tau), over one pass of bounds.

    The distinct thresholds go sorted to the tasks. There a block is no pair with each of them: its bounds are placed among them by
    binary search, places are counted, and running sums over the places give the counts of every threshold.
    """
    taus = np.sort(queries.select("tau").distinct().toArrow()["tau"].to_numpy())
    bounds = block_bounds(coords, size).filter("lower is not null").select("lower", "upper")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, len(taus) + 1), np.int64)
        for b in batches:
            low, high = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for n, at in zip(counts, (np.searchsorted(taus, low, "right"), np.searchsorted(taus, high[~np.isnan(high)], "right")), strict=True):
                n += np.bincount(at, minlength=len(taus) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(taus) + 1)), *map(pa.array, counts)], ["place", "n_low", "n_high"])

    counted = bounds.mapInArrow(place, "place long, n_low long, n_high long").groupBy("place").agg(F.sum("n_low").alias("n_low"), F.sum("n_high").alias("n_high"))
    # A threshold at place p is above the bounds placed up to p and not above the others. One row per distinct threshold.
    t = counted.toPandas().set_index("place").reindex(range(len(taus) + 1), fill_value=0)
    below, true = t["n_low"].cumsum().to_numpy(), t["n_high"].cumsum().to_numpy()
    total = int(t["n_low"].sum())
    rows = [(float(tau), int(true[i]), total - int(below[i]), int(below[i] - true[i])) for i, tau in enumerate(taus)]
    found = coords.sparkSession.createDataFrame(rows, "tau double, n_true long, n_false long, n_unknown long")
    return queries.join(found, "tau").select("query_id", "n_true", "n_false", "n_unknown")


def plan_compare(counts: DataFrame, scan_cost: float = 1.0, index_cost: float = 1.2, bound_cost: float = 0.02) -> DataFrame:
    """Costs in units of one full scan: direct, with bounds, and the number of queries from which the index pays."""
    direct = F.lit(scan_cost)
    one = F.lit(bound_cost) + (1 - F.col("pruned_percent") / 100) * scan_cost
    return counts.select("traj_id", direct.alias("direct"), one.alias("indexed"), F.when(one < direct, F.ceil(F.lit(index_cost) / (direct - one))).alias("break_even"))


#: Weights of reading, computing, seeking and compiling, and what each way of answering needs of them: at least, and in
#: proportion to the share of blocks that stays open. A full scan reads 100; building an index costs more than one scan.
WEIGHTS = {"io": 1.0, "cpu": 0.05, "refine": 2.0, "compile": 0.1}
WAYS = {
    "direct": ({"io": 100.0, "cpu": 50.0}, {}),
    "flat": ({"compile": 2.0, "io": 5.0, "cpu": 5.0}, {"io": 95.0, "cpu": 45.0}),
    "hierarchical": ({"compile": 5.0, "io": 2.0}, {"io": 30.0, "refine": 10.0}),
}
BUILD = {"io": 110.0, "cpu": 80.0}


def plan_costs(counts: DataFrame, queries: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """traj_id, workload, direct, flat, hierarchical, cheapest: what an answer costs by scanning, by one level of bounds and by several, for
    trajectories (traj_id, pruned_percent) and a handful of workloads (workload, remaining, indexed, cached). An index that is not there yet is
    shared out among the remaining queries; what is cached is taken from there. The first of equals is the cheapest."""
    weigh = lambda needs: sum(weights[k] * v for k, v in needs.items())
    rows = counts.select("traj_id", (1 - F.col("pruned_percent") / 100).alias("open")).join(F.broadcast(queries))
    share = F.when(F.col("indexed"), 0.0).otherwise(weigh(BUILD) / F.greatest(F.col("remaining"), F.lit(1)))
    costs = {n: F.lit(weigh(least)) + F.lit(weigh(more)) * F.col("open") + (share if n != "direct" else 0.0) for n, (least, more) in WAYS.items()}
    rows = rows.select("traj_id", "workload", "cached", *[c.alias(n) for n, c in costs.items()])
    least = F.least(*WAYS)
    return rows.select("traj_id", "workload", *WAYS, F.when(F.col("cached"), "cache").otherwise(F.coalesce(*[F.when(F.col(n) == least, n) for n in WAYS])).alias("cheapest"))


def ledger_verify(ledger: DataFrame) -> DataFrame:
    """Per ledger whether digests recompute and each names the one before: (ledger_id, seq, body, prev, digest)."""
    w = Window.partitionBy("ledger_id").orderBy("seq")
    again = F.sha2(F.concat_ws("|", "prev", F.col("seq").cast("string"), "body"), 256)
    rows = ledger.withColumns({"good": again == F.col("digest"), "chained": F.col("prev") == F.coalesce(F.lag("digest").over(w), F.lit(""))})
    return rows.groupBy("ledger_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("good").alias("digests_ok"), F.bool_and("chained").alias("chain_ok"))
