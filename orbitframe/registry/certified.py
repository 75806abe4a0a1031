"""Registered queries of the certified core, over the long two-group trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitframe.functions.geometry import r6
from orbitframe.operators.graphs import stored
from orbitframe.plans import certified as c
from orbitframe.plans import pyramid
from orbitframe.sources import views as v
from orbitframe.sources.views import sql

TAU = 4.0


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


@v.once("lineitem")
def index(spark: SparkSession, sf: str) -> pyramid.Pyramid:
    """Bounds and clustered coordinates of the long trajectories."""
    return pyramid.build(v.tl(spark, sf))


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    return pyramid.frame_truth(index(spark, sf), TAU)


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return pyramid.truth_spans(index(spark, sf), TAU)


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    return pyramid.evidence_table(index(spark, sf), TAU)


def _flipped(spark: SparkSession, sf: str) -> DataFrame:
    """A series of truths that is wrong in some frames."""
    return _truth(spark, sf).withColumn("truth", F.when(F.col("frame") % 97 == 5, ~F.col("truth")).otherwise(F.col("truth")))


def _quantified(spark: SparkSession, sf: str) -> DataFrame:
    spans = stored(_spans(spark, sf))
    parts = [pyramid.query_verdict(spans, kind, 50.0).withColumn("quantifier", F.lit(kind)) for kind in ("EXISTS", "FORALL", "DURATION")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence with a fault of each kind."""
    rows, k = _evidence(spark, sf), F.col("block_id") % 50
    return rows.withColumns({
        "verdict": F.when(k == 7, ~F.coalesce("verdict", F.lit(False))).otherwise(F.col("verdict")),
        "frame_start": F.col("frame_start") + (k == 13).cast("int"),
        "frame_end": F.col("frame_end") + (k == 21).cast("int"),
        "lower": F.when(k == 33, F.lit(-1.0)).otherwise(F.col("lower")),
        "upper": F.when(k == 41, F.col("lower") / 2).otherwise(F.col("upper")),
    })


#: Workloads to compare ways of answering for: one query, some, many; an index that is there; a cached answer.
WORKLOADS = [("one", 1, False, False), ("some", 3, False, False), ("many", 100, False, False), ("none", 0, False, False), ("indexed", 1, True, False), ("cached", 1, True, True)]
BOUNDS = [f"{e}_{n}" for n in "xyz" for e in ("min", "max")]
QUERIES = {
    "block_aabb": lambda s, d: _rounded(c.block_aabb(v.tl(s, d)).select("traj_id", "group_id", "block_id", "frame_start", "frame_end", *BOUNDS), *BOUNDS),
    "block_kdop14": lambda s, d: c.block_kdop14(v.tl(s, d)).select("traj_id", "group_id", "block_id", *[r6(F.get(side, F.lit(i))).alias(f"{side}_{i}") for side in ("lows", "highs") for i in range(7)]),
    "block_pair_join": lambda s, d: _rounded(c.block_pairs(c.block_aabb(v.tl(s, d))).select("traj_id", "block_id", F.col("a.min_x").alias("a_min_x"), F.col("b.min_x").alias("b_min_x")), "a_min_x", "b_min_x"),
    "pair_min_distance": lambda s, d: _rounded(c.pair_min_distance(v.tl(s, d)), "d_min"),
    "predicate_series": lambda s, d: c.pair_min_distance(v.tl(s, d)).select("traj_id", "frame", c.compare(F.col("d_min"), "<", c.threshold(0.4, "nm")).alias("truth")),
    "block_verdicts": lambda s, d: _rounded(c.block_verdicts(v.tl(s, d), TAU), "lower", "upper"),
    "block_verdicts_kdop": lambda s, d: _rounded(c.block_verdicts(v.tl(s, d), TAU, model="kdop"), "lower", "upper"),
    "prune_semi_join": lambda s, d: _rounded(c.prune_semi_join(v.tl(s, d), c.block_verdicts(v.tl(s, d), TAU)).select("traj_id", "frame", "block_id", "atom_id", "x"), "x"),
    "exact_frames": lambda s, d: _rounded(c.exact_frames(v.tl(s, d), c.block_verdicts(v.tl(s, d), TAU), TAU), "d_min"),
    "frame_truth": _truth,
    "oracle_diff": lambda s, d: _flipped(s, d).join(c.pair_min_distance(v.tl(s, d)), ["traj_id", "frame"]).filter(F.col("truth") != (F.col("d_min") < TAU)).select("traj_id", "frame", "truth"),
    "witness_intervals": lambda s, d: pyramid.witness_intervals(_spans(s, d)),
    "query_verdict": _quantified,
    "quantifier_exists": lambda s, d: c.block_verdicts(v.tl(s, d), TAU).groupBy("traj_id").agg(c.exists_(F.col("verdict")).alias("verdict")),
    "quantifier_forall": lambda s, d: c.block_verdicts(v.tl(s, d), TAU).groupBy("traj_id").agg(c.forall_(F.col("verdict")).alias("verdict")),
    "evidence_table": lambda s, d: _rounded(_evidence(s, d), "lower", "upper", "t_start_ns", "t_end_ns"),
    "evidence_counts": lambda s, d: _rounded(c.evidence_counts(_evidence(s, d)), "pruned_percent", "io_pruned"),
    "verify_evidence": lambda s, d: c.verify_evidence(_broken(s, d), TAU),
    "refine_dyadic": lambda s, d: pyramid.refine_dyadic(index(s, d), TAU).groupBy("traj_id", "size").agg(F.count(F.lit(1)).alias("n"), F.count_if("verdict").alias("n_true"), F.count_if(~F.col("verdict")).alias("n_false")),
    "batch_screen": lambda s, d: c.batch_screen(v.tl(s, d), s.range(150).select(F.col("id").alias("query_id"), (1.0 + F.col("id") * 0.2).alias("tau"))),
    "plan_compare": lambda s, d: _rounded(c.plan_compare(c.evidence_counts(_evidence(s, d))), "direct", "indexed"),
    "plan_costs": lambda s, d: _rounded(c.plan_costs(c.evidence_counts(_evidence(s, d)), s.createDataFrame(WORKLOADS, "workload string, remaining int, indexed boolean, cached boolean")), *c.WAYS),
    "ledger_verify": lambda s, d: c.ledger_verify(_ledger(s, d)),
    "distance_series_stats": lambda s, d: _rounded(c.pair_min_distance(v.tl(s, d)).groupBy("traj_id").agg(F.avg("d_min").alias("mean"), F.min("d_min").alias("min"), F.max("d_min").alias("max"), F.count("d_min").alias("n")), "mean", "min", "max"),
    "certified_query": lambda s, d: pyramid.query_verdict(_spans(s, d), "DURATION", 50.0),
}


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    """A chain per order, each line's digest covering the one before it; in some orders a body is changed, in others a line is gone."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    lines = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ledger_id"), F.row_number().over(w).alias("seq"), F.col("l_partkey").cast("string").alias("body"))
    rows = lines.groupBy("ledger_id").agg(F.array_sort(F.collect_list(F.struct("seq", "body"))).alias("rows"))

    def link(acc, row):
        prev = F.coalesce(F.get(acc, F.size(acc) - 1)["digest"], F.lit(""))
        digest = F.sha2(F.concat_ws("|", prev, row["seq"].cast("string"), row["body"]), 256)
        return F.concat(acc, F.array(F.struct(row["seq"].alias("seq"), row["body"].alias("body"), prev.alias("prev"), digest.alias("digest"))))

    empty = F.array().cast("array<struct<seq:int,body:string,prev:string,digest:string>>")
    chained = rows.select("ledger_id", F.inline(F.aggregate("rows", empty, link)))
    changed = chained.withColumn("body", F.when((F.col("ledger_id") % 10 == 3) & (F.col("seq") == 1), "0").otherwise(F.col("body")))
    return changed.filter(~((F.col("ledger_id") % 10 == 7) & (F.col("seq") == 2)))


def _axis(n: str) -> tuple[str, str]:
    d = f"abs((a.min_{n} + a.max_{n}) / 2 - (b.min_{n} + b.max_{n}) / 2 - 80 * round_even(((a.min_{n} + a.max_{n}) / 2 - (b.min_{n} + b.max_{n}) / 2) / 80, 0))"
    both = f"((a.max_{n} - a.min_{n}) / 2 + (b.max_{n} - b.min_{n}) / 2)"
    return f"greatest(0, {d} - {both})", f"least({d} + {both}, 40)"


_LOW, _HIGH = (" + ".join(f"({_axis(n)[k]})**2" for n in "xyz") for k in (0, 1))


def _bounds(size: int, name: str = "BB", source: str = "TL") -> str:
    ends = ", ".join(f"{e}({n}) AS {e}_{n}" for n in "xyz" for e in ("min", "max"))
    return f"{name} AS (SELECT traj_id, group_id, frame // {size} AS block_id, min(frame) AS frame_start, max(frame) + 1 AS frame_end, {ends} FROM {source} GROUP BY 1, 2, 3)"


def _verdicts(name: str = "V", bounds: str = "BB") -> str:
    return f"""{name} AS (SELECT *, CASE WHEN upper < 4 THEN true WHEN lower >= 4 THEN false END AS verdict FROM (
        SELECT a.traj_id, a.block_id, a.frame_start, a.frame_end, sqrt({_LOW}) AS lower, sqrt({_HIGH}) AS upper
        FROM {bounds} a JOIN {bounds} b ON a.traj_id = b.traj_id AND a.block_id = b.block_id AND a.group_id = 0 AND b.group_id = 1) q)"""


_MIN = """D AS (SELECT a.traj_id, a.frame, min(sqrt(""" + " + ".join(f"(a.{n} - b.{n} - 80 * round_even((a.{n} - b.{n}) / 80, 0))**2" for n in "xyz") + """)) AS d_min
    FROM TL a JOIN TL b ON a.traj_id = b.traj_id AND a.frame = b.frame AND a.group_id = 0 AND b.group_id = 1 GROUP BY 1, 2)"""
_FT = """FT AS (SELECT d.traj_id, d.frame, d.frame // 10 AS block_id, d.d_min < 4 AS truth, v.verdict IS NOT NULL AS certified FROM D d JOIN V v ON v.traj_id = d.traj_id AND v.block_id = d.frame // 10)"""
_EP = """EP AS (SELECT traj_id, min(frame) AS k_s, max(frame) + 1 AS k_e FROM (SELECT traj_id, frame, frame - row_number() OVER (PARTITION BY traj_id ORDER BY frame) AS run FROM FT WHERE truth) GROUP BY traj_id, run)"""
_ET = """ET AS (SELECT v.traj_id, v.block_id, frame_start, frame_end, lower, upper, frame_start * 10.0 / 1000 AS t_start_ns, frame_end * 10.0 / 1000 AS t_end_ns, verdict,
    CASE WHEN verdict THEN 'CERTIFIED_TRUE' WHEN NOT verdict THEN 'CERTIFIED_FALSE' WHEN every_ THEN 'EXACT_TRUE' WHEN NOT some_ THEN 'EXACT_FALSE' ELSE 'REFINED' END AS status
    FROM V v JOIN (SELECT traj_id, frame // 10 AS block_id, bool_and(d_min < 4) AS every_, bool_or(d_min < 4) AS some_ FROM D GROUP BY 1, 2) e USING (traj_id, block_id))"""
_EC = """EC AS (SELECT traj_id, count(*) AS n_blocks, count(*) FILTER (status = 'CERTIFIED_TRUE') AS n_certified_true, count(*) FILTER (status = 'CERTIFIED_FALSE') AS n_certified_false, count(*) FILTER (status = 'EXACT_TRUE') AS n_exact_true,
    count(*) FILTER (status = 'EXACT_FALSE') AS n_exact_false, count(*) FILTER (status = 'REFINED') AS n_refined, 100.0 * count(*) FILTER (verdict IS NOT NULL) / count(*) AS pruned_percent,
    1 - sum(CASE WHEN verdict IS NULL THEN frame_end - frame_start ELSE 0 END) / sum(frame_end - frame_start) AS io_pruned FROM ET GROUP BY 1)"""
_BV = f", {_bounds(10)}, {_verdicts()}"


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


_DIRS = ["x", "y", "z", "(x+y+z)/sqrt(3)", "(x+y-z)/sqrt(3)", "(x-y+z)/sqrt(3)", "(-x+y+z)/sqrt(3)"]
_KD = ", KD AS (SELECT traj_id, group_id, frame // 10 AS block_id, min(frame) AS frame_start, max(frame) + 1 AS frame_end, " + ", ".join(f"min({p}) AS l{i}, max({p}) AS h{i}" for i, p in enumerate(_DIRS)) + " FROM TL GROUP BY 1, 2, 3)"
_GAP = [f"greatest(0, a.l{i} - b.h{i}, b.l{i} - a.h{i})" for i in range(7)]
_SPAN = " + ".join(f"greatest(a.h{i} - b.l{i}, b.h{i} - a.l{i})**2" for i in range(3))
ORACLE_SQL = {
    "block_aabb": sql("TL", f", {_bounds(10)} SELECT traj_id, group_id, block_id, frame_start, frame_end, {_r(*BOUNDS)} FROM BB"),
    "block_kdop14": sql("TL", _KD + " SELECT traj_id, group_id, block_id, " + ", ".join(f"round({s[0]}{i}, 6) + 0.0 AS {s}_{i}" for s in ("lows", "highs") for i in range(7)) + " FROM KD"),
    "block_pair_join": sql("TL", f", {_bounds(10)} SELECT a.traj_id, a.block_id, round(a.min_x, 6) AS a_min_x, round(b.min_x, 6) AS b_min_x FROM BB a JOIN BB b ON a.traj_id = b.traj_id AND a.block_id = b.block_id AND a.group_id = 0 AND b.group_id = 1"),
    "pair_min_distance": sql("TL", f", {_MIN} SELECT traj_id, frame, {_r('d_min')} FROM D"),
    "predicate_series": sql("TL", f", {_MIN} SELECT traj_id, frame, d_min < 4 AS truth FROM D"),
    "block_verdicts": sql("TL", f"{_BV} SELECT traj_id, block_id, frame_start, frame_end, {_r('lower', 'upper')}, verdict FROM V"),
    "block_verdicts_kdop": sql("TL", _KD + f"""SELECT traj_id, block_id, frame_start, frame_end, {_r('lower', 'upper')}, CASE WHEN upper < 4 THEN true WHEN lower >= 4 THEN false END AS verdict FROM (
        SELECT a.traj_id, a.block_id, a.frame_start, a.frame_end, greatest(sqrt({' + '.join(f'({x})**2' for x in _GAP[:3])}), {', '.join(_GAP[3:])}) AS lower, sqrt({_SPAN}) AS upper
        FROM KD a JOIN KD b ON a.traj_id = b.traj_id AND a.block_id = b.block_id AND a.group_id = 0 AND b.group_id = 1) q"""),
    "prune_semi_join": sql("TL", f"{_BV} SELECT t.traj_id, frame, frame // 10 AS block_id, atom_id, round(x, 6) AS x FROM TL t JOIN V v ON v.traj_id = t.traj_id AND v.block_id = frame // 10 WHERE verdict IS NULL"),
    "exact_frames": sql("TL", f"{_BV}, {_MIN} SELECT d.traj_id, frame, {_r('d_min')}, d_min < 4 AS truth FROM D d JOIN V v ON v.traj_id = d.traj_id AND v.block_id = frame // 10 WHERE verdict IS NULL"),
    "frame_truth": sql("TL", f"{_BV}, {_MIN}, {_FT} SELECT * FROM FT"),
    "oracle_diff": sql("TL", f", {_MIN} SELECT traj_id, frame, d_min >= 4 AS truth FROM D WHERE frame % 97 = 5"),
    "witness_intervals": sql("TL", f"{_BV}, {_MIN}, {_FT}, {_EP} SELECT * FROM EP"),
    "query_verdict": sql("TL", f"""{_BV}, {_MIN}, {_FT}, {_EP} SELECT traj_id, bool_or(truth) AS verdict, 'COMPLETE' AS resolution, 'EXISTS' AS quantifier FROM FT GROUP BY 1
        UNION ALL SELECT traj_id, bool_and(truth), 'COMPLETE', 'FORALL' FROM FT GROUP BY 1
        UNION ALL SELECT traj_id, coalesce(max(k_e - k_s) >= 5, false), 'COMPLETE', 'DURATION' FROM (SELECT DISTINCT traj_id FROM FT) LEFT JOIN EP USING (traj_id) GROUP BY 1"""),
    "quantifier_exists": sql("TL", f"{_BV} SELECT traj_id, CASE WHEN bool_or(verdict) THEN true WHEN count(*) FILTER (verdict IS NULL) = 0 THEN false END AS verdict FROM V GROUP BY 1"),
    "quantifier_forall": sql("TL", f"{_BV} SELECT traj_id, CASE WHEN NOT bool_and(verdict) THEN false WHEN count(*) FILTER (verdict IS NULL) = 0 THEN true END AS verdict FROM V GROUP BY 1"),
    "evidence_table": sql("TL", f"{_BV}, {_MIN}, {_ET} SELECT traj_id, block_id, frame_start, frame_end, {_r('lower', 'upper', 't_start_ns', 't_end_ns')}, verdict, status FROM ET"),
    "evidence_counts": sql("TL", f"{_BV}, {_MIN}, {_ET}, {_EC} SELECT * REPLACE (round(pruned_percent, 6) AS pruned_percent, round(io_pruned, 6) AS io_pruned) FROM EC"),
    "verify_evidence": sql("TL", f"""{_BV}, {_MIN}, {_ET}, X AS (SELECT traj_id, block_id, frame_start + (block_id % 50 = 13)::INTEGER AS s, frame_end + (block_id % 50 = 21)::INTEGER AS e, CASE WHEN block_id % 50 = 33 THEN -1 ELSE lower END AS l,
        CASE WHEN block_id % 50 = 41 THEN lower / 2 ELSE upper END AS u, CASE WHEN block_id % 50 = 7 THEN NOT coalesce(verdict, false) ELSE verdict END AS v FROM ET),
        Y AS (SELECT *, lag(e) OVER (PARTITION BY traj_id ORDER BY s) AS b, CASE WHEN u < 4 THEN true WHEN l >= 4 THEN false END AS i FROM X)
        SELECT traj_id, block_id, 'verdict not implied' AS violation FROM Y WHERE v IS DISTINCT FROM i UNION ALL SELECT traj_id, block_id, 'bounds out of order' FROM Y WHERE l > u UNION ALL SELECT traj_id, block_id, 'negative bound' FROM Y WHERE l < 0
        UNION ALL SELECT traj_id, block_id, 'gap' FROM Y WHERE s > b UNION ALL SELECT traj_id, block_id, 'overlap' FROM Y WHERE s < b UNION ALL SELECT traj_id, block_id, 'first block missing' FROM Y WHERE b IS NULL AND s <> 0"""),
    "refine_dyadic": sql("TL", ", " + ", ".join(f"{_bounds(n, f'B{n}', 'TL' if n == 16 else f'T{n}')}, {_verdicts(f'V{n}', f'B{n}')}" + (f", T{n // 2} AS (SELECT t.* FROM {'TL' if n == 16 else f'T{n}'} t JOIN V{n} v ON v.traj_id = t.traj_id AND v.block_id = frame // {n} WHERE verdict IS NULL)" if n > 1 else "") for n in (16, 8, 4, 2, 1))
        + " " + " UNION ALL ".join(f"SELECT traj_id, {n} AS size, count(*) AS n, count(*) FILTER (verdict) AS n_true, count(*) FILTER (NOT verdict) AS n_false FROM V{n} GROUP BY 1" for n in (16, 8, 4, 2, 1))),
    "batch_screen": sql("TL", f"{_BV} SELECT query_id, count(*) FILTER (upper < tau) AS n_true, count(*) FILTER (upper >= tau AND lower >= tau) AS n_false, count(*) FILTER (upper >= tau AND lower < tau) AS n_unknown FROM V, (SELECT q AS query_id, 1.0::DOUBLE + q * 0.2::DOUBLE AS tau FROM (SELECT unnest(range(150)) AS q)) GROUP BY 1"),
    "plan_compare": sql("TL", f"{_BV}, {_MIN}, {_ET}, {_EC} SELECT traj_id, 1.0::DOUBLE AS direct, round(one, 6) AS indexed, CASE WHEN one < 1 THEN ceil(1.2 / (1.0::DOUBLE - one))::BIGINT END AS break_even FROM (SELECT traj_id, 0.02::DOUBLE + (1 - pruned_percent / 100) AS one FROM EC)"),
    "plan_costs": sql("TL", f"""{_BV}, {_MIN}, {_ET}, {_EC}, W AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {r}, {i}, {k})" for n, r, i, k in WORKLOADS)}) v(workload, remaining, indexed, cached)),
        X AS (SELECT traj_id, workload, cached, 1 - pruned_percent / 100 AS u, CASE WHEN indexed THEN 0.0 ELSE (110.0 + 0.05 * 80.0) / greatest(remaining, 1) END::DOUBLE AS b FROM EC, W),
        Y AS (SELECT traj_id, workload, cached, 102.5::DOUBLE AS direct, 0.2 + b + (5 + u * 95) + 0.05::DOUBLE * (5 + u * 45) AS flat, 0.5 + b + (2 + u * 30) + 2 * (u * 10) AS hierarchical FROM X)
        SELECT traj_id, workload, {_r("direct", "flat", "hierarchical")}, CASE WHEN cached THEN 'cache' WHEN direct <= flat AND direct <= hierarchical THEN 'direct' WHEN flat <= hierarchical THEN 'flat' ELSE 'hierarchical' END AS cheapest FROM Y"""),
    "ledger_verify": "SELECT l_orderkey AS ledger_id, n - (l_orderkey % 10 = 7 AND n >= 2)::INTEGER AS n, l_orderkey % 10 <> 3 OR first = '0' AS digests_ok, NOT (l_orderkey % 10 = 7 AND n >= 3) AS chain_ok FROM (SELECT l_orderkey, count(*) AS n, arg_min(l_partkey::VARCHAR, (l_linenumber, l_partkey)) AS first FROM lineitem GROUP BY 1)",
    "distance_series_stats": sql("TL", f", {_MIN} SELECT traj_id, round(avg(d_min), 6) AS mean, round(min(d_min), 6) AS min, round(max(d_min), 6) AS max, count(*) AS n FROM D GROUP BY 1"),
    "certified_query": sql("TL", f"{_BV}, {_MIN}, {_FT}, {_EP} SELECT traj_id, coalesce(max(k_e - k_s) >= 5, false) AS verdict, 'COMPLETE' AS resolution FROM (SELECT DISTINCT traj_id FROM FT) LEFT JOIN EP USING (traj_id) GROUP BY 1"),
}
