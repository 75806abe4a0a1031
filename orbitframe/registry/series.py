"""Registered episode, interval and series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.functions.geometry import r6
from orbitframe.operators import series as s
from orbitframe.plans import certified as c
from orbitframe.registry.structure import _turn, rounded
from orbitframe.sources import views as v
from orbitframe.sources.views import sql


KINDS = ("helix", "strand", "turn", "coil")


def _eps(p, d, flag):
    return c.episodes(v.ev(p, d), flag)


def _dur(p, d, frames, **kw):
    return c.duration_verdicts(v.ev(p, d).withColumn("f", F.when(F.col("frame") % 11 != 5, F.col("flag_a"))), frames * 10.0, 10.0, "f", **kw)


def _phase(p, d):
    return v.ev(p, d).withColumn("a", (F.col("value") * 37) % 360 - 180)


def _phi(p, d):
    return s.backbone_dihedrals(v.te_full(p, d))


def _counts(p, d):
    return v.ev(p, d).groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"))


def _ramachandran(p, d):
    kind, region = s.ramachandran(F.col("phi"), F.col("psi"), F.col("resname"), F.col("n_name"))
    return _phi(p, d).filter("phi is not null and psi is not null").select("traj_id", "frame", "chain", "residue", kind.alias("kind"), region.alias("region"))


QUERIES = {
    "episodes": lambda p, d: _eps(p, d, "flag_a"),
    "uninterrupted_lifetimes": lambda p, d: s.lifetimes(v.ev(p, d), "flag_a").select("traj_id", F.col("n").cast("long").alias("n"), "length"),
    "merge_intervals": lambda p, d: s.merge_intervals(_eps(p, d, "flag_a").unionByName(_eps(p, d, "flag_b").select("traj_id", "k_s", (F.col("k_e") + 1).alias("k_e")))),
    "duration_for": lambda p, d: _dur(p, d, 3).select("traj_id", "longest", "verdict"),
    "duration_possible": lambda p, d: _dur(p, d, 4),
    "frame_intervals": lambda p, d: rounded(s.frame_intervals(v.ev(p, d))),
    "time_weighted_occupancy": lambda p, d: rounded(s.time_weighted_occupancy(v.ev(p, d), "flag_a")),
    "frame_time": lambda p, d: v.te(p, d).select("traj_id", "frame", "t_ps").distinct().select("traj_id", "frame", r6(F.col("t_ps")).alias("t_ps"), r6(F.col("t_ps") / 1000).alias("t_ns"), F.lit("INFERRED").alias("source")),
    "unwrap_pbc_time": lambda p, d: rounded(s.unwrap_time(v.te(p, d))),
    "unwrap_pbc_frame": lambda p, d: rounded(s.unwrap_frame(v.te(p, d))),
    "dihedral_unwrap": lambda p, d: rounded(s.unwrap_phase(_phase(p, d), "a").select("traj_id", "frame", "phase")),
    "dihedral_circular_stats": lambda p, d: rounded(_phase(p, d).groupBy("traj_id").agg(F.avg(F.sin(F.radians("a"))).alias("s"), F.avg(F.cos(F.radians("a"))).alias("c")).select("traj_id", F.degrees(F.atan2("s", "c")).alias("mean"), (1 - F.sqrt(F.col("s") ** 2 + F.col("c") ** 2)).alias("variance"))),
    "autocorrelation": lambda p, d: rounded(s.autocorrelation(v.ev(p, d), "value")),
    "effective_sample_size": lambda p, d: rounded(s.effective_sample_size(s.autocorrelation(v.ev(p, d), "value"), _counts(p, d))),
    "block_averaging": lambda p, d: rounded(s.block_averaging(v.ev(p, d), "value", 400)),
    "drift_convergence": lambda p, d: rounded(s.drift_convergence(v.ev(p, d), "value")),
    "event_before": lambda p, d: s.event_before(_eps(p, d, "flag_a"), _eps(p, d, "flag_b")),
    "event_after": lambda p, d: s.event_before(_eps(p, d, "flag_b"), _eps(p, d, "flag_a")),
    "event_followed_by": lambda p, d: s.event_gap(_eps(p, d, "flag_a"), _eps(p, d, "flag_b"), True).select("traj_id", "gap", (F.coalesce(F.col("gap") * 10 <= 20, F.lit(False))).alias("verdict")),
    "event_within": lambda p, d: s.event_gap(_eps(p, d, "flag_a"), _eps(p, d, "flag_b"), False).select("traj_id", "gap", (F.coalesce(F.col("gap") * 10 <= 20, F.lit(False))).alias("verdict")),
    "backbone_dihedrals": lambda p, d: rounded(_phi(p, d).select("traj_id", "frame", "chain", "residue", "phi", "psi", "omega")),
    "secondary_structure": lambda p, d: _phi(p, d).select("traj_id", "frame", "chain", "residue", s.secondary_structure(F.col("phi"), F.col("psi")).alias("ss")),
    "ss_fractions": lambda p, d: rounded(_phi(p, d).withColumn("ss", s.secondary_structure(F.col("phi"), F.col("psi"))).groupBy("traj_id", "frame").agg(*[F.avg((F.col("ss") == k).cast("double")).alias(k) for k in KINDS])),
    "ramachandran": _ramachandran,
    "chain_breaks": lambda p, d: rounded(s.neighbours(v.te_full(p, d).filter("residue <> 3"), "C", "N").filter("d > 2.5 OR next <> residue + 1")),
    "peptide_bonds": lambda p, d: rounded(s.neighbours(v.te_full(p, d), "C", "N").filter("d <= 2.5")),
    "phosphodiester_bonds": lambda p, d: rounded(s.neighbours(v.te_full(p, d).withColumn("name", F.when(F.col("name") == "O", "O3'").when(F.col("name") == "N", "P").otherwise(F.col("name"))), "O3'", "P").withColumn("valid", F.col("d").between(1.3, 1.9))),
    "backbone_geometry": lambda p, d: s.neighbours(v.te_full(p, d), "CA", "CA").groupBy("traj_id", "frame").agg(F.count_if(~F.col("d").between(2.9, 4.8)).alias("n_design"), F.count_if(~F.col("d").between(3.2, 4.3)).alias("n_implausible")),
    "missing_ranges": lambda p, d: s.observed_sequence(v.te_full(p, d).select(F.col("traj_id").alias("key"), "residue", F.substring("resname", 1, 1).alias("letter")).distinct(), v.te_full(p, d).filter("residue NOT IN (2, 3)").select(F.col("traj_id").alias("key"), "residue")),
    "stream_occupancy_windows": lambda p, d: rounded(v.table(p, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.avg((F.col("value") < 35).cast("double")).alias("share"), F.count(F.lit(1)).alias("n")).select(F.unix_micros(F.col("window.start").cast("timestamp")).alias("start_us"), "event_type", "share", "n")),
}


def _ep(flag, name):
    return f"{name} AS (SELECT traj_id, min(frame) AS k_s, max(frame) + 1 AS k_e FROM (SELECT traj_id, frame, frame - row_number() OVER (PARTITION BY traj_id ORDER BY frame) AS run FROM EV WHERE {flag}) GROUP BY traj_id, run)"


EA, EB = _ep("flag_a", "EA"), _ep("flag_b", "EB")
DUR = """, W AS (SELECT traj_id, frame, CASE WHEN frame % 11 <> 5 THEN flag_a END AS f FROM EV),
    RS AS (SELECT traj_id, max(n) AS longest FROM (SELECT traj_id, count(*) AS n FROM (SELECT traj_id, frame - row_number() OVER (PARTITION BY traj_id ORDER BY frame) AS run FROM W WHERE f) GROUP BY traj_id, run) GROUP BY 1),
    RP AS (SELECT traj_id, max(n) AS possible FROM (SELECT traj_id, count(*) AS n FROM (SELECT traj_id, frame - row_number() OVER (PARTITION BY traj_id ORDER BY frame) AS run FROM W WHERE coalesce(f, true)) GROUP BY traj_id, run) GROUP BY 1),
    R AS (SELECT traj_id, coalesce(longest, 0) AS longest, coalesce(possible, 0) AS possible FROM (SELECT DISTINCT traj_id FROM EV) LEFT JOIN RS USING (traj_id) LEFT JOIN RP USING (traj_id))"""
AC = """, S AS (SELECT traj_id, frame, value AS y, avg(value) OVER w AS m, var_pop(value) OVER w AS v, count(*) OVER w AS n FROM EV WINDOW w AS (PARTITION BY traj_id)),
    AC AS (SELECT a.traj_id, (b.frame - a.frame)::INTEGER AS lag, CASE WHEN any_value(a.v) > 0 THEN avg((a.y - a.m) * (b.y - b.m)) / any_value(a.v) ELSE 1.0 END AS c FROM S a JOIN S b ON a.traj_id = b.traj_id AND b.frame BETWEEN a.frame AND a.frame + least(a.n // 2, 200) GROUP BY 1, 2)"""


def _before(a, b):
    return f""", {EA}, {EB}, X AS (SELECT traj_id, a_e, b_s, o FROM (SELECT traj_id, min(k_e) AS a_e FROM {a} GROUP BY 1) FULL JOIN (SELECT traj_id, max(k_s) AS b_s FROM {b} GROUP BY 1) USING (traj_id)
        LEFT JOIN (SELECT DISTINCT a.traj_id, true AS o FROM {a} a JOIN {b} b ON a.traj_id = b.traj_id AND a.k_s < b.k_e AND b.k_s < a.k_e) USING (traj_id))
        SELECT traj_id, CASE WHEN a_e <= b_s THEN true WHEN o THEN NULL ELSE false END AS verdict FROM X"""


DI = ", R0 AS (SELECT traj_id, frame, chain, residue, any_value(resname) AS resname, " + ", ".join(f"max({n}) FILTER (name = '{a}') AS {p}{n}" for a, p in (("N", "n"), ("CA", "a"), ("C", "c")) for n in "xyz") + " FROM TF GROUP BY 1, 2, 3, 4), R1 AS (SELECT *, lead(resname) OVER w AS n_name, " + ", ".join(f"lag(c{n}) OVER w AS p{n}, lead(n{n}) OVER w AS m{n}, lead(a{n}) OVER w AS d{n}" for n in "xyz") + f" FROM R0 WINDOW w AS (PARTITION BY traj_id, frame, chain ORDER BY residue)), DI AS (SELECT traj_id, frame, chain, residue, resname, n_name, {_turn('p', 'n', 'a', 'c')} AS phi, {_turn('n', 'a', 'c', 'm')} AS psi, {_turn('a', 'c', 'm', 'd')} AS omega FROM R1)"
SS = "CASE WHEN phi IS NULL OR psi IS NULL THEN 'unassigned' WHEN phi BETWEEN -140 AND -30 AND psi BETWEEN -80 AND -10 THEN 'helix' WHEN phi BETWEEN -180 AND -80 AND (psi BETWEEN 80 AND 180 OR psi BETWEEN -180 AND -160) THEN 'strand' WHEN phi BETWEEN 30 AND 90 AND psi BETWEEN 10 AND 80 THEN 'turn' ELSE 'coil' END"


REGION = "CASE WHEN resname = 'GLY' THEN CASE WHEN (phi <= 0 AND psi BETWEEN -80 AND 60) OR (phi >= 0 AND psi BETWEEN -60 AND 80) THEN 'FAVORED' ELSE 'ALLOWED' END WHEN (phi BETWEEN -120 AND -30 AND psi BETWEEN -70 AND -10) OR (phi BETWEEN -180 AND -50 AND (psi BETWEEN 80 AND 180 OR psi BETWEEN -180 AND -160)) THEN 'FAVORED' WHEN (phi BETWEEN 30 AND 90 AND psi BETWEEN 20 AND 80) OR (phi BETWEEN -180 AND 0 AND psi BETWEEN -100 AND 180) THEN 'ALLOWED' ELSE 'OUTLIER' END"


def _next(a, b, where="true"):
    return ", A AS (SELECT traj_id, frame, chain, residue, " + ", ".join(f"max({n}) FILTER (name = '{a}') AS p{n}, max({n}) FILTER (name = '{b}') AS q{n}" for n in "xyz") + f" FROM TF WHERE {where} GROUP BY 1, 2, 3, 4), B AS (SELECT traj_id, frame, chain, residue, lead(residue) OVER w AS next, sqrt(" + " + ".join(f"(p{n} - lead(q{n}) OVER w)**2" for n in "xyz") + ") AS d FROM A WINDOW w AS (PARTITION BY traj_id, frame, chain ORDER BY residue))"


GAP = ", G AS (SELECT a.traj_id, min(b.k_s - a.k_e) AS gap FROM EA a JOIN EB b ON a.traj_id = b.traj_id AND a.k_e <= b.k_s GROUP BY 1), T AS (SELECT DISTINCT traj_id FROM (SELECT traj_id FROM EA UNION ALL SELECT traj_id FROM EB))"
ORACLE_SQL = {
    "episodes": sql("EV", f", {EA} SELECT * FROM EA"),
    "uninterrupted_lifetimes": sql("EV", f", {EA} SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY k_s) AS n, k_e - k_s AS length FROM EA"),
    "merge_intervals": sql("EV", f""", {EA}, {EB}, U AS (SELECT * FROM EA UNION ALL SELECT traj_id, k_s, k_e + 1 FROM EB),
        M AS (SELECT *, sum(fresh) OVER (PARTITION BY traj_id ORDER BY k_s, k_e ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, coalesce((k_s > max(k_e) OVER (PARTITION BY traj_id ORDER BY k_s, k_e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INTEGER, 1) AS fresh FROM U))
        SELECT traj_id, min(k_s) AS k_s, max(k_e) AS k_e FROM M GROUP BY traj_id, run"""),
    "duration_for": sql("EV", f"{DUR} SELECT traj_id, longest, CASE WHEN longest >= 3 THEN true WHEN possible < 3 THEN false END AS verdict FROM R"),
    "duration_possible": sql("EV", f"{DUR} SELECT *, CASE WHEN longest >= 4 THEN true WHEN possible < 4 THEN false END AS verdict, CASE WHEN longest < 4 AND possible >= 4 THEN 'NEEDS_REFINEMENT' ELSE 'COMPLETE' END AS resolution FROM R"),
    "frame_intervals": sql("EV", ", I AS (SELECT traj_id, lead(t_ps) OVER (PARTITION BY traj_id ORDER BY frame) - t_ps AS dt FROM EV), J AS (SELECT *, avg(dt) OVER (PARTITION BY traj_id) AS m FROM I WHERE dt IS NOT NULL) SELECT traj_id, round(avg(dt), 6) AS mean_dt, round(min(dt), 6) AS min_dt, round(max(dt), 6) AS max_dt, bool_and(abs(dt - m) <= 1e-4) AS uniform FROM J GROUP BY 1"),
    "time_weighted_occupancy": sql("EV", ", I AS (SELECT traj_id, flag_a, lead(t_ps) OVER (PARTITION BY traj_id ORDER BY frame) - t_ps AS dt FROM EV) SELECT traj_id, round(CASE WHEN sum(dt) FILTER (dt > 0) > 0 THEN coalesce(sum(dt) FILTER (dt > 0 AND flag_a), 0) / sum(dt) FILTER (dt > 0) ELSE avg(flag_a::INTEGER) END, 6) AS occupancy FROM I GROUP BY 1"),
    "frame_time": sql("TE", "SELECT DISTINCT traj_id, frame, t_ps, round(t_ps / 1000, 6) AS t_ns, 'INFERRED' AS source FROM TE"),
    "unwrap_pbc_time": sql("TE", ", J AS (SELECT *, " + ", ".join(f"coalesce(round_even(({n} - lag({n}) OVER w) / 20, 0), 0) AS s{n}" for n in "xyz") + " FROM TE WINDOW w AS (PARTITION BY traj_id, atom_id ORDER BY frame)) SELECT traj_id, frame, atom_id, " + ", ".join(f"round({n} - 20 * sum(s{n}) OVER w, 6) + 0.0 AS {n}" for n in "xyz") + " FROM J WINDOW w AS (PARTITION BY traj_id, atom_id ORDER BY frame)"),
    "unwrap_pbc_frame": sql("TE", "SELECT traj_id, frame, atom_id, " + ", ".join(f"round({n} - 20 * round_even(({n} - f{n}) / 20, 0), 6) + 0.0 AS {n}" for n in "xyz") + " FROM (SELECT *, first(x) OVER w AS fx, first(y) OVER w AS fy, first(z) OVER w AS fz FROM TE WINDOW w AS (PARTITION BY traj_id, frame ORDER BY atom_id))"),
    "dihedral_unwrap": sql("EV", ", A AS (SELECT traj_id, frame, (value * 37) % 360 - 180 AS a FROM EV), J AS (SELECT *, coalesce(round_even((a - lag(a) OVER w) / 360, 0), 0) AS s FROM A WINDOW w AS (PARTITION BY traj_id ORDER BY frame)) SELECT traj_id, frame, round(a - 360 * sum(s) OVER (PARTITION BY traj_id ORDER BY frame), 6) + 0.0 AS phase FROM J"),
    "dihedral_circular_stats": sql("EV", "SELECT traj_id, round(degrees(atan2(s, c)), 6) AS mean, round(1 - sqrt(s*s + c*c), 6) AS variance FROM (SELECT traj_id, avg(sin(radians((value * 37) % 360 - 180))) AS s, avg(cos(radians((value * 37) % 360 - 180))) AS c FROM EV GROUP BY 1)"),
    "autocorrelation": sql("EV", f"{AC} SELECT traj_id, lag, round(c, 6) + 0.0 AS c FROM AC"),
    "effective_sample_size": sql("EV", f"{AC}, K AS (SELECT traj_id, coalesce(min(lag) FILTER (lag > 0 AND c <= 0.05), 1000000000) AS k FROM AC GROUP BY 1), U AS (SELECT traj_id, coalesce(sum(c) FILTER (lag > 0 AND lag < k), 0) AS tau FROM AC JOIN K USING (traj_id) GROUP BY 1) SELECT traj_id, n, round(tau, 6) + 0.0 AS tau, round(greatest(1, 1 + 2 * tau), 6) AS g, greatest(1, least(n, floor(n / greatest(1, 1 + 2 * tau))::BIGINT)) AS n_eff FROM U JOIN (SELECT traj_id, count(*) AS n FROM EV GROUP BY 1) USING (traj_id)"),
    "block_averaging": sql("EV", f", B AS (SELECT traj_id, size::INTEGER AS size, frame // size AS b, avg(value) AS m FROM (SELECT *, count(*) OVER (PARTITION BY traj_id) AS n FROM EV), (SELECT unnest({s.block_sizes(400)}) AS size) WHERE size <= n // 4 AND (frame // size + 1) * size <= n GROUP BY 1, 2, 3) SELECT traj_id, size, count(*) AS n_blocks, round(stddev_samp(m) / sqrt(count(*)), 6) AS sem FROM B GROUP BY 1, 2"),
    "drift_convergence": sql("EV", ", H AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY traj_id) AS n FROM EV) WHERE frame >= n // 2) SELECT traj_id, round(slope, 6) + 0.0 AS slope, round(sd, 6) AS sd, CASE WHEN n < 10 THEN 'INSUFFICIENT' WHEN abs(slope) * m < sd OR abs(slope) < 1e-3 THEN 'STATIONARY' ELSE 'DRIFTING' END AS status FROM (SELECT traj_id, regr_slope(value, frame) AS slope, stddev_pop(value) AS sd, count(*) AS m, any_value(n) AS n FROM H GROUP BY 1)"),
    "event_before": sql("EV", _before("EA", "EB")),
    "event_after": sql("EV", _before("EB", "EA")),
    "event_followed_by": sql("EV", f", {EA}, {EB}{GAP} SELECT traj_id, gap, coalesce(gap * 10 <= 20, false) AS verdict FROM T LEFT JOIN G USING (traj_id)"),
    "event_within": sql("EV", f", {EA}, {EB}{GAP}, N AS (SELECT a.traj_id, min(greatest(0, b.k_s - a.k_e, a.k_s - b.k_e)) AS gap FROM EA a JOIN EB b ON a.traj_id = b.traj_id GROUP BY 1) SELECT traj_id, gap, coalesce(gap * 10 <= 20, false) AS verdict FROM T LEFT JOIN N USING (traj_id)"),
    "backbone_dihedrals": sql("TF", f"{DI} SELECT traj_id, frame, chain, residue, round(phi, 6) + 0.0 AS phi, round(psi, 6) + 0.0 AS psi, round(omega, 6) + 0.0 AS omega FROM DI"),
    "secondary_structure": sql("TF", f"{DI} SELECT traj_id, frame, chain, residue, {SS} AS ss FROM DI"),
    "ss_fractions": sql("TF", f"{DI}, S AS (SELECT traj_id, frame, {SS} AS ss FROM DI) SELECT traj_id, frame, " + ", ".join(f"round(avg((ss = '{k}')::INTEGER), 6) AS {k}" for k in KINDS) + " FROM S GROUP BY 1, 2"),
    "ramachandran": sql("TF", f"{DI} SELECT traj_id, frame, chain, residue, CASE WHEN resname = 'GLY' THEN 'GLYCINE' WHEN resname = 'PRO' THEN 'PROLINE' WHEN n_name = 'PRO' THEN 'PRE_PROLINE' ELSE 'GENERAL' END AS kind, {REGION} AS region FROM DI WHERE phi IS NOT NULL AND psi IS NOT NULL"),
    "chain_breaks": sql("TF", _next("C", "N", "residue <> 3") + " SELECT traj_id, frame, chain, residue, next, round(d, 6) AS d FROM B WHERE next IS NOT NULL AND (d > 2.5 OR next <> residue + 1)"),
    "peptide_bonds": sql("TF", _next("C", "N") + " SELECT traj_id, frame, chain, residue, next, round(d, 6) AS d FROM B WHERE d <= 2.5"),
    "phosphodiester_bonds": sql("TF", _next("O", "N") + " SELECT traj_id, frame, chain, residue, next, round(d, 6) AS d, d BETWEEN 1.3 AND 1.9 AS valid FROM B WHERE next IS NOT NULL"),
    "backbone_geometry": sql("TF", _next("CA", "CA") + " SELECT traj_id, frame, count(*) FILTER (NOT d BETWEEN 2.9 AND 4.8) AS n_design, count(*) FILTER (NOT d BETWEEN 3.2 AND 4.3) AS n_implausible FROM B WHERE next IS NOT NULL GROUP BY 1, 2"),
    "missing_ranges": sql("TF", "SELECT traj_id AS key, string_agg(CASE WHEN residue IN (2, 3) THEN '-' ELSE letter END, '' ORDER BY residue) AS shown, 2::BIGINT AS n_missing FROM (SELECT DISTINCT traj_id, residue, substr(resname, 1, 1) AS letter FROM TF) GROUP BY 1"),
    "stream_occupancy_windows": "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, event_type, round(avg((value < 35)::INTEGER), 6) AS share, count(*) AS n FROM events GROUP BY 1, 2",
}
