"""Registered re-checks: claims with faults against evidence with faults, and ledgers with faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitframe.operators.graphs import stored
from orbitframe.plans import proofs, pyramid
from orbitframe.registry.certified import _BV, _EP, _ET, _FT, _MIN, TAU, _evidence, _spans
from orbitframe.sources import views as v
from orbitframe.sources.views import sql

KINDS = ("EXISTS", "FORALL", "DURATION")
N_FAULTS = 16


def _claims(spark: SparkSession, sf: str, evidence: DataFrame) -> DataFrame:
    """A claim per trajectory and quantifier; the remainder `fault` of its number says what is wrong with it or its evidence."""
    spans = stored(_spans(spark, sf))
    rows = None
    for q, kind in enumerate(KINDS):
        part = pyramid.query_verdict(spans, kind, 50.0).select("traj_id", (F.col("traj_id") * 3 + q).alias("claim_id"), F.lit(kind).alias("quantifier"), F.col("verdict").alias("truth"), "resolution")
        rows = part if rows is None else rows.unionByName(part)
    fault = F.col("claim_id") % N_FAULTS
    odd = lambda k, wrong, right: F.when(fault == k, wrong).otherwise(right)
    digest = F.sha2(F.concat(F.lit("trajectory "), F.col("traj_id").cast("string")), 256)
    return rows.join(evidence.groupBy("traj_id").agg(F.count(F.lit(1)).alias("blocks")), "traj_id").select(
        "traj_id", "claim_id", "quantifier", "resolution", fault.alias("fault"),
        odd(1, ~F.col("truth"), F.col("truth")).alias("truth"),
        odd(7, F.lit("!="), F.lit("<")).alias("op"),
        F.lit(TAU).alias("tau"),
        odd(13, F.lit(50_000_000.0), F.lit(50.0)).alias("duration"),
        F.lit(10.0).alias("dt"),
        odd(6, F.lit("continuous_physical"), odd(15, F.lit("weekly"), F.lit("sampled_frames"))).alias("sampling"),
        odd(8, F.lit("sphere"), F.lit("orthorhombic_minimum_image")).alias("boundary"),
        odd(9, F.lit("OBB"), F.lit("aabb")).alias("model"),
        odd(2, F.col("blocks") + 1, F.col("blocks")).alias("total_blocks"),
        odd(3, F.lit("0" * 64), digest).alias("trajectory_sha256"),
        digest.alias("index_sha256"),
        odd(4, F.lit("another"), digest).alias("manifest_sha256"),
        odd(5, F.lit(-1), F.lit(10)).alias("bytes_fetched"),
        F.lit(0).alias("frames_decoded"),
        F.lit(None).cast("int").alias("atoms_analyzed"),
    )


def _verify_claims(spark: SparkSession, sf: str) -> DataFrame:
    evidence = stored(_evidence(spark, sf))
    claims = stored(_claims(spark, sf, evidence))
    rows = evidence.join(claims.select("traj_id", "claim_id", "fault"), "traj_id")
    gone = ((F.col("fault") == 10) & F.col("status").isin(*proofs.WITNESS)) | ((F.col("fault") == 11) & (F.col("status") == "CERTIFIED_FALSE"))
    again = rows.filter((F.col("fault") == 12) & (F.col("block_id") % 50 == 8)).withColumns({n: F.col(n) + 3 for n in ("frame_start", "frame_end")})
    rows = rows.filter(~gone).withColumn("status", F.when((F.col("fault") == 14) & (F.col("block_id") % 50 == 7), "CERTIFIED_TRUE").otherwise(F.col("status"))).unionByName(again)
    blocks = proofs.block_violations(claims, rows).groupBy("claim_id", "violation").agg(F.count(F.lit(1)).alias("n"))
    return proofs.claim_violations(claims, rows).withColumn("n", F.lit(1).cast("long")).unionByName(blocks.select("claim_id", "violation", "n"))


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger per order: a record per line, which supersedes the line before it if its part's number divides by three. By the order's
    last digit: 1, a check is changed; 3, a body; 5, the first record's successor is taken out; 7, the second record is."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    lines = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ledger_id"), F.row_number().over(w).alias("seq"), F.col("l_partkey").alias("part"))
    # What is stored are the lines; digests, some hundred bytes a record, are made again wherever the ledger is read, if they are asked for.
    rows = stored(lines.groupBy("ledger_id").agg(F.array_sort(F.collect_list(F.struct("seq", "part"))).alias("rows")))

    def link(acc: Column, row: Column) -> Column:
        previous = F.get(acc, F.size(acc) - 1)["digest"]
        scientific = proofs.scientific_digest(row["part"].cast("string"))
        provenance = proofs.provenance_digest(scientific, F.lit("ok"))
        fields = {"previous": previous, "scientific": scientific, "provenance": provenance, "digest": proofs.chain_digest(previous, scientific, provenance)}
        return F.concat(acc, F.array(F.struct(*[c.alias(n) for n, c in fields.items()])))

    empty = F.array().cast("array<struct<previous:string,scientific:string,provenance:string,digest:string>>")
    chained = rows.select("ledger_id", "rows", F.aggregate("rows", empty, link).alias("links")).select("ledger_id", "rows", "links", F.inline("rows"))
    chained = chained.withColumns({"body": F.col("part").cast("string"), "checks": F.lit("ok"), "link": F.get("links", F.col("seq") - 1)})
    last, name = F.col("ledger_id") % 10, lambda s: F.col("ledger_id") * 100 + s
    part = lambda s: F.get("rows", s - 1)["part"]
    out = chained.select(
        "ledger_id", "seq", name(F.col("seq")).alias("record_id"),
        F.when((last == 3) & (F.col("seq") == 1), "0").otherwise(F.col("body")).alias("body"),
        F.when((last == 1) & (F.col("seq") == 1), "changed").otherwise(F.col("checks")).alias("checks"),
        "link.previous", "link.scientific", "link.provenance", "link.digest",
        F.when((F.col("seq") > 1) & (part(F.col("seq")) % 3 == 0), name(F.col("seq") - 1)).alias("supersedes"),
        F.when((part(F.col("seq") + 1) % 3 == 0) & ~((last == 5) & (F.col("seq") == 1)), name(F.col("seq") + 1)).alias("superseded_by"),
    )
    return out.filter(~((last == 7) & (F.col("seq") == 2)))


def _current(spark: SparkSession, sf: str) -> DataFrame:
    """Current records, with whether a record is one itself."""
    ledger = _ledger(spark, sf).select("ledger_id", "record_id", "superseded_by")
    return proofs.current_records(ledger, ["superseded_by"]).select("ledger_id", "record_id", "current", "steps", F.col("superseded_by").isNull().alias("active"))


QUERIES = {
    "verify_claims": _verify_claims,
    "ledger_integrity": lambda s, d: proofs.ledger_violations(_ledger(s, d)),
    "ledger_current": _current,
}

_W = "('CERTIFIED_TRUE', 'EXACT_TRUE')"
_CHECKS = {
    "sampling is unknown": "k = 15",
    "continuous sampling cannot be settled": "k = 6",
    "boundary is unknown": "k = 8",
    "bounding model is unknown": "k = 9",
    "operator is unknown": "k = 7",
    "digest is forged": "k = 3",
    "index is another one": "k = 4",
    "metric is negative": "k = 5",
    "witness is missing": "q <> 1 AND truth AND w = 0",
    "witness contradicts": "q = 0 AND NOT truth AND w > 0",
    "coverage is incomplete": "((q = 0 AND NOT truth) OR (q = 1 AND truth)) AND nb < blocks + (k = 2)::INTEGER",
    "counterexample is missing": "q = 1 AND NOT truth AND c = 0",
    "witnesses overlap": "q = 2 AND truth AND o > 0",
    "run is too short": "q = 2 AND truth AND w > 0 AND longest < CASE WHEN k = 13 THEN 5000000 ELSE 5 END",
}
_LINES = """L AS (SELECT l_orderkey AS ledger_id, l_orderkey % 10 AS k, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS seq FROM lineitem),
    R AS (SELECT *, lead(part) OVER (PARTITION BY ledger_id ORDER BY seq) AS following FROM L)"""
ORACLE_SQL = {
    "verify_claims": sql("TL", f"""{_BV}, {_MIN}, {_FT}, {_EP}, {_ET},
        T AS (SELECT traj_id, 0 AS q, bool_or(truth) AS t FROM FT GROUP BY 1 UNION ALL SELECT traj_id, 1, bool_and(truth) FROM FT GROUP BY 1
            UNION ALL SELECT traj_id, 2, coalesce(max(k_e - k_s) >= 5, false) FROM (SELECT DISTINCT traj_id FROM FT) LEFT JOIN EP USING (traj_id) GROUP BY 1),
        N AS (SELECT traj_id, count(*) AS blocks FROM ET GROUP BY 1),
        C AS (SELECT *, CASE WHEN k = 1 THEN NOT t ELSE t END AS truth FROM (SELECT *, traj_id * 3 + q AS claim_id, (traj_id * 3 + q) % {N_FAULTS} AS k FROM T JOIN N USING (traj_id))),
        E AS (SELECT claim_id, k, block_id, frame_start, frame_end, lower, upper, CASE WHEN k = 14 AND block_id % 50 = 7 THEN 'CERTIFIED_TRUE' ELSE status END AS status
                FROM ET JOIN C USING (traj_id) WHERE NOT (k = 10 AND status IN {_W}) AND NOT (k = 11 AND status = 'CERTIFIED_FALSE')
            UNION ALL SELECT claim_id, k, block_id, frame_start + 3, frame_end + 3, lower, upper, status FROM ET JOIN C USING (traj_id) WHERE k = 12 AND block_id % 50 = 8),
        S AS (SELECT claim_id, frame_start AS s, max(frame_end) AS e, count(*) AS same FROM E WHERE status IN {_W} GROUP BY 1, 2),
        O AS (SELECT claim_id, sum(same - 1 + coalesce(b > s, false)::INTEGER) AS o FROM (SELECT *, lag(e) OVER (PARTITION BY claim_id ORDER BY s) AS b FROM S) GROUP BY 1),
        M AS (SELECT claim_id, s, e, sum(fresh) OVER (PARTITION BY claim_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, coalesce((s > max(e) OVER (PARTITION BY claim_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INTEGER, 1) AS fresh FROM S)),
        G AS (SELECT claim_id, max(n) AS longest FROM (SELECT claim_id, run, max(e) - min(s) AS n FROM M GROUP BY 1, 2) GROUP BY 1),
        F AS (SELECT claim_id, count(DISTINCT block_id) AS nb, count(*) FILTER (status IN {_W}) AS w, count(*) FILTER (status = 'CERTIFIED_FALSE') AS c FROM E GROUP BY 1),
        X AS (SELECT C.claim_id, k, q, truth, blocks, coalesce(nb, 0) AS nb, coalesce(w, 0) AS w, coalesce(c, 0) AS c, coalesce(o, 0) AS o, coalesce(longest, 0) AS longest FROM C LEFT JOIN F USING (claim_id) LEFT JOIN O USING (claim_id) LEFT JOIN G USING (claim_id))
        """ + " UNION ALL ".join(f"SELECT claim_id, '{name}' AS violation, 1::BIGINT AS n FROM X WHERE {check}" for name, check in _CHECKS.items())
        + " UNION ALL SELECT claim_id, 'bounds do not imply the status', count(*) FROM E WHERE k <> 7 AND ((status = 'CERTIFIED_TRUE' AND NOT upper < 4) OR (status = 'CERTIFIED_FALSE' AND NOT lower >= 4)) GROUP BY 1"),
    "ledger_integrity": f"""WITH {_LINES}, X AS (SELECT ledger_id, ledger_id * 100 + seq AS record_id, list_concat(
            CASE WHEN k = 3 AND seq = 1 AND part <> 0 THEN ['scientific', 'provenance', 'digest'] WHEN k = 1 AND seq = 1 THEN ['provenance', 'digest'] WHEN k = 7 AND seq = 3 THEN ['chain', 'digest'] ELSE []::VARCHAR[] END,
            CASE WHEN part % 3 = 0 AND ((k = 7 AND seq = 3) OR (k = 5 AND seq = 2)) THEN ['supersession'] ELSE []::VARCHAR[] END) AS found FROM R)
        SELECT ledger_id, record_id, unnest(found) AS violation FROM X""",
    "ledger_current": f"""WITH {_LINES}, X AS (SELECT *, coalesce(following % 3 = 0, false) AND NOT (k = 5 AND seq = 1) AS gone FROM R), Y AS (SELECT *, gone AND NOT (k = 7 AND seq = 1) AS link FROM X WHERE NOT (k = 7 AND seq = 2)),
        Z AS (SELECT *, min(CASE WHEN NOT link THEN seq END) OVER (PARTITION BY ledger_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t FROM Y)
        SELECT ledger_id, ledger_id * 100 + seq AS record_id, ledger_id * 100 + t AS current, (t - seq)::BIGINT AS steps, NOT gone AS active FROM Z""",
}
