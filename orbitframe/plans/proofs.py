"""Re-checks of claims against their evidence, and of ledgers of records: violations as rows, none for what holds.

A claim says what a query found for a trajectory; its evidence is a table of blocks. Everything that a quantifier demands of the evidence is a
fold over it: counts of witnesses, counterexamples and blocks in one aggregation per claim, runs of TRUE blocks by ranges of frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.operators import segments
from orbitframe.operators.graphs import stored
from orbitframe.plans import certified as c

#: What a claim may name.
SAMPLING = ("sampled_frames", "continuous_physical")
BOUNDARIES = ("orthorhombic_minimum_image", "triclinic_minimum_image", "none", "cartesian_open_boundary")
MODELS = ("AABB", "KDOP14")
WITNESS, COUNTER = ("TRUE", "CERTIFIED_TRUE", "EXACT_TRUE"), ("FALSE", "CERTIFIED_FALSE")
METRICS = ("bytes_fetched", "frames_decoded", "atoms_analyzed")


def forged(digest: Column) -> Column:
    """A digest of zeros or of f alone, which no content has."""
    return F.coalesce(digest.rlike("^(0+|f+)$"), F.lit(False))


def block_violations(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, block_id, violation: blocks whose status their bounds do not imply under the claim's operator and threshold. A missing
    lower bound is 0, a missing upper one infinite."""
    rows = evidence.join(claims.select("claim_id", "op", "tau"), "claim_id")
    low, high = F.coalesce("lower", F.lit(0.0)), F.coalesce("upper", F.lit(float("inf")))
    true, false = F.lit(None).cast("boolean"), F.lit(None).cast("boolean")
    for op in c.OPS:
        verdict = c.decide(low, high, op, F.col("tau"))
        true, false = (F.when(F.col("op") == op, F.coalesce(v, F.lit(False))).otherwise(rest) for v, rest in ((verdict, true), (~verdict, false)))
    wrong = (F.col("status").isin("TRUE", "CERTIFIED_TRUE") & ~true) | (F.col("status").isin("FALSE", "CERTIFIED_FALSE") & ~false)
    return rows.filter(wrong).select("claim_id", "block_id", F.lit("bounds do not imply the status").alias("violation"))


def folded(evidence: DataFrame) -> DataFrame:
    """claim_id, n_blocks, witnesses, counterexamples, longest (frames of the longest run of TRUE blocks that adjoin each other) and
    overlaps (TRUE blocks that begin before an earlier one ends)."""
    true = evidence.filter(F.col("status").isin(*WITNESS) & (F.col("frame_end") > F.col("frame_start"))).select("claim_id", F.col("frame_start").cast("long").alias("k_s"), F.col("frame_end").cast("long").alias("k_e"))
    runs = segments.unions(true, ["claim_id"]).groupBy("claim_id").agg(F.max(F.col("k_e") - F.col("k_s")).alias("longest"))
    before = segments.neighbours(true.groupBy("claim_id", "k_s").agg(F.max("k_e").alias("k_e"), F.count(F.lit(1)).alias("same")), ["k_e"], -1, ["claim_id"], "k_s")
    overlaps = before.groupBy("claim_id").agg(F.sum(F.col("same") - 1 + F.coalesce(F.col("near_k_e") > F.col("k_s"), F.lit(False)).cast("long")).alias("overlaps"))
    counts = evidence.groupBy("claim_id").agg(F.count_distinct("block_id").alias("n_blocks"), F.count_if(F.col("status").isin(*WITNESS)).alias("witnesses"), F.count_if(F.col("status").isin(*COUNTER)).alias("counterexamples"))
    return counts.join(runs, "claim_id", "left").join(overlaps, "claim_id", "left")


def claim_violations(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, violation of claims (claim_id, quantifier, op, tau, truth, resolution, duration, dt, sampling, boundary, model, total_blocks,
    trajectory_sha256, index_sha256, manifest_sha256, and METRICS) against evidence (claim_id, block_id, frame_start, frame_end, lower, upper,
    status). A claim without evidence is checked against none. Null truth means UNKNOWN."""
    rows = claims.join(folded(evidence), "claim_id", "left").fillna(0, ["n_blocks", "witnesses", "counterexamples", "longest", "overlaps"])
    col, kind = F.col, lambda k: F.col("quantifier") == k
    yes, no = F.coalesce(col("truth"), F.lit(False)), F.coalesce(~col("truth"), F.lit(False))
    need = F.greatest(F.lit(1), F.ceil((col("duration") - 1e-9) / col("dt")))
    short = (col("sampling") == "continuous_physical") & (col("truth").isNotNull() | (kind("DURATION") & (col("duration") < col("dt")))) & (col("resolution") != "UNSUPPORTED_SEMANTICS")
    checks = {
        "sampling is unknown": ~col("sampling").isin(*SAMPLING),
        "continuous sampling cannot be settled": short,
        "boundary is unknown": ~col("boundary").isin(*BOUNDARIES),
        "bounding model is unknown": ~F.upper("model").isin(*MODELS),
        "operator is unknown": ~col("op").isin(*c.OPS),
        "digest is forged": forged(col("trajectory_sha256")) | forged(col("index_sha256")),
        "index is another one": col("index_sha256") != col("manifest_sha256"),
        "metric is negative": F.least(*[F.coalesce(m, F.lit(0)) for m in METRICS]) < 0,
        "witness is missing": (kind("EXISTS") | kind("DURATION")) & yes & (col("witnesses") == 0),
        "witness contradicts": kind("EXISTS") & no & (col("witnesses") > 0),
        "coverage is incomplete": ((kind("EXISTS") & no) | (kind("FORALL") & yes)) & (col("n_blocks") < col("total_blocks")),
        "counterexample is missing": kind("FORALL") & no & (col("counterexamples") == 0),
        "witnesses overlap": kind("DURATION") & yes & (col("overlaps") > 0),
        "run is too short": kind("DURATION") & yes & (col("witnesses") > 0) & (col("longest") < need),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(check, F.lit(False)), F.lit(name)) for name, check in checks.items()]))
    return rows.select("claim_id", F.explode(found).alias("violation"))


# Ledgers


def scientific_digest(body: Column) -> Column:
    return F.sha2(body, 256)


def provenance_digest(scientific: Column, checks: Column) -> Column:
    return F.sha2(F.concat_ws("|", scientific, F.coalesce(checks, F.lit(""))), 256)


def chain_digest(previous: Column, scientific: Column, provenance: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("")), scientific, provenance), 256)


def packed(digest: Column) -> Column:
    """A digest in half the bytes if it is 64 lower-case hexadecimal digits, any other text as it is; different ones stay different."""
    mark = lambda k: F.lit(bytes([k]))
    return F.when(digest.rlike(r"\A[0-9a-f]{64}\z"), F.concat(mark(1), F.unhex(digest))).otherwise(F.concat(mark(0), digest.cast("binary")))


def unpacked(digest: Column) -> Column:
    rest = F.substring(digest, 2, 1 << 30)
    return F.when(F.substring(digest, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def ledger_violations(ledger: DataFrame) -> DataFrame:
    """ledger_id, record_id, violation of records (ledger_id, seq, record_id, body, checks, previous, scientific, provenance, digest, supersedes,
    superseded_by). Each digest covers the recomputed one before it, as a reader would build it; a superseded record must name the
    one that supersedes it.

    What a record says by itself is judged before it is moved: its own digest too, under the digest that it names as the one before. If
    that is the one before, this is the verdict; if not, a digest that fits the named one fits no other, and the rest are made again."""
    col = F.col
    science = scientific_digest(col("body"))
    origin = provenance_digest(science, col("checks"))
    fits = F.coalesce(chain_digest(col("previous"), science, origin) == col("digest"), F.lit(False))
    judged = ledger.select("ledger_id", "seq", "record_id", packed(col("previous")).alias("previous"), packed(col("digest")).alias("digest"), F.struct(
        F.coalesce(science != col("scientific"), F.lit(True)).alias("scientific"), F.coalesce(origin != col("provenance"), F.lit(True)).alias("provenance"), fits.alias("fits")).alias("own"),
        F.when(~fits, F.struct(science.alias("science"), origin.alias("origin"))).alias("again"))
    rows = segments.neighbours(judged, ["digest"], -1, ["ledger_id"], "seq")
    blank = lambda c: F.coalesce(c, packed(F.lit("")))
    again = chain_digest(unpacked(col("near_digest")), col("again.science"), col("again.origin")) != unpacked(col("digest"))
    checks = {
        "chain": ~col("previous").eqNullSafe(col("near_digest")),
        "scientific": col("own.scientific"),
        "provenance": col("own.provenance"),
        "digest": F.when(blank(col("previous")) == blank(col("near_digest")), ~col("own.fits")).when(col("own.fits"), True).otherwise(again),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(check, F.lit(True)), F.lit(name)) for name, check in checks.items()]))
    # Only records that supersede one meet the others, and by their numbers alone.
    named = ledger.select("ledger_id", col("record_id").alias("supersedes"), col("superseded_by").alias("named_"), F.lit(True).alias("there_"))
    links = ledger.filter("supersedes IS NOT NULL").select("ledger_id", "record_id", "supersedes").join(named, ["ledger_id", "supersedes"], "left")
    links = links.filter(col("there_").isNull() | ~col("named_").eqNullSafe(col("record_id"))).select("ledger_id", "record_id", F.lit("supersession").alias("violation"))
    return rows.select("ledger_id", "record_id", F.explode(found).alias("violation")).unionByName(links)


def active_records(ledger: DataFrame) -> DataFrame:
    return ledger.filter("superseded_by IS NULL")


def current_records(ledger: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """ledger_id, record_id, current, steps, and the columns to keep: the record that a record's supersessions lead to, and how many they
    are. Pointers double in each round, so that a chain of n takes log n rounds; a pointer to a record that is not there ends the chain before
    it. A record on a circle of pointers has null. Rounds hold the records that have a pointer; all others are their own."""
    there = ledger.select("ledger_id", F.col("record_id").alias("next"))
    links = ledger.filter("superseded_by IS NOT NULL").select("ledger_id", "record_id", F.col("superseded_by").alias("next")).join(there, ["ledger_id", "next"], "left_semi")
    rows = stored(links.select("ledger_id", "record_id", "next", F.lit(1).cast("long").alias("steps"), F.col("next").alias("current")))
    most = rows.count()
    reach = 1
    while reach <= most and not rows.filter("next IS NOT NULL").isEmpty():
        ahead = rows.select("ledger_id", F.col("record_id").alias("next"), F.col("next").alias("then"), F.col("steps").alias("more"), F.col("current").alias("last"))
        joined = rows.join(ahead, ["ledger_id", "next"], "left")
        rows = stored(joined.select("ledger_id", "record_id", F.col("then").alias("next"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("last", "current").alias("current")))
        reach *= 2
    ends = rows.select("ledger_id", "record_id", F.col("next").isNotNull().alias("circle"), F.col("current").alias("end"), "steps")
    done = ledger.select("ledger_id", "record_id", *(keep or [])).join(ends, ["ledger_id", "record_id"], "left")
    own = F.col("circle").isNull()
    current = F.when(own, F.col("record_id")).when(~F.col("circle"), F.col("end"))
    steps = F.when(own, F.lit(0).cast("long")).when(~F.col("circle"), F.col("steps"))
    return done.select("ledger_id", "record_id", current.alias("current"), steps.alias("steps"), *(keep or []))
