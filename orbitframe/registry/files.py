"""Registered round trips: given tables written as structure, result and table files, and read back; and streamed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.operators.graphs import shared_path, stored
from orbitframe.plans import certified as c
from orbitframe.registry.certified import _BV
from orbitframe.registry.series import _ep
from orbitframe.registry.structure import rounded
from orbitframe.sources import export, ingest
from orbitframe.sources import views as v
from orbitframe.sources.views import sql
from orbitframe.streaming import blocks

TAU = 4.0


#: Frames whose atoms five digits can number: the part of a trajectory that one file holds.
PART = 99_999 // v.N_ATOMS


def _atoms(p: SparkSession, d: str) -> DataFrame:
    """Atoms of all frames, with their part of the trajectory and their number in it."""
    frame = F.col("frame")
    return v.te_full(p, d).withColumns({"part": F.floor(frame / PART).cast("int"), "serial": frame % PART * v.N_ATOMS + F.col("atom_id") + 1})


def _pdb(p: SparkSession, d: str) -> DataFrame:
    path = shared_path(p)
    # Halves are rounded up, as by SQL's round, and not by their binary value as by printf.
    rows = _atoms(p, d).withColumns({n: F.round(n, 3) for n in "xyz"})
    export.export_pdb(rows, path, by=["traj_id", "part"])
    return ingest.ingest_pdb(p, path).withColumns({n: ingest.folder_value(n).cast("int") for n in ("traj_id", "part")})


def _gro(p: SparkSession, d: str) -> DataFrame:
    path = shared_path(p)
    export.export_gro(_atoms(p, d), path, "traj_id")
    return ingest.ingest_gro(p, path).withColumn("traj_id", ingest.folder_value("traj_id").cast("int"))


def _conect(p: SparkSession, d: str) -> DataFrame:
    """Order lines as links between line numbers, named once or more."""
    path = shared_path(p)
    rows = v.table(p, d, "lineitem").select(F.format_string("CONECT%5d%5d%5d", F.col("l_linenumber").cast("int"), (F.col("l_linenumber") + F.col("l_quantity") % 3).cast("int"), (F.col("l_quantity") % 7 + 1).cast("int")).alias("value"), F.col("l_orderkey").alias("order"))
    rows.withColumn("part", F.col("order") % 16).repartition("part").select("value", "part").write.partitionBy("part").text(path)
    return ingest.ingest_conect(p, path).withColumn("part", ingest.folder_value("part").cast("long"))


def _hits(p: SparkSession, d: str) -> DataFrame:
    path = shared_path(p)
    key = lambda n, k: F.concat(F.lit(n), F.col(k).cast("string"))
    numbers = [F.col(n).cast("int") for n in ("l_linenumber", "l_suppkey", "l_quantity", "l_linenumber", "l_quantity", "l_suppkey", "l_partkey")]
    v.table(p, d, "lineitem").select(key("q", "l_orderkey"), key("t", "l_partkey"), (F.col("l_discount") * 10), *numbers, F.col("l_tax"), F.col("l_extendedprice")).toDF(*[f"c{k}" for k in range(12)]).write.csv(path, sep="\t")
    return ingest.ingest_alignment_hits(p, path)


def _pocket_csv(p: SparkSession, d: str) -> DataFrame:
    path = shared_path(p)
    v.pk(p, d).select(F.col("pocket_id").alias("Pocket ID"), F.col("volume").alias("score"), F.round("volume", 3).alias("prob"), *[F.col(n).alias(f"center_{n}") for n in "xyz"], F.array_join(F.col("residue_ids").cast("array<string>"), " ").alias("residues")).write.csv(path, header=True)
    return ingest.ingest_pocket_csv(p, path)


def _pocket_info(p: SparkSession, d: str) -> DataFrame:
    path = shared_path(p)
    line = lambda k, c: F.concat(F.lit(f"\t{k} : \t"), F.format_string("%.4f", c))
    v.pk(p, d).select(F.concat_ws("\n", F.concat(F.lit("Pocket "), F.col("pocket_id").cast("string"), F.lit(" :")), line("Volume", F.col("volume")), line("Center x", F.col("x")), F.lit("")).alias("value")).write.text(path)
    return ingest.ingest_pocket_info(p, path)


#: Orders whose keys follow each other and share a file, which a task writes and reads whole.
ORDERS = 16_384


def _residues(p: SparkSession, d: str) -> DataFrame:
    """Orders as sequences whose lines are segments, a file per range of keys: more orders make more files, and none larger."""
    path = shared_path(p)
    n = F.col("l_linenumber").cast("int")
    seg = F.struct(F.lit("A").alias("chain"), (n * 10).alias("unp_start"), (n * 10 + F.col("l_quantity").cast("int") % 8).alias("unp_end"), (n * 100).alias("pdb_start"))
    rows = v.table(p, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(seg).alias("segments"))
    docs = rows.select(F.floor(F.col("l_orderkey") / ORDERS).alias("part"), F.to_json(F.struct(F.concat(F.lit("P"), F.col("l_orderkey").cast("string")).alias("accession"), F.lit(100).alias("length"), "segments")).alias("doc"))
    docs.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("doc"), ","), F.lit("]")).alias("value")).write.partitionBy("part").text(path)
    return ingest.ingest_mapping_json(p, path)


def _mapped(p: SparkSession, d: str) -> DataFrame:
    return _residues(p, d).distinct()


def _features(p: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("P"), F.col("o_orderkey").cast("string"))
    first = (F.col("o_custkey") % 60).cast("int")
    return v.table(p, d, "orders").select(key.alias("accession"), F.col("o_orderstatus").alias("kind"), first.alias("begin"), (first + 12).alias("end"))


def _xml(p: SparkSession, d: str) -> DataFrame:
    path = shared_path(p)
    rows = v.table(p, d, "customer").select(F.col("c_custkey").cast("int").alias("resnr"), F.col("c_mktsegment").alias("restype"), F.lit("A").alias("reschain"), F.round("c_acctbal", 2).alias("dist_h_a"), F.col("c_nationkey").cast("int").alias("donoridx"))
    rows.write.format("xml").option("rowTag", "hydrogen_bond").option("rootTag", "hydrogen_bonds").save(path)
    return ingest.ingest_interaction_xml(p, path).select("resnr", "restype", "reschain", "dist_h_a", "donoridx")


def _provenance(p: SparkSession, d: str) -> DataFrame:
    """A file per trajectory against a manifest in which one in three is changed, one is left out and one is too many."""
    path = shared_path(p)
    line = F.concat_ws(",", "frame", "atom_id", *[F.round(F.col(n) * 1000).cast("long") for n in "xyz"])
    whole = v.te(p, d).groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("frame", "atom_id", line.alias("s")))).alias("a"))
    files = stored(whole.select("traj_id", F.array_join(F.transform("a", lambda x: x["s"]), "\n").alias("value")))
    files.write.partitionBy("traj_id").text(path)
    body = F.concat("value", F.lit("\n"))
    name = F.concat(F.lit("traj_id="), F.col("traj_id").cast("string"))
    manifest = files.filter("traj_id <> 2").select(name.alias("name"), F.octet_length(body).cast("long").alias("size_bytes"), F.sha2(F.when(F.col("traj_id") % 3 == 1, F.concat(body, F.lit("x"))).otherwise(body), 256).alias("sha256"))
    manifest = manifest.unionByName(files.filter("traj_id = 0").select(F.lit("traj_id=99").alias("name"), F.lit(1).cast("long").alias("size_bytes"), F.lit("").alias("sha256")))
    return ingest.verify_provenance(p, path, manifest, F.element_at(F.split("path", "/"), -2))


#: Rows of a stream's file, which one task sorts.
ROWS = 1 << 20


def _stream(p: SparkSession, rows: DataFrame, order: list[str], batches: int = 1) -> DataFrame:
    """A table as a stream of so many batches, about, of at least four files that hold ROWS rows each, about: a larger table makes more
    files, and none larger. Files come in no certain order."""
    path, files = shared_path(p), max(4, -(-rows.count() // ROWS))
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(path)
    return p.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(path)


def _batches(p: SparkSession, d: str, key: str, n: int = 4) -> DataFrame:
    """Events (ts, key, flag) as a stream of n files and more, written one after another in the order of time, and two rows far ahead, which
    close what is open."""
    rows = v.table(p, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col(key).cast("string").alias("key"), (F.col("value") < 35).alias("flag"))
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    path = shared_path(p)
    part = F.least(F.lit(n - 1), F.floor((F.unix_micros("ts") - low) * n / max(1, high - low)))
    for k in range(n):
        rows.filter(part == k).write.mode("append").parquet(path)
    for year in (2100, 2200):
        p.range(1, numPartitions=1).select(F.lit(f"{year}-01-01").cast("timestamp").alias("ts"), F.lit("").alias("key"), F.lit(False).alias("flag")).write.mode("append").parquet(path)
    return p.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path).filter("ts IS NOT NULL")


def _stream_windows(p: SparkSession, d: str) -> DataFrame:
    """A day's share every six hours; the last row of a window is its result."""
    found = blocks.run_available(blocks.stream_occupancy(_batches(p, d, "event_type"), "1 day", slide="6 hours"), "update").filter("key <> ''")
    last = found.groupBy("window", "key").agg(F.max_by(F.struct("share", "n"), "batch").alias("r"))
    return last.select(F.unix_micros("window.start").alias("start_us"), F.col("key").alias("event_type"), "r.share", "r.n")


def _stream_sessions(p: SparkSession, d: str) -> DataFrame:
    found = blocks.run_available(blocks.stream_sessions(_batches(p, d, "user_id"), "12 hours"), "append").filter("key <> ''")
    return found.select(F.col("key").cast("long").alias("user_id"), F.unix_micros("session.start").alias("start_us"), F.unix_micros("session.end").alias("end_us"), "share", "n")


def _stream_verdicts(p: SparkSession, d: str) -> DataFrame:
    found = blocks.run_available(blocks.stream_block_verdicts(_stream(p, v.tl(p, d), ["frame"], 4), TAU), "update")
    names = ["frame_start", "frame_end", "lower", "upper", "verdict"]
    return found.groupBy("traj_id", "block_id").agg(F.max_by(F.struct(*names), "batch").alias("r")).select("traj_id", "block_id", "r.*")


def _stream_episodes(p: SparkSession, d: str) -> DataFrame:
    """Episodes of events, in one batch, as older files than the watermark would be late; two last frames of each trajectory, far ahead,
    move the watermark on."""
    rows = v.ev(p, d).select("traj_id", "frame", F.col("flag_a").alias("flag"), F.timestamp_seconds("t_ps").alias("ts"))
    ends = [rows.groupBy("traj_id").agg((F.max("frame") + k).alias("frame"), F.lit(False).alias("flag"), F.lit(f"2{k}00-01-01").cast("timestamp").alias("ts")) for k in (1, 2)]
    return blocks.run_available(blocks.stream_episodes(_stream(p, rows.unionByName(ends[0]).unionByName(ends[1]), ["ts"])), "append").select("traj_id", "k_s", "k_e")


QUERIES = {
    "ingest_pdb": lambda p, d: rounded(_pdb(p, d).select("traj_id", "serial", "name", "resname", "chain", "residue", *"xyz", "occupancy", "b_factor", "element", "is_hetero")),
    "ingest_gro": lambda p, d: rounded(_gro(p, d).select("traj_id", "serial", "residue", "resname", "name", *"xyz")),
    "ingest_conect": lambda p, d: _conect(p, d).select("part", "i", "j", "bond_order"),
    "ingest_alignment_hits": lambda p, d: rounded(_hits(p, d)),
    "hits_filter_join": lambda p, d: rounded(ingest.hits_filter_join(_hits(p, d), v.table(p, d, "part").select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("target"), "p_brand"), 0.05, 0.3).select("query", "target", "identity", "evalue", "p_brand")),
    "ingest_pocket_csv": lambda p, d: rounded(_pocket_csv(p, d).withColumn("residue_ids", F.array_join("residue_ids", ","))),
    "ingest_pocket_info": lambda p, d: rounded(_pocket_info(p, d).select("pocket", "key", "value")),
    "ingest_mapping_json": lambda p, d: _mapped(p, d).select("accession", "length", "chain", "position", "residue"),
    "mapping_coverage": lambda p, d: rounded(ingest.mapping_coverage(_residues(p, d))),
    "uniprot_features_join": lambda p, d: ingest.uniprot_features_join(_features(p, d), _mapped(p, d)).select("accession", "position", "residue", "kind"),
    "ingest_interaction_xml": _xml,
    "roundtrip_check": lambda p, d: rounded(export.roundtrip_check(_atoms(p, d), _pdb(p, d), keys=("traj_id", "part", "serial"))),
    "verify_provenance": _provenance,
    "stream_block_verdicts": lambda p, d: rounded(_stream_verdicts(p, d)),
    "stream_episodes": _stream_episodes,
    "stream_occupancy_sliding": lambda p, d: rounded(_stream_windows(p, d)),
    "stream_sessions": lambda p, d: rounded(_stream_sessions(p, d)),
}
_SERIAL = "frame % 4761 * 21 + atom_id + 1"
_MAPPED = "MP AS (SELECT DISTINCT 'P' || l_orderkey AS accession, l_linenumber * 10 + k AS position, l_linenumber * 100 + k AS residue FROM (SELECT *, unnest(range((l_quantity::INTEGER % 8) + 1)) AS k FROM lineitem))"
ORACLE_SQL = {
    "ingest_pdb": sql("TF", f"SELECT traj_id, ({_SERIAL})::INTEGER AS serial, name, resname, chain, residue, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z, occupancy, b_factor, element, is_hetero FROM TF"),
    "ingest_gro": sql("TF", f"SELECT traj_id, ({_SERIAL})::INTEGER AS serial, residue, resname, name, round(round(x / 10, 3) * 10, 6) + 0.0 AS x, round(round(y / 10, 3) * 10, 6) + 0.0 AS y, round(round(z / 10, 3) * 10, 6) + 0.0 AS z FROM TF"),
    "ingest_conect": "SELECT part, least(a, b)::INTEGER AS i, greatest(a, b)::INTEGER AS j, (CASE WHEN count(*) >= 6 THEN 3 WHEN count(*) >= 4 THEN 2 ELSE 1 END)::INTEGER AS bond_order FROM (SELECT l_orderkey % 16 AS part, l_linenumber AS a, unnest([l_linenumber + l_quantity % 3, l_quantity % 7 + 1]) AS b FROM lineitem) WHERE a <> b GROUP BY part, least(a, b), greatest(a, b)",
    "ingest_alignment_hits": "SELECT 'q' || l_orderkey AS query, 't' || l_partkey AS target, round(l_discount * 10, 6) AS identity, l_linenumber::INTEGER AS length, l_suppkey::INTEGER AS mismatch, l_quantity::INTEGER AS gapopen, l_linenumber::INTEGER AS qstart, l_quantity::INTEGER AS qend, l_suppkey::INTEGER AS tstart, l_partkey::INTEGER AS tend, round(l_tax, 6) AS evalue, round(l_extendedprice, 6) AS bits, NULL::DOUBLE AS tm FROM lineitem",
    "hits_filter_join": "SELECT 'q' || l_orderkey AS query, 't' || l_partkey AS target, round(l_discount * 10, 6) AS identity, round(l_tax, 6) AS evalue, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_tax <= 0.05 AND l_discount * 10 >= 0.3",
    "ingest_pocket_csv": sql("PK", "SELECT pocket_id::VARCHAR AS pocket_id, round(volume, 6) AS score, round(volume, 3) AS probability, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, array_to_string(residue_ids, ',') AS residue_ids FROM PK"),
    "ingest_pocket_info": sql("PK", "SELECT pocket_id::INTEGER AS pocket, 'Volume' AS key, round(volume, 4) + 0.0 AS value FROM PK UNION ALL SELECT pocket_id::INTEGER, 'Center x', round(x, 4) + 0.0 FROM PK"),
    "ingest_mapping_json": f"WITH {_MAPPED} SELECT accession, 100 AS length, 'A' AS chain, position::INTEGER AS position, residue::INTEGER AS residue FROM MP",
    "mapping_coverage": f"WITH {_MAPPED} SELECT accession, 100 AS length, count(DISTINCT position)::DOUBLE AS coverage FROM MP GROUP BY 1",
    "uniprot_features_join": f"WITH {_MAPPED} SELECT accession, position::INTEGER AS position, residue::INTEGER AS residue, o_orderstatus AS kind FROM MP JOIN orders ON accession = 'P' || o_orderkey AND position BETWEEN o_custkey % 60 AND o_custkey % 60 + 12",
    "ingest_interaction_xml": "SELECT c_custkey::INTEGER AS resnr, c_mktsegment AS restype, 'A' AS reschain, round(c_acctbal, 2) AS dist_h_a, c_nationkey::INTEGER AS donoridx FROM customer",
    "roundtrip_check": sql("TF", "SELECT count(*) AS n, 0::BIGINT AS n_unmatched, round(max(greatest(abs(x - round(x, 3)), abs(y - round(y, 3)), abs(z - round(z, 3)))), 6) AS max_diff, true AS ok FROM TF"),
    "verify_provenance": sql("TE", "SELECT 'traj_id=' || traj_id AS name, CASE WHEN traj_id = 2 THEN 'UNLISTED' WHEN traj_id % 3 = 1 THEN 'CHANGED' ELSE 'OK' END AS status FROM (SELECT DISTINCT traj_id FROM TE) UNION ALL SELECT 'traj_id=99', 'MISSING'"),
    "stream_block_verdicts": sql("TL", f"{_BV} SELECT traj_id, block_id, frame_start, frame_end, round(lower, 6) + 0.0 AS lower, round(upper, 6) + 0.0 AS upper, verdict FROM V"),
    "stream_occupancy_sliding": """WITH w AS (SELECT event_type, value, epoch_us(ts) // 21600000000 * 21600000000 - k * 21600000000 AS start_us FROM events, (SELECT unnest(range(4)) AS k))
        SELECT start_us, event_type, round(avg((value < 35)::INTEGER), 6) AS share, count(*) AS n FROM w GROUP BY 1, 2""",
    "stream_sessions": """WITH e AS (SELECT user_id, value, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
        s AS (SELECT *, sum((before IS NULL OR t - before > 43200000000)::INTEGER) OVER (PARTITION BY user_id ORDER BY t) AS k FROM e)
        SELECT user_id, min(t) AS start_us, max(t) + 43200000000 AS end_us, round(avg((value < 35)::INTEGER), 6) AS share, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_episodes": sql("EV", f", {_ep('flag_a', 'EA')} SELECT * FROM EA"),
}
