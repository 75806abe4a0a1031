"""Views of the driver's tables as trajectories, series, sequences, pockets and lineage, in Spark and as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitframe.operators.graphs import stored
from orbitframe.operators.order import numbered as numbered

N_ATOMS, SCALE, BOX = 21, 40.0, 20.0
_made: dict[tuple[str, str, str], tuple[int, object]] = {}
Made = TypeVar("Made")


def state_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    """A number that changes when a table's files do: of their paths, sizes and times."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/{name}.parquet")
    return files.agg(F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()[0] or 0


def once(source: str) -> Callable[[Callable[[SparkSession, str], Made]], Callable[[SparkSession, str], Made]]:
    """Made once per session and folder of tables, and again when the files of the source table have changed."""

    def wrap(make: Callable[[SparkSession, str], Made]) -> Callable[[SparkSession, str], Made]:
        @wraps(make)
        def read(spark: SparkSession, sf_dir: str) -> Made:
            key, state = (spark.sparkContext.applicationId, make.__name__, sf_dir), state_of(spark, sf_dir, source)
            if _made.get(key, (None,))[0] != state:
                _made[key] = state, make(spark, sf_dir)
            return _made[key][1]

        return read

    return wrap


def materialised(source: str) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    """A view that is stored once: numbering frames is a global sort, and no part of an operator."""
    return lambda view: once(source)(wraps(view)(lambda spark, sf_dir: stored(view(spark, sf_dir))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@materialised("embeddings")
def te(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-atom trajectories: one row per label, frame and atom, exploded from an array column."""
    vectors = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda v: v.cast("double") * SCALE).alias("e"))
    frames = numbered(vectors, "label", ["vec_id"])
    rows = frames.select(F.col("label").alias("traj_id"), "frame", (F.col("frame") * 10.0).alias("t_ps"), F.explode(F.sequence(F.lit(0), F.lit(N_ATOMS - 1))).alias("atom_id"), "e")
    at = [F.get("e", F.col("atom_id") * 3 + k) for k in range(3)]
    return rows.select("traj_id", "frame", "t_ps", "atom_id", *(c.alias(n) for c, n in zip(at, "xyz", strict=True)), *(F.lit(BOX).alias(f"l{n}") for n in "xyz"))


def te_atoms(spark: SparkSession) -> DataFrame:
    """The 21 atoms of the trajectories: residues of four, chain A then B."""
    a = F.col("id").cast("int")
    names, residues = (F.array(*map(F.lit, v)) for v in (("N", "CA", "C", "O"), ("ALA", "GLY", "PRO", "CYS", "ASP")))
    residue = F.floor(a / 4).cast("int") + 1
    return spark.range(N_ATOMS).select(
        a.alias("atom_id"),
        residue.alias("residue"),
        F.get(names, a % 4).alias("name"),
        F.substring(F.get(names, a % 4), 1, 1).alias("element"),
        F.get(residues, (residue - 1) % 5).alias("resname"),
        F.when(a < 16, "A").otherwise("B").alias("chain"),
        (a == 20).alias("is_hetero"),
        F.when(a < 16, 0).otherwise(1).alias("group_id"),
        (F.lit(10.0) + 3 * (a % 7)).alias("b_factor"),
        F.when(a % 5 == 0, 0.5).otherwise(1.0).alias("occupancy"),
    )


def te_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return te(spark, sf_dir).join(F.broadcast(te_atoms(spark)), "atom_id")


@materialised("lineitem")
def tl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long two-group trajectories: atoms 0 and 1 in group 0, atom 2 in group 1."""
    order = ["l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    rows = numbered(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 16).alias("traj_id"), *order), "traj_id", order)
    rows = rows.select("traj_id", "frame", F.col("l_extendedprice") / 2000, F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10).toDF("traj_id", "frame", "a", "b", "c", "d")
    atoms = F.array(*[F.struct(F.lit(g).alias("group_id"), F.lit(i).alias("atom_id"), x.alias("x"), y.alias("y"), z.alias("z")) for g, i, x, y, z in ((0, 0, F.col("a"), F.col("b"), F.col("c")), (0, 1, F.col("a") + 1, F.col("b"), F.col("c")), (1, 2, F.lit(26.0), F.col("d"), F.lit(0.5)))])
    return rows.select("traj_id", "frame", F.inline(atoms)).withColumns({f"l{n}": F.lit(80.0) for n in "xyz"})


@materialised("events")
def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar series per user, irregularly spaced."""
    rows = numbered(table(spark, sf_dir, "events").select(F.col("user_id").alias("traj_id"), "ts", "event_id", "value"), "traj_id", ["ts", "event_id"])
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return rows.select("traj_id", "frame", seconds.alias("t_ps"), "value", (F.col("value") < 35).alias("flag_a"), (F.col("value") > 70).alias("flag_b"))


def sq(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """Sequences: the letters of whole texts, upper-cased."""
    return table(spark, sf_dir, name).select(F.col(key).alias("seq_id"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))


#: Kinds of nodes of the lineage by their code's remainder by four.
KINDS = "COPS"


def lg_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage edges customer -> order -> part -> supplier; a node's code is four times its key, and its kind."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")

    def edge(df: DataFrame, p: str, a: str, c: str, b: str) -> DataFrame:
        return df.select(*[(F.col(key).cast("long") * 4 + KINDS.index(kind)).alias(n) for kind, key, n in ((p, a, "parent"), (c, b, "child"))])

    return edge(orders, "C", "o_custkey", "O", "o_orderkey").unionByName(edge(items, "O", "l_orderkey", "P", "l_partkey")).unionByName(edge(items, "P", "l_partkey", "S", "l_suppkey")).distinct()


def lg_name(code: str) -> Column:
    """A node's name by its code."""
    kind = F.col(code).bitwiseAND(F.lit(3).cast("long")).cast("int")
    return F.concat(F.get(F.array(*map(F.lit, KINDS)), kind), F.shiftright(code, 2).cast("string"))


def lg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineage edges by name."""
    return lg_codes(spark, sf_dir).select(*[lg_name(n).alias(n) for n in ("parent", "child")])


def pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pockets of two methods per structure."""
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(9)]
    residues = F.array(*[F.floor(F.abs(e[k]) * 100).cast("int") % 20 for k in range(3, 8)])
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("structure_id"), F.concat(F.lit("m"), F.col("vec_id") % 2).alias("method"), F.col("vec_id").alias("pocket_id"), *[(e[k] * SCALE).alias(n) for k, n in enumerate("xyz")], residues.alias("residue_ids"), (F.abs(e[8]) * 1000).alias("volume"))


#: The same views for DuckDB, to be put after WITH.
SQL = {
    "TE": """TE AS (SELECT label AS traj_id, frame, frame * 10.0::DOUBLE AS t_ps, a::INTEGER AS atom_id, 40 * e[3*a+1]::DOUBLE AS x, 40 * e[3*a+2]::DOUBLE AS y, 40 * e[3*a+3]::DOUBLE AS z,
        20.0::DOUBLE AS lx, 20.0::DOUBLE AS ly, 20.0::DOUBLE AS lz
        FROM (SELECT label, embedding AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings) f, (SELECT unnest(range(21)) AS a) g)""",
    "ATOMS": """ATOMS AS (SELECT a::INTEGER AS atom_id, (a // 4 + 1)::INTEGER AS residue, ['N','CA','C','O'][a % 4 + 1] AS name, substr(['N','CA','C','O'][a % 4 + 1], 1, 1) AS element,
        ['ALA','GLY','PRO','CYS','ASP'][(a // 4) % 5 + 1] AS resname, CASE WHEN a < 16 THEN 'A' ELSE 'B' END AS chain, a = 20 AS is_hetero, (CASE WHEN a < 16 THEN 0 ELSE 1 END)::INTEGER AS group_id,
        10.0::DOUBLE + 3 * (a % 7) AS b_factor, (CASE WHEN a % 5 = 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS occupancy FROM (SELECT unnest(range(21)) AS a))""",
    "TF": "TF AS (SELECT * FROM TE JOIN ATOMS USING (atom_id))",
    "TL": """TL AS (SELECT traj_id, frame, g::INTEGER AS group_id, i::INTEGER AS atom_id, CASE i WHEN 0 THEN a WHEN 1 THEN a + 1 ELSE 26.0 END::DOUBLE AS x, CASE WHEN i < 2 THEN b ELSE d END AS y,
        CASE WHEN i < 2 THEN c ELSE 0.5 END::DOUBLE AS z, 80.0::DOUBLE AS lx, 80.0::DOUBLE AS ly, 80.0::DOUBLE AS lz
        FROM (SELECT l_suppkey % 16 AS traj_id, row_number() OVER (PARTITION BY l_suppkey % 16 ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS frame,
            l_extendedprice / 2000 AS a, l_quantity / 50 AS b, l_discount * 10 AS c, l_tax * 10 AS d FROM lineitem) f, (VALUES (0, 0), (0, 1), (1, 2)) AS v(g, i))""",
    "EV": """EV AS (SELECT user_id AS traj_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, epoch_us(ts) / 1e6 AS t_ps, value, value < 35 AS flag_a, value > 70 AS flag_b FROM events)""",
    "SQ": "SQ AS (SELECT doc_id AS seq_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents)",
    "SB": "SB AS (SELECT item_id AS seq_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM benchmark)",
    "LG": """LG AS (SELECT 'C' || o_custkey AS parent, 'O' || o_orderkey AS child FROM orders UNION SELECT 'O' || l_orderkey, 'P' || l_partkey FROM lineitem UNION SELECT 'P' || l_partkey, 'S' || l_suppkey FROM lineitem)""",
    "PK": """PK AS (SELECT label AS structure_id, 'm' || (vec_id % 2) AS method, vec_id AS pocket_id, 40 * embedding[1]::DOUBLE AS x, 40 * embedding[2]::DOUBLE AS y, 40 * embedding[3]::DOUBLE AS z,
        [(floor(abs(embedding[k]::DOUBLE) * 100)::INTEGER % 20)::INTEGER FOR k IN [4,5,6,7,8]] AS residue_ids, abs(embedding[9]::DOUBLE) * 1000 AS volume FROM embeddings)""",
}


def sql(views: str, body: str) -> str:
    """WITH the named views, in order, then the body, which may go on with further views after a comma."""
    names = views.split()
    if "TF" in names:
        names = [n for n in ("TE", "ATOMS") if n not in names] + names
    head = ", ".join(SQL[n].replace(" AS (", " AS MATERIALIZED (", 1) for n in names)
    body = body.strip()
    return f"WITH {head}{body}" if body.startswith(",") else f"WITH {head} {body}"
