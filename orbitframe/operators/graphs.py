"""Graph jobs on edge tables: components, triangles, rings, lineage; iterations are cut by tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from orbitframe.operators import sets


def shared_path(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one, spark.checkpoint.dir. Only a local session may do without that setting."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("orbitframe.scratch.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-orbitframe-", dir="/tmp")
        spark.conf.set("orbitframe.scratch.dir", folder)
    return f"{folder.rstrip('/')}/orbitframe-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df as Parquet to a folder that all executors share and reads it back, which cuts the lineage; with a path, after what
    is there already."""
    path = path or shared_path(df.sparkSession)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that are broadcast at most.
FEW = 1 << 18


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, stored and counted: up to `most` narrow rows are broadcast, so that what they pick from a large table is not shuffled, more are
    left to the planner. It knows the size of what is stored, but not of what is yet to be filtered."""
    df = stored(df)
    return F.broadcast(df) if df.count() <= most else df


def connected_components(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, component): least labels spread along edges (keys, i, j), pointers jumping, until none changes. Labels take a fraction
    of a byte a row on disk, by which the planner would broadcast millions of them, so the joins are told to merge."""
    both = edges.select(*keys, "i", "j").unionByName(edges.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    labels = stored(nodes.select(*keys, "node", F.col("node").alias("component")))
    both = stored(both)
    while True:
        near = both.join(labels.withColumnRenamed("node", "j").hint("merge"), [*keys, "j"]).groupBy(*keys, F.col("i").alias("node")).agg(F.min("component").alias("c"))
        new = labels.join(near.hint("merge"), [*keys, "node"], "left").select(*keys, "node", F.col("component").alias("was"), F.least("component", F.coalesce("c", "component")).alias("component"))
        jump = new.select(*keys, F.col("node").alias("component"), F.col("component").alias("further"))
        new = stored(new.join(jump.hint("merge"), [*keys, "component"], "left").select(*keys, "node", "was", F.coalesce("further", "component").alias("component")))
        labels = new.drop("was")
        if new.filter("component < was").isEmpty():
            return labels


def triangles(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Triples i < j < k of mutual edges."""
    e = edges.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    two = e.join(e.select(*keys, F.col("i").alias("j"), F.col("j").alias("k")).hint("merge"), [*keys, "j"])
    return two.join(e.select(*keys, "i", F.col("j").alias("k")).hint("merge"), [*keys, "i", "k"]).select(*keys, "i", "j", "k")


def contact_graph(edges: DataFrame, components: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: vertices, edges, density, triangles, components and independent cycles. A row per key is broadcast nowhere."""
    counted = components.groupBy(*keys).agg(F.count(F.lit(1)).alias("v"), F.count_distinct("component").alias("b0"))
    m = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("e"))
    t = triangles(edges, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("triangles"))
    rows = counted.join(m.hint("merge"), keys, "left").join(t.hint("merge"), keys, "left").fillna(0, ["e", "triangles"])
    return rows.withColumns({"density": 2.0 * F.col("e") / (F.col("v") * (F.col("v") - 1)), "b1": F.col("e") - F.col("v") + F.col("b0")})


def rings(edges: DataFrame, keys: list[str], longest: int = 7) -> DataFrame:
    """Simple cycles of 3 to `longest` atoms by bounded path expansion; each is found once, from its least atom."""
    both = edges.select(*keys, "i", "j").unionByName(edges.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    step = both.select(*keys, F.col("i").alias("tail"), F.col("j").alias("next"))
    paths = both.filter("i < j").select(*keys, F.array("i", "j").alias("path"), F.col("j").alias("tail"))
    found = None
    for size in range(3, longest + 1):
        grown = paths.join(step, [*keys, "tail"]).filter(F.col("next") > F.get("path", F.lit(0))).filter(~F.array_contains("path", F.col("next")))
        paths = grown.select(*keys, F.concat("path", F.array("next")).alias("path"), F.col("next").alias("tail"))
        closed = paths.join(step.filter("next < tail").withColumnRenamed("next", "head"), [*keys, "tail"]).filter(F.col("head") == F.get("path", F.lit(0))).filter(F.get("path", F.lit(1)) < F.col("tail"))
        part = closed.select(*keys, F.lit(size).alias("size"), F.array_join(F.array_sort("path"), ",").alias("atoms"))
        found = part if found is None else found.unionByName(part)
    return found.distinct()


#: Kinds of aromatic rings by size and numbers of atoms of C, N, O and S.
AROMATIC = {(6, 6, 0, 0, 0): "BENZENE", (6, 5, 1, 0, 0): "PYRIDINE", (6, 4, 2, 0, 0): "PYRIMIDINE", (5, 4, 1, 0, 0): "PYRROLE", (5, 3, 2, 0, 0): "IMIDAZOLE", (5, 4, 0, 1, 0): "FURAN", (5, 4, 0, 0, 1): "THIOPHENE"}


def ring_types(found: DataFrame, atoms: DataFrame, keys: list[str]) -> DataFrame:
    """rings with kind, aromatic and heterocyclic by element counts; atoms has a row (atom_id, element) per atom."""
    members = found.select(*keys, "size", "atoms", F.explode(F.split("atoms", ",").cast("array<bigint>")).alias("atom_id"))
    element = F.upper(F.trim(F.coalesce("element", F.lit("C"))))
    counts = {f"n_{e}": F.count_if(element == e.upper()) for e in "cnos"}
    rows = members.join(atoms.select("atom_id", "element"), "atom_id", "left").groupBy(*keys, "size", "atoms").agg(*[c.alias(n) for n, c in counts.items()])
    kind = F.lit("GENERAL_CYCLE")
    for values, name in AROMATIC.items():
        kind = F.when(F.array(F.col("size").cast("long"), *counts) == F.array(*[F.lit(v).cast("long") for v in values]), name).otherwise(kind)
    rows = rows.withColumns({"kind": kind, "heterocyclic": F.col("n_n") + F.col("n_o") + F.col("n_s") > 0})
    return rows.select(*keys, "size", "atoms", "kind", (F.col("kind") != "GENERAL_CYCLE").alias("aromatic"), "heterocyclic")


#: Ancestors of a node that one task gathers in one row at most.
CELL = 1 << 20


def generations(edges: DataFrame, depth: int | None, cell: int, packed: bool) -> DataFrame:
    """(node, distance, ancestors, n) over (parent, child) edges: the ancestors of a node at their least distance, as arrays or, of whole
    numbers, as packed sets, one for up to `cell` of them, and how many these are. A generation hands the last one's to children and takes
    away what a child has already, so that cycles end; an edge moves a set and not a row for each pair, and a packed one takes a byte or
    two for an ancestor. It ends at the depth, or where no node with new ancestors has children."""
    step = stored(edges.select("parent", "child").distinct())
    inner = step.select(F.col("parent").alias("child"), F.lit(True).alias("inner")).distinct()
    up = stored(step.join(inner, "child", "left").select(F.col("child").alias("node"), "parent", F.coalesce("inner", F.lit(False)).alias("inner")))
    degree = up.groupBy("node").count().agg(F.max("count")).first()[0] or 0
    path = shared_path(edges.sparkSession)

    def dealt(rows: DataFrame, cells: int) -> DataFrame:
        """Sets by node and cell; those of more than one cell are taken apart by the hash of the ancestor."""
        if cells == 1:
            return rows.withColumn("cell", F.lit(0).cast("long"))
        if packed:
            return sets.dealt(rows, "ancestors", cells)
        return rows.withColumn("a", F.explode("ancestors")).select("node", "inner", F.array("a").alias("ancestors"), F.pmod(F.xxhash64("a"), F.lit(cells)).alias("cell"))

    def kept(new: DataFrame, known: DataFrame | None, cells: int, k: int) -> DataFrame:
        rows = dealt(new, cells).withColumn("known", F.lit(False))
        if known is not None:
            rows = rows.unionByName(dealt(known, cells).withColumn("known", F.lit(True)))
        # By a shuffle of its own, as sets that are put side by side before it are no smaller.
        of = lambda known: F.collect_list(F.when(F.col("known") == known, F.col("ancestors")))
        found = rows.repartition("node", "cell").groupBy("node", "cell").agg(of(False).alias("new"), of(True).alias("old"), F.max("inner").alias("inner")).filter(F.size("new") > 0)
        if packed:
            found = sets.merged(found.drop("cell"), "new", "old", "ancestors")
        else:
            found = found.withColumn("ancestors", F.array_except(F.flatten("new"), F.flatten("old"))).withColumn("n", F.size("ancestors").cast("long")).filter("n > 0")
        return stored(found.select("node", F.lit(k).alias("distance"), "ancestors", "n", "inner"), path)

    k, cells = 1, -(-degree // cell) or 1
    found = kept(sets.singles(up, "parent", "ancestors") if packed else up.select("node", "inner", F.array("parent").alias("ancestors")), None, cells, k)
    while depth is None or k < depth:
        frontier = found.filter((F.col("distance") == k) & F.col("inner")).select(F.col("node").alias("parent"), "ancestors", "n")
        most = frontier.agg(F.max("n")).first()[0]
        if most is None:
            break
        k, cells = k + 1, -(-degree * most * cells // cell)
        found = kept(up.join(frontier, "parent").select("node", "inner", "ancestors"), found.select("node", "inner", "ancestors"), cells, k)
    return found.select("node", "distance", "ancestors", "n")


def packed_ancestors(edges: DataFrame, depth: int | None = None, cell: int = CELL) -> DataFrame:
    """(node, distance, ancestors) over (parent, child) edges of longs, the ancestors as packed sets."""
    return generations(edges, depth, cell, True).drop("n")


def ancestor_sets(edges: DataFrame, depth: int | None = None, cell: int = CELL) -> DataFrame:
    """(node, distance, ancestors) over (parent, child) edges: the ancestors of a node at their least distance, as arrays, one for up to
    `cell` of them."""
    if {edges.schema[n].dataType for n in ("parent", "child")} == {LongType()}:
        return sets.unpacked(packed_ancestors(edges, depth, cell), "ancestors")
    return generations(edges, depth, cell, False).drop("n")


def ancestors(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, ancestor, distance) over (parent, child) edges, each pair once, at its least distance."""
    return ancestor_sets(edges, depth).select("node", F.explode("ancestors").alias("ancestor"), "distance")


def roots(edges: DataFrame) -> DataFrame:
    """Parents that are nobody's child."""
    return edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The (parent, child) edges left when those that start at nobody's child or end at nobody's parent are taken away, again and
    again; every cycle stays whole."""
    core = stored(edges.select("parent", "child").distinct())
    n = core.count()
    while True:
        inner = core.join(core.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        core = stored(inner.join(inner.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("parent", "child"))
        left = core.count()
        if left == n:
            return core
        n = left


def cycle_edges(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """Edges that close a cycle: the child is an ancestor of the parent, or the same."""
    up = ancestors(cyclic_core(edges), depth).select(F.col("node").alias("parent"), F.col("ancestor").alias("child"))
    return edges.join(up, ["parent", "child"], "left_semi").unionByName(edges.filter("parent = child")).distinct()
