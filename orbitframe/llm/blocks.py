"""Sorted runs streamed through Arrow batches, hot keys cut into pairs of blocks, connected components of edge tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.common import stored


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, run borders) of whole runs of equal long keys from sorted batches; a run that goes on waits for its end."""
    waiting: list[pa.Table] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        first, end = tuple(int(c[0]) for c in cols), tuple(int(c[-1]) for c in cols)
        if waiting and first != last:
            yield _with_borders(pa.concat_tables(waiting), keys)
            waiting = []
        if end != first:
            change = np.zeros(b.num_rows - 1, bool)
            for c in cols:
                change |= c[1:] != c[:-1]
            at = int(np.flatnonzero(change)[-1]) + 1
            yield _with_borders(pa.concat_tables([*waiting, t.slice(0, at)]), keys)
            waiting = [t.slice(at)]
        else:
            waiting.append(t)
        last = end
    if waiting:
        yield _with_borders(pa.concat_tables(waiting), keys)


def _with_borders(t: pa.Table, keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    t = t.combine_chunks()
    change = np.zeros(max(0, t.num_rows - 1), bool)
    for k in keys:
        c = t.column(k).to_numpy()
        change |= c[1:] != c[:-1]
    return t, np.concatenate([[0], np.flatnonzero(change) + 1, [t.num_rows]])


def block_pairs(rows: DataFrame, counted: DataFrame, key: str, node: str, most: int) -> DataFrame:
    """rows with bi, bj: a key of more than `most` rows is cut into blocks by hash, and each row goes to all pairs of blocks
    with its own. Any two rows of a key so meet in a group of at most about 2 * most rows. `own` is the row's block.

    counted has (key, size) of the large keys at least. It is joined by the key's complement: a shuffle join by itself, which adaptive
    execution splits where a key has too many rows for a task.
    """
    large = counted.filter(F.col("size") > most).select(F.bitwise_not(key).alias("w_"), "size")
    n = F.coalesce(F.ceil(F.col("size") / most), F.lit(1)).cast("int")
    out = rows.join(large, F.bitwise_not(key) == F.col("w_"), "left").drop("w_").withColumn("n_", n)
    out = out.withColumn("own", F.pmod(F.xxhash64(F.lit(7), node), F.col("n_")).cast("int"))
    out = out.withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("n_") - 1)))
    return out.withColumns({"bi": F.least("own", "other_"), "bj": F.greatest("own", "other_")}).drop("other_", "n_", "size")


def forest(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the graph over 0..n-1 in which linked(i, js) flags the later js that i is linked with.

    Only those that are not connected yet are asked for, and what i brings together becomes a chain, so that no index gets many edges.
    """
    label = np.arange(n)
    out = []
    for i in range(n - 1):
        js = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(js):
            continue
        found = js[linked(i, js)]
        if len(found):
            old, at = np.unique(label[found], return_index=True)
            chain = [i, *found[at].tolist()]
            out += zip(chain[:-1], chain[1:], strict=True)
            label[np.isin(label, old)] = label[i]
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component, for all nodes that have an edge (u, v).

    Alternates large-star and small-star steps, each two aggregations and joins on the edges, until nothing changes; the
    number of rounds grows with the logarithm of the component size. Edges never leave the executors. A large component's least
    node gathers its edges: the aggregation is combined before the shuffle, and the join goes by the complement of the node, so
    that it is a shuffle join by itself, which adaptive execution splits where a node has too many edges for a task.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = stored(e)
    before = None

    def with_least(rows: DataFrame, least: Column) -> DataFrame:
        found = rows.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("w"), least.alias("m"))
        return rows.join(found, F.bitwise_not("u") == F.col("w"))

    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = with_least(both, F.least("u", "m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = with_least(big, F.col("m")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = stored(near.distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
