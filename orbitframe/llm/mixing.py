"""Mixing sources to target weights.

The words of a source form one stream, cut into blocks of a fixed number of words. Output shards draw how many of their slots
each source fills (multinomial draws against what the source has left), the k-th slot of a source maps to a block through a
pseudorandom permutation of the source's block numbers, one pass over the permutation per epoch, and blocks join slots by
number. A source's last slot is cut so that it gives its target to the word.

Targets: sources by code point with null last weigh 3, 1, 2, repeating, and share `share` of all words; a target stops at
`most` times its source's words and the excess is shared again by weight.

Null and empty texts have size 0 and take 0 words. Rows with equal ids count one by one. An empty table gives an empty result.
The driver sees one row per source, and plans one per source and shard of SHARD_SLOTS blocks, never a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.llm.common import SPACE, let, mix, stored, unused, word_counts

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
BLOCK_WORDS = 64
#: Output shards, and more of them where each would hold more slots than this.
SHARDS, SHARD_SLOTS = 64, 1 << 18
#: A source's documents are dealt by hash to cells of about so many; each cell is summed by itself, then the cells' totals are.
CELL_ROWS = 10_000
SEED = 20_240_229


def targets(sizes: list[float], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Shares of share * sum(sizes) by weight, none above most times its size; excess goes to the others by weight."""
    wanted = share * sum(sizes)
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    while open_:
        left = wanted - sum(out[i] for i in range(len(sizes)) if i not in open_)
        unit = left / sum(weight[i] for i in sorted(open_))
        full = [i for i in sorted(open_) if unit * weight[i] > most * sizes[i]]
        for i in full or sorted(open_):
            out[i] = most * sizes[i] if full else unit * weight[i]
        if not full:
            break
        open_ -= set(full)
    return out


def permuted(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at `index`: a four-round Feistel network, walked on until it falls below n."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for r in range(3, -1, -1) if inverse else range(4):
            salt = np.uint64((key * 4 + r) & 0xFFFFFFFFFFFFFFFF)
            if inverse:
                left, right = right ^ (mix(mix(left + np.uint64(0x51ED2701)) ^ salt) & mask), left
            else:
                left, right = right, left ^ (mix(mix(right + np.uint64(0x51ED2701)) ^ salt) & mask)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def shard_counts(slots: list[int], shards: int, seed: int) -> list[list[int]]:
    """counts[shard][source]: multinomial draws in proportion to the slots that each source has left; columns sum to `slots`."""
    rng = np.random.default_rng(seed)
    left = np.array(slots, np.int64)
    out = []
    for shard in range(shards):
        room = int(left.sum()) // (shards - shard)
        took = np.zeros_like(left)
        while room:
            draw = np.minimum(rng.multinomial(room, (left - took) / (left - took).sum()), left - took)
            took += draw
            room -= int(draw.sum())
        left -= took
        out.append(took.tolist())
    return out


def source_plan(sized: DataFrame, block: int, share: float, most: float, weights: tuple[float, ...], seed: int) -> list[dict]:
    """One row per source: its size, target, blocks and slots. The number of sources bounds it."""
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    found = sorted(((r["source"], int(r["size"]), r["n"]) for r in found), key=lambda x: (x[0] is None, [ord(c) for c in x[0] or ""]))
    out = []
    for i, ((source, size, n), target) in enumerate(zip(found, targets([s for _, s, _ in found], weights, share, most), strict=True)):
        blocks, whole = -(-size // block), int(target + 1e-6)
        epochs, rest = divmod(whole, size) if size else (0, 0)
        slots, last_cut = epochs * blocks, 0
        if rest:
            short = block - (size - (blocks - 1) * block)
            full, over = divmod(rest, block)
            at = int(permuted(np.array([blocks - 1]), blocks, seed * 1009 + i, inverse=True)[0])
            if short and full + (over > 0) > at:
                full, over = divmod(rest + short, block)
            used = full + (over > 0)
            if over and used - 1 == at:  # the short block is the last one taken
                over = rest - full * block
            slots += used
            last_cut = over
        out.append({"source": source, "source_no": i, "source_size": size, "target": float(target), "blocks": blocks, "slots": slots, "last_words": last_cut, "key": seed * 1009 + i, "cells": -(-n // CELL_ROWS)})
    return out


def slot_table(df: DataFrame, plan: list[dict], shards: int, seed: int) -> DataFrame:
    """A row per slot: source_no, shard, epoch, block, words (of the block that the slot takes, from its start; null: all)."""
    spark = df.sparkSession
    counts = shard_counts([p["slots"] for p in plan], shards, seed)
    ranges, first = [], [0] * len(plan)
    for shard, row in enumerate(counts):
        for p, n in zip(plan, row, strict=True):
            if n:
                ranges.append((p["source_no"], shard, first[p["source_no"]], n))
                first[p["source_no"]] += n
    by_no = {p["source_no"]: p for p in plan}

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source_no, shard, start, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p = by_no[source_no]
                for lo in range(start, start + n, 100_000):
                    k = np.arange(lo, min(lo + 100_000, start + n))
                    block = permuted(k % p["blocks"], p["blocks"], p["key"])
                    words = np.full(len(k), -1)
                    if p["last_words"]:
                        words[k == p["slots"] - 1] = p["last_words"]
                    arrays = [np.full(len(k), source_no, np.int32), np.full(len(k), shard, np.int32), (k // p["blocks"]).astype(np.int32), block, words.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["source_no", "shard", "epoch", "block", "words"])

    rows = spark.createDataFrame(ranges, "source_no int, shard int, start long, n long")
    return rows.repartition(min(len(ranges), 4 * shards) or 1, "source_no", "shard").mapInArrow(slots, "source_no int, shard int, epoch int, block long, words int")


def small(facts: DataFrame, plan: list[dict]) -> DataFrame:
    """facts, a row per source, sent to all tasks while there are at most 10,000; more of them are joined as any table."""
    return F.broadcast(facts) if len(plan) <= 10_000 else facts


def placed(sized: DataFrame, plan: list[dict]) -> DataFrame:
    """sized with source_no and offset, the words of the source before the row. Rows are ordered by cell, key, size and text.

    A running sum inside each of the source's cells, plus the sum of the cells before: no task sees a whole source.
    """
    spark = sized.sparkSession
    numbers = spark.createDataFrame([(p["source"], p["source_no"], p["cells"]) for p in plan], "s_ string, source_no int, cells int")
    rows = sized.join(small(numbers, plan), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("key", "size", "text_hash"), "cells").cast("int")).drop("cells")
    totals = rows.groupBy("source_no", "cell").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_no").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source_no", "cell", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_no", "cell").orderBy("key", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(totals, ["source_no", "cell"]).withColumn("offset", F.col("base") + F.col("inner")).drop("base", "inner", "cell")


def sized_rows(docs: DataFrame, key: str, column: str, source: str) -> DataFrame:
    """key, source, text_hash, size."""
    text = F.col(column).cast("string")
    return word_counts(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), text.alias("text")), "text", "size")


def taken_pieces(docs: DataFrame, key: str = "doc_id", column: str = "text", source: str = "source", block: int = BLOCK_WORDS, shards: int = SHARDS, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(documents: key, source, source_no, text_hash, size, offset; pieces: the same, shard, epoch, first, words; the plan).

    A piece is a run of `words` words of one document, from its word number `first`, that one slot of an output shard takes.
    """
    sized = stored(sized_rows(docs, key, column, source))
    plan = source_plan(sized, block, share, most, weights, seed)
    rows = placed(sized, plan)
    slots = slot_table(docs, plan, max(shards, -(-sum(p["slots"] for p in plan) // SHARD_SLOTS)), seed)
    spans = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block))))
    # The slots' size isn't seen from the few ranges that they are made of: they must not be taken for a small side.
    joined = spans.join(slots.hint("merge"), ["source_no", "block"])
    start = F.col("block") * block
    stop = start + F.when(F.col("words") >= 0, F.col("words")).otherwise(block)
    low, high = F.greatest(start, F.col("offset")), F.least(stop, F.col("offset") + F.col("size"))
    pieces = joined.filter(high > low).select("source_no", "source", "key", "text_hash", "size", "offset", "shard", "epoch", (low - F.col("offset")).alias("first"), (high - low).alias("words"))
    return rows, pieces, plan


def mixed(docs: DataFrame, key: str = "doc_id", column: str = "text", source: str = "source", **options) -> DataFrame:
    """key, size, source_size, target, taken; one row per input row."""
    rows, pieces, plan = taken_pieces(docs, key, column, source, **options)
    facts = docs.sparkSession.createDataFrame([(p["source_no"], p["source_size"], p["target"]) for p in plan], "source_no int, source_size long, target double")
    place = ["source_no", "offset", "size"]
    taken = pieces.groupBy(*place).agg(F.sum("words").alias("taken"))
    out = rows.select("key", *place).join(taken, place, "left").join(small(facts, plan), "source_no")
    return out.select(F.col("key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", column: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row per document and epoch that takes words of it.

    A text that is taken whole keeps as it is; otherwise it is the taken words, joined by one space. n_chars, where docs has
    it, is counted anew. Rows of which nothing is taken, and empty ones, go. Rows of one id, source and text are told apart by rank.
    """
    _, pieces, _ = taken_pieces(docs, key, column, source, **options)
    place, copy, take, takes = unused(docs, "place", "copy", "take", "takes")
    same = ["key", "source", "text_hash"]
    taken = pieces.groupBy(*same, "size", "offset", "epoch").agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias("spans"), F.sum("words").alias("taken"))
    taken = taken.withColumn("copy", F.dense_rank().over(Window.partitionBy(*same).orderBy("offset")))
    taken = taken.groupBy(F.xxhash64(*same).alias(place)).agg(F.collect_list(F.struct(*same, "size", "copy", "spans", "taken")).alias(takes))
    own = [F.col(key), F.col(source).cast("string"), F.xxhash64(F.col(column).cast("string"))]
    # The texts move once: by the hash of what tells rows apart, which both the rank and the join go by.
    keyed = docs.withColumn(place, F.xxhash64(*own)).repartition(place)
    keyed = keyed.withColumn(copy, F.row_number().over(Window.partitionBy(place, *own).orderBy(F.lit(0))))
    out = keyed.join(taken.hint("merge"), place).withColumn(take, F.explode(takes))
    t = F.col(take)
    mine = t["copy"] == F.col(copy)
    for name, c in zip(same, own, strict=True):
        mine &= t[name].eqNullSafe(c)
    parts = F.split(F.regexp_replace(F.col(column), f"^[{SPACE}]+|[{SPACE}]+$", ""), f"[{SPACE}]+")
    cut = let(parts, lambda w: F.array_join(F.flatten(F.transform(t["spans"], lambda s: F.slice(w, (s["first"] + 1).cast("int"), s["words"].cast("int")))), " "))
    out = out.filter(mine).withColumn(column, F.when(t["taken"] == t["size"], F.col(column)).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(F.col(column)).cast("long"))
    return out.select(*docs.columns)
