"""Packing by optimal length buckets.

The lengths are counted once and stored. Their global histogram (one map-side combined count) is all that the driver sees: a row
per distinct length. Dynamic programming over it chooses the bucket boundaries with the least padding. Inside each bucket, batches
hold as many documents as fit the token budget when every document is padded to the bucket's boundary.

A null or empty text has 0 tokens and goes to the first bucket. A document longer than the budget is a batch by itself. Rows
with equal ids are packed one by one. Extra columns of the input are not returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.llm.common import stored, word_counts

BUCKETS = 16
TOKEN_BUDGET = 65_536
#: Documents of a bucket that one task packs.
CELL_ROWS = 50_000


def length_histogram(lengths: DataFrame) -> list[tuple[int, int]]:
    """(length, documents), ascending: as many rows as there are distinct lengths, of which the longest document sets the bound."""
    t = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow()
    return sorted(zip(t["n_tokens"].to_pylist(), t["n"].to_pylist(), strict=True))


def best_splits(best: np.ndarray, before: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least best[i-1] + (documents of i..j) * length[j] over i <= j, and that i.

    The best i rises with j: the middle j of a range is settled first and halves the choices of the others. All ranges of one
    depth are settled together.
    """
    m = len(length)
    layer, split = best.copy(), np.zeros(m, np.int64)
    head = np.concatenate([[0.0], best[:-1]])
    lo, hi, first, last = (np.array([v]) for v in (0, m - 1, 0, m - 1))
    while len(lo):
        mid = (lo + hi) // 2
        sizes = np.minimum(last, mid) - first + 1
        starts = np.cumsum(sizes) - sizes
        own = np.repeat(np.arange(len(mid)), sizes)
        i = np.arange(len(own)) - starts[own] + first[own]
        costs = head[i] + (before[mid + 1][own] - before[i]) * length[mid][own]
        least = np.minimum.reduceat(costs, starts)
        hit = np.flatnonzero(costs == least[own])
        at = i[hit[np.unique(own[hit], return_index=True)[1]]]
        layer[mid], split[mid] = least, at
        lo, hi, first, last = (np.concatenate(x) for x in ((lo, mid + 1), (mid - 1, hi), (first, at), (at, last)))
        keep = lo <= hi
        lo, hi, first, last = lo[keep], hi[keep], first[keep], last[keep]
    return layer, split


def optimal_boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """The upper ends of at most `buckets` ranges of lengths that minimise the total padding, in buckets * M log M steps."""
    if not histogram:
        return []
    length = np.array([x for x, _ in histogram], np.float64)
    before = np.concatenate([[0], np.cumsum([n for _, n in histogram])]).astype(np.float64)
    m = len(length)
    best = before[1:] * length
    splits = []
    for _ in range(1, min(buckets, m)):
        best, split = best_splits(best, before, length)
        splits.append(split)
    out, j = [], m - 1
    for split in reversed(splits):
        out.append(int(length[j]))
        j = int(split[j]) - 1
        if j < 0:
            break
    if j >= 0:
        out.append(int(length[j]))
    return sorted(set(out))


def bucket_of(length: Column, boundaries: list[int]) -> tuple[Column, Column]:
    """(bucket's number, bucket's length) as chained conditions; there are few boundaries."""
    index, upto = F.lit(len(boundaries) - 1), F.lit(boundaries[-1])
    for i in range(len(boundaries) - 2, -1, -1):
        index = F.when(length <= boundaries[i], i).otherwise(index)
        upto = F.when(length <= boundaries[i], boundaries[i]).otherwise(upto)
    return index.cast("int"), upto.cast("long")


def packed(docs: DataFrame, key: str = "doc_id", column: str = "text", buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, tokens: Column | None = None) -> DataFrame:
    """key, n_tokens, bucket, bucket_length, batch_id, slot, padding; one row per input row.

    tokens: the length of a document; its words unless given. A bucket is cut into cells by a hash of key and length so that no
    task holds a whole bucket; each cell fills its own batches, of which only the last may be short.
    """
    if tokens is None:
        lengths = word_counts(docs.select(F.col(key).alias("key"), F.col(column).alias("text")), "text", "n_tokens")
    else:
        lengths = docs.select(F.col(key).alias("key"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"))
    lengths = stored(lengths)
    histogram = length_histogram(lengths)
    boundaries = optimal_boundaries(histogram, buckets) or [0]
    counts = [0] * len(boundaries)
    for length, n in histogram:
        counts[int(np.searchsorted(boundaries, length))] += n
    cells = F.element_at(F.array(*[F.lit(-(-n // CELL_ROWS) or 1) for n in counts]), F.col("bucket") + 1)
    index, upto = bucket_of(F.col("n_tokens"), boundaries)
    cell = F.pmod(F.xxhash64("key", "n_tokens"), cells).cast("int")
    order = Window.partitionBy("bucket", "cell").orderBy("key", "n_tokens")
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("long")
    return (
        lengths.withColumns({"bucket": index, "bucket_length": upto})
        .withColumn("cell", cell)
        .withColumn("at", F.row_number().over(order) - 1)
        .select(
            F.col("key").alias(key),
            "n_tokens",
            "bucket",
            "bucket_length",
            F.format_string("%d-%d-%d", "bucket", "cell", F.floor(F.col("at") / room)).alias("batch_id"),
            F.pmod(F.col("at"), room).cast("int").alias("slot"),
            (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
        )
    )
