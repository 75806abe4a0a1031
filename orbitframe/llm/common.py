"""Helpers shared by the operators: table access, lineage cuts, word hashing on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orbitframe.operators.graphs import stored as stored

#: The characters that separate words, as a Java and Python character class.
SPACE = r"\x20\x09-\x0D"
#: Bytes of text that a task hashes at a time.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed_sample(rows: DataFrame, by: Column, most: int) -> DataFrame:
    """The rows of distinct values of `by`, those of the `most` least hashes; all of them if there are no more. Copies fall to one
    hash and count once. A share of the hash range is cut out first, set by the number of distinct hashes and doubled until it
    holds `most` of them, so that tasks pass on a few times `most` rows between them at any input size and any number of copies."""
    rows = rows.withColumn("hash_", F.xxhash64(by))
    hashes = rows.select("hash_")
    n = hashes.agg(F.approx_count_distinct("hash_")).first()[0]
    share = (1.25 * most + 50) / max(n, 1)
    while share < 1:
        cut = F.col("hash_") <= F.lit(int((1 << 64) * share) - (1 << 63))
        if hashes.filter(cut).distinct().count() >= most:
            rows = rows.filter(cut)
            break
        share *= 2
    return rows.dropDuplicates(["hash_"]).orderBy("hash_").limit(most).drop("hash_")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until the table holds no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, by way of a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a bijection on 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        step = np.full(size, _BASE, np.uint64)
        back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        step[0] = back[0] = 1
        _powers[size] = np.cumprod(step), np.cumprod(back)
    return _powers[size]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets of the rows) of a string column, about `most` bytes at a time.

    A single text longer than that comes whole, by itself.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of each word, and where each row's words begin.

    Words are the runs without the bytes 9 to 13 and 32. The hash is a polynomial modulo 2^64 over the word's bytes, taken
    from prefix sums so that no word is visited in Python, then mixed.
    """
    n = len(raw)
    inside = np.zeros(n + 1, bool)
    np.logical_not((raw == 32) | ((raw >= 9) & (raw <= 13)), out=inside[:n])
    fresh = np.ones(n + 1, bool)
    fresh[1:] = ~inside[:n]
    fresh[offsets] = True
    starts = np.flatnonzero(inside & fresh)
    last = np.ones(n + 1, bool)
    last[:n] = ~inside[1:]
    last[offsets[offsets > 0] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    up, down = _power_tables(max(n, 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def counts_of(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of words of each row, as in words()."""
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    fresh = np.ones(len(raw), bool)
    fresh[1:] = ~inside[:-1]
    fresh[offsets[offsets < len(raw)]] = True
    return np.diff(np.searchsorted(np.flatnonzero(inside & fresh), offsets))


def word_counts(rows: DataFrame, column: str, name: str = "n_words") -> DataFrame:
    """rows with the number of words [^\\x20\\x09-\\x0D]+ in place of a text column; 0 for null."""
    rest = [f for f in rows.schema if f.name != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [counts_of(raw, offsets) for _, _, raw, offsets in chunks(b.column(len(rest)))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(np.concatenate([np.zeros(0, np.int64), *n]), pa.int64())], [*(f.name for f in rest), name])

    texts = rows.select(*[F.col(f"`{f.name}`") for f in rest], F.col(column).cast("string"))
    return texts.mapInArrow(run, StructType([*rest, StructField(name, LongType())]))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; the caller keeps to runs inside one row. Shorter than the input by n - 1."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:count]) * down[:count] + np.uint64(n))


def salted(values: np.ndarray, salt: int) -> np.ndarray:
    return mix(values ^ np.uint64((salt * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))
