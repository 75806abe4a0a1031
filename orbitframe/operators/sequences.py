"""Pairs of sequences: leakage between sets, global alignment of surviving pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.operators.graphs import few

GAP_OPEN, GAP_EXTEND = 10, 1


#: Training sequences that a query meets at a time.
BLOCK = 64


def leakage_join(queries: DataFrame, training: DataFrame, threshold: float = 0.30) -> DataFrame:
    """Pairs (seq_id, seq) x (train_id, train) of positional identity at or over the threshold.

    Identity is at most the ratio of lengths, so a pair's lengths lie in the same or in neighbouring bands of a geometric scale. The
    training sequences of a band are dealt to blocks; each query meets the blocks of its three bands, and letters are compared in
    numpy, a block at a time. Only pairs that reach the threshold become rows.
    """
    step = -np.log(threshold)
    band = lambda c: F.floor(F.log(F.greatest(F.length(c), F.lit(1)).cast("double")) / step)
    sized = training.withColumn("band", band("train"))
    counts = sized.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = sized.join(counts, "band").withColumn("block", F.pmod(F.xxhash64("train_id"), "blocks"))
    blocks = dealt.groupBy("band", "block").agg(F.collect_list(F.struct("train_id", "train")).alias("b")).select("band", F.transform("b", lambda x: x["train_id"]).alias("train_ids"), F.transform("b", lambda x: x["train"]).alias("trains"))
    rows = queries.withColumn("band", F.explode(F.array(*[band("seq") + k for k in (-1, 0, 1)]))).join(blocks, "band").select("seq_id", "seq", "train_ids", "trains")
    kinds = [rows.schema["seq_id"].dataType.simpleString(), training.schema["train_id"].dataType.simpleString()]

    def letters(s: str) -> np.ndarray:
        return np.frombuffer((s or "").encode("utf-32-le"), np.uint32)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for seq_id, seq, ids, trains in b.itertuples(index=False):
                a = letters(seq)
                for train_id, train in zip(ids, trains, strict=True):
                    n, m = len(a), len(train or "")
                    if min(n, m) >= threshold * max(n, m, 1):
                        c = letters(train)
                        share = (a[: min(n, m)] == c[: min(n, m)]).sum() / max(n, m)
                        if share >= threshold:
                            out.append((seq_id, train_id, float(share)))
            yield pd.DataFrame(out, columns=["seq_id", "train_id", "identity"])

    return rows.mapInPandas(compare, f"seq_id {kinds[0]}, train_id {kinds[1]}, identity double")


#: Substitution scores, the lower triangle in the order of the letters.
LETTERS = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""


def _table() -> np.ndarray:
    """Scores by code points under 128; letters that the matrix lacks score 1 with themselves, else -1."""
    table = np.full((128, 128), -1, np.int32)
    np.fill_diagonal(table, 1)
    for x, line in zip(LETTERS, BLOSUM62.split("\n")[1:], strict=False):
        for y, v in zip(LETTERS, line.split(), strict=False):
            table[ord(x), ord(y)] = table[ord(y), ord(x)] = int(v)
    return table


SCORES = _table()
FLAT = SCORES.ravel()
#: What a gap costs by how the cell before was reached.
UP, LEFT = (np.array([GAP_EXTEND if k == gap else GAP_OPEN for k in range(3)], np.int32) for gap in (1, 2))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Substitution scores of letters by code point, of any script."""
    plain = (a < 128) & (b < 128)
    return np.where(plain, SCORES[np.where(plain, a, 0), np.where(plain, b, 0)], np.where(a == b, 1, -1))


#: Bytes of trace that an alignment holds at a time, about; longer ones keep every so many antidiagonals and fill the rest again.
TRACE_BYTES = 1 << 25


class Diagonals:
    """Antidiagonals of the table of a global alignment, by row: the scores of the last two, and how the last one's cells were reached
    (0 by the diagonal, 1 by a gap in b, 2 by a gap in a)."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y, n = x, y, len(x)
        self.ascii = bool((x < 128).all() and (y < 128).all())
        # Where a letter's row begins in the flat table, and the other sequence backwards, as an antidiagonal meets it.
        self.row, self.back = x * 128, y[::-1].copy()
        self.k, self.before, self.last, self.reached = 0, np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32), np.zeros(n + 1, np.uint8)

    def saved(self) -> tuple:
        return self.k, self.before, self.last, self.reached

    def load(self, state: tuple) -> None:
        self.k, self.before, self.last, self.reached = state

    def advance(self) -> None:
        x, k = self.x, self.k + 1
        n, m = len(x), len(self.y)
        now, reached = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.uint8)
        lo, hi = max(1, k - m), min(n, k - 1) + 1
        if lo < hi:
            i = slice(lo, hi)
            above = slice(lo - 1, hi - 1)
            back = self.back[m - k + lo : m - k + hi]
            diagonal = self.before[above] + (FLAT.take(self.row[above] + back) if self.ascii else scores(x[above], back))
            up = self.last[above] - UP.take(self.reached[above])
            left = self.last[i] - LEFT.take(self.reached[i])
            best = np.maximum(diagonal, up)
            reached[i] = up > diagonal
            np.putmask(reached[i], left > best, 2)
            np.maximum(best, left, out=now[i])
        edge = -GAP_OPEN - (k - 1) * GAP_EXTEND
        if k <= n:
            now[k], reached[k] = edge, 1
        if k <= m:
            now[0], reached[0] = edge, 2
        self.k, self.before, self.last, self.reached = k, self.last, now, reached


def align(a: str, b: str, trace_bytes: int = TRACE_BYTES) -> tuple[int, float, float]:
    """(score, identity and similarity in percent of the alignment) of the global alignment in which a gap costs GAP_OPEN for its first
    letter and GAP_EXTEND for each further one.

    A cell takes the best of three, the diagonal first on ties, then the gap in b, and a gap is extended where the cell before was
    itself reached by one. Cells of an antidiagonal are filled together. If the trace fits, it is kept whole; else only every so many
    antidiagonals are, and the way back fills the stretch before each of them once more: n + m antidiagonals take the square root of
    that many at a time, in twice the time."""
    x, y = (np.array([ord(c) for c in s.upper()], np.int64) for s in (a, b))
    n, m = len(x), len(y)
    total = n + m
    stride = total + 1 if (n + 1) * total <= trace_bytes else int(np.sqrt(9 * total)) + 1
    rows, kept = Diagonals(x, y), []
    held: list[np.ndarray] = []
    for k in range(total):
        if k % stride == 0:
            kept.append(rows.saved())
            held = []
        rows.advance()
        held.append(rows.reached)
    score = int(rows.last[n])
    i, j, length, same, alike = n, m, 0, 0, 0
    for block in reversed(range(len(kept))):
        start, state = block * stride, kept.pop()
        if i + j <= start:
            continue
        if start + len(held) < i + j or rows.k != start + len(held):  # all but the last stretch
            rows.load(state)
            held = []
            for _ in range(stride):
                rows.advance()
                held.append(rows.reached)
        p, q = [], []
        while i + j > start:
            length += 1
            step = held[i + j - start - 1][i]
            if step == 0:
                p.append(i - 1)
                q.append(j - 1)
            i, j = i - (step != 2), j - (step != 1)
        p, q = np.array(p, np.int64), np.array(q, np.int64)
        same, alike = same + int((x[p] == y[q]).sum()), alike + int((scores(x[p], y[q]) > 0).sum())
    return score, 100.0 * same / max(length, 1), 100.0 * alike / max(length, 1)


def sequence_alignment_pairs(pairs: DataFrame) -> DataFrame:
    """score, identity and similarity for a table of pairs (left_id, right_id, left, right)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [align(x or "", y or "") for x, y in zip(b.left, b.right, strict=True)]
            yield pd.DataFrame({"left_id": b.left_id, "right_id": b.right_id, **{n: [f[k] for f in found] for k, n in enumerate(("score", "identity", "similarity"))}})

    return pairs.mapInPandas(run, "left_id long, right_id long, score long, identity double, similarity double")


#: Words that a task hands on at a time, about.
WORDS = 1 << 20


def hashes(seq: str, k: int) -> np.ndarray:
    """Hashes of all words of k letters, in order: words of one letter are put together to words of two, and so on."""
    raw = np.frombuffer(seq.encode(), np.uint8).astype(np.uint64)
    if len(raw) < k:
        return np.zeros(0, np.uint64)
    factor = 0x9E3779B97F4A7C15 | 1
    h, size = raw, 1
    for odd in bin(k)[3:]:
        h, size = h[:-size] * np.uint64(pow(factor, size, 1 << 64)) + h[size:], 2 * size
        if odd == "1":
            h, size = h[:-1] * np.uint64(factor) + raw[size:], size + 1
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(seq: str, k: int, share: int = 1) -> np.ndarray:
    """Distinct hashes of the words of k letters, of all or of those whose hash is a multiple of `share`."""
    h = hashes(seq, k)
    return np.unique(h if share == 1 else h[h % np.uint64(share) == 0]).view(np.int64)


#: A table of 2 ** BITS bits says which hashes may occur, by their highest bits.
BITS = 25


def bit_table(words: DataFrame) -> np.ndarray:
    """The table of the column word, as bytes. It is put together by the tasks; what reaches the driver is at most its size."""
    place = F.shiftrightunsigned("word", 64 - BITS) + 1
    rows = words.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    table = np.zeros(1 << BITS - 3, np.uint8)
    for r in rows.collect():
        at = np.frombuffer(r.bits, np.uint8)
        table[(r.bucket - 1) * len(at) : r.bucket * len(at)] = at
    return table


def related_pairs(left: DataFrame, right: DataFrame, k: int = 16, ratio: float = 0.5) -> DataFrame:
    """Pairs (left_id, right_id, left, right) of sequences (seq_id, seq) that share a word of k letters and whose lengths differ by no
    more than the ratio: candidates for an alignment, by an equi-join of the hashes of all words. A table of bits, of fixed size, drops
    most words of the left that the right has not before they become rows."""

    def words(rows: DataFrame, side: str, table: Broadcast | None = None) -> DataFrame:
        def found(seq: str) -> np.ndarray:
            if table is None:
                return word_hashes(seq, k)
            h = hashes(seq, k)
            place = h >> np.uint64(64 - BITS)
            return np.unique(h[(table.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]).view(np.int64)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                held, n = [], 0
                for place, s in enumerate(b.seq):
                    held.append(found(s or ""))
                    n += len(held[-1])
                    if n >= WORDS or place + 1 == len(b):
                        part = b.iloc[place + 1 - len(held) : place + 1]
                        sizes = [len(h) for h in held]
                        yield pd.DataFrame({"id": np.repeat(part.id.to_numpy(), sizes), "n": np.repeat(part.seq.map(lambda s: len(s or "")).to_numpy(), sizes), "word": np.concatenate(held)})
                        held, n = [], 0

        return rows.select(F.col("seq_id").cast("long").alias("id"), "seq").mapInPandas(run, "id long, n long, word long").toDF(f"{side}_id", f"n_{side}", "word")

    of_right = few(words(right, "right"))
    table = left.sparkSession.sparkContext.broadcast(bit_table(of_right))
    pairs = words(left, "left", table).join(of_right, "word").filter(F.least("n_left", "n_right") >= ratio * F.greatest("n_left", "n_right")).select("left_id", "right_id").distinct()
    pairs = few(pairs)
    for side, rows in (("left", left), ("right", right)):
        pairs = pairs.join(rows.select(F.col("seq_id").cast("long").alias(f"{side}_id"), F.col("seq").alias(side)), f"{side}_id")
    return pairs


def canonical_alignment(canonical: DataFrame, residues: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canonical sequences (key, seq) against structures' residues (key, number, code, seen), in order of their numbers.

    Returns (key, position, number) of aligned residues, positions from 1; per key the offset of numbers, whether a first M is cleaved,
    aligned and identical shares; and the runs of residues without coordinates (key, first, last, length, reason). A sequence whose M
    is followed by the structure's first residue starts at its second letter. A run at either end is terminal."""
    w = Window.partitionBy("key").orderBy("number")
    rows = residues.withColumn("k", F.row_number().over(w)).join(canonical, "key")
    first = F.first(F.upper("code")).over(w)
    upper = F.upper("seq")
    cleaved = (F.length("seq") > 1) & (F.substring(upper, 1, 1) == "M") & (first == F.substring(upper, 2, 1))
    rows = rows.withColumns({"cleaved": cleaved, "position": F.col("k") + cleaved.cast("int"), "start": F.first("number").over(w)})
    aligned = F.col("position") <= F.length("seq")
    same = aligned & (F.upper("code") == F.substr(upper, F.col("position"), F.lit(1)))
    n = F.count_if(aligned)
    facts = rows.groupBy("key").agg((F.min("start") - F.min("position")).alias("numbering_offset"), F.bool_or("cleaved").alias("initiator_cleaved"), n.alias("n_aligned"), F.when(n > 0, F.count_if(same) / n).otherwise(0.0).alias("identity"))
    whole = Window.partitionBy("key")
    gone = rows.withColumn("n", F.max("k").over(whole)).filter(~F.col("seen")).withColumn("run", F.col("k") - F.row_number().over(w))
    gone = gone.groupBy("key", "run").agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count(F.lit(1)).alias("length"), ((F.min("k") == 1) | (F.max("k") == F.max("n"))).alias("terminal"))
    reason = F.when(F.col("terminal"), "TERMINAL_FLEXIBILITY").otherwise("UNRESOLVED_DENSITY")
    return rows.filter(aligned).select("key", "position", "number"), facts, gone.select("key", "first", "last", "length", reason.alias("reason"))
