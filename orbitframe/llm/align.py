"""Alignment of the tokens of two tokenizers over the same bytes, and how often each pair of tokens is linked in the corpus.

Both tokenizers encode space + text; the byte offsets where tokens end are two rising lists per text. The shorter list drives a galloping
search into the longer: from a guess the steps double until they pass the value, then bisection closes in. Values found in both lists
cut the text into groups. The ranks say the rest: the tokens of the longer list that a token of the shorter one overlaps run from the
rank of its begin to the rank of its end.

Fragments between cuts that are certain for both tokenizers are encoded once per task, and all searches of a block of texts run at once
in numpy. The alignments are written once; how many documents hold each linked pair of ids is counted from them, summed per task before
the shuffle, and looked up again for every document. Up to `broadcast_pairs` distinct pairs travel to the tasks, after they have been
counted; more are joined.

Null and empty texts, and texts whose pieces do not spell space + text, have no tokens: zeros and empty groups. Rows of one id, or of
none, are documents of their own; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.llm.bpe import BLOCK_BYTES, Remembered, codec, encoded_rows, forced_pairs, ragged
from orbitframe.llm.common import chunks, stored

#: Distinct pairs of ids that are sent to every task, 17 bytes each; beyond, they are joined.
BROADCAST_PAIRS = 1 << 21
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


class Pieces:
    """A piece model that leaves texts as they are, with a blank in front. A fragment whose pieces spell something else has the
    one id -1."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.processor = SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.processor.serialized_model_proto())
        rule, byte, given = model.normalizer_spec, model.SentencePiece.BYTE, model.SentencePiece.USER_DEFINED
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix or not rule.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or any(p.type == given for p in model.pieces):
            raise ValueError("not a piece model that leaves texts as they are")
        self.letters = [bytes([int(p.piece[3:-1], 16)]) if p.type == byte else p.piece.replace("▁", " ").encode() for p in model.pieces]
        self.sizes = np.array([len(x) for x in self.letters])
        self.forced = forced_pairs(self.letters)
        self.flat, self.places = np.frombuffer(b"".join(self.letters), np.uint8), np.cumsum(self.sizes) - self.sizes

    def encode_fragments(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.processor.encode([f[1:].decode() for f in fragments], num_threads=1)
        n = np.array([len(ids) for ids in found])
        ids = np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))
        sizes = self.sizes[ids]
        lengths = np.diff(np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(n))])
        if (lengths == [len(f) for f in fragments]).all() and self.flat[ragged(self.places[ids], sizes)].tobytes() == b"".join(fragments):
            return ids, n
        found = [ids if b"".join([self.letters[i] for i in ids]) == f else [-1] for ids, f in zip(found, fragments)]
        return np.fromiter(chain.from_iterable(found), np.int64), np.array([len(ids) for ids in found])

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """True where rows of space + text may be cut: before blanks where the pair of bytes lies in no piece. Blanks at a row's end
        stay with the word before."""
        cut = np.zeros(len(raw) + 1, bool)
        at = np.flatnonzero((raw[1:] == 32) & (raw[:-1] != 32)) + 1
        cut[at[self.forced[raw[at - 1], 32]]] = True
        solid = np.flatnonzero(raw != 32)
        trailing = np.append(-1, solid)[np.searchsorted(solid, offsets[1:])] + 1  # after the last other byte of each row or before it
        cut[trailing[trailing > offsets[:-1]]] = False
        cut[offsets] = True
        return cut


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """Built once per Python worker."""
    return Pieces(path)


@lru_cache(maxsize=2)
def fragments(path_a: str, path_b: str) -> Remembered:
    """What both tokenizers make of the fragments between cuts that are certain for both."""
    return Remembered(codec(path_a, False).encode_fragments, pieces(path_b).encode_fragments)


def gallop(values: np.ndarray, among: np.ndarray, guess: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each value the first place in lo..hi of the rising list `among` that is not below it (hi if none), all at once: steps from
    the guess double until they pass the value, then the gap is halved."""
    left, right = np.clip(guess, lo, hi), np.clip(guess, lo, hi)
    padded = np.append(among, 0)
    todo = np.flatnonzero((right < hi) & (padded[right] < values))
    up, step = todo, 1
    while len(todo):
        left[todo] = right[todo] + 1
        right[todo] = np.minimum(right[todo] + step, hi[todo])
        todo = todo[(right[todo] < hi[todo])]
        todo = todo[padded[right[todo]] < values[todo]]
        step *= 2
    down = np.ones(len(values), bool)
    down[up] = False
    todo, step = np.flatnonzero(down & (left > lo) & (padded[left - 1] >= values)), 1
    while len(todo):
        right[todo] = left[todo] - 1
        left[todo] = np.maximum(left[todo] - step, lo[todo])
        todo = todo[left[todo] > lo[todo]]
        todo = todo[padded[left[todo] - 1] >= values[todo]]
        step *= 2
    todo = np.flatnonzero(left < right)
    while len(todo):
        middle = (left[todo] + right[todo]) // 2
        below = padded[middle] < values[todo]
        left[todo[below]] = middle[below] + 1
        right[todo[~below]] = middle[~below]
        todo = todo[left[todo] < right[todo]]
    return left


class Aligned:
    """The alignment of a block of texts: a_ids and b_ids with the rows' first places, groups of tokens, and links as pairs of places."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, path_a: str, path_b: str):
        one, other = codec(path_a, False), pieces(path_b)
        data = raw.tobytes()
        (a, a_at), (b, b_at) = encoded_rows(fragments(path_a, path_b), data, one.cuts(raw, offsets, data) & other.cuts(raw, offsets), offsets)
        rows = np.arange(len(offsets) - 1)
        good = np.diff(offsets) > 1  # more than the blank in front
        good[np.repeat(rows, np.diff(b_at))[b < 0]] = False
        good[np.diff(a_at) == 0] = False
        (self.a, self.a_at), (self.b, self.b_at) = chosen(a, a_at, good), chosen(b, b_at, good)
        a_ends, b_ends = ends_of(one.sizes[self.a], self.a_at, offsets), ends_of(other.sizes[self.b], self.b_at, offsets)
        n_a, n_b = np.diff(self.a_at), np.diff(self.b_at)
        both, swap = np.concatenate([a_ends, b_ends]), n_b < n_a
        first_a, first_b = self.a_at[:-1], len(a_ends) + self.b_at[:-1]
        n_short, n_long = np.where(swap, n_b, n_a), np.where(swap, n_a, n_b)
        short, long = ragged(np.where(swap, first_b, first_a), n_short), ragged(np.where(swap, first_a, first_b), n_long)
        row = np.repeat(rows, n_short)
        lo = (np.cumsum(n_long) - n_long)[row]
        order = np.arange(len(short)) - (np.cumsum(n_short) - n_short)[row]
        values, among = both[short], both[long]
        rank = gallop(values, among, lo + order * n_long[row] // np.maximum(n_short[row], 1), lo, lo + n_long[row])
        common = among[rank] == values if len(rank) else np.zeros(0, bool)
        begin = lo.copy()
        begin[1:] = np.where(row[1:] == row[:-1], rank[:-1] + common[:-1], lo[1:])
        size = rank - begin + 1
        x, y = short[np.repeat(np.arange(len(short)), size)], long[ragged(begin, size)]
        self.link_row = np.repeat(row, size)
        turned = swap[self.link_row]
        self.link_a, self.link_b = np.where(turned, y, x), np.where(turned, x, y) - len(a_ends)
        common_long = np.zeros(len(among), bool)
        common_long[rank[common]] = True
        group = np.zeros(len(both), np.int64)
        group[short], group[long] = np.cumsum(common) - common, np.cumsum(common_long) - common_long
        self.group_a, self.group_b = group[: len(a_ends)], group[len(a_ends) :]
        self.counts = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(row, common, len(rows)).astype(np.int64), "n_links": np.bincount(self.link_row, minlength=len(rows))}
        self.n_rows, self.width = len(rows), len(other.sizes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id of a * number of b ids + id of b, occurrences) of each row's distinct linked pairs, by row."""
        code = self.a[self.link_a].astype(np.int64) * self.width + self.b[self.link_b]
        most = int(code.max(initial=0)) + 1
        key, n = np.unique(self.link_row * most + code, return_counts=True)
        return key // most, key % most, n

    def texts(self, names_a: list[str], names_b: list[str]) -> list[str]:
        """Each row's groups as a1,a2|b1;a3|b2,b3. names hold two strings per id: followed by a comma, and by the group's sign."""
        n = int(self.group_a[-1]) + 1 if len(self.group_a) else 0
        per_a, per_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        out = np.zeros(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + (np.cumsum(per_b) - per_b)[self.group_a]] = self.a * 2 + last(self.group_a)
        out[np.arange(len(self.b)) + np.cumsum(per_a)[self.group_b]] = len(names_a) + self.b * 2 + last(self.group_b)
        names = names_a + names_b
        parts, at = [names[i] for i in out.tolist()], (self.a_at + self.b_at).tolist()
        return ["".join(parts[x:y])[:-1] for x, y in zip(at, at[1:])]


def last(group: np.ndarray) -> np.ndarray:
    """Whether a token is its group's last."""
    out = np.ones(len(group), bool)
    out[:-1] = group[1:] != group[:-1]
    return out


def chosen(ids: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.where(rows, np.diff(at), 0)
    return ids[ragged(at[:-1], sizes)], np.append(0, np.cumsum(sizes))


def ends_of(sizes: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The byte offset at which each token ends."""
    total = np.append(0, np.cumsum(sizes))
    return total[1:] + np.repeat(offsets[:-1] - total[at[:-1]], np.diff(at))


@lru_cache(maxsize=2)
def names_of(path_a: str, path_b: str) -> tuple[list[str], list[str]]:
    return tuple([f"{i}{sign}" for i in range(n) for sign in signs] for n, signs in ((len(codec(path_a, False).sizes), ",|"), (len(pieces(path_b).sizes), ",;")))


def linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: doc_id, the four counts, groups (a1,a2|b1;a3|b2,b3), and its distinct linked pairs (a's id * number of b's ids +
    b's id) with their times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = names_of(path_a, path_b)
        for b in batches:
            for lo, hi, raw, offsets in chunks(b.column(1), BLOCK_BYTES // 2):
                found = Aligned(raw, offsets, path_a, path_b)
                row, pair, times = found.pairs()
                at = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32())
                columns = {"doc_id": b.column(0).slice(lo, hi - lo)} | {k: pa.array(found.counts[k], pa.int64()) for k in COUNTS}
                columns |= {"groups": pa.array(found.texts(*names), pa.string())}
                columns |= {k: pa.ListArray.from_arrays(at, pa.array(v)) for k, v in (("pairs", pair), ("times", times.astype(np.int32)))}
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    spaced = docs.select("doc_id", F.concat(F.lit(" "), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return spaced.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups string, pairs array<long>, times array<int>")


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """pair, n: the number of documents that hold it linked, and `best`: whether no other pair of the same id of a has more. Tasks
    sum before they shuffle."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    own = Window.partitionBy(F.floor(F.col("pair") / width))  # holds `width` pairs at most, the ids of b
    return counts.withColumn("best", F.col("n") == F.max("n").over(own))


def aligned(docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """linked() without pairs and times, but with n_best (links whose pair no other pair of the same id of a outnumbers in the
    corpus) and count_sum (the links' numbers of documents, summed)."""
    rows = stored(linked(docs, path_a, path_b))
    counts = stored(pair_counts(rows, len(pieces(path_b).sizes)))
    rest = ["doc_id", *COUNTS, "groups"]
    if counts.count() > broadcast_pairs:
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
        each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        sums = each.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        return rows.join(sums, "row", "left").select(*rest, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"))
    found = counts.orderBy("pair").toArrow()
    table = docs.sparkSession.sparkContext.broadcast(tuple(found.column(c).to_numpy() for c in ("pair", "n", "best")))

    @F.arrow_udf("n_best long, count_sum long")
    def sums(pairs: pa.Array, times: pa.Array) -> pa.Array:
        codes, n, best = table.value
        at = pairs.offsets.to_numpy()
        i = np.searchsorted(codes, pairs.flatten().to_numpy())
        each = times.flatten().to_numpy().astype(np.int64)
        totals = [np.diff(np.append(0, np.cumsum(each * y[i]))[at - at[0]]) for y in (best, n)] if len(codes) else [np.zeros(len(pairs), np.int64)] * 2
        return pa.StructArray.from_arrays([pa.array(t, pa.int64()) for t in totals], names=["n_best", "count_sum"])

    return rows.withColumn("sums", sums("pairs", "times")).select(*rest, "sums.n_best", "sums.count_sum")


def digests(rows: DataFrame) -> DataFrame:
    """The counts with a digest in place of the groups; '' without tokens."""
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return rows.select("doc_id", *COUNTS, "n_best", "count_sum", digest.alias("groups_sha256"))
