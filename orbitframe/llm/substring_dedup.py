"""Substring dedup by relative Lempel-Ziv parsing.

A word goes if a window of WINDOW consecutive words that covers it also starts in a document with a smaller id. Words are the
runs between white space, unchanged.

Every document is both text to parse and reference. It is cut into blocks at places that depend on content only: a block is a
run of windows with the same least word 8-gram, its anchor. Equal passages are so cut alike, whatever stands around them.

1. The index of reference blocks: rows of (anchor, block, document, place), range-partitioned and sorted, stream through tasks.
   A block that a smaller document holds too is found there, at the first place of the least such document. Anchors of one document
   only can't begin a factor.
2. Factor boundaries: at its ends a passage meets other text, and its last blocks differ from document to document. For blocks
   whose anchor other documents have, in the first document that holds the block, every window is looked up by itself.
3. The greedy parse: from left to right, a factor goes on for as long as the next block or window is found right behind it in the
   same reference document; otherwise a new factor begins. Factors of WINDOW words or more (all are, as they hold a window) are the
   duplicate spans: their words go. A factor is kept as start, length, and the reference's document and start, in words.

Ranges split inside a key, so a passage that a third of all documents hold is spread over many tasks; of runs that cross tasks,
each task reports one summary row, and only these reach the driver. Windows are compared by 128 bits of hash.

Null and empty texts have no words. A null id counts as the smallest. Rows with one id are one document: their windows do not
count against each other. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.blocks import whole_runs
from orbitframe.llm.common import _power_tables, chunks, mix, ngrams, shuffle_width, stored, words

WINDOW, GRAM = 50, 8
#: A place is the number of its first window, then in the low bits the number of windows; a longer block is cut in pieces.
SPAN_BITS = 24
LONGEST = LONGEST_BLOCK = (1 << SPAN_BITS) - 1
LATER, FIRST, UNDECIDED, SUMMARY = 0, 1, 2, 3
NAMES = ["a", "b", "doc", "text_hash", "place"]
SCHEMA = ", ".join(f"{n} long" for n in NAMES)
#: Where a row's block or window is first found: document and number of the first window.
SOURCE = ["source_doc", "source_at"]
FACTORS = "array<struct<start:bigint,length:bigint,source_doc:bigint,source_start:bigint>>"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, done = values, 1
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchored(hashes: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, as word numbers, that lie inside a row; each one's row; each one's anchor)."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding_min(ngrams(hashes, gram), window - gram + 1)
    first = np.arange(len(least))
    inside = at[1:][row[: len(least)]] - first >= window
    return first[inside], row[: len(least)][inside], least[inside]


def spans_hash(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the words lo..hi-1 for each pair."""
    up, down = _power_tables(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def identified(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(doc, text_hash, text); doc is the id, the least long for null; text_hash tells rows of one id apart."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.hash(text).cast("long").alias("text_hash"), text.alias("text"))


def _rows(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], NAMES)


def reference_blocks(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(a: anchor, b: hash of the block's words, doc, text_hash, place) of every block of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text_hash = (batch.column(i).to_numpy() for i in (0, 1))
            for lo, _, raw, offsets in chunks(batch.column(2)):
                hashes, _, _, at = words(raw, offsets)
                first, row, anchor = anchored(hashes, at, window, gram)
                if not len(first):
                    continue
                new = np.ones(len(first), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                k = np.flatnonzero(new)
                into = np.arange(len(first)) - np.repeat(k, np.diff(np.append(k, len(first))))
                k = np.flatnonzero(into % LONGEST_BLOCK == 0)
                n = np.diff(np.append(k, len(first)))
                start, own = first[k], row[k]
                yield _rows([anchor[k], spans_hash(hashes, start, start + n + window - 1), doc[lo + own], text_hash[lo + own], ((start - at[own]) << SPAN_BITS) | n])

    return rows.mapInArrow(run, SCHEMA)


def boundary_windows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """From (doc, text_hash, text, places): (a: anchor, b: hash of the window, doc, text_hash, place) of each window in places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text_hash = (batch.column(i).to_numpy() for i in (0, 1))
            places = batch.column(3)
            for lo, hi, raw, offsets in chunks(batch.column(2)):
                hashes, _, _, at = words(raw, offsets)
                part = places.slice(lo, hi - lo)
                place = part.flatten().to_numpy()
                own = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                n = place & ((1 << SPAN_BITS) - 1)
                start = (place >> SPAN_BITS) + at[own]
                first = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                own = np.repeat(own, n)
                least = sliding_min(ngrams(hashes, gram), window - gram + 1)
                yield _rows([least[first], spans_hash(hashes, first, first + window), doc[lo + own], text_hash[lo + own], ((first - at[own]) << SPAN_BITS) | 1])

    return rows.mapInArrow(run, SCHEMA)


def ranked(rows: DataFrame, firsts: bool) -> DataFrame:
    """kind, the columns of rows and SOURCE: LATER for rows of a key (a, b) whose document is not the key's least, with the least
    document's first place as source; if firsts, also FIRST for the others, except under an `a` of a single document.

    A run that goes on from one task to the next is settled once all tasks have reported their border runs' first rows."""
    # Stored, since a range partitioning reads its input twice.
    ordered = stored(rows).repartitionByRange(shuffle_width(rows.sparkSession), *NAMES).sortWithinPartitions(*NAMES)
    names = ["kind", *NAMES, *SOURCE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(kind: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (kind.astype(np.int64), *columns)], names)

        def judge(t: pa.Table, borders: np.ndarray, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
            columns = [t.column(c).to_numpy() for c in NAMES]
            b, doc, place = columns[1], columns[2], columns[4]
            new = np.ones(len(b), bool)
            new[1:] = b[1:] != b[:-1]
            new[borders[:-1]] = True
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(b)))
            columns += [np.repeat(doc[starts], sizes), np.repeat(place[starts] >> SPAN_BITS, sizes)]
            kind = np.where(doc != columns[5], LATER, FIRST if firsts else -1)
            if firsts:
                alone = np.minimum.reduceat(doc, borders[:-1]) == np.maximum.reduceat(doc, borders[:-1])
                alone[0] &= not first
                alone[-1] &= not last
                kind[np.repeat(alone, np.diff(borders))] = -1
            if first:  # the run may go on from the task before
                kind[: sizes[0]] = UNDECIDED
            for i in sorted({*[0] * first, *[len(starts) - 1] * last}):
                lo = starts[i]
                yield emit(np.array([SUMMARY]), [c[lo : lo + 1] for c in columns])
            out = kind >= 0
            yield emit(kind[out], [c[out] for c in columns])

        held, first = None, True
        for t, borders in whole_runs(batches, ["a"]):
            if held:
                yield from judge(*held, first, False)
                first = False
            held = t, borders
        if held:
            yield from judge(*held, first, True)

    schema = f"kind long, {SCHEMA}, " + ", ".join(f"{n} long" for n in SOURCE)
    found = stored(ordered.mapInArrow(run, schema))
    least: dict[tuple[int, int], tuple[int, int, int]] = {}
    for a, b, *row in found.filter(F.col("kind") == SUMMARY).select("a", "b", "doc", "text_hash", "place").collect():
        least[a, b] = min(tuple(row), least.get((a, b), tuple(row)))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, a, b, doc = (batch.column(i).to_numpy() for i in range(4))
            kind, source = kind.copy(), [batch.column(i).to_numpy().copy() for i in (6, 7)]
            at = np.flatnonzero(kind == UNDECIDED)
            if len(at):
                change = np.ones(len(at), bool)
                change[1:] = (a[at[1:]] != a[at[:-1]]) | (b[at[1:]] != b[at[:-1]])
                own = np.cumsum(change) - 1
                for c, k in zip(source, (0, 2), strict=True):
                    c[at] = np.array([least[int(a[i]), int(b[i])][k] for i in at[change]], np.int64)[own] >> (SPAN_BITS if k else 0)
                kind[at] = np.where(doc[at] > source[0][at], LATER, FIRST)
            arrays = [pa.array(kind), *batch.columns[1:6], *map(pa.array, source)]
            yield pa.RecordBatch.from_arrays(arrays, names).filter(pa.array(kind <= FIRST))

    # least has at most two keys per task, so it goes along with the function.
    return found.mapInArrow(settle, schema)


def greedy_factors(row: np.ndarray, first: np.ndarray, n: np.ndarray, doc: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, source document, source window) of the factors of sorted hits: a hit is n windows of a row that are
    found in a document from a window on, and goes on the factor before it if both its place and its source do."""
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + n[:-1]) | (source[1:] != source[:-1] + n[:-1])
    at = np.flatnonzero(fresh)
    total = np.add.reduceat(n, at) if len(at) else n
    return row[at], first[at], total, doc[at], source[at]


def parsed(rows: DataFrame, window: int) -> DataFrame:
    """From (doc, text_hash, text, hits) with hits of known windows (place, source_doc, source_at): doc, text_hash, n_words, n_removed,
    n_spans, kept, factors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[np.ndarray]] = [[], [], []]
            kept: list[str] = []
            parts: list[pa.Array] = []
            hits = batch.column(3)
            for lo, hi, raw, offsets in chunks(batch.column(2)):
                _, starts, ends, at = words(raw, offsets)
                part = hits.slice(lo, hi - lo)
                place, doc, source = (c.to_numpy() for c in part.flatten().flatten())
                own = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                order = np.lexsort((place, own))
                own, place, doc, source = own[order], place[order], doc[order], source[order]
                row, begin, n, source_doc, source_at = greedy_factors(own, place >> SPAN_BITS, place & LONGEST, doc, source)
                length = n + window - 1
                cuts = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32))
                parts.append(pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(c) for c in (begin, length, source_doc, source_at)], ["start", "length", "source_doc", "source_start"])))
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, begin + at[row], 1)
                np.add.at(cover, begin + at[row] + length, -1)
                gone = np.cumsum(cover)[:-1] > 0
                before = np.concatenate([[False], gone])[: len(gone)]
                before[at[at < len(gone)]] = False  # a row starts anew
                total, removed, opened = (np.concatenate([[0], np.cumsum(x)]) for x in (np.ones(len(gone), np.int64), gone, gone & ~before))
                for c, x in zip(counts, (total, removed, opened), strict=True):
                    c.append(x[at[1:]] - x[at[:-1]])
                stay = np.flatnonzero(~gone)
                out, keep = raw.copy(), np.zeros(len(raw) + 1, np.int64)
                np.add.at(keep, starts[stay], 1)
                np.add.at(keep, ends[stay], -1)
                mask = np.cumsum(keep)[:-1] > 0
                row = np.searchsorted(at, stay, "right") - 1
                inner = np.zeros(len(stay), bool)
                inner[:-1] = row[1:] == row[:-1]
                gaps = ends[stay[inner]]
                out[gaps], mask[gaps] = 32, True
                stops = np.concatenate([[0], np.cumsum(mask)])[offsets]
                data = out[mask].tobytes()
                kept += [data[a:b].decode() for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
            if parts:
                arrays = [*(pa.array(np.concatenate(c)) for c in counts), pa.array(kept, pa.string()), pa.concat_arrays(parts)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc", "text_hash", "n_words", "n_removed", "n_spans", "kept", "factors"])

    return rows.mapInArrow(run, f"doc long, text_hash long, n_words long, n_removed long, n_spans long, kept string, factors {FACTORS}")


def deduplicated(docs: DataFrame, key: str = "doc_id", column: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """key, n_words, n_removed, n_spans (runs of removed words), kept (the kept words, joined by one space), factors; one row per input
    row. A factor's source document is its id, the least long for null."""
    rows = identified(docs, key, column)
    pick = ["doc", "text_hash"]
    hit = F.struct("place", *SOURCE)
    blocks = ranked(reference_blocks(rows, window, gram), True)
    firsts = blocks.filter(F.col("kind") == FIRST).groupBy(*pick).agg(F.collect_list("place").alias("places"))
    windows = ranked(boundary_windows(rows.join(firsts, pick).select(*pick, "text", "places"), window, gram), False)
    hits = blocks.filter(F.col("kind") == LATER).select(*pick, hit.alias("hit")).unionByName(windows.filter(F.col("kind") == LATER).select(*pick, hit.alias("hit")))
    # Rows of one id and text are one document: their hits are equal, and count once.
    hits = hits.groupBy(*pick).agg(F.collect_set("hit").alias("hits"))
    none = F.array().cast("array<struct<place:bigint,source_doc:bigint,source_at:bigint>>")
    out = parsed(rows.join(hits, pick, "left").select(*pick, "text", F.coalesce("hits", none).alias("hits")), window)
    kind = docs.schema[key].dataType
    return out.select(F.when(F.col("doc") != -(1 << 63), F.col("doc")).cast(kind).alias(key), "n_words", "n_removed", "n_spans", "kept", "factors")
