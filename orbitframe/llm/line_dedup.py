"""Line dedup by range partitions of line hashes with a secondary sort.

A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least MIN_CHARS characters found in at
least MIN_DOCS documents lose all their lines except in one document, the one of the largest id.

Rows of (hash, document, position) are range-partitioned and sorted by hash, then descending id, so that the document that keeps
a line streams by first. Ranges also split inside a hash: a key that a third of all documents hold is spread over many tasks.
Each task decides its inner runs; of its first and last run it reports the rows and one summary, and once the summaries of
neighbouring tasks are added up those rows are decided too. The result is a bitmap of kept lines per document, compressed to the
lengths of its runs: "5,1,3" keeps five lines, drops one and keeps three; a bitmap that starts with a dropped line starts with 0.

Null and empty texts are one empty line. Rows with one id count as one document. A null id counts as the smallest. Lines are
told apart by 96 bits of hash. Two rows per task reach the driver, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.blocks import whole_runs
from orbitframe.llm.common import let, shuffle_width, stored, unused

MIN_CHARS, MIN_DOCS = 20, 3
#: Fixed values for A-Z to a-z, which lower() would extend to other letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """ASCII lower case of the stripped line; a line of ASCII only takes the fast function."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def identified(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(doc, text_hash, lines): doc is the id, the least long for null; text_hash tells rows of one id apart."""
    doc = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return docs.select(doc.alias("doc"), F.xxhash64(text).alias("text_hash"), F.split(text, "\n").alias("lines"))


def line_rows(docs: DataFrame, key: str, column: str, least: int) -> DataFrame:
    """(hash, check, doc, text_hash, pos): lines with long enough keys, by number from 0."""
    rows = identified(docs, key, column).select("doc", "text_hash", F.posexplode("lines").alias("pos", "line"))
    rows = rows.filter(F.length("line") >= least).select("doc", "text_hash", "pos", line_key(F.col("line")).alias("k"))
    rows = rows.filter(F.length("k") >= least)
    return rows.select(F.xxhash64("k").alias("hash"), F.hash("k").cast("long").alias("check"), "doc", "text_hash", "pos")


DROPPED, UNDECIDED, SUMMARY = 0, 1, 2


def decided(rows: DataFrame, min_docs: int) -> DataFrame:
    """Streams sorted rows. kind 0: a line that goes; kind 1: a line of a border run; kind 2: a border run's summary, with its
    number of documents in pos, first document in doc and last in text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        names = ["hash", "check", "doc", "text_hash", "pos"]

        def emit(kind: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (kind, np.full(len(kind), task), *columns)], ["kind", "task", *names])

        def judge(t: pa.Table, borders: np.ndarray, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
            columns = [t.column(c).to_numpy() for c in names]
            doc = columns[2]
            starts, sizes = borders[:-1], np.diff(borders)
            new_doc = np.ones(len(doc), bool)
            new_doc[1:] = doc[1:] != doc[:-1]
            new_doc[starts] = True
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            kind = np.where(np.repeat(docs >= min_docs, sizes) & (doc != np.repeat(doc[starts], sizes)), DROPPED, -1)
            for i in sorted({*[0] * first, *[len(starts) - 1] * last}):
                lo, hi = borders[i], borders[i + 1]
                kind[lo:hi] = UNDECIDED
                yield emit(np.array([SUMMARY]), [columns[0][lo : lo + 1], columns[1][lo : lo + 1], doc[lo : lo + 1], doc[hi - 1 : hi], docs[i : i + 1]])
            out = kind >= 0
            yield emit(kind[out], [c[out] for c in columns])

        held, first = None, True
        for t, borders in whole_runs(batches, ["hash", "check"]):
            if held:
                yield from judge(*held, first, False)
                first = False
            held = t, borders
        if held:
            yield from judge(*held, first, True)

    return rows.mapInArrow(run, "kind long, task long, hash long, check long, doc long, text_hash long, pos long")


def keepers(summaries: list[tuple[int, int, int, int, int, int]], min_docs: int) -> list[tuple[int, int, int]]:
    """(hash, check, document that keeps) of the border runs that min_docs documents hold, from (task, hash, check, first
    document, last document, documents); a document on both sides of a border counts once."""
    runs: dict[tuple[int, int], list[int]] = {}
    for _, h, c, first, last, docs in sorted(summaries, key=lambda x: (x[0], x[1], x[2])):
        if (h, c) in runs:
            run = runs[h, c]
            run[1] += docs - (run[2] == first)
            run[2] = last
        else:
            runs[h, c] = [first, docs, last]
    return [(h, c, first) for (h, c), (first, docs, _) in runs.items() if docs >= min_docs]


def dropped_lines(docs: DataFrame, key: str = "doc_id", column: str = "text", least: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, text_hash, pos) of all lines that go."""
    spark = docs.sparkSession
    order = [F.col("hash"), F.col("check"), F.col("doc").desc(), F.col("text_hash"), F.col("pos")]
    # Stored, since a range partitioning reads its input twice.
    rows = stored(line_rows(docs, key, column, least).withColumn("pos", F.col("pos").cast("long")))
    rows = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    found = stored(decided(rows, min_docs))
    summaries = found.filter(F.col("kind") == SUMMARY).select("task", "hash", "check", "doc", "text_hash", "pos").collect()
    kept = spark.createDataFrame(keepers([tuple(r) for r in summaries], min_docs), "hash long, check long, keeper long")
    lines = found.filter(F.col("kind") == UNDECIDED).join(F.broadcast(kept), ["hash", "check"]).filter("doc <> keeper")
    place = ["doc", "text_hash", "pos"]
    return found.filter(F.col("kind") == DROPPED).select(*place).unionByName(lines.select(*place))


def bitmap_runs(lost: Column, n: Column) -> Column:
    """The run lengths of the bitmap of n lines without those at the positions `lost`, by column functions only."""
    def cuts(p: Column) -> Column:
        starts = F.filter(p, lambda x, i: ~(x - 1).eqNullSafe(F.get(p, i - 1)))
        ends = F.filter(p, lambda x, i: ~(x + 1).eqNullSafe(F.get(p, i + 1)))
        return F.concat(F.flatten(F.zip_with(starts, ends, lambda s, e: F.array(s, e + 1))), F.array(n))

    runs = let(let(F.array_sort(lost), cuts), lambda c: F.transform(c, lambda x, i: x - F.coalesce(F.get(c, i - 1), F.lit(0))))
    return F.array_join(F.filter(runs, lambda x, i: (i == 0) | (x > 0)), ",")


def kept_lines(lines: list[str], bitmap: str) -> list[str]:
    out, at = [], 0
    for i, n in enumerate(map(int, bitmap.split(","))):
        if i % 2 == 0:
            out += lines[at : at + n]
        at += n
    return out


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", column: str = "text", least: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, text_hash, n_lines, n_dropped, bitmap; a row per distinct id and text. No text is shuffled."""
    places = ["doc", "text_hash"]
    lost = dropped_lines(docs, key, column, least, min_docs).groupBy(*places).agg(F.collect_set("pos").alias("lost"))
    rows = identified(docs, key, column).select(*places, F.size("lines").cast("long").alias("n_lines")).distinct().join(lost, places, "left")
    lost = F.coalesce("lost", F.array().cast("array<long>"))
    return rows.select(*places, "n_lines", F.size(lost).cast("long").alias("n_dropped"), bitmap_runs(lost, F.col("n_lines")).alias("bitmap"))


def kept_texts(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """docs with n_lines_, n_dropped_, bitmap_ and kept_text_, the text of the lines that the bitmaps keep. Where docs has columns
    of these names, the new ones get further underscores."""
    names = unused(docs, "n_lines_", "n_dropped_", "bitmap_", "kept_text_", "doc_", "hash_", "text_", "doc_b", "hash_b")
    n_lines, n_dropped, bits, kept_text, doc_, hash_, text_, doc_b, hash_b = names
    doc = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    named = bitmaps.select(F.col("doc").alias(doc_b), F.col("text_hash").alias(hash_b), F.col("n_lines").alias(n_lines), F.col("n_dropped").alias(n_dropped), F.col("bitmap").alias(bits))
    joined = docs.withColumns({doc_: doc, hash_: F.xxhash64(text), text_: text}).join(named, (F.col(doc_) == F.col(doc_b)) & (F.col(hash_) == F.col(hash_b)))

    @F.pandas_udf("string")
    def keep(texts: pd.Series, bitmap: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(kept_lines(t.split("\n"), b)) for t, b in zip(texts, bitmap, strict=True)], dtype=object)

    kept = F.when(F.col(n_dropped) == 0, F.col(text_)).otherwise(keep(text_, bits))
    return joined.select(*docs.columns, n_lines, n_dropped, bits, kept.alias(kept_text))


def deduplicated(docs: DataFrame, key: str = "doc_id", column: str = "text", **options) -> DataFrame:
    """docs with their kept lines as text, and n_chars, where docs has it, counted anew. Documents left without text go."""
    out = kept_texts(docs, keep_bitmaps(docs, key, column, **options), key, column)
    n_lines, n_dropped, _, kept_text = (F.col(c) for c in out.columns[-4:])
    whole = n_dropped == 0
    changed = {column: F.when(whole, F.col(column)).otherwise(kept_text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(kept_text).cast("long"))
    return out.filter(n_dropped < n_lines).withColumns(changed).select(*docs.columns)
