"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents are sets of word 5-grams, words being the runs between white space, unchanged; a document of fewer words is the set
of its one whole sequence. Two documents are linked if the Jaccard similarity of their sets is at least the threshold.

1. Documents with one and the same set form a node; everything after works on nodes, and copies are only counted.
2. A node's MinHash labels are cut into trees. A tree is a sorted prefix trie: its rows are range-partitioned and sorted by their
   labels, and neighbours show the longest prefix that a node shares with any other. A node without another under its first
   base_depth() labels has no candidate in that tree.
3. Each node starts at its longest shared prefixes and shortens them, label by label in all trees at once, until its own expected
   recall, the chance that a pair at the threshold agrees on the matched prefix in some tree, reaches the target. Two nodes of a
   tree are candidates if they agree on the matched prefix of either; the chance counts a node's partner itself among the sharers
   of prefixes, so that the recall is at least the expected one.
4. Candidates are compared by their whole signatures; likely ones become edges. Prefixes held by many nodes are cut into pairs of
   blocks, so that no task holds a group and all its pairs are still compared.
5. Candidate components bring the texts together, again in pairs of blocks, and every pair of a component is verified exactly.
   Tasks return counts of links per node and a spanning forest of the links, never the pairs.

Null and empty texts have no words: they are linked to nothing and are a class of their own. Null ids are allowed; a class's id
is the least id in it. Rows with equal ids are joined one by one. Extra columns are ignored. Nodes are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.blocks import block_pairs, components, forest, whole_runs
from orbitframe.llm.common import chunks, mix, ngrams, salted, shuffle_width, stored, words

N, THRESHOLD = 5, 0.8
TREES, DEPTH, TARGET_RECALL = 16, 6, 0.999
#: Standard deviations that a signature may fall below the threshold before a pair is not verified.
SLACK = 4.5
#: Nodes of a prefix, and texts of a component, that one block holds.
PREFIX_BLOCK, TEXT_BLOCK = 1000, 200


def base_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = TARGET_RECALL) -> int:
    """The number of labels at which pairs at the threshold agree in some tree with the target recall, whatever the data."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def matched_depth(deeper: dict[int, Column], threshold: float, trees: int, base: int, recall: float) -> Column:
    """The most labels that a node's matched prefixes may have. deeper: by depth above the base, the number of trees in which the
    node shares a prefix at least so long; in the others the matched prefix is shorter anyway."""
    missed = {d: float(np.log1p(-(threshold**d))) for d in (base, *deeper)}
    out = F.lit(base)
    for most in sorted(deeper):
        log_miss = (F.lit(trees) - deeper[base + 1]) * missed[base]
        for d in range(base + 1, most + 1):
            log_miss += (deeper[d] - (deeper[d + 1] if d < most else 0)) * missed[d]
        out = F.when(log_miss <= float(np.log1p(-recall)), most).otherwise(out)
    return out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int = N) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each row."""
    hashes, _, _, at = words(raw, offsets)
    grams = ngrams(hashes, n)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.unique(grams[a : b - n + 1]) if b - a >= n else salted(ngrams(hashes[a:b], b - a), b - a) if b > a else np.zeros(0, np.uint64))
    return out


def node_of(shingles: np.ndarray) -> int:
    return int(mix(salted(shingles, 1).sum(keepdims=True) + np.uint64(len(shingles))).view(np.int64)[0])


def signatures(docs: DataFrame, key: str, column: str, n: int, base: int) -> DataFrame:
    """key, text_hash, node (null without words), signature (a byte per permutation), prefixes (per tree a long for its first `base`
    labels), tails (per tree the other labels, 16 bits each, in order)."""
    permutations = TREES * DEPTH
    factors = mix(np.arange(1, permutations + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes: list = []
            labels = np.zeros((b.num_rows, permutations), np.uint64)
            for lo, _, raw, offsets in chunks(b.column(2)):
                for i, s in enumerate(shingle_sets(raw, offsets, n), lo):
                    nodes.append(node_of(s) if len(s) else None)
                    if len(s) > 4096:
                        labels[i] = [(s * f).min() for f in factors]
                    elif len(s):
                        labels[i] = (s * factors[:, None]).min(axis=1)
            labels = mix(labels)
            prefixes, tails = np.zeros((b.num_rows, TREES), np.uint64), np.zeros((b.num_rows, TREES), np.uint64)
            for d in range(DEPTH):
                if d < base:
                    prefixes = mix(prefixes + labels[:, d::DEPTH] + np.uint64(d))
                else:
                    tails = (tails << np.uint64(16)) | (labels[:, d::DEPTH] >> np.uint64(48))
            prefixes = mix(prefixes + np.arange(TREES, dtype=np.uint64)).view(np.int64)
            sig = np.ascontiguousarray((labels & np.uint64(255)).astype(np.uint8))
            at = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * TREES)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(nodes, pa.int64()),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(permutations), b.num_rows, [None, pa.py_buffer(sig)]).cast(pa.binary()),
                    pa.ListArray.from_arrays(at, pa.array(prefixes.ravel())),
                    pa.ListArray.from_arrays(at, pa.array(tails.view(np.int64).ravel())),
                ],
                ["key", "text_hash", "node", "signature", "prefixes", "tails"],
            )

    text = F.col(column).cast("string")
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text_hash long, node long, signature binary, prefixes array<long>, tails array<long>")


def agreeing(a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """How many labels two rows under one prefix agree on, from their tails."""
    differ = (a ^ b).view(np.uint64)
    return base + sum((differ >> np.uint64(16 * k) == 0).astype(np.int64) for k in range(DEPTH - base))


def sharers(nodes: DataFrame, base: int) -> DataFrame:
    """(prefix, tail, node, shared): of each tree the nodes that share at least `base` labels with another one, and how many they
    share at most. At a task's ends, where a neighbour is out of sight, a node counts as sharing `base`."""
    order = ["prefix", "tail", "node"]
    rows = nodes.select("node", F.inline(F.arrays_zip(F.col("prefixes").alias("prefix"), F.col("tails").alias("tail"))))
    rows = rows.select(*order).repartitionByRange(shuffle_width(nodes.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, np.array([base])  # the last row so far, and what it shares with the one before it

        def emit(columns: list[np.ndarray], shared: np.ndarray) -> pa.RecordBatch:
            keep = shared >= base
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (*columns, shared)], [*order, "shared"])

        for b in batches:
            columns = [c.to_numpy() for c in b.columns]
            if not len(columns[0]):
                continue
            if held:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            prefix, tail, _ = columns
            near = np.where(prefix[1:] == prefix[:-1], agreeing(tail[1:], tail[:-1], base), 0)
            sides = np.concatenate([before, near])
            yield emit([c[:-1] for c in columns], np.maximum(sides[:-1], near))
            held, before = [c[-1:] for c in columns], sides[-1:]
        if held:
            yield emit(held, np.array([base]))

    return rows.mapInArrow(run, "prefix long, tail long, node long, shared long")


def candidate_edges(nodes: DataFrame, threshold: float, recall: float = TARGET_RECALL) -> DataFrame:
    """(u, v): a spanning forest, inside each shared prefix, of the candidates whose signatures are near the threshold."""
    permutations = TREES * DEPTH
    base = base_depth(threshold, TREES, DEPTH, recall)
    least = int(np.floor((threshold - SLACK * np.sqrt(threshold * (1 - threshold) / permutations)) * permutations))
    found = stored(sharers(nodes, base))
    deeper = {d: F.count_if(F.col("shared") >= d) for d in range(base + 1, DEPTH + 1)}
    own = found.groupBy("node").agg(matched_depth(deeper, threshold, TREES, base, recall).alias("most"), F.collect_list(F.struct("prefix", "tail", "shared")).alias("places"))
    rows = own.join(nodes.select("node", "signature"), "node").select("node", "signature", "most", F.inline("places"))
    rows = rows.select("prefix", "node", "tail", F.least("shared", "most").alias("depth"), "signature")
    counted = found.groupBy("prefix").agg(F.count(F.lit(1)).alias("size"))
    rows = block_pairs(rows, counted.filter(F.col("size") > PREFIX_BLOCK), "prefix", "node", PREFIX_BLOCK)
    rows = rows.repartition(shuffle_width(nodes.sparkSession), "prefix", "bi", "bj").sortWithinPartitions("prefix", "bi", "bj")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, borders in whole_runs(batches, ["prefix", "bi", "bj"]):
            node, tail, depth = (t.column(c).to_numpy() for c in ("node", "tail", "depth"))
            sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(-1, permutations)

            def near(i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
                out = agreeing(tail[i], tail[j], base) >= np.minimum(depth[i], depth[j])
                out[out] = (sig[j[out]] == sig[i if np.ndim(i) == 0 else i[out]]).sum(axis=1) >= least
                return out

            sizes = np.diff(borders)
            two = borders[:-1][sizes == 2]
            two = two[near(two, two + 1)]
            us, vs = [node[two]], [node[two + 1]]
            for k in np.flatnonzero(sizes > 2):
                lo = int(borders[k])
                pairs = np.array(forest(int(sizes[k]), lambda i, js, lo=lo: near(lo + i, lo + js)), np.int64).reshape(-1, 2) + lo
                us.append(node[pairs[:, 0]])
                vs.append(node[pairs[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return rows.select("prefix", "bi", "bj", "node", "tail", "depth", "signature").mapInArrow(run, "u long, v long")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections, by products of slices of the incidence matrix of elements that two sets share."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.float32)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    keep = count[place] > 1
    number = np.cumsum(count > 1) - 1
    row, place = row[keep], number[place[keep]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((n, n), np.float32)
    width = 8192
    for lo in range(0, int((count > 1).sum()), width):
        a, b = np.searchsorted(place, [lo, lo + width])
        part = np.zeros((n, width), np.float32)
        part[row[a:b], place[a:b] - lo] = 1
        out += part @ part.T
    return out


def verified(texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """From rows (component, bi, bj, own, node, copies, text): (u, v, copies) with v a node for the edges of a spanning forest
    of the links, copies then null; and (u, number of linked nodes, number of documents in them)."""
    rows = texts.repartition(shuffle_width(texts.sparkSession), "component", "bi", "bj").sortWithinPartitions("component", "bi", "bj")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, borders in whole_runs(batches, ["component", "bi", "bj"]):
            node, copies, own = (t.column(c).to_numpy() for c in ("node", "copies", "own"))
            across = t.column("bi").to_numpy() != t.column("bj").to_numpy()
            text = t.column("text").combine_chunks()
            out: list[tuple] = []
            for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                sets = [s for _, _, raw, offsets in chunks(text.slice(lo, hi - lo)) for s in shingle_sets(raw, offsets, n)]
                mine = node[lo:hi]
                fits = np.array([len(s) > 0 and node_of(s) == m for s, m in zip(sets, mine, strict=True)])
                _, once = np.unique(np.where(fits, mine, -1), return_index=True)
                pick = np.array([i for i in sorted(once.tolist()) if fits[i]], np.int64)
                if len(pick) < 2:
                    continue
                mine, mine_copies, mine_own = mine[pick], copies[lo:hi][pick], own[lo:hi][pick]
                sets = [sets[i] for i in pick]
                shared = shared_counts(sets)
                size = np.array([len(s) for s in sets], np.float64)
                linked = shared / np.maximum(size[:, None] + size - shared, 1) >= threshold
                np.fill_diagonal(linked, False)
                if across[lo]:
                    linked &= mine_own[:, None] != mine_own
                some = np.flatnonzero(linked.any(axis=1))
                out += zip(mine[some].tolist(), linked[some].sum(axis=1).tolist(), (linked[some] @ mine_copies).tolist(), strict=True)
                pairs = forest(len(mine), lambda i, js, linked=linked: linked[i, js])
                out += [(int(mine[i]), int(mine[j]), None) for i, j in pairs]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v", "c"])

    return rows.mapInArrow(run, "u long, v long, c long")


def joined(docs: DataFrame, key: str = "doc_id", column: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """key, class_id (the least id that links lead to), n_links (other documents linked, copies counted), n_text_links (other
    shingle sets linked); one row per input row."""
    rows = stored(signatures(docs, key, column, n, base_depth(threshold, TREES, DEPTH, recall)))
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("key").alias("least"), F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_hash")).alias("pick"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"), F.first("prefixes").alias("prefixes"), F.first("tails").alias("tails"))
    nodes = stored(nodes)
    groups = components(candidate_edges(nodes, threshold, recall))
    groups = stored(groups.join(nodes.select("node", "pick", "copies"), "node"))
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    # The text of the node's least id stands for it; repeated ids are told apart by the text's hash.
    text = F.col(column).cast("string")
    picked = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    # By merge at every size: texts are moved once, and never for a candidate list that happened to be small enough to send.
    texts = groups.hint("merge").join(picked, F.col("pick.key").eqNullSafe(F.col("key")) & (F.col("pick.text_hash") == F.col("text_hash")))
    found = stored(verified(block_pairs(texts, sizes, "component", "node", TEXT_BLOCK).select("component", "bi", "bj", "own", "node", "copies", "text"), n, threshold))
    links = found.filter("c is not null").groupBy("u").agg(F.sum("v").alias("texts"), F.sum("c").alias("others"))
    classes = components(found.filter("c is null").select("u", "v"))
    members = nodes.select("node", "least", "copies").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = members.groupBy("component").agg(F.min("least").alias("class_id"))
    members = members.join(ids, "component").join(links, F.col("node") == F.col("u"), "left")
    members = members.select("node", "class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"))
    out = rows.select("key", "node").join(members, "node", "left")
    return out.select(F.col("key").alias(key), F.coalesce("class_id", "key").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"))


def kept(docs: DataFrame, key: str = "doc_id", column: str = "text", **options) -> DataFrame:
    """One document of each class: that of its least id, with all columns of docs."""
    ids = joined(docs, key, column, **options).filter(F.col(key).eqNullSafe(F.col("class_id"))).select(F.col(key).alias("kept_"))
    return docs.join(ids.distinct(), F.col(key).eqNullSafe(F.col("kept_")), "left_semi")
