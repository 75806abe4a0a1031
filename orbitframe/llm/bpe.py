"""Byte-level BPE by forced boundaries: where two neighbouring bytes never occur inside any token of the vocabulary, no merge can
reach across, so that the fragments on both sides are encoded by themselves and their ids set side by side.

Cuts come in two layers. The first runs over whole blocks of text in numpy: a forced pair whose second byte is white space and whose
first ends no white space, since there the pattern of the pre-tokeniser, too, always ends a match and never looks back. What lies
between is mostly a word with the blank before it, and each distinct fragment is encoded once per task: the pattern splits it, forced
pairs split the matches, and merges by rank encode what remains, for all new fragments of a block at once. Nothing is shuffled; memory is a block of text and a bounded cache.

Null and empty texts give no ids; repeated rows and null ids of documents stay rows of their own; a text of any length is read whole.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.common import chunks

#: Distinct fragments, and their bytes, that a task remembers at a time.
REMEMBERED = 1 << 18
REMEMBERED_BYTES = 1 << 24
#: Bytes of text that a task encodes at a time.
BLOCK_BYTES = 1 << 19
#: Parts of more bytes are merged with a heap.
SHORT = 40
#: The rank of a pair that no merge joins.
NEVER = 1 << 30
BLANKS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: What the pre-tokeniser's pattern makes of a byte: white space, letters, digits, other signs; HARD bytes need the pattern itself.
BLANK, LETTER, DIGIT, SIGN, HARD = range(5)
KINDS = np.full(256, SIGN, np.uint8)
KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
KINDS[48:58] = DIGIT
KINDS[[39, *range(128, 256)]] = HARD
KINDS[BLANKS] = BLANK


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run of the given size, one run after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class Remembered:
    """Distinct fragments by number, with their ids kept flat. Each encoder takes a list of new fragments and gives their ids and
    how many each has."""

    def __init__(self, *encoders):
        self.encoders, self.number, self.held = encoders, {}, 0
        self.flat, self.starts = [array("i") for _ in encoders], [array("q", [0]) for _ in encoders]

    def ids_of(self, fragments: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each encoder the ids of all fragments in a row, and how many each has."""
        if len(self.number) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.__init__(*self.encoders)
        known = self.number
        new = [f for f in set(fragments) if f not in known]
        if new:
            for encode, flat, starts in zip(self.encoders, self.flat, self.starts):
                ids, sizes = encode(new)
                starts.frombytes((np.cumsum(sizes) + len(flat)).astype(np.int64).tobytes())
                flat.frombytes(ids.astype(np.int32).tobytes())
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.held += sum(map(len, new))
        number, out = np.array([known[f] for f in fragments], np.int64), []
        for flat, starts in zip(self.flat, self.starts):
            at = np.array(starts, np.int64)
            sizes = np.diff(at)[number]
            out.append((np.array(flat, np.int32)[ragged(at[number], sizes)], sizes))
        return out


def encoded_rows(known: Remembered, data: bytes, cut: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each encoder the ids of the rows, and where each row's begin, from the fragments between cuts."""
    at = np.flatnonzero(cut)
    bounds, row, out = at.tolist(), np.searchsorted(at, offsets), []
    for ids, sizes in known.ids_of([data[a:b] for a, b in zip(bounds, bounds[1:])]):
        out.append((ids, np.append(0, np.cumsum(sizes))[row]))
    return out


class Codec:
    """Encoder and decoder of a byte-level BPE file. Without `specials`, the strings of special tokens are plain text."""

    def __init__(self, path: str, specials: bool = True):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "unk_token") if model.get(k)]
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec["normalizer"] or odd:
            raise ValueError("not a plain byte-level BPE file")
        added = {t["id"]: t for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in added.values()):
            raise ValueError("added tokens must be special and stand by themselves")
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        letters = byte_letters()
        self.plain = {ord(c): b for b, c in enumerate(letters)}
        vocabulary = model["vocab"]
        self.byte_ids = np.array([vocabulary[c] for c in letters])
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)}
        tokens = {i: t.translate(self.plain).encode("latin-1") for t, i in vocabulary.items()}
        self.forced = forced_pairs(list(tokens.values()))
        self.specials = {t["content"].encode(): i for i, t in added.items()} if specials else {}
        self.special = re.compile(b"|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        tokens |= {i: t["content"].encode() for i, t in added.items()}
        self.sizes = np.zeros(max(tokens) + 1, np.int64)
        for i, t in tokens.items():
            self.sizes[i] = len(t)
        codes = np.array([a * len(self.sizes) + b for a, b in self.ranks] or [-1])
        order = np.argsort(codes)
        self.pair_codes, self.pair_ranks = codes[order], np.array([r for r, _ in self.ranks.values()] or [0])[order]
        self.merge_ids = np.zeros(len(merges) + 1, np.int64)
        for rank, new in self.ranks.values():
            self.merge_ids[rank] = new
        self.places = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(self.sizes))), np.uint8)
        ends = np.zeros((256, 256), bool)
        for c in map(chr, range(0x80, 0x110000)):
            if c.isspace() or c == "᠎":
                a, b = c.encode()[-2:]
                ends[a, b] = True
        self.after_blank = ends
        self.known = Remembered(self.encode_fragments)

    def matches(self, fragments: list[bytes]) -> list[int]:
        """The sizes in bytes of the pre-tokeniser's matches over all fragments. Fragments that begin with white space after one
        that ends without are split in one call, as no match reaches across."""
        out, lo = [], 0
        for hi in range(1, len(fragments) + 1):
            if hi == len(fragments) or not (BLANKS[fragments[hi][0]] and 33 <= fragments[hi - 1][-1] < 127):
                run = fragments[lo:hi]
                if len(run) == 1 and run[0] in self.specials:
                    out.append(len(run[0]))
                else:
                    out += [len(match) for match, _ in self.split(b"".join(run).decode())]
                lo = hi
        return out

    def match_cuts(self, fragments: list[bytes], raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the pre-tokeniser's matches end. A fragment of letters, digits and signs, with no apostrophe and with one blank at
        most, in front, is cut where the kind of letter changes; a blank goes with what follows. The rest is left to the library."""
        starts = ends - np.diff(ends, prepend=0)
        kind = KINDS[raw]
        latin = np.flatnonzero(raw[:-1] == 0xC3)
        letter = latin[(raw[latin + 1] >= 0x80) & (raw[latin + 1] != 0x97) & (raw[latin + 1] != 0xB7)]
        kind[letter] = kind[letter + 1] = LETTER
        inner = kind == BLANK
        inner[starts] = False
        easy = ~np.logical_or.reduceat(inner | (kind == HARD), starts)
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) & (raw[:-1] != 32)
        cut[ends] = True
        if not easy.all():
            hard = np.flatnonzero(~easy)
            sizes = (ends - starts)[hard]
            places = ragged(starts[hard], sizes)
            cut[places] = False
            at = np.cumsum(self.matches([fragments[i] for i in hard.tolist()]))
            cut[places[at - 1] + 1] = True
            cut[starts[hard]] = True
        return cut

    def encode_fragments(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct fragments, one after the other, and how many each has."""
        data = b"".join(fragments)
        raw = np.frombuffer(data, np.uint8)
        ends = np.cumsum([len(f) for f in fragments])
        cut = self.match_cuts(fragments, raw, ends)
        cut[1:-1] |= self.forced[raw[:-1], raw[1:]]
        cut[0] = True
        own = [(fragments.index(f), i) for f, i in self.specials.items() if f in fragments]
        for i, _ in own:  # kept whole, replaced below
            cut[ends[i] - len(fragments[i]) + 1 : ends[i]] = False
        at = np.flatnonzero(cut)
        ids, part = self.merged(raw, at)
        of = np.searchsorted(ends, at[part], "right")
        for i, token in own:
            keep = np.flatnonzero(of == i)
            ids[keep[0]] = token
            ids, of = np.delete(ids, keep[1:]), np.delete(of, keep[1:])
        return ids, np.bincount(of, minlength=len(fragments))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left * len(self.sizes) + right
        i = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[i] == code, self.pair_ranks[i], NEVER)

    def merged(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts of bytes, and the part of each id. All parts take their next merge at once: the one of least rank,
        the leftmost of equals. Long parts go through a heap, one by one."""
        sizes = np.diff(at)
        part = np.repeat(np.arange(len(sizes)), sizes)
        ids, out = self.byte_ids[raw].astype(np.int64), []
        for i in np.flatnonzero(sizes > SHORT).tolist():
            long = merged_by_heap(ids[at[i] : at[i + 1]].tolist(), self.ranks)
            out.append((np.array(long, np.int64), np.full(len(long), i)))
        short = np.repeat(sizes <= SHORT, sizes)
        ids, part = ids[short], part[short]
        rank = np.full(len(ids), NEVER)
        same = np.flatnonzero(part[:-1] == part[1:])
        rank[same] = self.rank_of(ids[same], ids[same + 1])
        while len(ids):
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            best = np.minimum.reduceat((rank << 32) + np.arange(len(ids)), first)
            live = best >> 32 < NEVER
            at = best[live] & 0xFFFFFFFF
            ids[at] = self.merge_ids[best[live] >> 32]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            if not live.all():
                done = np.repeat(~live, np.diff(np.append(first, len(ids))))
                out.append((ids[done], part[done]))
                keep &= ~done
            place = np.cumsum(keep) - 1
            ids, part, rank, at = ids[keep], part[keep], rank[keep], place[at]
            for i in (at, at[(at > 0)] - 1):  # the pairs that the new token takes part in
                rank[i] = NEVER
                i = i[i + 1 < len(ids)]
                i = i[part[i] == part[i + 1]]
                rank[i] = self.rank_of(ids[i], ids[i + 1])
        ids, part = (np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in (0, 1))
        order = np.argsort(part, kind="stable")
        return ids[order], part[order]

    def cuts(self, raw: np.ndarray, offsets: np.ndarray, data: bytes) -> np.ndarray:
        """True where a fragment begins, and at the end: bounds of rows, forced pairs before white space, both ends of special tokens."""
        cut = np.zeros(len(raw) + 1, bool)
        cut[offsets] = True
        at = np.flatnonzero(BLANKS[raw[1:]] & ~BLANKS[raw[:-1]]) + 1
        last = raw[at - 1]
        free = self.forced[last, raw[at]] & ~((last >= 128) & self.after_blank[raw[np.maximum(at - 2, 0)], last])
        cut[at[free]] = True
        if self.special:
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                for found in self.special.finditer(data, lo, hi):
                    a, b = found.span()
                    cut[a:b] = False
                    cut[[a, b]] = True
        return cut

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows of a block, and where each row's begin."""
        data = raw.tobytes()
        return encoded_rows(self.known, data, self.cuts(raw, offsets, data), offsets)[0]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of the rows, and where each row's begin; ids outside the vocabulary say nothing."""
        there = (ids >= 0) & (ids < len(self.sizes))
        ids = np.where(there, ids, 0)
        sizes = np.where(there, self.sizes[ids], 0)
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        return self.letters[ragged(self.places[ids], sizes)].tobytes(), total[offsets]


def forced_pairs(tokens: list[bytes]) -> np.ndarray:
    """256 x 256: true where the pair of bytes lies inside no token."""
    flat = np.frombuffer(b"".join(tokens), np.uint8)
    inside = np.ones(max(len(flat) - 1, 0), bool)
    ends = np.cumsum([len(t) for t in tokens])
    inside[ends[(ends > 0) & (ends < len(flat))] - 1] = False
    out = np.ones((256, 256), bool)
    out[flat[:-1][inside], flat[1:][inside]] = False
    return out


def merged_by_heap(ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The same merges in n log n: a heap of ranks and places over a chain of the parts that are left."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int, j: int) -> None:
        found = ranks.get((ids[i], ids[j]))
        if found:
            heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, left, right, new = heapq.heappop(heap)
        j = after[i]
        if ids[i] != left or j == n or ids[j] != right:
            continue
        ids[i], ids[j], after[i] = new, -1, after[j]
        if after[j] < n:
            before[after[j]] = i
            offer(i, after[j])
        if before[i] >= 0:
            offer(before[i], i)
    return [t for t in ids if t >= 0]


@lru_cache(maxsize=4)
def codec(path: str, specials: bool = True) -> Codec:
    """Built once per Python worker."""
    return Codec(path, specials)


def _texts(coder: Codec, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    data, at = coder.decode(ids, at)
    at = at.tolist()
    return pa.array([data[x:y].decode("utf-8", "replace") for x, y in zip(at, at[1:])], pa.string())


def encoded(docs: DataFrame, path: str, specials: bool = True, decode: bool = False) -> DataFrame:
    """doc_id and `ids`: the token ids of the text as little-endian unsigned 32-bit integers, as training readers map them. With
    decode, also `decoded`, the text that the ids stand for, in the same pass."""
    names = ["doc_id", "ids", "decoded"][: 3 if decode else 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, specials)
        for b in batches:
            for lo, hi, raw, offsets in chunks(b.column(1), BLOCK_BYTES):
                ids, at = coder.encode(raw, offsets)
                flat, to = ids.astype("<u4").tobytes(), (at * 4).tolist()
                columns = [b.column(0).slice(lo, hi - lo), pa.array([flat[x:y] for x, y in zip(to, to[1:])], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns + [_texts(coder, ids, at)] * decode, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(run, f"doc_id {kind}, ids binary" + ", decoded string" * decode)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and `decoded`: the text that the ids stand for; bytes that are no UTF-8 become replacement characters. Null ids
    count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for b in batches:
            lists = [x or b"" for x in b.column(1).to_pylist()]
            offsets = np.cumsum([0, *(len(x) // 4 for x in lists)])
            ids = np.frombuffer(b"".join(x[: len(x) // 4 * 4] for x in lists), "<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, _texts(coder, ids, offsets)], ["doc_id", "ids", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def digests(rows: DataFrame) -> DataFrame:
    """Per document: number of tokens, digest of the ids, digest of the decoded text."""
    return rows.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
