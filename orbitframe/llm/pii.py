"""Personal data by candidate gradient boosting.

Base rules find e-mail addresses, IP addresses, card and phone numbers by exact formats; their spans always stay. Beyond them,
high-recall generators propose overlapping spans per kind, written in looser ways ("name (at) host dot org", phone numbers
without a plus, addresses with spaces). Boosted trees score each by its format and its context, probabilities are calibrated on
held-out documents, and per kind a threshold with the wanted precision selects what is added.

The trees are trained on the driver from the surroundings of proposals, at most SAMPLE_PIECES of PIECE_CHARS characters at most,
in at most SAMPLE_DOCUMENTS documents with digits or an @, those of the least text hashes. Base spans rewritten in looser ways are
the positives; broken ones and all other proposals are the negatives. Extraction maps over all documents and whole texts, in time
linear in a text's length; nothing is shuffled.

A null or empty text has no spans. Offsets are code points, ends exclusive. Rows with equal ids are read one by one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.common import hashed_sample

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCUMENTS, SAMPLE_PIECES, PIECE_CHARS = 4000, 20_000, 2000
ROUNDS, DEPTH, SHRINK, BINS, LEAST_LEAF = 100, 4, 0.3, 24, 8
#: Calibrated precision that an added span must reach, and proposals that a calibration step needs at least.
PRECISION, LEAST_STEP = 0.97, 20
FOLDS = 3
#: Code points of context on either side.
CONTEXT = 32

# Fixed formats of the base rules. Each is read in one pass: no start inside a run of digits or letters is tried again.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Generators: looser formats per kind. Spans of digits start and end with a run of digits, so that a long run is looked at once.
_AT_SIGN = re.compile(r" ?@ ?| ?[(\[{] ?at ?[)\]}] ?| at ", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_NEXT_LABEL = re.compile(r"(?: ?\. ?| ?[(\[{] ?dot ?[)\]}] ?| dot )[A-Za-z0-9-]+", re.I)
MOST_LABELS = 8
LOOSE = {
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?(?:\.|[(\[{]\.[)\]}]) ?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ./_-]{0,2}[0-9]){12,19}(?![0-9])"),
    "phone": re.compile(r"(?:\+ ?)?\(?(?<![0-9])[0-9]{1,4}\)?(?:[ ./()-]{0,2}[0-9]){5,12}(?![0-9])"),
}
_CUES = [re.compile(p, re.I) for p in (r"mail|write|contact", r"\bip\b|host|server|addr", r"card|visa|credit|pay", r"call|tel|phone|mobile|fax|\+", r"version|v\.|date|no\.|price|\$|id\b|key|token|pass")]
_AT = re.compile(r"[(\[{ ]at[)\]} ]", re.I)


#: Frequent endings of host names.
ENDINGS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au ch at be se jp in br".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches in linear time: each has one @, and starts where the run before it does or the last match ends."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            # Four by four, the groups of a chain are the leftmost matches.
            at, parts = m.start(), m[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                end = at + sum(map(len, parts[k : k + 4])) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
                    out["ip"].append((at, end))
                at = end + 1
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def loose_emails(text: str) -> list[tuple[int, int]]:
    """From each sign for @, back over the name and on over 2 to MOST_LABELS labels of the host, each of which may be the last."""
    out = []
    for sign in _AT_SIGN.finditer(text):
        start = sign.start()
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        m = _LABEL.match(text, sign.end()) if start < sign.start() else None
        for _ in range(MOST_LABELS - 1):
            m = m and _NEXT_LABEL.match(text, m.end())
            if m:
                out.append((start, m.end()))
    return out


def proposals(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all looser matches, with every suffix that starts at an inner group of digits: spans may overlap."""
    out = []
    if "@" in text or _AT.search(text):
        out += [("email", *s) for s in loose_emails(text)]
    if _DIGIT.search(text):
        for kind, pattern in LOOSE.items():
            for m in pattern.finditer(text):
                out.append((kind, *m.span()))
                if kind in ("card", "phone"):
                    for g in re.finditer(r"(?<=[ /])[+(]?[0-9]", m[0]):
                        if sum(c.isdigit() for c in m[0][g.start() :]) >= (13 if kind == "card" else 7):
                            out.append((kind, m.start() + g.start(), m.end()))
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    groups = re.findall(r"[0-9]+", span)
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    tail = re.split(r"[^A-Za-z]+", span)[-1]
    return [
        KINDS.index(kind),
        len(span),
        len(digits),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len(groups[0]) if groups else 0,
        len(groups[-1]) if groups else 0,
        max((int(g[:6]) for g in groups), default=0),
        sum(c.isalpha() for c in span),
        span.count(" "),
        span.count("-"),
        span.count("."),
        span.count("("),
        span.count("/"),
        float(span[:1] == "+"),
        float(span[:2] == "00"),
        float("@" in span),
        float(bool(_AT.search(span))),
        len(tail),
        float(bool(digits) and luhn(digits)),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(before[-1:] in "+-./=:#" and before != ""),
        float(after[:1] in "-/=:@" and after != ""),
        sum(c.isdigit() for c in before),
        sum(c.isdigit() for c in after),
        float(tail[:1].isupper()),
        float(tail.lower() in ENDINGS),
        float(bool(_NEXT_LABEL.match(text, end))),
        len(re.findall(r"\.|dot", span)),
        *(float(bool(p.search(before))) for p in _CUES),
    ]


@dataclass
class Trees:
    """Trees of fixed depth on binned features; node n has children 2n + 1 and 2n + 2."""

    edges: list[np.ndarray]
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)]).astype(np.int64)

    def odds(self, binned: np.ndarray) -> np.ndarray:
        out = np.full(len(binned), self.base)
        rows = np.arange(len(binned))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(binned), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boosted(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of the log-loss: per level, one histogram of gradients and curvatures finds each node's best split."""
    trees = Trees([np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1], method="lower")) for j in range(x.shape[1])])
    b = trees.binned(x)
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    trees.base = float(np.log(rate / (1 - rate)))
    odds, n_features, inner = np.full(len(y), trees.base), x.shape[1], 2**DEPTH - 1
    rows = np.arange(len(y))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-odds))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, BINS), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            key = ((node - first)[:, None] * n_features + np.arange(n_features)) * BINS + b
            shape = (count, n_features, BINS)
            gs, hs, ns = (np.bincount(key.ravel(), np.repeat(w, n_features), count * n_features * BINS).reshape(shape).cumsum(2) for w in (g, h, np.ones(len(y))))
            total_g, total_h, total_n = gs[:, :, -1:], hs[:, :, -1:], ns[:, :, -1:]
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            gain = np.where((ns >= LEAST_LEAF) & (total_n - ns >= LEAST_LEAF), gain, 0).reshape(count, -1)
            best = gain.argmax(1)
            useful = gain[np.arange(count), best] > 1e-9
            feature[first : first + count] = np.where(useful, best // BINS, 0)
            cut[first : first + count] = np.where(useful, best % BINS, BINS)
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        at = node - inner
        leaf = SHRINK * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + 1)
        trees.feature.append(feature)
        trees.cut.append(cut)
        trees.leaf.append(leaf)
        odds += leaf[at]
    return trees


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least scores, precision) of rising steps of at least LEAST_STEP proposals: pooled adjacent violators."""
    order = np.argsort(score, kind="stable")
    steps: list[list[float]] = []
    for i in order:
        steps.append([float(score[i]), float(y[i]), 1.0])
        while len(steps) > 1 and (steps[-2][1] / steps[-2][2] >= steps[-1][1] / steps[-1][2] or steps[-1][0] == steps[-2][0]):
            _, s, n = steps.pop()
            steps[-1][1] += s
            steps[-1][2] += n
    return np.array([s[0] for s in steps]), np.array([s[1] / s[2] if s[2] >= LEAST_STEP else min(s[1] / s[2], 0.5) for s in steps])


@dataclass
class Selector:
    trees: Trees | None = None
    least: dict[str, float] = field(default_factory=dict)

    def added(self, text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
        """Selected proposals by kind that overlap no base span; of overlapping ones the best, then the longest, wins."""
        out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        if not self.trees or not self.least:
            return out
        used = bytearray(len(text))

        def take(start: int, end: int) -> None:
            used[start:end] = b"\1" * (end - start)

        for spans in base.values():
            for span in spans:
                take(*span)
        free = [p for p in dict.fromkeys(proposals(text)) if p[0] in self.least and 1 not in used[p[1] : p[2]]]
        if free:
            odds = self.trees.odds(self.trees.binned(np.array([features(text, *p) for p in free])))
            for o, (kind, start, end) in sorted(zip(odds.tolist(), free, strict=True), key=lambda x: (-x[0], x[1][1] - x[1][2], x[1][1])):
                if o >= self.least[kind] and 1 not in used[start:end]:
                    take(start, end)
                    out[kind].append((start, end))
        return out


def rewrites(kind: str, span: str, rng: np.random.Generator) -> list[tuple[str, bool]]:
    """The span in looser ways, still personal data (True), and broken, no longer so."""
    if kind == "email":
        name, _, host = span.partition("@")
        spelled = host.replace(".", " dot ")
        return [(f"{name} (at) {host}", True), (f"{name} at {spelled}", True), (f"{name} @ {host}", True), (f"{name}[at]{host.replace('.', '[dot]')}", True), (f"{name} at {host.partition('.')[0]}", False)]
    if kind == "ip":
        return [(span.replace(".", " . "), True), (span.replace(".", "[.]"), True), (f"{int(rng.integers(256, 999))}{span[span.index('.') :]}", False), (f"{span.replace('.', ' . ')} . {int(rng.integers(256))}", False)]
    digits = re.sub("[^0-9]", "", span)
    broken = f"{digits[:-1]}{(int(digits[-1]) + int(rng.integers(1, 10))) % 10}"
    fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
    if kind == "card":
        return [(".".join(fours), True), ("/".join(fours), True), ("  ".join(fours), True), (broken, False), (" ".join(broken[i : i + 4] for i in range(0, len(broken), 4)), False), (".".join(broken[i : i + 4] for i in range(0, len(broken), 4)), False)]
    tail = f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}"
    return [(span.lstrip("+"), True), (f"00{span.lstrip('+')}", True), (f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", True), (tail, True), (digits + str(int(rng.integers(10**9))), False), (digits[-10:] + "e" + digits[:3], False)]


def examples(texts: list[str], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, kind, fold) of the proposals in the texts and in the texts with base spans rewritten."""
    rng = np.random.default_rng(seed)
    rows: list[tuple[list[float], bool, int, int]] = []
    for text in texts:
        fold = zlib.crc32(text.encode()) % FOLDS
        base = base_spans(text)
        true = {(k, *s) for k in KINDS for s in base[k]}
        for kind, start, end in dict.fromkeys(proposals(text)):
            # Base spans need no tree: their kinds are learned from their rewritten forms.
            if not any(start < e and s < end for _, s, e in true):
                rows.append((features(text, kind, start, end), False, KINDS.index(kind), fold))
        for kind, start, end in sorted(true):
            for new, good in rewrites(kind, text[start:end], rng):
                lo, hi = max(0, start - 80), min(len(text), end + 80)
                changed, at = text[lo:start] + new + text[end:hi], start - lo
                for k, s, e in dict.fromkeys(proposals(changed)):
                    if s < at + len(new) and at < e:
                        rows.append((features(changed, k, s, e), good and (k, s, e) == (kind, at, at + len(new)), KINDS.index(k), fold))
    if not rows:
        return np.zeros((0, 1)), np.zeros(0), np.zeros(0, int), np.zeros(0, int)
    return np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])


def fit(docs: DataFrame, column: str = "text", most: int = SAMPLE_DOCUMENTS, precision: float = PRECISION, seed: int = 1) -> Selector:
    rows = docs.select(F.col(column).cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]"))
    # Texts come as the surroundings of what the looser formats can match; all of a sampled document is looked at.
    near = hashed_sample(rows, F.col("text"), most)

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                spans = [(s, e) for _, s, e in proposals(text)] + [s for v in base_spans(text).values() for s in v]
                end = 0
                for s, e in sorted(spans):
                    if s >= end:
                        lo, end = max(0, s - 120), min(len(text), e + 120)
                        out.append(text[lo:end])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["text"])

    pieces = near.mapInArrow(surroundings, "text string").filter(F.length("text") <= PIECE_CHARS)
    texts = sorted(r["text"] for r in pieces.orderBy(F.xxhash64("text"), "text").limit(SAMPLE_PIECES).collect())
    return trained(texts, precision, seed)


def trained(texts: list[str], precision: float = PRECISION, seed: int = 1) -> Selector:
    x, y, kind, fold = examples(texts, seed)
    if not 0 < y.sum() < len(y):
        return Selector()
    score = np.zeros(len(y))
    for k in range(FOLDS):
        train = fold != k
        if 0 < y[train].sum() < train.sum() and (~train).any():
            trees = boosted(x[train], y[train])
            score[~train] = trees.odds(trees.binned(x[~train]))
    # Proposals of the corpus count as negatives without anybody having looked at them. Those that models of other documents take
    # for personal data still count in the calibration, but the final trees don't learn to reject them.
    plain = (y == 1) | (score <= 0)
    out = Selector(boosted(x[plain], y[plain]))
    for i, name in enumerate(KINDS):
        own = kind == i
        if own.any():
            least, sure = isotonic(score[own], y[own])
            if (sure >= precision).any():
                # Half way to the next lower proposal, but never under the odds of the precision itself.
                step = float(least[np.argmax(sure >= precision)])
                under = score[own][score[own] < step]
                out.least[name] = max(float(np.log(precision / (1 - precision))), (step + float(under.max())) / 2 if len(under) else -np.inf)
    return out


def written(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


def found(docs: DataFrame, selector: Selector, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans, written kind:start:end), spans (all), n_added."""
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for b in batches:
            out: list[list] = [[] for _ in names]
            for text in b.column(1):
                row = (0, 0, 0, 0, nothing, "", 0)
                text = text.as_py()
                if text and ("@" in text or _DIGIT.search(text) or _AT.search(text)):
                    base = base_spans(text)
                    more = selector.added(text, base)
                    every = {k: base[k] + more[k] for k in KINDS}
                    row = (*(len(base[k]) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(every), sum(map(len, more.values())))
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["key", *names])

    rows = docs.select(F.col(key).alias("key"), F.col(column).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, {', '.join(f'{n} long' for n in names[:4])}, base_sha256 string, spans string, n_added long").withColumnRenamed("key", key)


def redacted(docs: DataFrame, selector: Selector, column: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; overlapping spans are replaced together."""

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if text:
                base = base_spans(text)
                more = selector.added(text, base)
                pieces, at = [], 0
                for s, e, k in sorted((s, e, k) for k in KINDS for s, e in base[k] + more[k]):
                    if s >= at:
                        pieces += [text[at:s], f"[{k}]"]
                    at = max(at, e)
                text = "".join(pieces) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    return docs.withColumn(column, hide(F.col(column).cast("string")))
