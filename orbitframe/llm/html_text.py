"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags. Each block has a vector of its hashed tag
path (names, classes and ids of the enclosing elements), a vector of its hashed words, and a few measures such as link density.
A bidirectional LSTM in numpy reads the whole sequence and labels every block as main text or not.

The labeller is trained on the driver, from at most SAMPLE_PAGES pages of at most SAMPLE_CHARS characters, those of the least text
hashes: as they are, and rearranged under random page templates, so that no single template is learned by heart. Labels come from the elements that a template gives a
meaning. Extraction maps over all pages, whole, in batches of pages of like length; nothing is shuffled.

A null or empty page has the empty text. Rows with equal ids are read one by one; extra columns are ignored. Markup errors are
read as browsers do: unknown or unclosed elements end with their parent, rows, cells, items and terms with the next one of their kind,
stray end tags are dropped. Of a path of more than 64 parts the middle is left out; time and memory are linear in the page. Text in a closed svg, select,
iframe, object, template or noscript is skipped; if the element is not closed, its text is read and labelled like any other.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.common import hashed_sample

SAMPLE_PAGES, SAMPLE_CHARS = 200, 1_000_000
#: Templates under which each sampled page is seen again.
REARRANGED = 3
PATH_SIZE, WORD_SIZE, MEASURES = 96, 32, 6
FEATURES = PATH_SIZE + WORD_SIZE + MEASURES
HIDDEN, EPOCHS, BATCH, RATE = 16, 8, 32, 0.01
SEED = 5
#: Parts of a path that count: so many from the page's root, and as many from the block up.
PATH_ENDS = 32
#: Blocks that are labelled at a time, padding included; a longer page goes by itself.
LABELLED = 20_000

#: A quote opens a value behind "=" only; elsewhere it is part of a name. A tag or comment without end reaches to the page's end.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)|([^<]+|<)",
    re.S,
)
_EMPTY = re.compile(r"(?:^|[\s\"'])[^\s\"'=/]*/$")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template title textarea iframe object svg select".split())
#: Silent elements whose content is no markup: without an end tag they reach to the end of the page, as in browsers.
RAW = frozenset("script style title textarea".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
#: Start tags that end open elements: of which names, and the elements inside which they must lie.
_CELLS, _ROWS = ("td", "th"), ("tbody", "thead", "tfoot")
IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "table")),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl", "table"))),
    **dict.fromkeys(_CELLS, (_CELLS, ("tr", "table"))),
    "tr": (("tr", *_CELLS, "caption", "colgroup"), ("table",)),
    **dict.fromkeys(_ROWS, ((*_ROWS, "tr", *_CELLS, "caption", "colgroup"), ("table",))),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements and words of class names that say what a part of a page is, for training labels.
MAIN_PARTS = frozenset("article main".split())
OTHER_PARTS = frozenset("nav footer aside form menu ad ads advert sidebar navigation cookie notice banner comments comment promo related newsletter header login search breadcrumb share".split())


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def raw_end(page: str, name: str, at: int) -> int:
    end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
    return end.end() if end else len(page)


def silent_ends(page: str) -> dict[int, int]:
    """Where the closed silent elements end, by where their start tags end. An end tag closes the last open one of its name."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = {name: [] for name in SILENT - RAW}
    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        name = (m[2] or "").lower()
        if name not in SILENT:
            continue
        if m[1]:
            if opened.get(name):
                out[opened[name].pop()] = at
        elif (name not in RAW or opened["svg"]) and _EMPTY.search(m[3]):
            continue
        elif name in RAW:
            at = raw_end(page, name, at)
        else:
            opened[name].append(at)
    return out


class Opened:
    """The open elements. Where the elements of a name lie is kept as well, so that ending one takes no search."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}

    @property
    def path(self) -> tuple[str, ...]:
        return self.stack[-1][1] if self.stack else ()

    def last(self, names: tuple[str, ...]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def cut(self, place: int) -> None:
        for name, _ in reversed(self.stack[place:]):
            self.places[name].pop()
        del self.stack[place:]

    def close(self, name: str) -> None:
        place = self.last((name,))
        if place >= 0:
            self.cut(place)

    def open(self, name: str, marks: list[str]) -> None:
        """A start tag first ends what it cannot lie in: a paragraph before a block, a row before a row, up to the table or list."""
        if self.stack and self.stack[-1][0] == "p" and name in CLOSES_P:
            self.cut(len(self.stack) - 1)
        if name in IMPLIED_ENDS:
            ended, within = IMPLIED_ENDS[name]
            edge = self.last(within)
            first = min((p for n in ended for p in reversed(self.places.get(n, ())[-len(ended) :]) if p > edge), default=-1)
            if first >= 0:
                self.cut(first)
        path = (*self.path, name, *(f".{w}" for w in marks))
        if len(path) > 2 * PATH_ENDS:
            path = path[:PATH_ENDS] + path[-PATH_ENDS:]
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, path))


def page_blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, with white space collapsed and character references decoded."""
    out: list[Block] = []
    opened = Opened()
    pieces: list[str] = []
    linked = links = 0
    path: tuple[str, ...] = ()
    ends: dict[int, int] | None = None

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, path, linked))
            pieces.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        closing, name, attributes, text = m.group(1, 2, 3, 4)
        if text is not None:
            piece = html.unescape(text) if "&" in text else text
            pieces.append(piece)
            if links:
                linked += len(piece)
            continue
        if name is None:
            continue
        name = name.lower()
        if name in SILENT and not closing:
            if (name not in RAW or opened.places.get("svg")) and _EMPTY.search(attributes):
                continue
            if name in RAW:
                at = raw_end(page, name, at)
                continue
            if ends is None:
                ends = silent_ends(page)
            if at in ends:
                at = ends[at]
                continue
            # Without an end tag it is an element like others: nothing is skipped, and it ends with its parent.
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            elif name in ("br", "wbr"):
                pieces.append(" " if name == "br" else "")
            continue
        flush()
        if closing:
            opened.close(name)
        elif name not in VOID:
            opened.open(name, [w for a in _NAMED.finditer(attributes) for w in (a[1] or a[2] or a[3] or "").lower().split()] if attributes else [])
        path = opened.path
        links = 0
    flush()
    return out


_WORDS = re.compile(r"\w+")
_paths: dict[tuple[str, ...], np.ndarray] = {}
_slots: dict[str, int] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = _paths.get(path)
    if v is None:
        if len(_paths) > 50_000:
            _paths.clear()
        v = np.zeros(PATH_SIZE)
        for part in path:
            for token in (part, *(f"~{w}" for w in re.split(r"[^a-z]+", part) if part[0] == "." and len(w) > 1)):
                h = zlib.crc32(token.encode())
                v[h % PATH_SIZE] += 1 if h >> 20 & 1 else -1
        _paths[path] = v = np.clip(v, -2, 2)
    return v


def _slot(word: str) -> int:
    k = _slots.get(word)
    if k is None:
        if len(_slots) > 200_000:
            _slots.clear()
        k = _slots[word] = zlib.crc32(word.encode()) % WORD_SIZE
    return k


def block_features(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), FEATURES))
    for i, b in enumerate(blocks):
        found = _WORDS.findall(b.text.lower())
        out[i, :PATH_SIZE] = _path_vector(b.path)
        if found:
            out[i, PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.bincount([_slot(w) for w in found], minlength=WORD_SIZE) / np.sqrt(len(found))
        n = len(b.text)
        out[i, -MEASURES:] = (np.log1p(n) / 5, min(1.0, b.linked / n), i / len(blocks), len(blocks) / 100 if len(blocks) < 100 else 1, b.text[-1] in ".!?", len(found) / n)
    return out


class Labeller:
    """A bidirectional LSTM with a logistic output per step."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, 0.5 / np.sqrt(FEATURES), (FEATURES, 4 * HIDDEN))
            self.p["u" + d] = rng.normal(0, 0.5 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.p["c" + d] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        self.p["out"] = rng.normal(0, 0.1, 2 * HIDDEN)
        self.p["skip"] = np.zeros(FEATURES)
        self.p["bias"] = np.zeros(1)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states over steps; masked steps leave the state as it is."""
        steps, size, _ = x.shape
        h, c = np.zeros((size, HIDDEN)), np.zeros((size, HIDDEN))
        z = x @ self.p["w" + d] + self.p["c" + d]
        states, tape = np.zeros((steps, size, HIDDEN)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ self.p["u" + d]
            gates = 1 / (1 + np.exp(-a[:, : 3 * HIDDEN]))
            g = np.tanh(a[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            new = f * c + i * g
            squashed = np.tanh(new)
            m = mask[t][:, None]
            if keep:
                tape.append((t, h, c, i, f, o, g, squashed, m))
            h, c = m * (o * squashed) + (1 - m) * h, m * new + (1 - m) * c
            states[t] = h
        return states, tape

    def odds(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        forward, _ = self._pass(x, mask, "f", False)
        backward, _ = self._pass(x, mask, "b", False)
        return np.concatenate([forward, backward], 2) @ self.p["out"] + x @ self.p["skip"] + self.p["bias"]

    def slopes(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log-loss over unmasked steps, by backpropagation through time."""
        runs = {d: self._pass(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        odds = both @ self.p["out"] + x @ self.p["skip"] + self.p["bias"]
        error = (1 / (1 + np.exp(-odds)) - y) * mask / max(mask.sum(), 1)
        out = {"out": np.einsum("tb,tbh->h", error, both), "skip": np.einsum("tb,tbf->f", error, x), "bias": error.sum(keepdims=True)[0]}
        for k, d in enumerate("fb"):
            to_h = error[:, :, None] * self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            dh, dc = np.zeros(to_h.shape[1:]), np.zeros(to_h.shape[1:])
            dz = np.zeros((*to_h.shape[:2], 4 * HIDDEN))
            du = np.zeros_like(self.p["u" + d])
            for t, h, c, i, f, o, g, squashed, m in reversed(runs[d][1]):
                dh = dh + to_h[t]
                inner = m * dh
                cell = m * dc + inner * o * (1 - squashed**2)
                a = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), inner * squashed * o * (1 - o), cell * i * (1 - g**2)], 1)
                dz[t] = a
                du += h.T @ a
                dh = (1 - m) * dh + a @ self.p["u" + d].T
                dc = (1 - m) * dc + cell * f
            out |= {"w" + d: np.einsum("tbf,tbg->fg", x, dz, optimize=True), "u" + d: du, "c" + d: dz.sum((0, 1))}
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = SEED) -> "Labeller":
        """Adam over batches of pages of like length."""
        rng = np.random.default_rng(seed)
        pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
        groups = [pages[i : i + BATCH] for i in range(0, len(pages), BATCH)]
        mean, square, k = {n: 0.0 for n in self.p}, {n: 0.0 for n in self.p}, 0
        for _ in range(epochs):
            for at in rng.permutation(len(groups)):
                k += 1
                x, mask = padded([f for f, _ in groups[at]])
                y = np.zeros(mask.shape)
                for j, (_, labels) in enumerate(groups[at]):
                    y[: len(labels), j] = labels
                for n, g in self.slopes(x, mask, y).items():
                    mean[n] = 0.9 * mean[n] + 0.1 * g
                    square[n] = 0.99 * square[n] + 0.01 * g * g
                    self.p[n] = self.p[n] - RATE * (mean[n] / (1 - 0.9**k)) / (np.sqrt(square[n] / (1 - 0.99**k)) + 1e-8)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            take = 1
            while at + take < len(order) and take < 64 and (take + 1) * len(pages[order[at + take]]) <= LABELLED:
                take += 1  # by the longest page, to which all are padded
            group = order[at : at + take]
            x, mask = padded([pages[i] for i in group])
            odds = self.odds(x, mask)
            for j, i in enumerate(group):
                out[i] = odds[: len(pages[i]), j] > 0
            at += take
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), FEATURES))
    mask = np.zeros(x.shape[:2])
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


def known_label(path: tuple[str, ...]) -> bool:
    """Whether the path lies in a main part, and in no other part below it."""
    main = False
    for part in path:
        named = {part} if part[0] != "." else set(re.split(r"[^a-z]+", part))
        if named & OTHER_PARTS:
            return False
        main |= bool(named & MAIN_PARTS)
    return main


def rearranged(main: list[Block], other: list[Block], strange: list[str], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page's main blocks under a random template, among menus, notices, adverts, forms and comments of other texts."""

    def some(n: int, least: int = 1) -> list[str]:
        pool = strange if rng.random() < 0.6 or not other else [b.text for b in other]
        return [pool[int(rng.integers(len(pool)))] for _ in range(int(rng.integers(least, n + 1)))]

    def pick(*choices: tuple[str, ...]) -> tuple[str, ...]:
        return choices[int(rng.integers(len(choices)))]

    top = ("html", "body") + pick((), ("div", ".page"), ("div", ".wrapper"), ("div", ".container"), ("div", f".c{int(rng.integers(1000))}"), ("div", "div"), ("div", ".layout"))
    body = top + pick(("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".main-content"), ("div", ".article-body"), ("div", ".post"), ("section", ".entry-content"), ("div", ".story"), ("div", ".post-content"), ("div", ".content", "div", ".text"), ("section", ".article"))
    out: list[tuple[Block, bool]] = []

    def add(path: tuple[str, ...], texts: list[str], link: float = 0.0) -> None:
        out.extend((Block(t, path, int(len(t) * link)), False) for t in texts if t)

    def short(texts: list[str]) -> list[str]:
        return [" ".join(t.split()[: int(rng.integers(1, 4))]) for t in texts]

    if rng.random() < 0.6:
        add(top + pick(("header",), ("div", ".header"), ("div", ".site-header"), ("header", ".top")) + pick((), ("p",), ("h1",), ("div",)), short(some(2)))
    if rng.random() < 0.8:
        add(top + pick(("nav", "ul", "li"), ("ul", ".menu", "li"), ("div", ".nav", "ul", "li"), ("header", "nav", "ul", "li"), ("div", ".breadcrumb")), short(some(8, 2)), 1.0)
    if rng.random() < 0.5:
        add(top + pick(("div", ".cookie-notice", "p"), ("div", ".notice"), ("div", ".cookie"), ("div", ".banner", "p"), ("section", ".alert")), some(2))
    if rng.random() < 0.5:
        add(top + pick(("div", ".ad"), ("aside", ".ad"), ("div", ".advert", "p"), ("div", ".sponsored")), some(2))
    side = pick(("aside",), ("aside", "p"), ("div", ".sidebar", "p"), ("div", ".related", "li"), ("aside", "ul", "li"))
    if rng.random() < 0.25:
        add(top + side, some(4), float(rng.random() < 0.5))
    if rng.random() < 0.5:
        out.append((Block(short(some(1))[0] or "Title", body + pick(("h1",), ("h2",), ("h1", ".title")), 0), True))
    for k, b in enumerate(main):
        if k and rng.random() < 0.15:
            out.append((Block(short(some(1))[0] or "Notes", body + pick(("h2",), ("h3",), ("h4",)), 0), True))
        leaf = tuple(t for t in b.path[-1:] if t in ("p", "h1", "h2", "h3", "li", "blockquote", "pre", "td", "div"))
        if rng.random() < 0.2:
            leaf = pick(("ul", "li"), ("ol", "li"), ("h2",), ("h3",), ("div",), ("blockquote", "p"), ("section", "p"))
        text = short([b.text])[0] if leaf in (("h2",), ("h3",)) or rng.random() < 0.1 else b.text
        out.append((Block(text, body + leaf, int(len(text) * 0.3 * rng.random()) if rng.random() < 0.2 else 0), True))
        if k and rng.random() < 0.06:
            add(body + pick(("div", ".ad"), ("div", ".promo", "p"), ("aside",), ("aside", "p"), ("form", "p"), ("div", ".share")), some(2))
    if rng.random() < 0.5:
        add(pick(top, body) + pick(("section", ".comments", "p"), ("div", ".comments", "div", ".comment", "p"), ("div", ".comment-list", "li"), ("ol", ".comments", "li", "p"), ("section", ".comments", "article", ".comment", "p"), ("div", ".responses", "p")), some(5))
    if rng.random() < 0.35:
        add(pick(top, body) + pick(("form",), ("form", "label"), ("form", "p"), ("div", ".newsletter", "form", "p"), ("div", ".search", "form")), some(3))
    if rng.random() < 0.4:
        add(top + side, some(4), float(rng.random() < 0.5))
    if rng.random() < 0.8:
        add(top + pick(("footer",), ("footer", "p"), ("div", ".footer"), ("div", ".site-footer", "p"), ("footer", "ul", "li")), some(3))
    return [b for b, _ in out], np.array([y for _, y in out], float)


def fit(pages: DataFrame, column: str = "html", most: int = SAMPLE_PAGES, seed: int = SEED) -> Labeller:
    rng = np.random.default_rng(seed)
    rows = pages.select(F.col(column).cast("string").alias("html")).filter(F.length("html").between(1, SAMPLE_CHARS))
    sample = [page_blocks(r["html"]) for r in hashed_sample(rows, F.col("html"), most).collect()]
    strange = [b.text for blocks in sample for b in blocks[:: max(1, len(blocks) // 8)]]
    seen = []
    for blocks in sample:
        labels = np.array([known_label(b.path) for b in blocks], float)
        if labels.any():
            seen.append((block_features(blocks), labels))
        main = [b for b, y in zip(blocks, labels, strict=True) if y] or [b for b in blocks if len(b.text) > 80]
        other = [b for b in blocks if not any(b is x for x in main)]
        if main and strange:
            for _ in range(REARRANGED):
                made, y = rearranged(main, other, strange, rng)
                seen.append((block_features(made), y))
    return Labeller(seed).fit(seen, seed=seed)


def extracted(pages: DataFrame, labeller: Labeller, keys: tuple[str, ...] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """keys, text (the main blocks, joined by newlines), n_blocks, n_kept; one row per input row."""
    names = [f"k{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html, lo = b.column(len(names)), 0
            while lo < b.num_rows:
                pages, n = [], 0
                while lo + len(pages) < b.num_rows and len(pages) < 512 and n < 4 * LABELLED:
                    pages.append(page_blocks(html[lo + len(pages)].as_py() or ""))
                    n += len(pages[-1])
                labels = labeller.label([block_features(p) for p in pages])
                text = ["\n".join(x.text for x, y in zip(p, keep, strict=True) if y) for p, keep in zip(pages, labels, strict=True)]
                counts = pa.array([len(p) for p in pages], pa.int64()), pa.array([int(y.sum()) for y in labels], pa.int64())
                part = b.slice(lo, len(pages))
                lo += len(pages)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(text, pa.string()), *counts], [*names, "text", "n_blocks", "n_kept"])

    rows = pages.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(column).cast("string").alias("html"))
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(run, f"{kinds}, text string, n_blocks long, n_kept long").withColumnsRenamed(dict(zip(names, keys, strict=True)))
