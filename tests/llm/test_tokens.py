"""BPE and token alignment against the libraries and brute force, whitening against numpy, and odd input."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from orbitframe.llm import align, bpe, queries, whitening

SF = "/root/testdata/sf0.001"
PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: doc_id and text among columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, ids string, decoded long, groups string, pairs int, n_a string, row long, sums int"
PARTS = ["a", "b", "the ", " ", "  ", "\n", "\t", "é", "ção", "日本", "'s", "'ll", "<|endoftext|>", "<|endof", "!", "...", "　", " ", "\x85", "\x1c", "\x00", "×", "12", "٣", "²", "😀", "ing", " don't", "\r\n", "unaffordable", "<0x41>", "</s>", "᠎"]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    out += [None, "", " ", "   ", "x ", " x  ", "▁", "a▁b", "<|endoftext|>" * 3, "a  <|endoftext|>  b"]
    return out + ["x" * 70_000, "ab " * 30_000, " " * 5000 + "q", "日" * 9000, out[3], out[3]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i != 7 else None, t, "i", 1, "g", 2, "n", 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH_A)


def test_bpe_equals_the_library(docs, texts, library):
    rows = {r.doc_id: r for r in bpe.decoded(bpe.encoded(docs, PATH_A), PATH_A).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        row, ids = rows[i if i != 7 else None], library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == ids, text
        assert row.decoded == library.decode(ids, skip_special_tokens=False)


def test_bpe_query_over_all_documents(spark, library):
    found = {r.doc_id: r for r in queries.op11_bpe(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (found[r.doc_id].n_tokens, found[r.doc_id].ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert found[r.doc_id].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_bpe_cuts_lie_between_tokens(library):
    """No token reaches over a forced pair, and fragments encoded alone give the ids of the whole."""
    coder = bpe.codec(PATH_A)
    for token in library.get_vocab():
        raw = np.frombuffer(token.translate(coder.plain).encode("latin-1"), np.uint8) if token != "<|endoftext|>" else np.zeros(1, np.uint8)
        assert not coder.forced[raw[:-1], raw[1:]].any()
    assert coder.forced.mean() > 0.9


def test_bpe_merges_of_long_parts(library):
    """The heap gives what the joint merges give, ties included."""
    coder, rng = bpe.codec(PATH_A), random.Random(5)
    for _ in range(300):
        part = "".join(rng.choice("aehinrst") for _ in range(rng.randint(1, 40))).encode()
        one, _ = coder.merged(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
        assert one.tolist() == bpe.merged_by_heap(coder.byte_ids[list(part)].tolist(), coder.ranks)


def test_bpe_forgets_and_goes_on(monkeypatch, texts, library):
    import pyarrow as pa

    from orbitframe.llm.common import chunks

    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    coder = bpe.Codec(PATH_A)
    for text in texts[:100]:
        for _, _, raw, offsets in chunks(pa.array([text or ""])):
            assert coder.encode(raw, offsets)[0].tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_bpe_decodes_odd_ids(spark):
    """Half letters become replacement characters, unknown ids say nothing, null ids are none."""
    half = Tokenizer.from_file(PATH_A).encode("日", add_special_tokens=False).ids[:1]
    rows = [(1, bytearray(np.array(half + [99_999_999], "<u4").tobytes())), (2, None), (2, bytearray())]
    found = bpe.decoded(spark.createDataFrame(rows, "doc_id int, ids binary"), PATH_A).collect()
    assert sorted((r.doc_id, r.decoded) for r in found) == [(1, "�"), (2, ""), (2, "")]


def brute(text, library, processor):
    """(n_a, n_b, n_groups, groups, links) by intervals, or None without tokens."""
    if not text:
        return None
    whole, letters = (" " + text).encode(), align.pieces(PATH_B).letters
    coder = bpe.codec(PATH_A, False)
    a, b = library.encode(" " + text, add_special_tokens=False).ids, processor.encode(text)
    sides = [[coder.letters[coder.places[i] :][: coder.sizes[i]].tobytes() for i in a], [letters[i] for i in b]]
    if any(b"".join(s) != whole for s in sides):
        return None
    ends = [np.cumsum([len(t) for t in s]).tolist() for s in sides]
    groups, done = [], [0, 0]
    for end in sorted(set(ends[0]) & set(ends[1])):
        upto = [side.index(end, at) + 1 for side, at in zip(ends, done)]
        groups.append("|".join(",".join(map(str, ids[x:y])) for ids, x, y in zip((a, b), done, upto)))
        done = upto
    links, j = Counter(), 0
    for i, (x, start, end) in enumerate(zip(a, [0, *ends[0]], ends[0])):
        while j and ends[1][j - 1] > start:
            j -= 1
        while ends[1][j] <= start:
            j += 1
        while j < len(b) and (ends[1][j - 1] if j else 0) < end:
            links[x, b[j]] += 1
            j += 1
        j = min(j, len(b) - 1)
    return len(a), len(b), len(groups), ";".join(groups), links


def expected(texts, library, processor):
    found = [brute(t, library, processor) for t in texts]
    held = Counter(pair for f in found if f for pair in f[4])
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for f in found:
        if not f:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            links = f[4]
            out.append((*f[:3], sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()), sha(f[3])))
    return out


@pytest.fixture(scope="module")
def plain_library():
    out = Tokenizer.from_file(PATH_A)
    out.encode_special_tokens = True
    return out


@pytest.fixture(scope="module")
def processor():
    return SentencePieceProcessor(model_file=PATH_B)


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [align.BROADCAST_PAIRS, 0])
def test_alignment_equals_brute_force(docs, texts, plain_library, processor, most):
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.digests(align.aligned(docs, PATH_A, PATH_B, most)).collect()}
    want = {i if i != 7 else None: w for i, w in enumerate(expected(texts, plain_library, processor))}
    assert found == want


def test_alignment_query_over_all_documents(spark, plain_library, processor):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = dict(zip((r.doc_id for r in rows), expected([r.text for r in rows], plain_library, processor)))
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_token_alignment(spark, SF).collect()} == want


def test_gallop_finds_lower_bounds():
    rng = np.random.default_rng(6)
    for _ in range(50):
        among = np.unique(rng.integers(0, 500, rng.integers(0, 200)))
        values = rng.integers(0, 510, 60)
        lo = rng.integers(0, len(among) + 1, 60)
        hi = np.minimum(len(among), lo + rng.integers(0, 90, 60))
        found = align.gallop(values, among, rng.integers(-5, 250, 60), lo, hi)
        assert found.tolist() == [lo[i] + np.searchsorted(among[lo[i] : hi[i]], values[i]) for i in range(60)]


@pytest.mark.parametrize("most", [align.BROADCAST_PAIRS, 0])
def test_tokens_of_empty_tables(spark, most):
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.digests(bpe.decoded(bpe.encoded(none, PATH_A), PATH_A)).collect() == []
    assert align.digests(align.aligned(none, PATH_A, PATH_B, most)).collect() == []
    only_null = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in align.digests(align.aligned(only_null, PATH_A, PATH_B, most)).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


# Whitening


def scatter(x):
    return (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))


def kinds_of_rows():
    rng = np.random.default_rng(7)
    plain = np.floor(rng.normal(size=(900, 12)) * 30 * rng.uniform(0.2, 2, 12))
    low = np.floor(rng.normal(size=(300, 3)) * 20) @ rng.integers(-3, 4, (3, 12)).astype(float)
    same = plain.copy()
    same[:, 4], same[:, 6:9] = same[:, 5], 0
    return {"plain": plain, "low rank": low, "equal columns": same, "one row": plain[:1], "equal rows": np.repeat(plain[:1], 5, 0), "two rows": plain[:2], "large": plain * 1e12, "diagonal": np.vstack([np.eye(12), -np.eye(12)])}


@pytest.mark.parametrize("kind", kinds_of_rows())
@pytest.mark.parametrize("block", [1, 7, 200])
def test_rank_one_updates_give_the_spectrum(kind, block):
    x = kinds_of_rows()[kind]
    spectra = []
    for part in np.array_split(x, 3):
        own = whitening.Spectrum(12)
        for lo in range(0, len(part), block):
            own.add_rows(part[lo : lo + block])
        spectra.append(own)
    whole = spectra[0]
    for s in spectra[1:]:
        if s.n:
            whole.add_spectrum(s)
    top = max(np.linalg.eigvalsh(scatter(x))[-1], 1e-300)
    assert whole.n == len(x) and np.allclose(whole.mean, x.mean(axis=0), rtol=1e-12)
    assert np.abs(whole.values - np.linalg.eigvalsh(scatter(x))).max() < 1e-11 * top
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(12)).max() < 1e-11
    assert np.abs(whole.vectors * whole.values @ whole.vectors.T - scatter(x)).max() < 1e-11 * top


def test_secular_roots_interlace_and_keep_close_poles():
    d, z = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-12, 5.0]), np.array([0.3, 0.4, 0.5, 0.5, 0.5])
    z /= np.linalg.norm(z)
    roots, vectors = whitening.secular(d, z, 2.0)
    assert (roots[:-1] <= d[1:]).all() and (roots >= d).all()
    assert np.abs(vectors.T @ vectors - np.eye(5)).max() < 1e-13
    assert np.abs(vectors * roots @ vectors.T - np.diag(d) - 2 * np.outer(z, z)).max() < 1e-13


def check_whitened(rows, vectors):
    """rows of the operator against numpy; vectors by id, in order."""
    x = {i: [int(np.floor(256 * float(c))) for c in v] for i, v in vectors}
    fit = np.array(sorted({tuple(v) for v in x.values()}), float)
    n, d = fit.shape
    cov = (fit - fit.mean(axis=0)).T @ (fit - fit.mean(axis=0)) / n
    e, v = np.linalg.eigh(cov)
    sums = [sum(int(c) for c in col) for col in fit.T]
    assert len(rows) == len(vectors) * 4
    signs = {}
    for r in rows:
        k = r.component - 1
        y = (np.array(x[r.vec_id]) - fit.mean(axis=0)) @ v[:, -1 - k] / np.sqrt(e[-1 - k])
        if abs(y) > 1e-3:
            assert signs.setdefault(k, np.sign(y * r.whitened)) == np.sign(y * r.whitened)
        assert abs(abs(y) - abs(r.whitened)) < 1e-8
        assert (r.n, r.deviation) == (n, sum((n * c - s) ** 2 for c, s in zip(x[r.vec_id], sums)))
        assert abs(r.explained - e[-1 - k] / np.trace(cov)) < 1e-10 and r.identity_error < 1e-10


def test_whitening_query_over_all_embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check_whitened(queries.op12_whitening(spark, SF).collect(), [(r.vec_id, r.embedding) for r in rows])


def test_whitening_drops_bad_rows_and_counts_copies_once(spark):
    rng = np.random.default_rng(8)
    good = [(i, rng.normal(size=6).tolist(), "w", 1) for i in range(60)]
    good += [(100 + i, good[i % 3][1], None, 2) for i in range(40)]
    bad = [(200, None, "x", 1), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x", 1), (202, [float("nan")] * 6, "x", 1), (203, [float("inf")] + [0.0] * 5, "x", 1)]
    schema = "vec_id long, embedding array<double>, whitened string, x int"
    df = spark.createDataFrame(good + bad, schema).repartition(7)
    check_whitened(whitening.whitened(df).collect(), [r[:2] for r in good])


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    same = whitening.whitened(spark.createDataFrame([(1, [0.5, 1.0]), (None, [0.5, 1.0])], schema)).collect()
    assert sorted((r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same) == [(1, 1, 0, None, None, None)] * 2 + [(2, 1, 0, None, None, None)] * 2
    short = whitening.whitened(spark.createDataFrame([(1, [0.5]), (2, [1.0, 1.0]), (3, [0.0, 2.0, 0.0])], schema)).collect()
    assert len(short) == 9 and {r.n for r in short} == {3}
    huge = whitening.whitened(spark.createDataFrame([(1, [1e30]), (2, [-1e30]), (3, [0.0])], schema)).collect()
    assert sorted((r.vec_id, r.deviation) for r in huge) == [(1, None), (2, None), (3, 1)]


def test_whitening_is_the_same_in_any_partitioning(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    one, two = ({(r.vec_id, r.component): r for r in whitening.whitened(df.repartition(n, F.rand(n))).collect()} for n in (1, 13))
    assert one.keys() == two.keys() and all(abs(one[k].whitened - two[k].whitened) < 1e-9 and one[k].deviation == two[k].deviation for k in one)
