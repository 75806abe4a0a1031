"""Pairs to align are all that share a word, whatever its hash."""

import random

import pytest
from pyspark.sql import functions as F

from orbitframe.operators import sequences as q

K = 16


@pytest.fixture(scope="module")
def sides():
    """Thirty items, and as many texts that hold one word of the item of their number and nothing else of it; short, empty and null ones."""
    r = random.Random(5)
    letters = lambda n: "".join(r.choices("ACDEFGHIKLMNPQRSTVWY", k=n))
    items = [(k, letters(40)) for k in range(30)]
    texts = [(k, letters(25) + s[k % 24 : k % 24 + K] + letters(30)) for k, s in items]
    odd = [(100, None), (101, ""), (102, items[3][1][: K - 1]), (103, items[4][1] + items[5][1] + letters(2000)), (7, texts[7][1])]
    return [*texts, *odd], [*items, (200, None), (201, items[6][1][:K])]


@pytest.mark.parametrize("words, bits", [(1 << 20, 25), (5, 16)])
def test_pairs_of_one_word_are_found(spark, sides, monkeypatch, words, bits):
    monkeypatch.setattr(q, "WORDS", words)
    monkeypatch.setattr(q, "BITS", bits)
    left, right = sides
    of = lambda s: {s[i : i + K] for i in range(len(s or "") - K + 1)}
    near = lambda a, b: min(len(a), len(b)) >= 0.1 * max(len(a), len(b))
    want = sorted((i, j, a, b) for i, a in left for j, b in right if of(a) & of(b) and near(a, b))
    tables = [spark.createDataFrame(rows, "seq_id int, seq string").repartition(2) for rows in sides]
    found = q.related_pairs(*tables, k=K, ratio=0.1)
    assert sorted(tuple(r) for r in found.select("left_id", "right_id", "left", "right").collect()) == want
    # One of four would have been looked at.
    chosen = {i for i, a in left for j, b in right if set(q.word_hashes(a or "", K, 4)) & set(q.word_hashes(b or "", K, 4))}
    assert len({i for i, *_ in want}) == 30 > len(chosen)


def test_bits_of_the_words(spark):
    words = [0, -1, 1 << 62, 5 << 40, -(7 << 50), 5 << 40]
    table = q.bit_table(spark.createDataFrame([(w,) for w in words], "word long").select(F.col("word")))
    places = {(w % (1 << 64)) >> (64 - q.BITS) for w in words}
    assert len(table) * 8 == 1 << q.BITS and {8 * i + k for i in table.nonzero()[0].tolist() for k in range(8) if table[i] >> k & 1} == places


def test_a_side_without_words(spark):
    none = spark.createDataFrame([(1, None), (2, "ACD")], "seq_id int, seq string")
    some = spark.createDataFrame([(1, "ACDEFGHIKLMNPQRSTVWY")], "seq_id int, seq string")
    assert q.related_pairs(some, none).collect() == [] == q.related_pairs(none, some).collect()
