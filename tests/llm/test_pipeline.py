"""Each stage of the pipeline, on what the one before kept, against a plain version."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from orbitframe.llm import mixing, toxicity
from tests.llm.test_operators import line_reference, shingles, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_are_named_and_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "packing"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_toxic_documents_go(spark, stages):
    chain = toxicity.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    rows = stages[0].collect()
    p = np.round(chain.probabilities(toxicity.count_rows([r.text for r in rows], chain.vocabulary)), 6)[:, chain.names.index("toxic")]
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r, x in zip(rows, p, strict=True) if x < chain.threshold}


def test_repeated_lines_go(stages):
    expected = line_reference([(r.doc_id, r.text) for r in stages[1].collect()])
    found = Counter((r.doc_id, r.text) for r in stages[2].collect())
    assert found == Counter({(k, t): n for (k, lines, dropped, t), n in expected.items() if dropped < lines})
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_one_of_each_near_duplicate_class_stays(stages):
    rows = {r.doc_id: shingles(r.text) for r in stages[2].collect()}
    parent = {k: k for k in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(rows)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if rows[a] and len(rows[a] & rows[b]) >= 0.8 * len(rows[a] | rows[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {r.doc_id for r in stages[3].collect()} == {k for k in keys if root(k) == k}


def test_mix_meets_the_targets(stages):
    sizes, taken, texts = defaultdict(int), defaultdict(int), {}
    for r in stages[3].collect():
        sizes[r.source] += len(words(r.text))
        texts[r.doc_id] = Counter(words(r.text))
    for r in stages[4].collect():
        taken[r.source] += len(words(r.text))
        assert not Counter(words(r.text)) - texts[r.doc_id]
    names = sorted(sizes)
    for s, t in zip(names, mixing.targets([float(sizes[s]) for s in names]), strict=True):
        assert abs(taken[s] - t) <= 1


def test_batches_hold_the_mix(spark, stages):
    rows = stages[5].collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((r.doc_id, len(words(r.text))) for r in stages[4].collect())
    batches = Counter((r.batch_id, r.bucket_length) for r in rows)
    assert all(n * length <= 65_536 or n == 1 for (_, length), n in batches.items())


def test_run_is_the_stages(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, stages[5].collect()))
