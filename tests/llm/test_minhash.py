"""The pipeline's near-duplicate stage against brute force: five-word shingles, Jaccard 0.8 or more."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from quarry.llm import minhash
from tests.llm.brute import SCHEMA, brute_kept, odd_rows


def stage(spark, rows, schema="doc_id long, text string"):
    return corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), "")


@pytest.mark.parametrize("block", [minhash.BLOCK, 3000])
def test_near_copies_and_crowds(spark, monkeypatch, block):
    """The small block cuts both crowds to a dozen blocks and their rest to batches."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, i = [], 0
    for copies, edits in ((1, 2), (3, 4), (150, 3), (150, 6)):  # pairs, chains, two crowds (the second mostly under 0.8)
        for _ in range(20 if copies < 10 else 1):
            text = [word() for _ in range(220)]
            for c in range(copies + 1):
                t = list(text)
                for _ in range(edits if c else 0):
                    t[rng.randrange(len(t))] = word()
                rows.append((i := i + 1, " ".join(t)))
    rng.shuffle(rows)
    assert sorted(r.doc_id for r in stage(spark, rows).collect()) == brute_kept(rows)


def test_generated_and_odd(spark, small):
    source = pd.read_parquet(f"{small}/documents.parquet", columns=["doc_id", "text"])
    rows = [(int(d.doc_id), d.text) for d in source.itertuples()]
    assert sorted(r.doc_id for r in stage(spark, rows).collect()) == brute_kept(rows)
    out = stage(spark, odd_rows(), SCHEMA)
    groups = defaultdict(int)
    for r in out.collect():
        groups[r.doc_id] += 1
    assert groups == {1: 1, 2: 1, 5: 1, 6: 1, 9: 1, None: 1}
    assert stage(spark, [], "doc_id long, text string").count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_forest(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 14, rng.integers(1, 14))) for _ in range(60)]
    near = lambda a, b, s: len(np.intersect1d(a, b)) >= s * len(np.union1d(a, b))
    links = minhash.forest(list(range(60)), sets)
    assert len(links) < 60 and all(near(sets[a], sets[b], 0.8) for a, b in links)
    root = list(range(60))
    for a, b in links:
        root = [root[a] if r == root[b] else r for r in root]
    assert all(root[a] == root[b] for a in range(60) for b in range(60) if near(sets[a], sets[b], 0.8))
