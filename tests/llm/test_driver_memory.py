"""What the pipeline's stages ask of the driver: few jobs for few links, packed word numbers for the toxicity model."""

import random
import tracemalloc

import numpy as np
import pytest

from quarry.llm import components as module
from quarry.llm import toxicity


def linked(n, m, seed):
    rng = random.Random(seed)
    ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(n)]
    chain = list(zip(ids[: n // 4], ids[1 : n // 4]))
    return chain + [tuple(rng.choices(ids[n // 4 :], k=2)) for _ in range(m)] + [(ids[0], ids[0]), (None, ids[0]), (ids[1], None), chain[0][::-1]]


def reached(links):
    near = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for low in sorted(near):
        todo = [] if low in out else [low]
        while todo:
            if (x := todo.pop()) not in out:
                out[x] = low
                todo += near[x]
    return out


@pytest.mark.parametrize("few", [module.FEW, 10])
def test_components(spark, monkeypatch, few):
    """At once and in rounds."""
    monkeypatch.setattr(module, "FEW", few)
    links = linked(400, 180, 1)
    got = module.components(spark.createDataFrame(links, "a long, b long").repartition(5))
    assert sorted((r.node, r.root) for r in got.collect()) == sorted(reached(links).items())
    none = module.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"))
    assert none.columns == ["node", "root"] and none.count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_smallest(seed):
    links = [(a, b) for a, b in linked(3000, 1500, seed) if a is not None and b is not None and a != b]
    nodes, roots = module.smallest(*np.array(links).T)
    assert dict(zip(nodes.tolist(), roots.tolist())) == reached(links)


def test_jobs_for_few_links(spark):
    """A chain takes rounds, of a dozen jobs each, unless its links are followed at once."""
    links = spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long")
    spark.sparkContext.setJobGroup("few-links", "")
    try:
        module.components(links)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-links")) <= 6


def test_training_memory(spark):
    """The driver's Python holds the training words as flat numbers, not as lists of lists."""
    rows = [(i, " ".join(f"{'bad' if i % 2 else 'good'} w{i}." for _ in range(200))) for i in range(1, 2001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    tracemalloc.start()
    try:
        model = toxicity.train(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.weights["bad"] > 0 and peak < 60e6
