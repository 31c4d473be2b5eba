"""The SimHash of the pipeline's near-duplicate stage: wide fingerprints, blocks, verified links."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import minhash, simhash
from quarry.llm.components import components
from tests.llm.brute import brute_kept

PAIR = "doc_id long, text string"


def edited(rng, sizes, count):
    """Pairs of different texts whose five-word similarity is 0.8 or barely more, one edit at the end or some inside."""
    rows, i = [], 0
    while len(rows) < 2 * count:
        a = [f"w{rng.randrange(50_000)}" for _ in range(rng.choice(sizes))]
        b = list(a)
        if rng.random() < 0.5:
            del b[len(b) - len(a) // 6 :]
        else:
            for _ in range(max(1, len(a) // 48)):
                b[rng.randrange(len(b))] = "other"
        x, y = ({tuple(t[j : j + 5]) for j in range(max(1, len(t) - 4))} for t in (a, b))
        if 0.8 <= len(x & y) / len(x | y) < 0.84:
            rows += [(i := i + 1, " ".join(a)), (i := i + 1, " ".join(b))]
    return rows


def near(words, sizes):
    apart = np.bitwise_count(words[:, None] ^ words).sum(axis=2, dtype=int)
    first = np.bitwise_count(words[:, None, 0] ^ words[:, 0])
    return (apart <= 120) & (first <= 24) & (np.minimum(sizes[:, None], sizes) >= 0.8 * np.maximum(sizes[:, None], sizes))


def grouped(n, links):
    root = list(range(n))
    for a, b in links:
        a, b = sorted((root[a], root[b]))
        root = [a if r == b else r for r in root]
    return root


def family_prints(rng):
    words = [np.frombuffer(rng.bytes(64), dtype=np.uint64) for _ in range(40)]
    for w, flips, size in zip(list(words), (30, 60, 90, 110, 122), (40, 30, 30, 30, 20)):
        for _ in range(size):
            bits = np.unpackbits(w.view(np.uint8))
            bits[rng.choice(512, flips, replace=False)] ^= 1
            words.append(np.packbits(bits).view(np.uint64))
    words = np.array(words)[rng.permutation(len(words))]
    return words, rng.integers(80, 130, len(words))


def test_fingerprint():
    rng = np.random.default_rng(1)
    for n in (1, 2, 255, 256, 257, 700):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        votes = [0] * 512
        for x in h.tolist():
            for i, m in enumerate(simhash._MULTIPLY.tolist()):
                y = x * m % 2**64
                y = (y ^ (y >> 32)) * 0x9E3779B97F4A7C15 % 2**64
                for j, byte in enumerate((y ^ (y >> 29)).to_bytes(8, "little")):
                    votes[8 * i + j] += byte
        want = sum(1 << i for i, v in enumerate(votes) if 2 * v > 255 * n)
        assert int.from_bytes(simhash.wide_fingerprint(h), "little") == want


@pytest.mark.parametrize("seed", range(5))
def test_tree(seed):
    words, sizes = family_prints(np.random.default_rng(seed))
    ok, links = near(words, sizes), simhash.tree(words, sizes, 0.8)
    assert all(ok[a, b] for a, b in links)
    assert grouped(len(words), links) == grouped(len(words), [(a, b) for a, b in zip(*np.nonzero(ok)) if a < b])


def test_crowded_values(spark, monkeypatch):
    """One block for all, dealt to parts of about 20: every two parts meet."""
    monkeypatch.setattr(simhash, "PART", 20)
    words, sizes = family_prints(np.random.default_rng(9))
    prints = spark.createDataFrame([(i, int(n), bytearray(w.tobytes())) for i, (w, n) in enumerate(zip(words, sizes))], "id long, n int, print binary")
    roots = {r.node: r.root for r in components(simhash.wide_links(prints, 0.8)).collect()}
    want = grouped(len(words), [(a, b) for a, b in zip(*np.nonzero(near(words, sizes))) if a < b])
    assert [roots.get(i, i) for i in range(len(words))] == want


def test_pairs_at_the_threshold(spark, monkeypatch):
    """Blocks as on a table of 64 times as many texts as a value gathers; pairs of 0.8 to 0.84, the hardest there are."""
    rng = random.Random(8)
    rows = edited(rng, [8, 12, 20, 50, 100, 200, 400], 400)
    monkeypatch.setattr(simhash, "GATHER", len(rows) / 64)
    assert len(simhash.wide_blocks(len(rows))) > 20
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, PAIR), "")
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows) == [i for i, _ in rows[::2]]


def test_blocks_of_shared_bits():
    """More bits than there are: pairs at the threshold, some with many differing bits, are lost no oftener."""
    blocks, rng = simhash.wide_blocks(15_000_000), np.random.default_rng(4)
    assert sum(map(len, blocks)) > 512 and all(len(set(b)) >= len(b) - 1 for b in blocks)
    differ = rng.random((60_000, 512)) < 1 - simhash.WIDE_AGREE
    agree = np.zeros(len(differ), dtype=bool)
    for b in blocks:
        agree |= ~differ[:, b].any(axis=1)
    assert (~agree).sum() <= 9


def test_only_linked_fingerprints_are_compared(spark, monkeypatch):
    """Without links of fingerprints only texts of the same words are one: nothing else gives candidates."""
    rows = edited(random.Random(3), [100], 5) + [(98, "the same  words"), (99, "The same words")]
    monkeypatch.setattr(minhash, "wide_links", lambda prints, similarity: prints.selectExpr("id AS a", "id AS b").limit(0))
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, PAIR), "")
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in rows[:-1]]
