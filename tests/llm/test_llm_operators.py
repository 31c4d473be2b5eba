"""Each operator against a brute-force version on small tables, and its odd rows: nulls, empty, long, repeated, clashing columns."""

import gzip
import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from quarry.llm import decontamination, mixing, neighbours, quality, registry, sharding, simhash, substrings, tokens, toxicity, warc
from quarry.llm.common import fresh, held_out, labelled_rows
from quarry.llm.components import components
from tests.llm.brute import LONG, PASSAGE, SCHEMA, WORD, brute_components, brute_fingerprint, odd_rows

@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def table(small, name):
    return pd.read_parquet(f"{small}/{name}.parquet")


def counted(df):
    return Counter(tuple(r) for r in df.collect())


# -- 1 ---------------------------------------------------------------------------------------------------------------------


def brute_coverage(doc, item, k):
    """Longest free common run first, until none of k tokens is left."""
    a, b, used_a, used_b, covered = decontamination.tokens(doc), decontamination.tokens(item), set(), set(), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < k:
            return covered / max(len(b), 1)
        n, i, j = best
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))
        covered += n


@pytest.mark.parametrize("seed", range(6))
def test_tiling(seed):
    rng = np.random.default_rng(seed)
    word = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 12, n))
    item = word(30)
    parts = item.split()
    doc = " ".join([word(10), *parts[15:], word(5), *parts[:15], word(10)])
    found = list(decontamination.Passages([(1, item)], 4).matches(doc))
    assert found and found[0][1] == pytest.approx(brute_coverage(doc, item, 4))
    tiles = found[0][2]
    places = [x for _, p, n in tiles for x in range(p, p + n)]
    assert len(places) == len(set(places))


def test_repeated_words():
    """300,000 equal words against 400 of them, and runs of few words: memory in proportion, coverage as by brute force."""
    same = decontamination.Passages([(1, "a " * 400), (2, "b a a a a c")], 4)
    tracemalloc.start()
    found = {i: (c, t) for i, c, t in same.matches("a " * 300_000, 0.5)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {1: (1.0, [(0, 0, 400)]), 2: (4 / 6, [(0, 1, 4)])} and peak < 500e6
    rng = np.random.default_rng(0)
    for _ in range(30):
        doc, item = (" ".join(rng.choice(["a", "b"], n, p=[0.8, 0.2])) for n in (50, 24))
        got = list(decontamination.Passages([(1, item)], 4).matches(doc))
        assert (got[0][1] if got else 0) == pytest.approx(brute_coverage(doc, item, 4))


def test_op1(spark, tmp_path):
    """The whole query against brute force: reordered, repeated, partial and odd passages."""
    rng = np.random.default_rng(7)
    word = lambda n: [f"t{x}" for x in rng.integers(0, 40, n)]
    items = [word(20) for _ in range(6)] + [["a"] * 9, ["x", "y"]]
    docs = [" ".join([*word(8), *items[i % 8][10:], *word(5), *items[i % 8][:10], *word(8)]) for i in range(16)] + [" ".join([*word(9), *items[2][:9], *word(9)]), "a " * 30, None, "", " ".join(items[7])]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(99, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in decontamination.op1_decontamination(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for i, d in enumerate(docs):
        want = {n: c for n, x in enumerate(items) if len(x) >= 4 and (c := brute_coverage(d, " ".join(x), 4)) >= 0.5}
        assert got[i].item_ids == sorted(want) and got[i].contaminated == bool(want)
        assert got[i].coverage == pytest.approx(max(want.values(), default=0))


def test_contamination(spark, documents, small, odd):
    bench = table(small, "benchmark")
    got = {r.doc_id: set(r.ids) for r in decontamination.contamination(documents, spark.createDataFrame(bench)).select("doc_id", F.col("contamination.item_id").alias("ids")).collect()}
    for d in table(small, "documents").itertuples():
        for b in bench.itertuples():
            if b.text in (d.text or ""):
                assert b.item_id in got[d.doc_id]
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "a b"), (None, PASSAGE)], "item_id long, text string")
    for block in (decontamination.BLOCK_TOKENS, 10):
        rows = decontamination.contamination(odd, items, block_tokens=block).collect()
        assert len(rows) == len(odd_rows()) and {r.doc_id for r in rows if r.contamination} == {6, 7, 8}
    kept = decontamination.decontaminate(odd, items)
    assert kept.columns == odd.columns and counted(kept) == counted(odd.where("doc_id IS NULL OR doc_id NOT IN (6, 7, 8)"))
    assert decontamination.decontaminate(odd, items.limit(0)).count() == len(odd_rows())
    assert decontamination.decontaminate(odd.limit(0), items).count() == 0


# -- 2, 8 --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("op,label,at_least", [(quality.op2_quality, "quality", 0.9), (toxicity.op8_toxicity, "toxic", 0.85)])
def test_classifier(spark, small, op, label, at_least):
    got = op(spark, small).toPandas().merge(table(small, "labels"), on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda x: zlib.crc32(str(x).encode()) % 5 == 0)).all()
    assert got.score.between(0, 1).all()
    assert (got.predicted == got[label])[got.held_out].mean() >= at_least


def slow_discriminant(x, y, shrink, pool):
    """Log-density difference by sums of outer products, inverses and determinants."""
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    low, high, d = x.min(axis=0), x.max(axis=0), x.shape[1]
    z = (x - shift) / scale
    means = [z[y == c].mean(axis=0) for c in (0, 1)]
    covs = [sum(np.outer(r - means[c], r - means[c]) for r in z[y == c]) / (y == c).sum() for c in (0, 1)]
    share = [(y == c).mean() for c in (0, 1)]
    both = share[0] * covs[0] + share[1] * covs[1]
    mixed = [(1 - pool) * s + pool * both for s in covs]
    mixed = [(1 - shrink) * s + shrink * np.trace(s) / d * np.eye(d) for s in mixed]

    def difference(rows):
        out = []
        for r in (np.clip(rows, low, high) - shift) / scale:
            log = [np.log(share[c]) - 0.5 * np.linalg.slogdet(mixed[c])[1] - 0.5 * (r - means[c]) @ np.linalg.inv(mixed[c]) @ (r - means[c]) for c in (0, 1)]
            out.append(log[1] - log[0])
        return np.array(out)

    return difference


def test_quality_by_brute_force(spark, small):
    """op2's scores against a plain discriminant with the shrinkage and the logistic curve of least out-of-fold loss."""
    docs, labels = table(small, "documents"), table(small, "labels")
    rows = docs.merge(labels, on="doc_id").sort_values("doc_id")
    rows = rows[rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 != 0)]
    x, y = np.array([quality.statistics(t) for t in rows.text]), rows.quality.to_numpy()
    fold, best = np.arange(len(y)) % 5, None
    for shrink in (0.01, 0.05, 0.2):
        for pool in (0.0, 0.1, 0.4, 0.8):
            s = np.empty(len(y))
            for f in range(5):
                s[fold == f] = slow_discriminant(x[fold != f], y[fold != f], shrink, pool)(x[fold == f])
            unit = s.std()
            a, w = np.clip(s / unit, -8, 8), np.zeros(2)
            for _ in range(200):  # Newton steps on the ridge-penalised likelihood, with the Hessian in sums
                p = 1 / (1 + np.exp(-(w[0] * a + w[1])))
                v = p * (1 - p)
                aa, ab, bb = (v * a * a).sum() + 1e-3, (v * a).sum(), v.sum() + 1e-3
                ga, gb = ((p - y) * a).sum() + 1e-3 * w[0], (p - y).sum() + 1e-3 * w[1]
                w -= np.array([bb * ga - ab * gb, aa * gb - ab * ga]) / (aa * bb - ab * ab)
            t = np.clip(max(w[0], 0) / unit * s + w[1], -30, 30)
            loss = np.mean(np.logaddexp(0, t) - y * t)
            if best is None or loss < best[0] - 1e-9:
                best = loss, shrink, pool, max(w[0], 0) / unit, w[1]
    t = best[3] * slow_discriminant(x, y, *best[1:3])(np.array([quality.statistics(t) for t in docs.text])) + best[4]
    want = dict(zip(docs.doc_id, 1 / (1 + np.exp(-np.clip(t, -500, 500)))))
    got = {r.doc_id: r.score for r in quality.op2_quality(spark, small).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_noisy_or_by_hand(spark, small):
    """op8's scores from the fitted weights, sentence by sentence."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.op8_toxicity(spark, small).collect()}
    for d in table(small, "documents").itertuples():
        clean = 1.0
        for part in re.findall(r"[^.!?\n]+[.!?]*|[.!?]+", (d.text or "").lower()):
            if part.strip():
                known = {w for w in re.findall(r"[^\W\d_]+", part)}
                known |= {w[:k] + "*" for w in known for k in range(4, 8) if k < len(w)}
                clean *= 1 - 1 / (1 + np.exp(-model.bias - sum(model.weights.get(w, 0.0) for w in known)))
        assert got[d.doc_id] == pytest.approx(1 - clean, abs=1e-9)


def test_noisy_or_fit():
    """The fitted loss is that of a slow optimiser (numeric gradients, many small steps) or less."""
    rng = np.random.default_rng(0)
    bags = [[[int(w) for w in set(rng.integers(0, 6, 2))] for _ in range(rng.integers(1, 4))] for _ in range(60)]
    y = np.array([int(any(0 in s or (1 in s and 2 in s) for s in b)) for b in bags])
    plain = rng.integers(0, 3, 60).tolist()

    def loss(v):
        total = 0.0
        for b, p, label in zip(bags, plain, y):
            z = [v[-1] + sum(v[w] for w in s) for s in b] + [v[-1]] * p
            clean = -sum(np.logaddexp(0, x) for x in z)
            total -= np.log(max(-np.expm1(clean), 1e-300)) if label else clean
        return total / len(y) + 2e-5 * (v[:-1] ** 2).sum() + 4e-5 * abs(v[:-1]).sum()

    bias, w = toxicity.fit(bags, plain, y, 6)
    v = np.append(np.zeros(6), -2.0)
    for t in range(600):
        g = np.array([(loss(v + e) - loss(v - e)) / 2e-5 for e in np.eye(7) * 1e-5])
        v -= 2.0 / (1 + t / 200) * g
    assert loss(np.append(w, bias)) <= loss(v) + 1e-3


def test_classifier_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 1), (5, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for m, train, label in ((quality, quality.train, "quality"), (toxicity, toxicity.train, "toxic")):
        for rows in (labels, labels.limit(0)):
            out = m.scores(odd, train(odd, rows, label))
            assert out.count() == len(odd_rows()) and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    many = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in labelled_rows(many, labels, "quality", 100).collect()] == [(1, "text 0", 1)]
    model = toxicity.NoisyOr(-6.0, {"bad": 12.0})
    assert toxicity.clean(odd, model).count() == len(odd_rows())
    bad = spark.createDataFrame([(1, "fine here. a Bad one! fine")], "doc_id long, text string")
    assert toxicity.clean(bad, model).count() == 0
    spans = toxicity.locate(bad, model).first().offending
    assert [("fine here. a Bad one! fine"[s.start : s.end]).strip() for s in spans] == ["a Bad one!"]


def test_fold(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 7, 123456789012)] + [(None,)], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


# -- 3 ---------------------------------------------------------------------------------------------------------------------


def test_warc(spark, small, tmp_path):
    long = "é" * 600
    pages = spark.createDataFrame([(1, "http://a", long), (2, "http://b", long), (3, None, long), (4, "http://a\r\nX: 1", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 90), (None, "u", "x" * 1000), (8, "u", "x" * 1000)], "page_id long, url string, html string")
    warc.write(warc.records(pages), str(tmp_path / "w"))
    got = {r.headers.get("x-record-key"): r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert len(got) == 9 and {k for k, r in got.items() if r.record_type == "revisit"} == {"1", "2"}
    assert got["2"].headers["x-refers-to-key"] == "3" and bytes(got["2"].payload) == b"" and bytes(got["3"].payload).decode() == long
    assert bytes(got["7"].payload).decode() == "\r\n\r\nWARC/1.1\r\n" * 90
    reader = warc.WarcReader([(str(f), 1) for f in (tmp_path / "w").glob("*.txt")], ["record_type", "payload"], 1 << 20)
    asked = [EqualTo(("record_type",), "revisit"), EqualTo(("payload_digest",), "sha1:x"), In(("target_uri",), ("http://a", "http://b"))]
    assert list(reader.pushFilters(asked)) == asked[1:2] and reader.wanted == {"warc-type": {"revisit"}, "warc-target-uri": {"http://a", "http://b"}}
    assert sorted(x for part in reader.partitions() for x in reader.read(part)) == [("revisit", b""), ("revisit", b"")]  # decided on headers
    only = warc.read(spark, str(tmp_path / "w"), ["record_type", "target_uri"]).where("record_type = 'revisit'")
    assert only.count() == 2 and "EqualTo" not in only._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    (tmp_path / "z").mkdir()
    for i, f in enumerate((tmp_path / "w").glob("*.txt")):  # a member a record, as archives have it, and one member for a file
        b = f.read_bytes()
        starts = [x.start() for x in re.finditer(rb"WARC/1.1\r\nWARC-Type", b)] + [len(b)]
        parts = [b] if i % 2 else [b[x:y] for x, y in zip(starts, starts[1:])]
        (tmp_path / "z" / f"{i}.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    plain, zipped = (counted(warc.read(spark, str(tmp_path / x)).select("record_id", "record_type", "payload")) for x in "wz")
    assert zipped == plain and warc.read(spark, str(tmp_path / "z"), ["record_type"]).where("record_type = 'revisit'").count() == 2
    warc.write(warc.records(pages.limit(0)), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_op3(spark, small, tmp_path):
    """The whole query, type and reference included, against brute force on the small table and on repeated payloads."""
    html = ["x" * 1000, "y" * 999, None, "é" * 500, "é" * 499, ""]
    made = pd.DataFrame([(i, "http://a", html[i % 6]) for i in range(30)], columns=["page_id", "url", "html"])
    spark.createDataFrame(made.astype(object).where(made.notna(), None).values.tolist(), "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for folder, src in ((small, table(small, "pages")), (str(tmp_path), made)):
        body = {r.page_id: (r.html or "").encode() for r in src.itertuples()}
        holder = defaultdict(int)
        for i, b in body.items():
            holder[b] = max(holder[b], i)
        want = {}
        for i, b in body.items():
            revisit = len(b) >= 1000 and holder[b] != i
            want[i] = (len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", holder[b] if revisit else None)
        rows = warc.op3_warc(spark, folder).collect()
        assert len(rows) == len(want) and {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == want


# -- 4 ---------------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, odd):
    got = simhash.fingerprints(odd.where("doc_id IS NOT NULL")).select("doc_id", "text", "fingerprint").collect()
    assert all(r.fingerprint % 2**64 == brute_fingerprint(r.text) for r in got)


def test_links(spark):
    rng = np.random.default_rng(3)
    seeds = [int(x) for x in rng.integers(0, 2**63, 30, dtype=np.uint64)]
    values = set(seeds)
    for s in seeds[:6]:
        for _ in range(60):  # crowded blocks, chains
            values.add(s ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
    values = sorted(values)
    prints = spark.createDataFrame([(simhash._signed(v),) for v in values], "fingerprint long")
    roots = {r.node: r.root for r in components(simhash.links(prints)).collect()}
    want = brute_components({simhash._signed(v): v for v in values})
    groups, expected = defaultdict(set), defaultdict(set)
    for v, r in want.items():
        expected[r].add(v)
        groups[roots.get(v, v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def kept_ids(frame):
    """The smallest doc_id (null: -1, if there is no other) of each group of fingerprints."""
    prints, out = {}, defaultdict(list)
    for r in frame.collect():
        prints.setdefault(brute_fingerprint(r.text), []).append(r.doc_id)
    for f, root in brute_components({f: f for f in prints}).items():
        out[root] += prints[f]
    return [min((x for x in ids if x is not None), default=-1) for ids in out.values()]


def test_deduplicate(spark, odd, documents, small):
    source = table(small, "documents")
    prints = {d.doc_id: brute_fingerprint(d.text) for d in source.itertuples()}
    want = brute_components(prints)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents).collect()}
    assert got == want
    kept = simhash.deduplicate(documents)
    assert kept.columns == documents.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    few = simhash.deduplicate(odd)
    ids = [r.doc_id for r in few.collect()]
    assert few.columns == odd.columns and sorted(-1 if x is None else x for x in ids) == sorted(kept_ids(odd))
    assert simhash.near_duplicates(odd).count() == len(odd_rows())
    assert simhash.deduplicate(odd.limit(0)).count() == 0


# -- 5 ---------------------------------------------------------------------------------------------------------------------


def exact_neighbours(ids, vectors, q, k=10):
    """Ids and distances of the k nearest of one id, ties to smaller ids."""
    d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
    d[ids == q] = np.inf
    order = np.lexsort((ids, d))[:k]
    return ids[order], d


def test_neighbours(spark):
    """Production parameters on more vectors than centroids, without clusters: recall and the share that is read."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    read = []
    walk_length = neighbours.walk_length
    neighbours.walk_length = lambda *a: read.append(walk_length(*a)) or read[-1]
    try:
        got = neighbours.search(frame, frame.where("vec_id % 100 = 0")).toPandas()
    finally:
        neighbours.walk_length = walk_length
    ids, hits = np.arange(8000), 0
    for q in range(0, 8000, 100):
        want, d = exact_neighbours(ids, x, q)
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and own.vec_id.is_unique
        assert np.allclose(own.score, d[own.vec_id], rtol=0, atol=1e-12)
        hits += len(set(want) & set(own.vec_id))
    assert hits / 800 >= 0.9 and read[0] < 0.25 * 8000


def test_neighbours_odd_rows(spark, monkeypatch):
    """Blocks and batches of a few rows; unusable vectors, copies of one vector, ids with several vectors, few candidates."""
    monkeypatch.setattr(neighbours, "LIST_ROWS", 64)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 8)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0]), (3004, x[5].tolist()), (5, x[5].tolist()), (None, x[0].tolist()), (7, x[8].tolist()), (100, x[9].tolist())]
    x[7], x[100] = min(x[7].tolist(), x[8].tolist()), min(x[100].tolist(), x[9].tolist())
    rows += [(4000 + i, x[20].tolist()) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(frame, frame.where("vec_id % 20 = 0"), n_centroids=64).toPandas()
    ids = np.array([*range(1500), 3004, *range(4000, 4030)])
    vectors, hits = np.vstack([x, x[5], *[x[20]] * 30]), 0
    asked = [int(i) for i in ids if i % 20 == 0]
    assert set(got.query_id) == set(asked)
    for q in asked:
        want, d = exact_neighbours(ids, vectors, q)
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and own.vec_id.is_unique
        assert np.allclose(own.score, [d[ids.tolist().index(v)] for v in own.vec_id], rtol=0, atol=1e-12)
        hits += len(set(want) & set(own.vec_id))
    assert hits / (10 * len(asked)) >= 0.9
    assert neighbours.search(frame.limit(0), frame).count() == 0
    few = neighbours.search(frame.where("vec_id < 4"), frame.where("vec_id < 4"))
    assert few.count() == 12
    same = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [4.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in neighbours.search(same, same.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1.0), (2, 3.0)]


# -- 6 ---------------------------------------------------------------------------------------------------------------------


def brute_removed(rows):
    """rows: (doc_id, text) -> multiset of (doc_id, n_words, n_removed, sha256)."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    n = Counter(tuple(w[k : k + 35]) for _, w in words for k in range(len(w) - 34))
    out = Counter()
    for i, w in words:
        gone = np.zeros(len(w), dtype=bool)
        for k in range(len(w) - 34):
            if n[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = True
        out[(i, len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("shard_bytes", [substrings.SHARD_BYTES, 20_000])
def test_passages(spark, odd, documents, small, shard_bytes):
    pick = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    loop = spark.createDataFrame([(20, "a b " * 40), (21, PASSAGE), (22, " ".join(PASSAGE.split()[:34])), (23, PASSAGE.replace(" ", " "))], "doc_id long, text string")
    for frame in (odd.select("doc_id", "text").unionByName(loop), documents.select("doc_id", "text")):
        rows = [tuple(r) for r in frame.collect()]
        assert counted(substrings.repeated_passages(frame, shard_bytes=shard_bytes).select(pick)) == brute_removed(rows)
    assert substrings.repeated_passages(odd.limit(0)).count() == 0


def test_passage_everywhere(spark, tmp_path):
    """One passage in a text of every shard, and one row many times over: op6 itself and its operator, by small shards."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join([*(f"u{x}" for x in rng.integers(0, 9**9, 30)), *PASSAGE.split(), f"v{i}"])) for i in range(60)] + [(77, "again " + " ".join(f"r{x}" for x in range(50)))] * 40
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    pick = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = brute_removed(rows)
    assert counted(substrings.op6_substrings(spark, str(tmp_path))) == want
    assert counted(substrings.repeated_passages(docs, shard_bytes=700, spread=F.col("_metadata.row_index")).select(pick)) == want


def test_windows_by_two_hashes():
    """Windows that agree in one of the two hashes only are told apart."""
    both = lambda pairs: (np.array([a for a, _ in pairs], dtype=np.uint64), np.array([b for _, b in pairs], dtype=np.uint32))
    known, count = substrings._distinct(*both([(5, 3), (5, 1), (5, 1), (7, 1)]))
    assert [x.tolist() for x in known] == [[5, 5, 7], [1, 3, 1]] and count.tolist() == [2, 1, 1]
    asked = both([(5, 1), (5, 2), (5, 3), (7, 1), (7, 3), (9, 1), (0, 0)])
    assert substrings._among(*asked, known).tolist() == [True, False, True, True, False, False, False]


# -- 7 ---------------------------------------------------------------------------------------------------------------------


def all_pieces():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.VOCABULARY)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def test_token_counts(spark, odd, documents):
    """Against a unigram model that has the special pieces (for its byte fallback), on texts that do not spell them."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    exact = Tokenizer(models.Unigram(all_pieces(), unk_id=0, byte_fallback=True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    extra = spark.createDataFrame([(30, "  two  spaces "), (31, "日本語 \U0001f600 \x00 ▁mark aaaaaaaaaaaaaaaaaa"), (32, "\n\n\tx")], "doc_id long, text string")
    for frame in (odd.select("doc_id", "text").unionByName(extra), documents.select("doc_id", "text")):
        for r in tokens.token_counts(frame, tokens.read_vocabulary()).collect():
            assert r.n_tokens == (len(exact.encode(r.text, add_special_tokens=False).ids) if r.text else 0)


def test_special_pieces():
    """A text that spells a control, unknown or byte piece is characters, as in a unigram model without those pieces."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = tokens.read_vocabulary()
    assert len(vocabulary) < len(all_pieces()) and not {"<s>", "</s>", "<unk>", "<0x41>"} & {p for p, _ in vocabulary}
    plain = Tokenizer(models.Unigram([("\uffff\uffffunknown", min(s for _, s in vocabulary)), *vocabulary], unk_id=0))
    plain.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    counter = tokens.Counter(vocabulary)
    for text in ("x</s>", "x<unk>", "x<0x41>", "<s> a <s>", "the <0xE2> mark"):
        assert counter.text(text) == len(plain.encode(text, add_special_tokens=False).ids) > 2


# -- 9 ---------------------------------------------------------------------------------------------------------------------


def test_mixing(spark, odd, small):
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = sql.execute(mixing.ORACLE_SQL["op9_mixing"]).df().sort_values("doc_id").reset_index(drop=True)
    got = mixing.op9_mixing(spark, small).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], check_dtype=False)
    total = got["size"].sum()
    per = got.assign(source=got.doc_id.map(table(small, "documents").set_index("doc_id").source)).groupby("source", dropna=False)
    assert per.target.first().sum() == pytest.approx(total) and (got.taken <= 3 * got["size"]).all()
    taken = mixing.copies(odd)
    assert taken.count() == len(odd_rows()) and taken.where("__copies IS NULL").count() == 0
    names = ["__size", "__class", "__bucket", "__place", "__start", "__source", "size", "class", "bucket", "tie", "place", "start", "target", "copies"]
    wide = odd.select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    mixed = mixing.mix(wide)
    assert mixed.columns == wide.columns and counted(mixed) == counted(mixing.mix(wide)) and mixed.where("class <> 'own class' OR __place <> 'own __place'").count() == 0
    assert {c: n for c, n in mixing.copies(wide).dtypes}["__size"] == "bigint" and mixing.copies(wide).where("place <> 'own place'").count() == 0
    ties = spark.createDataFrame([(1, "s", t) for t in "abcdefgh"] * 3 + [(None, "s", t) for t in "ab"], "doc_id long, source string, text string")
    assert counted(mixing.mix(ties)) == counted(mixing.mix(ties.orderBy(F.desc("text")).repartition(3)))
    assert mixing.mix(odd.limit(0)).count() == 0


# -- 10 --------------------------------------------------------------------------------------------------------------------


def test_sharding(spark, odd, tmp_path):
    wide = odd.withColumn("__run", F.lit("x")).withColumn("__shard", F.lit("y")).withColumn("file", F.lit("z")).withColumn("bytes", F.lit(1))
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=2_000_000)
    for i in range(4):
        store.append(wide.where(F.coalesce("doc_id", F.lit(0)) % 4 == i), f"a{i}")
    assert store.compact(wide.schema) > 4
    assert counted(store.documents(wide.schema)) == counted(wide)
    assert counted(store.documents(wide.schema, 4)) == counted(wide)  # older versions stay readable
    assert store.manifest().agg(F.sum("rows")).first()[0] == len(odd_rows())
    assert sharding.assignments(store, wide).count() == len(odd_rows())
    before = store.version()
    store.append(wide.limit(0), "none")
    assert store.version() == before + 1 and counted(store.documents(wide.schema)) == counted(wide)
    store.vacuum()
    assert store.versions() == [before + 1] and counted(store.documents(wide.schema)) == counted(wide)
    assert sharding.shard(wide.limit(0), str(tmp_path / "e")).documents(wide.schema).count() == 0


def test_two_writers(spark, odd, tmp_path, monkeypatch):
    """Both read version 1; the first to commit version 2 wins, the other gets an error and can append anew."""
    one, two = (sharding.ShardStore(spark, str(tmp_path / "s")) for _ in range(2))
    one.append(odd, "first")
    late, commit = odd.where("doc_id = 1"), sharding.ShardStore._commit

    def overtaken(self, *args):
        if self is two and self.version() == 1:
            one.append(odd.where("doc_id = 2"), "quick")
        commit(self, *args)

    monkeypatch.setattr(sharding.ShardStore, "_commit", overtaken)
    with pytest.raises(RuntimeError, match="another writer"):
        two.append(late, "late")
    assert one.version() == 2 and one.documents(odd.schema).count() == len(odd_rows()) + 1
    two.append(late, "late")
    assert counted(one.documents(odd.schema)) == counted(odd.unionByName(odd.where("doc_id <= 2")))


def test_lost_before_commit(spark, odd, tmp_path, monkeypatch):
    store, commit = sharding.ShardStore(spark, str(tmp_path / "s")), sharding.ShardStore._commit
    monkeypatch.setattr(sharding.ShardStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.append(odd, "a")
    monkeypatch.setattr(sharding.ShardStore, "_commit", commit)
    assert store.version() == 0 and store.append(odd, "a") == 1
    assert counted(store.documents(odd.schema)) == counted(odd)
    store.vacuum()
    assert len(list((tmp_path / "s" / "data").iterdir())) == 1


def test_shards_agree(spark, small, tmp_path):
    """Two runs give the same shards; no shard is far over the target."""
    docs = spark.read.parquet(f"{small}/documents.parquet").repartitionByRange(9, "doc_id")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = [counted(sharding.assignments(sharding.shard(docs, target_bytes=150_000), docs)) for _ in range(2)]
    assert got[0] == got[1] and len({r[0] for r in got[0]}) > 1


def test_compaction_sizes(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=50_000, fan_in=4)
    for i in range(8):
        store.append(rows.where(F.col("doc_id") % 8 == i).coalesce(1), f"a{i}")
    assert store.manifest().count() == 8
    store.compact(rows.schema)
    sizes = [r.bytes for r in store.manifest().collect()]
    assert sum(sizes) == 200_000 and len(sizes) <= 5 and counted(store.documents(rows.schema)) == counted(rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, small, name):
    sql = duckdb.connect()
    for t in ("documents", "pages"):
        sql.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = sql.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert counted(registry.QUERIES[name](spark, small).select(columns)) == Counter(want.fetchall())


def test_fresh(odd):
    assert fresh(odd, "SCORE") == "SCORE_" and fresh(odd, "free") == "free"
