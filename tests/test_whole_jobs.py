"""Operators on whole inputs: nothing that grows is bounded."""

from collections import Counter
from hashlib import sha256
from math import isclose, sqrt

from pyspark.sql import functions as F

from quarry.operators import graph, index, learning
from quarry.plans import queries
from quarry.sources import readers
from quarry.streaming import increments


def test_vectoriser_keeps_all_words(spark):
    """More distinct words than 1 << 18, each in one mail only."""
    train = spark.range(300).select(F.transform(F.sequence(F.lit(0), F.lit(899)), lambda i: F.concat_ws("x", F.col("id").cast("string"), i.cast("string"))).alias("tokens"))
    assert len(learning.vectoriser(train).vocabulary) == 270_000
    assert len(learning.vectoriser(train, 10).vocabulary) == 10


def test_whole_base_and_hits(spark, tmp_path):
    """Roots of any id, three rounds, 200 links each way; page 5000 has 230 out-links, of which 200 are followed."""
    orders = [(5000, 300 + i, 50) for i in range(230)] + [(310, 9001, 1), (9001, 9002, 1), (9002, 9003, 1), (7, 8, 48)]
    lines = [(n, k, part, q) for n, (src, dst, q) in enumerate(orders) for k, part in ((1, src), (2, dst))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity int").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = Counter((s, t) for s, t, _ in orders)
    base = {s for s, _, q in orders if q >= 49}
    for _ in range(3):
        near = set()
        for page in base:
            for way in (0, 1):
                others = sorted({e[1 - way] for e in edges if e[way] == page}, key=lambda x: (sha256(str(x).encode()).hexdigest(), x))
                near |= set(others[:200])
        base |= near
    got = {r.page for r in queries.QUERIES["base_set"](spark, str(tmp_path)).collect()}
    assert got == base and 201 <= len(base) < 235
    inside, hub = {e: w for e, w in edges.items() if e[0] in base and e[1] in base}, dict.fromkeys(base, 1.0)
    for _ in range(11):
        auth = {p: sum(w * hub[s] for (s, t), w in inside.items() if t == p) for p in base}
        norm = sqrt(sum(x * x for x in auth.values()))
        auth = {p: x / norm for p, x in auth.items()}
        hub = {p: sum(w * auth[t] for (s, t), w in inside.items() if s == p) for p in base}
        norm = sqrt(sum(x * x for x in hub.values()))
        hub = {p: x / norm for p, x in hub.items()}
    rows = {r.page: r for r in queries.QUERIES["hits_k11"](spark, str(tmp_path)).collect()}
    assert set(rows) == base and all(isclose(rows[p].authority, auth[p], abs_tol=1e-7) and isclose(rows[p].hub, hub[p], abs_tol=1e-7) for p in base)


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_documents_are_counted_without_a_shuffle(spark):
    """Postings come from a document's own row; documents that repeat an id are joined as one, null ids too."""
    once = index.tokenised(spark.createDataFrame([(1, "b a b"), (2, "a"), (3, None), (None, "c")], "doc_id long, text string"))
    assert _exchanges(index.positions(once)) == _exchanges(index.frequencies(once)) == _exchanges(index.Index(once).postings()) == 0
    assert {(r.doc_id, r.term, r.tf, tuple(r.pos)) for r in index.positions(once).collect()} == {(1, "a", 1, (2,)), (1, "b", 2, (1, 3)), (2, "a", 1, (1,)), (None, "c", 1, (1,))}
    again = index.tokenised(spark.createDataFrame([(1, "b a b"), (1, "b c"), (2, "a"), (None, "d d"), (None, "d e")], "doc_id long, text string"))
    want = {(1, "a", 1, (2,)), (1, "b", 3, (1, 1, 3)), (1, "c", 1, (2,)), (2, "a", 1, (1,)), (None, "d", 3, (1, 1, 2)), (None, "e", 1, (2,))}
    assert {(r.doc_id, r.term, r.tf, tuple(r.pos)) for r in index.positions(again).collect()} == want
    assert {(r.doc_id, r.term, r.tf) for r in index.frequencies(again).collect()} == {w[:3] for w in want}
    own = {(r.doc_id, r.dl, r.term, r.tf, tuple(r.pos)) for r in index.Index(again).postings().collect()}
    assert {(1, 3, "b", 2, (1, 3)), (1, 2, "b", 1, (1,)), (None, 2, "d", 3, (1, 1, 2))} <= own and len(own) == 7


def test_lists_are_shuffled_once(spark):
    c = index.tokenised(spark.createDataFrame([(2, "b a b"), (1, "a")], "doc_id long, text string"))
    assert _exchanges(index.postings(index.frequencies(c))) == _exchanges(index.postings(index.positions(c))) == 1
    got = {r.term: (r.df, r.cf, [tuple(p) for p in r.postings]) for r in index.postings(index.frequencies(c)).collect()}
    assert got == {"a": (2, 2, [(1, 1), (2, 1)]), "b": (1, 2, [(2, 2)])}
    assert {r.term: [p.doc_id for p in r.postings] for r in index.postings(index.positions(c), ranges=True).collect()} == {"a": [1, 2], "b": [2]}


def test_parts_of_an_index_are_written_when_asked_for(spark, tmp_path):
    c = index.tokenised(spark.createDataFrame([(1, "b a b"), (2, "a")], "doc_id long, text string"))
    there = lambda: {p.name for p in (tmp_path / "i").iterdir()}
    whole = index.grown_index(c, str(tmp_path / "i"), 4)
    assert whole.forward.count() == 2 and whole.statistics(False).first().total == 4 and there() == {"forward"}
    assert {tuple(r) for r in whole.vocabulary().collect()} == {("a", 2, 2), ("b", 1, 2)} and there() == {"forward", "vocabulary"}
    assert whole.statistics().first().vocab == 2 and "postings" not in there()
    assert {(r.doc_id, r.dl, r.term, r.tf) for r in whole.postings().collect()} == {(1, 3, "a", 1), (1, 3, "b", 2), (2, 1, "a", 1)}
    assert index.read_index(spark, str(tmp_path / "i")).postings(c.select(F.lit("b").alias("term"))).count() == 1


def test_long_lines_and_long_documents(spark, tmp_path):
    """A class of 40,000 words and a document of 60,000 different ones: neither costs the square of its length."""
    words = [f"w{i}" for i in range(40_000)]
    (tmp_path / "stems").write_text("root | " + " ".join(words) + "\nno class\n")
    rows = readers.stem_classes(spark, str(tmp_path / "stems"))
    assert "split(value" not in str(rows._jdf.queryExecution().optimizedPlan()).split("Generate")[0]
    assert {tuple(r) for r in rows.collect()} == {(w, "root") for w in words}
    text = " ".join(f"x{i}" for i in range(60_000)) + " x5 x5"
    spark.createDataFrame([(1, text), (2, "x5")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    path = str(tmp_path / "out")
    stream = increments.statistics_stream(increments.document_stream(spark, f"{tmp_path}/in", "doc_id long, text string"))
    stream.writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(path)).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    got = {r.term: (r.df, r.cf) for r in spark.read.parquet(path).collect()}
    assert len(got) == 60_000 and got["x5"] == (2, 4) and got["x6"] == (1, 1)


def test_text_ids_stay_out_of_pagerank(spark, monkeypatch):
    """Ranks of text ids equal those of numbers; ids whose hashes are equal keep their texts."""
    pairs = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1), (4, 3), (3, 5), (6, None)], "src long, dst long")
    texts = pairs.select(F.concat(F.lit("p"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("dst").cast("string")).alias("dst"))
    ranks = lambda e: {str(r.page).lstrip("p"): round(r.rank, 12) for r in graph.pagerank(e, iterations=4, tolerance=None).collect()}
    assert graph._names(texts).count() == 7 and graph._names(pairs) is None
    want = ranks(pairs)
    assert ranks(texts) == want and len(want) == 5
    monkeypatch.setattr(graph, "_key", lambda c: F.length(c).cast("long"))
    assert graph._names(texts) is None and ranks(texts) == want


def test_saved_vectors_stay_sparse(spark, tmp_path):
    """A vocabulary of 200,000 words: arrays of that length for 400 mails would be 640 MB."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(500)) + " same same", 0) for i in range(400)] + [(400, "", 1)]
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = queries.QUERIES["saved_vectors"](spark, str(tmp_path))
    assert "unwrap_udt" in str(df._jdf.queryExecution().optimizedPlan()) and "UDF(" not in str(df._jdf.queryExecution().optimizedPlan())
    got = {r.doc_id: (r.words, r.total) for r in df.collect()}
    assert len(got) == 400 and set(got.values()) <= {(501, 502.0), (1, 2.0)}
