from math import isclose, log

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import crawl, evaluation, expansion, graph, index, learning, scoring, search
from quarry.streaming import increments

DOCS = [(1, "apple banana apple"), (2, "banana cherry"), (3, "cherry cherry date banana apple"), (4, ""), (5, None)]


def corpus(spark):
    return index.tokenised(spark.createDataFrame(DOCS, "doc_id long, text string"))


def asked(spark, *texts):
    return scoring.query_terms(spark.createDataFrame(list(enumerate(texts, 1)), "query_id int, text string"))


def table(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_index(spark):
    c = corpus(spark)
    p = table(index.positions(c), "doc_id", "term")
    assert p[(1, "apple")].tf == 2 and p[(1, "apple")].pos == [1, 3]
    s = table(index.term_statistics(index.frequencies(c)), "term")
    assert (s[("banana",)].df, s[("cherry",)].cf) == (3, 3)
    assert index.corpus_statistics(c).first().asDict() == {"n_docs": 5, "avgdl": 2.0, "total": 10, "vocab": 4}
    ids = table(index.first_seen_ids(index.tokens(c)), "term")
    assert [ids[(w,)].term_id for w in ("apple", "banana", "cherry", "date")] == [1, 2, 3, 4]
    parts = index.merge([index.positions(c.where("doc_id < 3")), index.positions(c.where("doc_id >= 2"))])
    assert table(parts, "doc_id", "term")[(2, "cherry")].tf == 2  # counted in both generations
    back = table(index.decompressed(index.compressed(index.postings(index.positions(c)))), "term")
    assert [(x.doc_id, x.tf) for x in back[("cherry",)].postings] == [(2, 1), (3, 2)]


def test_stored_index(spark, tmp_path, monkeypatch):
    """A stored index scores as the documents do, by literals and by joins; a lookup opens the asked directories only."""
    c, q = corpus(spark), asked(spark, "apple apple date", "banana zebra")
    index.write_index(c, str(tmp_path / "i"), 4)
    stored = index.read_index(spark, str(tmp_path / "i"))
    assert stored.statistics().first().asDict() == index.corpus_statistics(c).first().asDict()
    for literals in (index.LITERALS, 0):
        monkeypatch.setattr(index, "LITERALS", literals)
        for model in scoring.MODELS:
            rows = [{(r.query_id, r.doc_id): round(r.score, 9) for r in scoring.scores(x, q, model).collect()} for x in (c, stored)]
            assert rows[0] == rows[1]
        assert stored.vocabulary().count() == 4 and stored.documents(spark.createDataFrame([(3,), (9,)], "doc_id long")).count() == 1
        assert [r.term for r in expansion.feedback_terms(stored, q, 10, 2).orderBy("query_id", "rank").collect()] == [r.term for r in expansion.feedback_terms(c, q, 10, 2).orderBy("query_id", "rank").collect()]
        assert expansion.significant_terms(stored, q, min_docs=1).exceptAll(expansion.significant_terms(c, q, min_docs=1)).count() == 0
    monkeypatch.setattr(index, "LITERALS", 1000)
    plan = stored.postings(q.where("term = 'date'"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,date)" in plan
    assert index.read_index(spark, str(tmp_path / "i")).buckets == 4
    index.write_index(c.limit(0), str(tmp_path / "e"))
    assert scoring.scores(index.read_index(spark, str(tmp_path / "e")), q, "bm25").count() == 0


def test_crawl(spark):
    links = spark.createDataFrame([("http://a/1", "http://a/2", ""), ("http://a/1", "http://b/3", "War"), ("http://a/2", "http://b/3", ""), ("http://b/3", "http://a/1", ""), ("http://b/3", "http://b/4", "")], "src string, dst string, anchor string")
    seeds = spark.createDataFrame([("http://a/1",), ("http://a/1",)], "url string")
    got = {r.url[7:]: (r.wave, r.in_links, r.priority, r.turn, r.place) for r in crawl.crawl(links, seeds, ["war"], waves=3).collect()}
    assert got == {"a/1": (0, 1, -10001, 1, 1), "b/3": (1, 2, -2, 1, 2), "a/2": (1, 1, 0, 1, 3), "b/4": (2, 1, 1, 1, 4)}
    assert crawl.crawl(links, seeds, [], waves=3, most=2).count() == 2 and crawl.crawl(links, seeds.limit(0), [], waves=2).count() == 0
    rows = spark.createDataFrame([("HTTP://A/1",), ("https://c/9",), (None,)], "url string")
    assert sorted(str(r.url) for r in crawl.unvisited(rows.withColumn("url", F.lower("url")), seeds).collect()) == ["None", "https://c/9"]
    assert [r.x for r in spark.createDataFrame([("http://1234/",), ("http://a1/",), ("x",), (None,)], "u string").select(crawl.has_named_host(F.col("u")).alias("x")).collect()] == [False, True, False, False]
    replies = spark.createDataFrame([(200, "text/html"), (200, None), (404, "text/html"), (None, "text/html"), (200, "text/plain")], "status int, content_type string")
    assert crawl.fetched_html(replies).count() == 1
    docs = spark.createDataFrame([(1, "en"), (2, None)], "doc_id int, lang string")
    assert crawl.in_language(docs).count() == 1
    both = crawl.records(docs, spark.createDataFrame([(1, ["a"], None)], "doc_id int, in_links array<string>, out_links array<string>"), spark.createDataFrame([(2, "h")], "doc_id int, header string"))
    assert [tuple(r) for r in both.orderBy("doc_id").collect()] == [(1, "en", ["a"], [], ""), (2, None, [], [], "h")]


def test_scores(spark):
    c = corpus(spark)
    q = asked(spark, "apple apple date", "zebra")
    n, avgdl = 5, 2.0
    okapi = lambda tf, dl: tf / (tf + 0.5 + 1.5 * dl / avgdl)
    got = table(scoring.scores(c, q, "okapi_tf"), "doc_id")
    assert set(got) == {(1,), (3,)} and isclose(got[(3,)].score, 2 * okapi(1, 5) + okapi(1, 5))
    got = table(scoring.scores(c, q, "tf_idf"), "doc_id")
    assert isclose(got[(1,)].score, 2 * okapi(2, 3) * log(n / 2))
    got = table(scoring.scores(c, q, "lm_laplace"), "doc_id")
    assert isclose(got[(1,)].score, 2 * log(3 / (3 + 4)) - 1000)
    got = table(scoring.scores(c, q, "lm_jelinek_mercer"), "doc_id")
    assert isclose(got[(3,)].score, 2 * log(0.5 / 5 + 0.5 * 3 / 10) + log(0.5 / 5 + 0.5 * 1 / 10))
    all_ = asked(spark, "banana")
    wide = table(scoring.score_table(c, all_), "doc_id")
    one = table(scoring.scores(c, all_, "bm25"), "doc_id")
    assert all(isclose(one[k].score, wide[k].bm25) for k in one)
    ranks = [r.doc_id for r in scoring.ranked(scoring.scores(c, all_, "bm25_default")).orderBy("rank").collect()]
    assert len(ranks) == 3
    assert scoring.rescored(c, all_, "bm25", most=2).count() == 2
    assert scoring.scores(c.limit(0), q, "bm25").count() == 0


def test_proximity(spark):
    c = index.tokenised(spark.createDataFrame([(1, "aa xx bb yy yy yy yy yy bb"), (2, "aa aa"), (3, "bb aa cc")], "doc_id long, text string"))
    q = asked(spark, "aa bb")
    assert {k[0]: round(r.score, 6) for k, r in table(scoring.proximity(c, q), "doc_id").items()} == {1: round(1 / 3, 6), 3: 0.5}
    assert {k[0]: r.score for k, r in table(scoring.nearest_pair(c, q), "doc_id").items()} == {1: 0.5, 2: 0.0, 3: 1.0}


def test_search(spark):
    c = corpus(spark)
    assert [r.doc_id for r in search.phrase(c, ["cherry", "date"]).collect()] == [3]
    assert search.phrase(c, []).count() == 0
    snip = spark.createDataFrame(DOCS, "doc_id long, text string").select("doc_id", search.snippet(F.col("text"), ["Cherry"]).alias("s"))
    assert table(snip, "doc_id")[(2,)].s == "banana <em>cherry</em>" and table(snip, "doc_id")[(1,)].s == ""
    old = spark.createDataFrame([(1, 1, 0), (1, 2, 1)], "query_id int, doc_id int, grade int")
    new = spark.createDataFrame([(1, 1, 2)], "query_id int, doc_id int, grade int")
    assert {k: r.grade for k, r in table(search.assess(old, new), "doc_id").items()} == {(1,): 2, (2,): 1}


def test_expansion(spark):
    c, q = corpus(spark), asked(spark, "apple cherry")
    terms = [r.term for r in expansion.feedback_terms(c, q, 10, 2).orderBy("rank").collect()]
    assert terms[0] == "banana"
    assert expansion.rerun(c, q, expansion.feedback_terms(c, q, 10, 2)).count() == 3
    assert expansion.significant_terms(c, q, min_docs=1).count() >= 0


def test_pagerank(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "b")], "src string, dst string")
    ranks = {r.page: r.rank for r in graph.pagerank(e, tolerance=1e-9).collect()}
    assert isclose(sum(ranks.values()), 1, abs_tol=1e-6)
    want = dict.fromkeys("abcd", 0.25)
    for _ in range(100):
        sink = want["d"]
        give = {"a": want["c"] / 2, "b": want["a"] * 2 / 3, "c": want["a"] / 3 + want["b"], "d": want["c"] / 2}
        want = {p: 0.15 / 4 + 0.85 * sink / 4 + 0.85 * give[p] for p in want}
    assert all(isclose(ranks[p], want[p], abs_tol=1e-6) for p in want)
    assert [r.page for r in graph.sinks(e).collect()] == ["d"]
    assert graph.pagerank(e.limit(0)).count() == 0
    base = graph.base_set(spark.createDataFrame([("a",)], "page string"), e, rounds=1)
    assert {r.page for r in base.collect()} == {"a", "b", "c"}
    h = graph.hits(e, base).collect()
    assert isclose(sum(r.authority**2 for r in h), 1) and isclose(sum(r.hub**2 for r in h), 1)


def test_evaluation(spark):
    run = spark.createDataFrame([(1, "d1", 3.0), (1, "d2", 2.0), (1, "d3", 1.0), (2, "d1", 1.0)], "query_id int, doc_id string, score double")
    rel = spark.createDataFrame([(1, "d1", 1), (1, "d3", 2), (1, "d9", 0)], "query_id int, doc_id string, grade int")
    judged = evaluation.judged_run(run, rel)
    s = table(evaluation.summary(judged, rel), "query_id")
    assert isclose(s[(1,)].average_precision, (1 + 2 / 3) / 3) and isclose(s[(1,)].r_precision, 2 / 3) and s[(2,)].ndcg == 0
    assert isclose(s[(1,)].ndcg, (1 + 3 / 2) / (3 + 1 / log(3, 2)))
    c = evaluation.classic(run, rel).collect()
    assert len(c) == 1 and c[0].num_rel == 3 and isclose(c[0].avg_prec, (1 * 1 / 1 + 2 * 2 / 3) / 3) and isclose(c[0].p_5, 3 / 5) and c[0].ip_10 == 1.0
    assert [r.cutoff for r in evaluation.at_cutoffs(judged, (1, 3, 5)).where("query_id = 1").orderBy("cutoff").collect()] == [1, 3]
    binary = table(evaluation.summary(evaluation.judged_run(run, rel, binary=True), rel), "query_id")
    assert isclose(binary[(1,)].average_precision, (1 + 2 / 3) / 2)


def test_learning(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "label int, predicted int")
    report = table(learning.classification_report(rows), "class")
    assert report[("1",)].precision == 1.0 and report[("1",)].recall == 0.5 and report[("accuracy",)].precision == 0.75
    scores = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 0)], "score double, label int")
    assert learning.roc_auc(scores).first()[0] == (1 + 1 + 0.5 + 1) / 4
    mails = spark.createDataFrame([(1, "free cash free", 1), (2, "hello friend", 0), (3, "cash friend", 1)], "doc_id int, text string, label int").withColumn("tokens", text.unigrams(F.col("text")))
    t = learning.bayes_table(mails)
    assert isclose(t.where("label = 1 AND term = 'free'").first().log_prob, log(3 / (5 + 4)))
    labels = table(learning.bayes_labels(learning.bayes_scores(t, mails)), "doc_id")
    assert labels[(1,)].predicted == 1 and labels[(2,)].predicted == 0
    f = table(learning.word_features(mails, ["free", "cash", "free"], counts=True), "doc_id")
    assert (f[(1,)].f_free, f[(1,)].f_cash) == (2, 1)
    runs = {"a": spark.createDataFrame([(1, "x", 2.0)], "query_id int, doc_id string, score double"), "b": spark.createDataFrame([(1, "y", 3.0)], "query_id int, doc_id string, score double")}
    wide = table(learning.features(runs, spark.createDataFrame([(1, "z", 1)], "query_id int, doc_id string, grade int"), "a"), "doc_id")
    assert set(wide) == {("x",), ("z",)} and wide[("z",)].label == 1 and wide[("x",)].a == 2.0


def test_streamed_index(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    docs.where("doc_id < 3").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        increments.index_increments(increments.document_stream(spark, str(tmp_path / "in"), "doc_id long, text string"), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
        docs.where("doc_id >= 3").write.mode("append").parquet(str(tmp_path / "in")) if _ == 0 else None
    whole = index.positions(index.tokenised(docs))
    merged = increments.merged_index(spark, str(tmp_path / "out"))
    assert merged.exceptAll(whole.select("doc_id", "term", "tf", "pos")).count() == 0 and merged.count() == whole.count()
