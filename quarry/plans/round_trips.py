"""Queries that write whole tables in the toolkit's file formats and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import graph, index, learning, scoring
from quarry.operators.lineage import new_folder
from quarry.plans.inputs import SQL_EDGES, SQL_JUDGEMENTS, SQL_MAILS, corpus, edges, indexed, judgements, mails, pages, sql_tokens, table, terms
from quarry.plans.queries import _BEST, _TEXT, _TITLE, query, urls
from quarry.sources import readers, writers
from quarry.streaming import increments

_DOC = sql_tokens()
_SPACED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def _spaced(name: str = "text"):
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def _news(spark, d, blocks):
    path = new_folder(spark, "news")
    writers.write_news(table(spark, d, "documents"), path, ["lang", "text"])
    rows = readers.documents(spark, path, encoding="UTF-8", blocks=blocks)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), _spaced().alias("text"))


@query(f"SELECT doc_id, {_SPACED} AS text FROM documents")
def news_last_block(spark, d):
    return _news(spark, d, "last")


@query(f"SELECT doc_id, trim(lang || ' ' || {_SPACED}) AS text FROM documents")
def news_all_blocks(spark, d):
    return _news(spark, d, "all")


@query(rf"WITH p AS (SELECT url, {_TITLE} AS title, {_TEXT} AS text FROM pages) SELECT sha256(url) AS doc_id, url, title, {_SPACED} AS text FROM p")
def crawl_files(spark, d):
    path = new_folder(spark, "crawled")
    writers.write_crawled(pages(spark, d).select("url", urls.title(F.col("html")).alias("title"), urls.html_text(F.col("html")).alias("text")), path)
    return readers.crawled(spark, path).select("doc_id", "url", "title", _spaced().alias("text"))


@query(f"WITH {_DOC} SELECT DISTINCT term FROM tok")
def word_list_file(spark, d):
    path = new_folder(spark, "words")
    indexed(spark, d).vocabulary().select("term").write.text(path)
    return readers.word_list(spark, path)


@query(f"WITH {_DOC} SELECT term AS word, 'r' || substr(term, 1, 2) AS root FROM ts")
def stem_class_file(spark, d):
    path = new_folder(spark, "stems")
    groups = indexed(spark, d).vocabulary().groupBy(F.concat(F.lit("r"), F.substring("term", 1, 2)).alias("root")).agg(F.array_join(F.collect_list("term"), " ").alias("words"))
    groups.select(F.concat_ws(" | ", "root", "words")).write.text(path)
    return readers.stem_classes(spark, path)


@query(f"SELECT item_id::INT AS query_id, {_SPACED} AS text FROM benchmark WHERE {_SPACED} <> ''")
def topic_file(spark, d):
    path = new_folder(spark, "topics")
    table(spark, d, "benchmark").select(F.concat_ws(".   ", F.col("item_id").cast("string"), _spaced())).write.text(path)
    return readers.topics(spark, path)


@query(f"WITH {SQL_JUDGEMENTS} SELECT query_id::VARCHAR AS query_id, doc_id::VARCHAR AS doc_id, (grade + CASE WHEN grade = 0 THEN 3 ELSE 0 END)::INT AS grade FROM j")
def qrel_file(spark, d):
    """Appended to: of a pair judged twice the later grade holds."""
    path, old = new_folder(spark, "qrel"), judgements(spark, d)
    writers.append_judgements(old, path)
    writers.append_judgements(old.where("grade = 0").withColumn("grade", F.lit(3)), path)
    return readers.judgements(spark, path)


@query(f"WITH {SQL_JUDGEMENTS} SELECT query_id::VARCHAR AS query_id, doc_id::VARCHAR AS doc_id, grade::INT AS grade FROM j")
def qrel_over_lines(spark, d):
    """Two fields a line: judgements are groups of four whatever the line ends."""
    path = new_folder(spark, "qrel")
    judgements(spark, d).select(F.concat(F.col("query_id").cast("string"), F.lit(" me\n"), F.col("doc_id").cast("string"), F.lit(" "), F.col("grade").cast("string"))).write.text(path)
    return readers.judgements(spark, path, across_lines=True)


@query(f"{_BEST} SELECT query_id::VARCHAR AS query_id, doc_id::VARCHAR AS doc_id, rank, score, 'Exp' AS tag FROM r")
def run_file(spark, d):
    path = new_folder(spark, "run")
    writers.write_run(scoring.ranked(scoring.scores(indexed(spark, d), terms(spark), "bm25_default"), 1000, 6), path)
    return readers.run(spark, path)


@query(f"{_BEST} SELECT query_id::VARCHAR AS query_id, doc_id::VARCHAR AS doc_id, 1 AS rank, score, 'ltr' AS tag FROM r")
def run_constant_rank(spark, d):
    path = new_folder(spark, "run")
    writers.write_run(scoring.ranked(scoring.scores(indexed(spark, d), terms(spark), "bm25_default"), 1000, 6), path, tag="ltr", constant_rank=True)
    return readers.run(spark, path, across_lines=True)


@query(f"WITH {SQL_EDGES} SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, count(*) AS n FROM e GROUP BY ALL")
def adjacency_file(spark, d):
    path = new_folder(spark, "adjacency")
    writers.write_adjacency(edges(spark, d), path)
    return readers.edges(readers.adjacency(spark, path)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_EDGES} SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, count(*) AS n FROM e GROUP BY ALL")
def in_link_file(spark, d):
    """Targets with their sources."""
    path = new_folder(spark, "in-links")
    writers.write_adjacency(edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst")), path)
    return readers.edges(readers.adjacency(spark, path), links_in=True).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_EDGES} SELECT src::VARCHAR AS key, string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS links FROM e GROUP BY src")
def link_map_file(spark, d):
    path = new_folder(spark, "link-map")
    lists = edges(spark, d).groupBy(F.col("src").cast("string").alias("key")).agg(F.array_sort(F.collect_list("dst")).cast("array<string>").alias("links"))
    writers.write_link_map(lists, path)
    return readers.link_map(spark, path).select("key", F.array_join("links", " ").alias("links"))


@query(f"WITH {SQL_EDGES}, r AS (SELECT src AS page, count(*) AS n FROM e GROUP BY src ORDER BY n DESC, page LIMIT 500), i AS (SELECT dst AS page, count(*) AS n_in FROM e GROUP BY dst) SELECT page::VARCHAR AS page, n::DOUBLE AS rank, n::BIGINT AS n_out, coalesce(n_in, 0) AS n_in FROM r LEFT JOIN i USING (page)")
def top_pages_file(spark, d):
    """The 500 pages of most out-links as fixed-width lines."""
    path, e = new_folder(spark, "top"), edges(spark, d)
    writers.write_top_pages(graph.report(e.groupBy(F.col("src").alias("page")).agg(F.count("*").cast("double").alias("rank")), e), path)
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(p[0].alias("page"), p[1].cast("double").alias("rank"), p[2].cast("long").alias("n_out"), p[3].cast("long").alias("n_in"))


@query(f"WITH {SQL_EDGES} SELECT src::VARCHAR AS page, count(*)::DOUBLE AS score FROM e GROUP BY src ORDER BY score DESC, src LIMIT 500")
def top_scores_file(spark, d):
    """The same as tab-separated rows."""
    path = new_folder(spark, "scores")
    writers.write_scores(edges(spark, d).groupBy(F.col("src").alias("page")).agg(F.count("*").cast("double").alias("score")), path, "score")
    return spark.read.schema("page string, score double").option("sep", "\t").csv(path)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_file(spark, d):
    path, rows = new_folder(spark, "json"), table(spark, d, "documents")
    writers.write_json(rows, path)
    return readers.json_records(spark, path, rows.schema).select("doc_id", "text", "lang", "source", "n_chars")


@query("SELECT doc_id::VARCHAR AS id, text FROM documents WHERE text IS NOT NULL")
def mail_records(spark, d):
    """Mails as JSON lines under ids derived from their file names."""
    path = new_folder(spark, "mails")
    rows = table(spark, d, "documents").where("text IS NOT NULL").select(F.concat(F.lit("inmail."), F.col("doc_id").cast("string")).alias("file"), "text")
    writers.write_json(rows.select(readers.mail_id(F.col("file")).alias("id"), "text"), path)
    return readers.json_records(spark, path, "id string, text string")


@query("SELECT 'inmail.' || doc_id AS file, CASE WHEN toxic = 1 THEN 'spam' ELSE 'ham' END AS label FROM labels")
def mail_label_file(spark, d):
    path = new_folder(spark, "labels")
    table(spark, d, "labels").select(F.concat(F.when(F.col("toxic") == 1, "spam").otherwise("HAM"), F.lit(" ../data/inmail."), F.col("doc_id").cast("string"))).write.text(path)
    return readers.mail_labels(spark, path)


@query("SELECT page_id::VARCHAR AS doc_id, trim(regexp_replace(url, '[\\r\\n]+', ' ', 'g')) AS header FROM pages")
def header_file(spark, d):
    path = new_folder(spark, "headers")
    writers.write_headers(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("header")), path)
    return readers.headers(spark, path).select("doc_id", F.trim("header").alias("header"))


@query("SELECT 'Precision' AS metric, doc_id::INT AS cutoff, round(1.0::DOUBLE / (doc_id + 1), 4) AS value FROM labels")
def metrics_file(spark, d):
    path = new_folder(spark, "metrics")
    table(spark, d, "labels").select(F.concat(F.lit("Precision@"), F.col("doc_id").cast("string"), F.lit(": "), F.format_string("%.4f", 1.0 / (F.col("doc_id") + 1)))).write.text(path)
    return readers.metrics(spark, path)


@query("SELECT doc_id::VARCHAR AS id, printf('%.5f', (n_chars % 100003) / 100003.0::DOUBLE) AS probability FROM documents")
def prediction_file(spark, d):
    path = new_folder(spark, "predictions")
    writers.write_predictions(table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 100003 / F.lit(100003.0)).alias("probability")), path)
    return spark.read.option("header", True).schema("id string, probability string").csv(path)


@query("SELECT count(*) FILTER (text IS NOT NULL AND lang = 'en') AS written, count(*) FILTER (NOT (text IS NOT NULL AND coalesce(lang = 'en', false))) AS refused FROM documents")
def bulk_counts(spark, d):
    """Documents under hashed ids; those without English text are refused and counted."""
    path = new_folder(spark, "bulk")
    rows = table(spark, d, "documents").withColumn("english", F.when(F.col("lang") == "en", F.col("text")))
    written, refused = writers.write_documents(rows, path, "doc_id", ["english"])
    stored = spark.read.parquet(path).select(F.count_distinct("_id").alias("ids"))
    return stored.select(F.lit(written).cast("long").alias("written"), F.lit(refused).cast("long").alias("refused"))


@query(f"WITH {_DOC} SELECT term, df, cf, (SELECT string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) FROM tf f WHERE f.term = ts.term) AS postings FROM ts")
def index_text_file(spark, d):
    path = new_folder(spark, "index-text")
    writers.write_index_text(index.postings(index.positions(corpus(spark, d)), ranges=True), path, dealt=True)
    rows = readers.index_text(spark, path)
    return rows.select("term", "df", "cf", F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"].cast("string"), p["tf"].cast("string"))), " ").alias("postings"))


@query(f"WITH {_DOC} SELECT n_docs, round(avgdl, 6) AS avgdl, total, vocab FROM st")
def index_metadata(spark, d):
    """Statistics as the stored index keeps them."""
    return indexed(spark, d).statistics().select("n_docs", F.round("avgdl", 6).alias("avgdl"), "total", "vocab")


@query(f"WITH {_DOC} SELECT doc_id, dl, term, tf, (SELECT df FROM ts WHERE ts.term = tf.term) AS df FROM tf")
def stored_index(spark, d):
    whole = indexed(spark, d)
    return whole.postings().join(whole.vocabulary().select("term", "df"), "term").select("doc_id", "dl", "term", "tf", "df")


def _stream(spark, d):
    """The documents as files that arrive in a folder."""
    path = new_folder(spark, "arrivals")
    rows = table(spark, d, "documents").select("doc_id", "text")
    rows.repartition(6, "doc_id").write.option("parquet.block.size", 16 << 20).parquet(path)  # a row group is the least a task reads
    return increments.document_stream(spark, path, rows.schema.simpleString()[7:-1].replace(":", " "), 2)


@query(f"WITH {_DOC} SELECT doc_id, term, tf FROM tf")
def streamed_index(spark, d):
    """Three batches of files, each an index generation; the generations read as one index."""
    path = new_folder(spark, "generations")
    increments.index_increments(_stream(spark, d), path, new_folder(spark, "log")).awaitTermination()
    return increments.merged_index(spark, path).select("doc_id", "term", "tf")


@query(f"WITH {_DOC} SELECT term, df, cf FROM ts")
def streamed_statistics(spark, d):
    """Running counts after the last batch."""
    path = new_folder(spark, "statistics")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(path)

    stream = increments.statistics_stream(_stream(spark, d)).writeStream.outputMode("complete").foreachBatch(write)
    stream.option("checkpointLocation", new_folder(spark, "log")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("term", "df", "cf")


@query(f"WITH {SQL_MAILS} SELECT doc_id, count(DISTINCT token) AS words, count(*)::DOUBLE AS total FROM (SELECT doc_id, unnest(tokens) AS token FROM m) WHERE token IN (SELECT unnest(tokens) FROM m WHERE split = 'train') GROUP BY doc_id")
def saved_vectors(spark, d):
    """Word counts of all mails by the vectoriser of the training ones, both saved and loaded again."""
    path, m = new_folder(spark, "vectors"), mails(spark, d)
    learning.save_vectors(learning.vectoriser(m.where("split = 'train'")), m, path)
    _, matrix = learning.load_vectors(spark, path)
    held = F.filter(F.unwrap_udt("x")["values"], lambda v: v > 0)  # the vectors stay sparse: a whole one has the length of the vocabulary
    rows = matrix.select("doc_id", held.alias("held")).where(F.size("held") > 0)
    return rows.select("doc_id", F.size("held").cast("long").alias("words"), F.aggregate("held", F.lit(0.0), lambda a, v: a + v).alias("total"))
