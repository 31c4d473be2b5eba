"""The registered queries, one per operator: name -> (spark, folder) -> DataFrame, and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import codec, text, urls
from quarry.operators import crawl, evaluation, expansion, graph, index, learning, scoring, search
from quarry.operators.lineage import settled
from quarry.plans.inputs import (
    FEATURES, SQL_EDGES, SQL_JUDGEMENTS, SQL_MAILS, SQL_TERMS, STEMS, STOPS, corpus, edges, indexed, judgements, mails, pages,
    sql_ranked, sql_scores, sql_tokens, sql_words, table, terms,
)
from quarry.sources.readers import split_by_hash, split_by_place
from quarry.sources.writers import graph_line, run_line
from quarry.streaming.increments import event_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_DOC = sql_tokens()
_MATCH = f"WITH {_DOC}, {SQL_TERMS}"
_BEST = f"{_MATCH}, {sql_scores('bm25_default')}, {sql_ranked()}"

# -- analysis --------------------------------------------------------------------------------------------------------------


@query(f"WITH {_DOC} SELECT doc_id, dl, array_to_string(tokens, ' ') AS tokens FROM t")
def tokenize_words(spark, d):
    return corpus(spark, d).select("doc_id", "dl", F.array_join("tokens", " ").alias("tokens"))


@query(rf"""WITH a AS (SELECT doc_id, regexp_replace(text, '[^\p{{L}}\p{{N}}\p{{M}}_\s.-]', '', 'g') AS text FROM documents),
b AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM a),
c AS (SELECT doc_id, list_filter(list_transform(ws, lambda w: lower(regexp_replace(regexp_replace(w, '^[.-]+', ''), '[.-]+$', ''))), lambda w: w <> '' AND NOT list_contains({_LIST(STOPS)}, w)) AS ws FROM b)
SELECT doc_id, len(ws)::INT AS doc_length, array_to_string(ws, ' ') AS content FROM c""")
def tokenize_news(spark, d):
    """Punctuation only inside words: here dots and hyphens at the ends of a word go however many stand there."""
    plain = F.regexp_replace("text", r"[^\p{L}\p{N}\p{M}_\s.-]", "")
    ends = F.transform(text.spaced(plain), lambda w: F.lower(F.regexp_replace(w, r"^[.-]+|[.-]+$", "")))
    words = F.filter(text.without(ends, list(STOPS)), lambda w: w != "")
    return table(spark, d, "documents").select("doc_id", F.size(words).alias("doc_length"), F.array_join(words, " ").alias("content"))


@query()
def analyse_news(spark, d):
    words = text.analyse_news(F.col("text"), list(STOPS), STEMS)
    return table(spark, d, "documents").select("doc_id", F.size(words).alias("doc_length"), F.array_join(words, " ").alias("content"))


@query(f"WITH a AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '' AND NOT list_contains({_LIST(STOPS)}, lower(w))), ' ') AS text FROM documents) SELECT doc_id, len({sql_words('text')})::INT AS n, array_to_string({sql_words('text')}, ' ') AS tokens FROM a")
def analyse_spaced(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.analyse_spaced(F.col("text"), list(STOPS)).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


@query(f"WITH {_DOC} SELECT term, count(*) AS n FROM tok WHERE NOT list_contains({_LIST(STOPS)}, term) GROUP BY term")
def stopword_filter(spark, d):
    stops = spark.createDataFrame([(w,) for w in STOPS], "term string")
    return text.without_table(index.tokens(corpus(spark, d)), stops).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {_DOC} SELECT coalesce(root, term) AS term, count(*) AS n FROM tok LEFT JOIN (VALUES {', '.join(f"('{w}', '{r}')" for w, r in STEMS.items())}) v(word, root) ON term = word GROUP BY 1")
def stem_class_map(spark, d):
    classes = spark.createDataFrame(list(STEMS.items()), "word string, root string")
    return text.stemmed_by_table(index.tokens(corpus(spark, d)), classes).groupBy("term").agg(F.count("*").alias("n"))


@query()
def porter_stem(spark, d):
    rows = table(spark, d, "documents").select(F.explode(text.analyse_page(F.col("text"), list(STOPS))).alias("stem"))
    return rows.groupBy("stem").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '\p{L}+')), ' ') AS words FROM documents")
def letter_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.letter_words(F.col("text")), " ").alias("words"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<[^>]*>', ' ', 'g'), '[^a-zA-Z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS content FROM documents")
def clean_mail(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_mail(F.col("text")).alias("content"))


# -- index -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {_DOC} SELECT doc_id, term, count(*)::INT AS tf, array_to_string(list_sort(list(pos)), ' ') AS positions FROM tok GROUP BY doc_id, term")
def term_positions(spark, d):
    rows = index.positions(corpus(spark, d))
    return rows.select("doc_id", "term", "tf", F.array_join(F.col("pos").cast("array<string>"), " ").alias("positions"))


@query(f"WITH {_DOC} SELECT doc_id, term, tf FROM tf")
def postings_tf(spark, d):
    return index.frequencies(corpus(spark, d))


@query(f"WITH {_DOC} SELECT term, df, cf FROM ts")
def df_cf(spark, d):
    return index.term_statistics(index.frequencies(corpus(spark, d)))


@query(f"WITH {_DOC} SELECT term, df, cf, (SELECT string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) FROM tf f WHERE f.term = ts.term) AS postings FROM ts")
def postings_lists(spark, d):
    lists = index.postings(index.frequencies(corpus(spark, d)))
    return lists.select("term", "df", "cf", F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"].cast("string"), p["tf"].cast("string"))), " ").alias("postings"))


@query(f"WITH {_DOC} SELECT n_docs, round(avgdl, 6) AS avgdl, total, vocab FROM st")
def corpus_statistics(spark, d):
    return index.corpus_statistics(corpus(spark, d)).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "total", "vocab")


@query()
def vocabulary_sketch(spark, d):
    return index.corpus_statistics(corpus(spark, d), approximate=True)


@query(f"WITH {_DOC}, a AS (SELECT term, min((doc_id, pos)) AS seen FROM tok GROUP BY term) SELECT term, row_number() OVER (ORDER BY seen) AS term_id FROM a")
def term_ids(spark, d):
    return index.first_seen_ids(index.tokens(corpus(spark, d)))


@query(f"WITH {_DOC} SELECT doc_id, term, tf FROM tf")
def merge_partials(spark, d):
    """Two generations, of early and late documents, merged: the same as one index of both."""
    whole = corpus(spark, d)
    early = F.length(F.col("doc_id").cast("string")) <= 2
    parts = [index.positions(whole.where(early)), index.positions(whole.where(~early))]
    return index.merge(parts).select("doc_id", "term", "tf")


_GAPS = f"WITH {_DOC}, g AS (SELECT term, doc_id, tf, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM tf)"


@query(f"{_GAPS} SELECT term, string_agg(gap::VARCHAR, ' ' ORDER BY doc_id) AS gaps FROM g GROUP BY term")
def delta_gaps(spark, d):
    ids = index.frequencies(corpus(spark, d)).repartition("term").groupBy("term").agg(F.collect_list("doc_id").alias("ids"))
    return ids.select("term", F.array_join(codec.gaps(F.col("ids")).cast("array<string>"), " ").alias("gaps"))


@query(f"{_GAPS} SELECT term, sum(greatest(1, ceil(length(bin(gap)) / 7.0)) + greatest(1, ceil(length(bin(tf)) / 7.0)))::INT AS bytes FROM g GROUP BY term")
def vbyte_size(spark, d):
    return index.compressed(index.postings(index.frequencies(corpus(spark, d)))).select("term", "bytes")


@query(f"WITH {_DOC} SELECT term, df, string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS postings FROM tf JOIN ts USING (term) GROUP BY term, df")
def codec_round_trip(spark, d):
    back = index.decompressed(index.compressed(index.postings(index.frequencies(corpus(spark, d)))))
    return back.select("term", "df", F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"].cast("string"), p["tf"].cast("string"))), " ").alias("postings"))


@query(f"WITH {_DOC} SELECT term, doc_id, tf FROM tf QUALIFY row_number() OVER (PARTITION BY term ORDER BY tf DESC, doc_id) <= 10")
def posting_cap(spark, d):
    return index.capped(index.frequencies(corpus(spark, d)), 10).select("term", "doc_id", "tf")


@query(f"{_MATCH} SELECT d.doc_id, q.term, coalesce(tf, 0)::INT AS tf FROM documents d CROSS JOIN (SELECT DISTINCT term FROM q) q LEFT JOIN tf ON tf.doc_id = d.doc_id AND tf.term = q.term")
def term_lookup(spark, d):
    whole, asked = indexed(spark, d), terms(spark).select("term").distinct()
    pairs = whole.forward.select("doc_id").crossJoin(F.broadcast(asked))  # a literal list of terms
    return index.term_frequency(whole.postings(asked).select("doc_id", "term", "tf"), pairs)


@query(f"WITH {_DOC} SELECT doc_id, term, tf, df, cf AS ttf FROM tf JOIN ts USING (term) WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def term_vectors(spark, d):
    whole, asked = indexed(spark, d), table(spark, d, "labels").where("toxic = 1")
    return index.term_vectors(index.frequencies(whole.documents(asked)), whole.vocabulary(), asked)


@query(f"WITH {_DOC} SELECT l.doc_id, coalesce(dl, 0)::INT AS dl FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN t USING (doc_id)")
def doc_lengths(spark, d):
    return index.lengths(indexed(spark, d).forward, table(spark, d, "labels"))


# -- search and scoring ------------------------------------------------------------------------------------------------------


def _scored(model: str):
    def run(spark, d):
        return scoring.ranked(scoring.scores(indexed(spark, d), terms(spark), model), digits=6)

    query(f"{_MATCH}, {sql_scores(model)}, {sql_ranked()} SELECT * FROM r", f"score_{model}")(run)


for _m in scoring.MODELS:
    _scored(_m)


@query(f"{_BEST} SELECT query_id, doc_id, rank FROM r")
def match_topk(spark, d):
    return scoring.ranked(scoring.scores(indexed(spark, d), terms(spark), "bm25_default"), 1000, 6).select("query_id", "doc_id", "rank")


@query(f"{_BEST}, {sql_scores('bm25_penalised', out='s2', candidates='r')}, {sql_ranked('s2', 'r2')} SELECT * FROM r2")
def two_stage_rescore(spark, d):
    whole, asked = indexed(spark, d), terms(spark)
    best = settled(scoring.ranked(scoring.scores(whole, asked, "bm25_default"), 1000, 6))
    return scoring.ranked(scoring.scores(whole, asked, "bm25_penalised", candidates=best), digits=6)


@query(f"""{_MATCH}, p AS (SELECT a.query_id, x.doc_id, abs(x.pos - y.pos) AS d FROM q a JOIN q b ON a.query_id = b.query_id AND a.term < b.term
JOIN tok x ON x.term = a.term JOIN tok y ON y.term = b.term AND y.doc_id = x.doc_id AND abs(x.pos - y.pos) <= 5)
SELECT query_id, doc_id, round(1 / (1 + avg(d)), 6) AS score FROM p GROUP BY query_id, doc_id""")
def proximity_pairs(spark, d):
    return scoring.proximity(indexed(spark, d), terms(spark)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"""{_MATCH}, p AS (SELECT a.query_id, x.doc_id, min(abs(x.pos - y.pos)) AS d FROM q a JOIN q b ON a.query_id = b.query_id AND a.term < b.term
JOIN tok x ON x.term = a.term JOIN tok y ON y.term = b.term AND y.doc_id = x.doc_id GROUP BY ALL),
h AS (SELECT query_id, doc_id, count(*) AS n FROM q JOIN tf USING (term) GROUP BY ALL), k AS (SELECT query_id, count(*) AS n FROM q GROUP BY ALL)
SELECT h.query_id, h.doc_id, CASE WHEN h.n = k.n THEN round(coalesce(1.0::DOUBLE / d, 0), 6) ELSE 0 END AS score FROM h JOIN k USING (query_id) LEFT JOIN p ON p.query_id = h.query_id AND p.doc_id = h.doc_id""")
def proximity_min(spark, d):
    return scoring.nearest_pair(indexed(spark, d), terms(spark)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_DOC} SELECT doc_id, tf FROM tf WHERE term = 'thble'")
def term_documents(spark, d):
    asked = spark.createDataFrame([("thble",)], "term string")
    return indexed(spark, d).postings(asked).select("doc_id", "tf")


@query(f"WITH {_DOC} SELECT a.doc_id, count(*)::INT AS hits FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id")
def phrase_match(spark, d):
    return search.phrase(indexed(spark, d).forward, ["of", "the"])


def _fields(spark, d):
    p = pages(spark, d)
    return [index.tokenised(p.select("doc_id", urls.title(F.col("html")).alias("text"))), index.tokenised(p.select("doc_id", urls.html_text(F.col("html")).alias("text")))]


_UNESCAPE = lambda x: f"replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_SQUEEZE = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
_TITLE = f"coalesce({_SQUEEZE(_UNESCAPE(r"regexp_extract_all(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1)[1]"))}, 'No title')"


def _sql_visible(tags: str) -> str:
    out = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in tags.split():
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    return out


_PARTS = lambda x: rf"list_filter(list_transform({x}, lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
_TEXT = f"array_to_string({_PARTS(rf'regexp_split_to_array({_UNESCAPE(f"regexp_replace({_sql_visible('script style')}, '(?s)<[^>]*>', '', 'g')")}, {chr(39)}[\r\n]|  {chr(39)})')}, ' ')"
_STRINGS = f"array_to_string({_PARTS(f"list_transform(regexp_split_to_array({_sql_visible('script style header')}, '(?s)<[^>]*>'), lambda y: {_UNESCAPE('y')})")}, ' ')"
_PAGES = f"p AS MATERIALIZED (SELECT page_id AS doc_id, url, {_TITLE} AS title, {_TEXT} AS text FROM pages)"


@query(f"""WITH {_PAGES}, {sql_tokens("p", column="title", name="1")}, {sql_tokens("p", column="text", name="2")}, {SQL_TERMS},
{sql_scores("bm25_default", "1", "s1")}, {sql_scores("bm25_default", "2", "s2")}, s AS (SELECT query_id, doc_id, max(score) AS score FROM (FROM s1 UNION ALL FROM s2) GROUP BY ALL), {sql_ranked(most=None)} SELECT * FROM r""")
def multi_match_best_fields(spark, d):
    asked = terms(spark)
    one, two = (scoring.scores(f, asked, "bm25_default").withColumn("score", F.round("score", 6)) for f in _fields(spark, d))
    return scoring.ranked(one.unionByName(two).groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), None)


@query(f"{_BEST} SELECT * FROM r WHERE rank BETWEEN 11 AND 20")
def paged_search(spark, d):
    return search.page(scoring.ranked(scoring.scores(indexed(spark, d), terms(spark), "bm25_default"), 1000, 6), 1)


@query("""WITH p AS (SELECT doc_id, text, instr(lower(text), 'thble') AS a FROM documents)
SELECT doc_id, CASE WHEN a > 0 THEN regexp_replace(substr(text, greatest(a - 50, 1), 100), '(?i)(thble)', '<em>\\1</em>', 'g') ELSE '' END AS snippet FROM p""")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", search.snippet(F.col("text"), ["thble"]).alias("snippet"))


@query(f"WITH {_PAGES} SELECT doc_id, title FROM p WHERE len(list_filter({sql_words('title')}, lambda w: starts_with(w, 'thb'))) > 0 OR len(list_filter({sql_words('text')}, lambda w: starts_with(w, 'thb'))) > 0 ORDER BY doc_id LIMIT 5")
def autocomplete(spark, d):
    p = pages(spark, d).select("doc_id", urls.title(F.col("html")).alias("title"), urls.html_text(F.col("html")).alias("text"))
    return search.complete(p.select("doc_id", "title", text.words(F.col("title")).alias("title_tokens"), text.words(F.col("text")).alias("tokens")), "thb")


@query(f"WITH {SQL_JUDGEMENTS} SELECT query_id, doc_id, (CASE WHEN query_id = 1 AND grade = 0 THEN 2 ELSE grade END)::INT AS grade FROM j")
def assess(spark, d):
    old = judgements(spark, d)
    return search.assess(old, old.where("query_id = 1 AND grade = 0").withColumn("grade", F.lit(2))).select("query_id", "doc_id", "grade")


# -- expansion -------------------------------------------------------------------------------------------------------------


@query(f"""{_BEST}, b AS (SELECT r.query_id, term, sum(df)::BIGINT AS df, sum(cf)::BIGINT AS ttf FROM r JOIN tf USING (doc_id) JOIN ts USING (term) WHERE rank <= 10 GROUP BY ALL)
SELECT query_id, term, df, ttf, (row_number() OVER (PARTITION BY query_id ORDER BY df DESC, ttf, term))::INT AS rank FROM b QUALIFY rank <= 5""")
def prf_basic_terms(spark, d):
    return expansion.feedback_terms(indexed(spark, d), terms(spark))


@query(f"""{_MATCH}, f AS (SELECT DISTINCT q.term AS asked, doc_id FROM q JOIN tf USING (term)), nf AS (SELECT asked, count(*) AS n_front FROM f GROUP BY ALL),
c AS (SELECT asked, term, count(*) AS n_both FROM f JOIN tf USING (doc_id) GROUP BY ALL HAVING count(*) >= 3),
x AS (SELECT asked, term, round((n_both / n_front - df / n_docs) * ((n_both / n_front) / (df / n_docs)), 9) AS jlh FROM c JOIN nf USING (asked) JOIN ts USING (term), st WHERE n_both / n_front > df / n_docs),
k AS (SELECT asked, term, row_number() OVER (PARTITION BY asked ORDER BY jlh DESC, term) AS place FROM x QUALIFY place <= 5),
v AS (SELECT q.query_id, k.term, count(*) AS votes, min((q.first, k.place)) AS seen FROM q JOIN k ON k.asked = q.term GROUP BY ALL HAVING count(*) >= 2)
SELECT query_id, term, votes, (row_number() OVER (PARTITION BY query_id ORDER BY seen, term))::INT AS rank FROM v QUALIFY rank <= 5""")
def prf_significant_terms(spark, d):
    return expansion.significant_terms(indexed(spark, d), terms(spark))


@query(f"""{_BEST}, b AS (SELECT r.query_id, term, sum(df)::BIGINT AS df, sum(cf)::BIGINT AS ttf FROM r JOIN tf USING (doc_id) JOIN ts USING (term) WHERE rank <= 10 GROUP BY ALL),
x AS (SELECT query_id, term FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY df DESC, ttf, term) <= 5),
y AS (SELECT query_id, term, sum(qtf)::INT AS qtf, NULL AS first FROM (SELECT query_id, term, qtf FROM q UNION ALL SELECT query_id, term, 1 FROM x) GROUP BY query_id, term),
z AS (SELECT *, (sum(qtf) OVER (PARTITION BY query_id))::INT AS n FROM y), {sql_scores('bm25', out='s2').replace('FROM q JOIN', 'FROM z JOIN')}, {sql_ranked('s2', 'r2')} SELECT * FROM r2""")
def prf_rerun(spark, d):
    whole, asked = indexed(spark, d), terms(spark)
    return expansion.rerun(whole, asked, expansion.feedback_terms(whole, asked), "bm25", digits=6)


# -- graph -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {SQL_EDGES} SELECT page, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT src AS page, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY page")
def degrees(spark, d):
    return graph.degrees(edges(spark, d))


@query(f"WITH {SQL_EDGES} SELECT DISTINCT dst AS page FROM e WHERE dst NOT IN (SELECT src FROM e)")
def sink_pages(spark, d):
    return graph.sinks(edges(spark, d))


#: The line after the last of an order stands for it, under a negative number: the whole graph with natural sinks.
_ENDED = f"WITH {SQL_EDGES}, e2 AS MATERIALIZED (SELECT src, dst FROM e UNION ALL SELECT max_by(l_partkey, (l_linenumber, l_partkey, l_quantity)), -l_orderkey FROM lineitem GROUP BY l_orderkey)"


def _ended(spark, d):
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("src"))
    return edges(spark, d).select("src", "dst").unionByName(last.select("src", (-F.col("l_orderkey")).alias("dst")))


@query(f"{_ENDED} SELECT DISTINCT dst AS page FROM e2 WHERE dst NOT IN (SELECT src FROM e2)")
def sink_orders(spark, d):
    return graph.sinks(_ended(spark, d))


@query(f"WITH {SQL_EDGES} SELECT src AS page, string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS links FROM e GROUP BY src")
def invert_links(spark, d):
    return graph.inverted(edges(spark, d)).select("page", F.array_join(F.col("links").cast("array<string>"), " ").alias("links"))


def _sql_pagerank(edges_: str, rounds: int) -> str:
    out = f"{edges_}, o AS (SELECT src, count(*) AS n FROM f GROUP BY src), w AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / n AS share FROM f JOIN o USING (src)),\n"
    out += "n AS MATERIALIZED (SELECT p.dst AS page, o.src IS NULL AS sink, (SELECT count(DISTINCT dst) FROM f) AS n FROM (SELECT DISTINCT dst FROM f) p LEFT JOIN o ON o.src = p.dst),\nr0 AS MATERIALIZED (SELECT page, sink, n, 1.0::DOUBLE / n AS rank FROM n)"
    for i in range(rounds):
        out += f",\nr{i + 1} AS MATERIALIZED (SELECT a.page, a.sink, a.n, 0.15 / a.n + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE sink) / a.n + 0.85 * coalesce(g, 0) AS rank FROM r{i} a LEFT JOIN (SELECT w.dst, sum(r.rank * w.share) AS g FROM w JOIN r{i} r ON r.page = w.src GROUP BY w.dst) b ON b.dst = a.page)"
    return out


@query(f"{_sql_pagerank(f'WITH {SQL_EDGES}, f AS MATERIALIZED (SELECT src, dst FROM e)', 10)} SELECT page, round(rank, 9) AS rank FROM r10")
def pagerank_k10(spark, d):
    return graph.pagerank(edges(spark, d), iterations=10, tolerance=None).select("page", F.round("rank", 9).alias("rank"))


@query(f"{_sql_pagerank(f'{_ENDED}, f AS MATERIALIZED (FROM e2)', 10)} SELECT page, round(rank, 9) AS rank FROM r10")
def pagerank_sinks(spark, d):
    """The mass of pages without out-links goes to all pages."""
    return graph.pagerank(_ended(spark, d), iterations=10, tolerance=None).select("page", F.round("rank", 9).alias("rank"))


_URL_EDGES = f"WITH {SQL_EDGES}, f AS MATERIALIZED (SELECT sha256('http://p.org/' || src) AS src, sha256('http://p.org/' || dst) AS dst FROM e)"


@query(f"{_sql_pagerank(_URL_EDGES, 10)} SELECT page, round(rank, 9) AS rank FROM r10")
def pagerank_urls(spark, d):
    """Pages known by URLs, ranked by the hash of each."""
    url = lambda c: graph.url_id(F.concat(F.lit("http://p.org/"), F.col(c).cast("string"))).alias(c)
    return graph.pagerank(edges(spark, d).select(url("src"), url("dst")), iterations=10, tolerance=None).select("page", F.round("rank", 9).alias("rank"))


@query()
def pagerank_converged(spark, d):
    return graph.pagerank(edges(spark, d))


@query(f"WITH {SQL_EDGES}, r AS (SELECT src AS page, count(*) AS n FROM e GROUP BY src ORDER BY n DESC, page LIMIT 500), i AS (SELECT dst AS page, count(*) AS n_in FROM e GROUP BY dst) SELECT rpad(page::VARCHAR, 40, ' ') || rpad(printf('%.16f', n::DOUBLE), 25, ' ') || rpad(n::VARCHAR, 12, ' ') || coalesce(n_in, 0) AS line FROM r LEFT JOIN i USING (page)")
def top_pages_report(spark, d):
    e = edges(spark, d)
    out = e.groupBy(F.col("src").alias("page")).agg(F.count("*").cast("double").alias("rank"))
    return graph.report(out, e).select(graph_line(F.col("page"), F.col("rank"), F.col("n_out"), F.col("n_in")).alias("line"))


def _whole_base(e):
    """From every source of an edge with l_quantity >= 49: three rounds, 200 links each way, no page target."""
    roots = e.where("l_quantity >= 49").select(F.col("src").alias("page"))
    return graph.base_set(roots, e, rounds=3, per_page=200, target=2**63 - 1)


_BASE = f"""WITH {SQL_EDGES}, b2 AS MATERIALIZED (SELECT DISTINCT src AS page, dst AS other, 'out' AS way FROM e UNION SELECT DISTINCT dst, src, 'in' FROM e),
k AS MATERIALIZED (SELECT page, other FROM b2 QUALIFY row_number() OVER (PARTITION BY page, way ORDER BY sha256(other::VARCHAR), other) <= 200),
p0 AS MATERIALIZED (SELECT DISTINCT src AS page FROM e WHERE l_quantity >= 49), p1 AS MATERIALIZED (FROM p0 UNION SELECT other FROM k WHERE page IN (FROM p0)),
p2 AS MATERIALIZED (FROM p1 UNION SELECT other FROM k WHERE page IN (FROM p1)), p3 AS MATERIALIZED (FROM p2 UNION SELECT other FROM k WHERE page IN (FROM p2))"""


@query(f"{_BASE} FROM p3")
def base_set(spark, d):
    return _whole_base(edges(spark, d))


def _sql_hits(rounds: int) -> str:
    out = f"{_BASE}, l AS MATERIALIZED (SELECT src, dst, count(*) AS w FROM e WHERE src IN (FROM p3) AND dst IN (FROM p3) GROUP BY ALL), h0 AS MATERIALIZED (SELECT page, 1.0::DOUBLE AS v FROM p3)"
    for i in range(rounds):
        for to, source, a, b in ((f"a{i + 1}", f"h{i}", "src", "dst"), (f"h{i + 1}", f"a{i + 1}", "dst", "src")):
            out += f",\n{to} AS MATERIALIZED (SELECT p.page, coalesce(s / (sqrt(sum(s * s) OVER ())), 0) AS v FROM p3 p LEFT JOIN (SELECT l.{b} AS page, sum(w * v) AS s FROM l JOIN {source} x ON x.page = l.{a} GROUP BY 1) USING (page))"
    return out + f" SELECT page, round(a.v, 8) AS authority, round(h.v, 8) AS hub FROM a{rounds} a JOIN h{rounds} h USING (page)"


@query(_sql_hits(11))
def hits_k11(spark, d):
    e = edges(spark, d)
    found = graph.hits(e, _whole_base(e))
    return found.select("page", F.round("authority", 8).alias("authority"), F.round("hub", 8).alias("hub"))


# -- pages and URLs --------------------------------------------------------------------------------------------------------

_U = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$'"
_PART = lambda i: f"regexp_extract(url, {_U}, {i})"
_PORT = lambda s, h: f"CASE WHEN {s} = 'http' THEN regexp_replace({h}, ':80$', '') WHEN {s} = 'https' THEN regexp_replace({h}, ':443$', '') ELSE {h} END"


def _sql_canonical(url: str) -> str:
    part = lambda i: f"regexp_extract({url}, {_U}, {i})"
    host = _PORT(f"lower({part(1)})", f"regexp_replace(lower({part(2)}), '^www\\.', '')")
    path = f"regexp_replace(regexp_replace(regexp_replace({part(3)}, '/+', '/', 'g'), '/$', ''), ';[^/]*$', '')"
    return f"lower({part(1)}) || '://' || {host} || {path} || CASE WHEN {part(4)} = '?' THEN '' ELSE {part(4)} END"


@query(f"SELECT page_id, {_sql_canonical('url')} AS canonical FROM pages")
def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, lower({_PART(1)}) || '://' || {_PORT(f'lower({_PART(1)})', _PART(2))} || regexp_replace(regexp_replace({_PART(3)}, '//', '/', 'g'), '/+$', '') AS canonical FROM pages")
def url_canonical_plain(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical_plain(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, {_PART(2)} AS domain, lower({_PART(1)}) <> '' AND {_PART(2)} <> '' AS valid, regexp_replace(url, 'https?://', '', 'g') AS bare FROM pages")
def url_domain(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.domain(u).alias("domain"), urls.is_valid(u).alias("valid"), urls.without_scheme(u).alias("bare"))


@query(rf"""WITH k AS (SELECT page_id, list_filter(string_split_regex(translate(regexp_extract(l, '^([^(]*)', 1) || ' ' || regexp_extract(l, '\(([^)(]*)\)', 1), '_-', '  '), ' +'), lambda x: x <> '') AS words, p FROM (SELECT page_id, {_PART(3)} AS p, url_decode(split_part({_PART(3)}, '/', -1)) AS l FROM pages))
SELECT page_id, array_to_string(words, ' ') AS last_words, array_to_string(list_transform(list_filter(string_split(p, '/'), lambda x: x <> ''), lambda x: lower(replace(url_decode(x), '_', ' '))), '|') AS parts FROM k""")
def url_keywords(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.array_join(urls.url_keywords(u), " ").alias("last_words"), F.array_join(urls.path_keywords(u), "|").alias("parts"))


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", urls.title(F.col("html")).alias("title"))


@query(f"SELECT page_id, {_TEXT} AS text FROM pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", urls.html_text(F.col("html")).alias("text"))


@query(f"SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<title') THEN {_STRINGS} END AS text FROM pages")
def html_strings(spark, d):
    return table(spark, d, "pages").select("page_id", urls.html_strings(F.col("html")).alias("text"))


def _links(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url", F.posexplode(urls.links(F.col("html"))).alias("n", "l"))
    return rows.select("page_id", "n", "url", F.col("l.href").alias("href"), F.col("l.anchor").alias("anchor"))


_LINKS = rf"""l AS MATERIALIZED (SELECT page_id, url, unnest(h) AS h, unnest(a) AS a, generate_subscripts(h, 1)::INT - 1 AS n FROM (SELECT page_id, url,
  regexp_extract_all(html, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a\s*>', 1) AS h, regexp_extract_all(html, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a\s*>', 2) AS a FROM pages)),
k AS (SELECT page_id, n, url, {_UNESCAPE("h")} AS href, {_SQUEEZE(_UNESCAPE("regexp_replace(a, '(?s)<[^>]*>', '', 'g')"))} AS anchor FROM l),
z AS MATERIALIZED (SELECT *, {_PART(1)} || '://' || {_PART(2)} AS root, {_PART(3)} AS path, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN lower({_PART(1)}) || ':' || href WHEN starts_with(href, '/') THEN lower({_PART(1)}) || '://' || {_PART(2)} || href
  WHEN starts_with(href, '?') THEN lower({_PART(1)}) || '://' || {_PART(2)} || {_PART(3)} || href WHEN starts_with(href, '#') THEN regexp_replace(url, '#.*$', '') || href WHEN href = '' THEN regexp_replace(url, '#.*$', '')
  ELSE lower({_PART(1)}) || '://' || {_PART(2)} || coalesce(nullif(regexp_replace({_PART(3)}, '[^/]*$', ''), ''), '/') || href END AS target FROM k)"""


@query(f"WITH {_LINKS} SELECT page_id, n, target, anchor FROM z")
def extract_links(spark, d):
    return _links(spark, d).select("page_id", "n", urls.resolve(F.col("url"), F.col("href")).alias("target"), "anchor")


_BLOCKED = [".jpg", ".svg", ".png", ".pdf", ".gif", "mailto", "tel:", "javascript"]
_KEYWORDS = ["the", "split", "and", "split", "th"]


def _frontier(spark, d):
    rows = _links(spark, d).select("page_id", urls.canonical(urls.resolve(F.col("url"), F.col("href"))).alias("target"), "anchor")
    rows = rows.where(urls.is_valid(F.col("target")) & ~urls.listed(F.col("target"), _BLOCKED))
    keys = urls.keyword_matches(F.col("anchor"), _KEYWORDS)
    return rows.groupBy("target").agg(F.count("*").alias("in_links"), F.count_distinct("page_id").alias("pages"), F.max(keys).alias("keywords"), F.max(urls.relevance(F.col("target"), F.col("anchor"), _KEYWORDS)).alias("relevance"))


_FRONTIER = f"""WITH {_LINKS}, c AS (SELECT page_id, anchor, {_sql_canonical("target")} AS target FROM z),
f AS MATERIALIZED (SELECT target, count(*) AS in_links, count(DISTINCT page_id) AS pages, max({" + ".join(f"contains(anchor, '{k}')::INT" for k in _KEYWORDS)}) AS keywords,
  max({" + ".join(f"(contains(lower(target), '{k}') OR contains(lower(anchor), '{k}'))::INT" for k in _KEYWORDS)}) AS relevance
  FROM c WHERE regexp_extract(target, {_U}, 1) <> '' AND regexp_extract(target, {_U}, 2) <> '' AND NOT ({" OR ".join(f"contains(target, '{b}')" for b in _BLOCKED)}) GROUP BY target)"""


@query(f"{_FRONTIER} SELECT target, in_links, pages, keywords FROM f")
def link_counts(spark, d):
    return _frontier(spark, d).select("target", "in_links", "pages", "keywords")


@query(f"{_FRONTIER} SELECT target, in_links * 2 + keywords * 3 + CASE WHEN regexp_extract(target, {_U}, 2) = 'spam-farm.example.org' THEN 5 ELSE 0 END AS score FROM f")
def frontier_score(spark, d):
    score = urls.frontier_score(F.col("in_links"), F.col("keywords"), F.lit(False), urls.domain(F.col("target")), {"www.spam-farm.example.org": 5})
    return _frontier(spark, d).select("target", score.alias("score"))


@query(f"{_FRONTIER} SELECT target, 1 - relevance - in_links AS priority, (row_number() OVER (PARTITION BY regexp_extract(target, {_U}, 2) ORDER BY 1 - relevance - in_links, target))::INT AS turn FROM f")
def frontier_priority(spark, d):
    """``turn``: a page's place in its domain; taking turn by turn alternates the domains."""
    rows = _frontier(spark, d).select("target", urls.frontier_priority(F.lit(False), F.col("relevance"), F.lit(1), F.col("in_links")).alias("priority"), urls.domain(F.col("target")).alias("domain"))
    from pyspark.sql import Window

    return rows.select("target", "priority", F.row_number().over(Window.partitionBy("domain").orderBy("priority", "target")).alias("turn"))


@query(f"{_FRONTIER} SELECT target, in_links FROM f WHERE regexp_replace(lower(target), 'https?://', '', 'g') NOT IN (SELECT regexp_replace(lower(url), 'https?://', '', 'g') FROM pages)")
def unvisited_links(spark, d):
    return crawl.unvisited(_frontier(spark, d), table(spark, d, "pages"), "target").select("target", "in_links")


@query(f"SELECT page_id, {_PART(2)} <> '' AND NOT regexp_full_match({_PART(2)}, '[0-9]+') AS named FROM pages")
def named_hosts(spark, d):
    return table(spark, d, "pages").select("page_id", crawl.has_named_host(F.col("url")).alias("named"))


@query("SELECT page_id FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN contains(lower(html), '<html') THEN 'text/html; charset=utf-8' ELSE 'text/plain' END AS content_type FROM pages) WHERE status = 200 AND contains(content_type, 'text/html')")
def html_gate(spark, d):
    """The table has no responses: status and type are made up from the id and the page."""
    status, kind = F.when(F.col("page_id") % 7 == 0, 404).otherwise(200), F.when(F.lower("html").contains("<html"), "text/html; charset=utf-8").otherwise("text/plain")
    return crawl.fetched_html(table(spark, d, "pages").withColumns({"status": status, "content_type": kind})).select("page_id")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def language_gate(spark, d):
    return crawl.in_language(table(spark, d, "documents")).select("doc_id", "lang")


#: Edges as links between URLs of seven domains, and where the crawl starts.
_WEB = "CASE WHEN {0} % 10 = 0 THEN 'http://h' || ({0} % 7) || '.org/split/' || {0} ELSE 'http://h' || ({0} % 7) || '.org/' || {0} END"
_SEEDS = (1, 2, 3)


def _sql_crawl(waves: int) -> str:
    out = f"WITH {SQL_EDGES}, k AS MATERIALIZED (SELECT DISTINCT {_WEB.format('src')} AS src, {_WEB.format('dst')} AS dst FROM e), p0 AS MATERIALIZED (SELECT {_WEB.format('s')} AS url, 0 AS wave FROM (VALUES {', '.join(f'({s})' for s in _SEEDS)}) v(s))"
    for i in range(1, waves):
        out += f", p{i} AS MATERIALIZED (SELECT * FROM p{i - 1} UNION ALL SELECT DISTINCT dst, {i} FROM k WHERE src IN (SELECT url FROM p{i - 1} WHERE wave = {i - 1}) AND dst NOT IN (SELECT url FROM p{i - 1}))"
    score = "contains(url, 'split')::INT + contains(url, 'h3')::INT"
    out += f", f AS (SELECT dst AS url, count(DISTINCT src) AS n FROM k WHERE src IN (SELECT url FROM p{waves - 1} WHERE wave < {waves - 1}) GROUP BY dst)"
    out += f", r AS (SELECT url, wave, coalesce(n, 0) AS in_links, (wave - ({score}) - coalesce(n, 0) - CASE WHEN wave = 0 THEN 10000 ELSE 0 END)::BIGINT AS priority FROM p{waves - 1} LEFT JOIN f USING (url))"
    return out + f", t AS (SELECT *, (row_number() OVER (PARTITION BY wave, regexp_extract(url, '//([^/]*)', 1) ORDER BY priority, url))::INT AS turn FROM r) SELECT *, row_number() OVER (ORDER BY wave, turn, priority, url) AS place FROM t"


def _web_links(spark, d):
    url = lambda c: F.concat(F.lit("http://h"), (F.col(c) % 7).cast("string"), F.lit(".org/"), F.when(F.col(c) % 10 == 0, "split/").otherwise(""), F.col(c).cast("string"))
    seeds = spark.createDataFrame([(s,) for s in _SEEDS], "s long").select(url("s").alias("url"))
    return edges(spark, d).select(url("src").alias("src"), url("dst").alias("dst"), F.lit("").alias("anchor")).distinct(), seeds


@query(_sql_crawl(3))
def crawl_waves(spark, d):
    return crawl.crawl(*_web_links(spark, d), ["split", "h3"], waves=3)


@query(f"FROM ({_sql_crawl(3)}) WHERE place <= 400")
def crawl_limit(spark, d):
    """A crawl that ends after 400 pages."""
    return crawl.crawl(*_web_links(spark, d), ["split", "h3"], waves=3, most=400)


@query(f"""WITH {_LINKS}, o AS (SELECT page_id, list_sort(list(DISTINCT target)) AS out_links FROM z WHERE target IS NOT NULL GROUP BY page_id)
SELECT page_id AS doc_id, p.url, '' AS in_links, coalesce(array_to_string(out_links, ' '), '') AS out_links, coalesce(d.lang, '') AS header FROM pages p LEFT JOIN o USING (page_id) LEFT JOIN documents d ON d.doc_id = page_id""")
def crawl_records(spark, d):
    """Pages with their links and, for want of response headers, the language of the document of the same id."""
    out = _links(spark, d).select("page_id", urls.resolve(F.col("url"), F.col("href")).alias("target")).groupBy(F.col("page_id").alias("doc_id")).agg(F.array_sort(F.collect_set("target")).alias("out_links"))
    rows = crawl.records(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url"), out.withColumn("in_links", F.array().cast("array<string>")), table(spark, d, "documents").select("doc_id", F.col("lang").alias("header")))
    return rows.select("doc_id", "url", F.array_join("in_links", " ").alias("in_links"), F.array_join("out_links", " ").alias("out_links"), "header")


@query(f"SELECT page_id, array_to_string(list_filter(regexp_split_to_array(lower(CASE WHEN {_TITLE} = 'No title' AND NOT regexp_matches(html, '(?i)<title') THEN '' ELSE {_TITLE} END), '\\s+'), lambda x: x <> ''), ' ') AS title, array_to_string(list_filter(list_transform(string_split(regexp_extract(html, '(?is)<meta\\s[^>]*name\\s*=\\s*[\"'']keywords[\"''][^>]*content\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1), ','), lambda x: lower(trim(x))), lambda x: x <> ''), '|') AS meta FROM pages")
def page_keywords(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(urls.title_keywords(F.col("html")), " ").alias("title"), F.array_join(urls.meta_keywords(F.col("html")), "|").alias("meta"))


@query("SELECT page_id, sha256(url) AS id, sha256(url) AS same FROM pages")
def url_hash(spark, d):
    one = table(spark, d, "pages").select("page_id", graph.url_id(F.col("url")).alias("id"))
    return one.select("page_id", "id", graph.url_id(F.col("id")).alias("same"))


# -- evaluation ------------------------------------------------------------------------------------------------------------

_EVAL = f"""{_BEST}, {SQL_JUDGEMENTS}, g AS (SELECT query_id, sum(grade)::BIGINT AS num_rel FROM j GROUP BY query_id),
y AS (SELECT r.query_id, r.doc_id, r.rank, r.score, coalesce(j.grade, 0) AS grade, coalesce(num_rel, 0) AS num_rel FROM r LEFT JOIN j USING (query_id, doc_id) LEFT JOIN g ON g.query_id = r.query_id),
v AS MATERIALIZED (SELECT *, (sum((grade > 0)::INT) OVER w)::BIGINT AS hits, hits / rank AS precision, CASE WHEN num_rel > 0 THEN hits / num_rel ELSE 0 END AS recall FROM y WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING))"""


def _run(spark, d):
    """The ranking is computed once: several branches of an evaluation read it."""
    return settled(scoring.ranked(scoring.scores(indexed(spark, d), terms(spark), "bm25_default"), 1000, 6))


def _rounded(rows):
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in rows.dtypes])


@query(f"{_EVAL} SELECT query_id, rank AS cutoff, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM v WHERE rank IN (5, 10, 20, 50, 100)")
def eval_at_cutoffs(spark, d):
    return _rounded(evaluation.at_cutoffs(evaluation.judged_run(_run(spark, d), judgements(spark, d))))


_SUMMARY = f"""{_EVAL}, i AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(x + 1)) AS idcg FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS x FROM j) GROUP BY query_id),
o AS (SELECT query_id, CASE WHEN num_rel > 0 THEN coalesce(sum(CASE WHEN grade > 0 THEN precision END), 0) / num_rel ELSE 0 END AS average_precision, CASE WHEN num_rel > 0 THEN coalesce(max(CASE WHEN rank = num_rel THEN precision END), max(hits) / num_rel) ELSE 0 END AS r_precision,
  coalesce(sum(CASE WHEN rank <= num_rel THEN (pow(2, grade) - 1) / log2(rank + 1) END), 0) AS dcg FROM v GROUP BY query_id, num_rel)"""


@query(f"{_SUMMARY} SELECT query_id, round(average_precision, 6) AS average_precision, round(r_precision, 6) AS r_precision, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM o LEFT JOIN i USING (query_id)")
def eval_summary(spark, d):
    j = judgements(spark, d)
    return _rounded(evaluation.summary(settled(evaluation.judged_run(_run(spark, d), j)), j))


@query(f"{_SUMMARY} SELECT round(avg(average_precision), 6) AS average_precision, round(avg(r_precision), 6) AS r_precision, round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS ndcg FROM o LEFT JOIN i USING (query_id)")
def eval_means(spark, d):
    j = judgements(spark, d)
    return _rounded(evaluation.means(evaluation.summary(settled(evaluation.judged_run(_run(spark, d), j)), j)))


@query(f"{_EVAL} SELECT query_id, rank, round(recall, 6) AS recall, round(precision, 6) AS precision FROM v")
def pr_curve(spark, d):
    return _rounded(evaluation.curve(evaluation.judged_run(_run(spark, d), judgements(spark, d))))


@query(f"WITH {SQL_JUDGEMENTS} SELECT query_id, count(*) AS relevant FROM j WHERE grade > 0 GROUP BY query_id")
def relevant_counts(spark, d):
    return evaluation.relevant_counts(judgements(spark, d))


_CLASSIC = f"""{_BEST}, {SQL_JUDGEMENTS}, g AS (SELECT query_id, sum(grade)::BIGINT AS num_rel FROM j GROUP BY query_id HAVING sum(grade) > 0),
c AS (SELECT r.query_id, (row_number() OVER (PARTITION BY r.query_id ORDER BY score DESC, r.doc_id DESC))::INT AS rank, coalesce(j.grade, 0) AS grade, num_rel FROM r JOIN g USING (query_id) LEFT JOIN j ON j.query_id = r.query_id AND j.doc_id = r.doc_id),
v AS (SELECT *, (sum(grade) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING))::BIGINT AS gained FROM c),
u AS MATERIALIZED (SELECT *, gained / rank AS prec, gained / num_rel AS rec, max(gained / rank) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM v),
k AS MATERIALIZED (SELECT query_id, count(*) AS num_ret, num_rel, max(gained) AS rel_ret, round(sum(CASE WHEN grade > 0 THEN grade * (1 + gained - grade) / rank ELSE 0 END) / num_rel, 6) AS avg_prec,
  round(CASE WHEN num_rel > count(*) THEN max(gained) / num_rel ELSE max(CASE WHEN rank = num_rel THEN prec END) END, 6) AS r_prec,
  {", ".join(f"round(max(CASE WHEN rank <= {n} THEN gained END) / {n}, 6) AS p_{n}" for n in evaluation.CLASSIC_CUTOFFS)},
  {", ".join(f"round(coalesce(max(CASE WHEN rec >= {x}::DOUBLE THEN best END), 0), 6) AS ip_{round(x * 10)}" for x in evaluation.LEVELS)} FROM u GROUP BY query_id, num_rel)"""


@query(f"{_CLASSIC} SELECT * FROM k")
def eval_classic(spark, d):
    return _rounded(evaluation.classic(_run(spark, d), judgements(spark, d)))


@query(f"{_CLASSIC} SELECT count(*) AS topics, sum(num_ret)::BIGINT AS num_ret, sum(num_rel)::BIGINT AS num_rel, sum(rel_ret)::BIGINT AS rel_ret, round(avg(avg_prec), 5) AS avg_prec, round(avg(r_prec), 5) AS r_prec, round(avg(p_10), 5) AS p_10, round(avg(ip_5), 5) AS ip_5 FROM k")
def eval_classic_summary(spark, d):
    rows = evaluation.classic_summary(_rounded(evaluation.classic(_run(spark, d), judgements(spark, d))))
    return rows.select("topics", "num_ret", "num_rel", "rel_ret", *[F.round(c, 5).alias(c) for c in ("avg_prec", "r_prec", "p_10", "ip_5")])


@query(f"{_BEST} SELECT query_id || ' Q0 ' || doc_id || ' ' || rank || ' Exp' AS line FROM r")
def run_lines(spark, d):
    """Without the score, whose decimal form differs between engines."""
    line = run_line(F.col("query_id"), F.col("doc_id"), F.col("rank"), F.lit("@"))
    return _run(spark, d).select(F.replace(line, F.lit(" @ "), F.lit(" ")).alias("line"))


# -- learning --------------------------------------------------------------------------------------------------------------

_LTR = ("okapi_tf", "tf_idf", "bm25", "bm25_default", "lm_laplace", "lm_jelinek_mercer")


def _features(spark, d):
    table_ = settled(scoring.score_table(indexed(spark, d), terms(spark), _LTR))
    return learning.joined_features(table_.select("query_id", "doc_id", *[F.round(m, 6).alias(m) for m in _LTR]), judgements(spark, d))


@query(f"""{_MATCH}, {", ".join(sql_scores(m, out=f"s_{m}").replace(" + -1000 * (any_value(n) - sum(qtf))", "") for m in _LTR)}, {SQL_JUDGEMENTS},
k AS (SELECT query_id, doc_id FROM j UNION SELECT query_id, doc_id FROM s_bm25_default)
SELECT k.query_id, k.doc_id, {", ".join(f"coalesce(s_{m}.score, 0) AS {m}" for m in _LTR)}, coalesce(grade, 0)::INT AS label FROM k {" ".join(f"LEFT JOIN s_{m} ON s_{m}.query_id = k.query_id AND s_{m}.doc_id = k.doc_id" for m in _LTR)} LEFT JOIN j ON j.query_id = k.query_id AND j.doc_id = k.doc_id""")
def ltr_features(spark, d):
    return _features(spark, d)


@query()
def ltr_rerank(spark, d):
    rows = settled(_features(spark, d))
    split = learning.query_split(rows, 1)
    rows = rows.join(F.broadcast(split), "query_id")  # a row per query
    model = learning.ols(rows.where("split = 'train'"), list(_LTR))
    return learning.reranked(learning.predict(model, rows.where("split = 'test'"), list(_LTR)))


_ONE = f"""{_BEST}, {SQL_JUDGEMENTS}, x AS MATERIALIZED (SELECT coalesce(r.query_id, j.query_id) AS query_id, coalesce(r.doc_id, j.doc_id) AS doc_id, coalesce(score, 0.0)::DOUBLE AS s, coalesce(grade, 0)::DOUBLE AS label FROM r FULL JOIN j ON r.query_id = j.query_id AND r.doc_id = j.doc_id),
a AS (SELECT regr_slope(label, s) AS m, regr_intercept(label, s) AS b FROM x WHERE query_id IN (1, 2)), p AS (SELECT query_id, doc_id, round(b + m * s, 6) AS score FROM x, a WHERE query_id NOT IN (1, 2)), {sql_ranked("p", "o", None)} SELECT * FROM o"""


@query(_ONE)
def ltr_rerank_one(spark, d):
    """One feature, so that SQL's regression functions give the same line; topics 1 and 2 train."""
    run = _run(spark, d).select("query_id", "doc_id", F.col("score").alias("bm25_default"))
    rows = settled(learning.joined_features(run, judgements(spark, d)))
    model = learning.ols(rows.where("query_id IN (1, 2)"), ["bm25_default"])
    found = learning.predict(model, rows.where("query_id NOT IN (1, 2)"), ["bm25_default"])
    return learning.reranked(found.withColumn("predicted", F.round("predicted", 6)))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < 0.8 * count(*) OVER () THEN 'train' ELSE 'test' END AS split FROM documents")
def place_split(spark, d):
    return split_by_place(table(spark, d, "documents").select("doc_id"), ["doc_id"])


@query("SELECT query_id, CASE WHEN row_number() OVER (ORDER BY md5('42' || query_id), query_id) <= 2 THEN 'test' ELSE 'train' END AS split FROM (VALUES (1), (2), (3), (4)) v(query_id)")
def query_split(spark, d):
    return learning.query_split(terms(spark), 2)


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT < 3435973836 THEN 'train' ELSE 'test' END AS split FROM documents")
def row_split(spark, d):
    return table(spark, d, "documents").select("doc_id", split_by_hash(F.col("doc_id")).alias("split"))


@query(f"WITH {SQL_MAILS} SELECT doc_id, {', '.join(f"list_contains(tokens, '{w}')::INT AS f_{w}" for w in FEATURES)} FROM m")
def spam_presence(spark, d):
    return learning.word_features(mails(spark, d), list(FEATURES))


@query(f"WITH {SQL_MAILS} SELECT doc_id, {', '.join(f"list_contains(tokens, '{w}')::INT AS f_{w}" for w in dict.fromkeys(learning.SPAM_WORDS))} FROM m")
def spam_word_list(spark, d):
    """The fixed list of spam words."""
    return learning.word_features(mails(spark, d))


@query()
def spam_coefficients(spark, d):
    """The ten words of largest weight in the logistic model."""
    m = mails(spark, d).where("split = 'train'")
    words = learning.vectoriser(m)
    model = learning.classifier("logistic", m.count()).fit(words.transform(m))
    return spark.createDataFrame(learning.coefficients(model, words.vocabulary), "word string, weight double")


@query(f"WITH {SQL_MAILS} SELECT doc_id, {', '.join(f"len(list_filter(tokens, lambda x: x = '{w}'))::INT AS f_{w}" for w in FEATURES)} FROM m")
def spam_counts(spark, d):
    return learning.word_features(mails(spark, d), list(FEATURES), counts=True)


@query(f"WITH {SQL_MAILS}, a AS (SELECT list_contains(tokens, 'the')::INT AS x, label::DOUBLE AS y, split FROM m), b AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM a WHERE split = 'train') SELECT doc_id, round(i + s * list_contains(tokens, 'the')::INT, 6) AS predicted, (i + s * list_contains(tokens, 'the')::INT > 0.5)::INT AS spam FROM m, b")
def spam_ols(spark, d):
    """One feature, so that SQL's regression functions give the same line."""
    m = mails(spark, d)
    rows = m.select("doc_id", "split", F.array_contains("tokens", "the").cast("double").alias("f_the"), F.col("label").cast("double").alias("label"))
    out = learning.predict(learning.ols(rows.where("split = 'train'"), ["f_the"]), rows, ["f_the"])
    return out.select("doc_id", F.round("predicted", 6).alias("predicted"), learning.threshold(F.col("predicted")).alias("spam"))


_BAYES = f"""WITH {SQL_MAILS}, x AS MATERIALIZED (SELECT doc_id, label, split, unnest(tokens) AS term FROM m), n AS (SELECT label, term, count(*) AS n FROM x WHERE split = 'train' GROUP BY ALL),
v AS (SELECT DISTINCT term FROM n), p AS (SELECT label, ln(count(*) / (SELECT count(*) FROM m WHERE split = 'train')) AS log_prior, (SELECT sum(n) FROM n WHERE n.label = m.label) AS total FROM m WHERE split = 'train' GROUP BY label),
l AS MATERIALIZED (SELECT p.label, v.term, ln((coalesce(n, 0) + 1) / (total + (SELECT count(*) FROM v)))::DOUBLE AS log_prob FROM v CROSS JOIN p LEFT JOIN n ON n.label = p.label AND n.term = v.term),
s AS MATERIALIZED (SELECT m.doc_id, p.label, any_value(p.log_prior) + coalesce(sum(log_prob), 0) AS score FROM m CROSS JOIN p LEFT JOIN x ON x.doc_id = m.doc_id LEFT JOIN l ON l.term = x.term AND l.label = p.label WHERE m.split = 'test' GROUP BY m.doc_id, p.label)"""


def _bayes(spark, d):
    m = mails(spark, d)
    return m, learning.bayes_scores(learning.bayes_table(m.where("split = 'train'")), m.where("split = 'test'"))


@query(f"{_BAYES} SELECT doc_id, label, round(score, 4) AS score FROM s")
def nb_multinomial(spark, d):
    return _bayes(spark, d)[1].select("doc_id", "label", F.round("score", 4).alias("score"))


@query(f"""{_BAYES}, o AS (SELECT doc_id, arg_max(label, score) AS predicted FROM s GROUP BY doc_id), z AS (SELECT m.label, predicted FROM o JOIN m USING (doc_id)),
c AS (SELECT c AS class, (SELECT count(*) FROM z WHERE predicted = c) AS np, (SELECT count(*) FROM z WHERE label = c) AS support, (SELECT count(*) FROM z WHERE label = c AND predicted = c) AS h FROM (SELECT label AS c FROM z UNION SELECT predicted FROM z)),
e AS (SELECT class::VARCHAR AS class, CASE WHEN np > 0 THEN h / np ELSE 0 END AS precision, CASE WHEN support > 0 THEN h / support ELSE 0 END AS recall, CASE WHEN np + support > 0 THEN 2 * h / (np + support) ELSE 0 END AS f1, support, h FROM c),
f AS (SELECT class, precision, recall, f1, support FROM e UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM e UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM e UNION ALL SELECT 'accuracy', sum(h) / sum(support), NULL, NULL, sum(support)::BIGINT FROM e)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f""")
def classification_report(spark, d):
    m, scores = _bayes(spark, d)
    return _rounded(learning.classification_report(learning.bayes_labels(scores).join(m.select("doc_id", "label"), "doc_id")))


@query(f"WITH {_DOC}, a AS (SELECT dl AS s, toxic AS y FROM t JOIN labels USING (doc_id)) SELECT round(sum(CASE WHEN p.s > n.s THEN 1 WHEN p.s = n.s THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS auc FROM (SELECT s FROM a WHERE y = 1) p, (SELECT s FROM a WHERE y <> 1) n")
def roc_auc(spark, d):
    rows = corpus(spark, d).select("doc_id", F.col("dl").alias("score")).join(table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    return learning.roc_auc(rows).select(F.round("auc", 6).alias("auc"))


def _spam_model(kind: str):
    def run(spark, d):
        m = mails(spark, d)
        train = m.where("split = 'train'")
        words = learning.vectoriser(train)
        model = learning.classifier(kind, train.count()).fit(words.transform(train))
        return learning.probabilities(model.transform(words.transform(m.where("split = 'test'"))))

    query(None, f"spam_{kind}")(run)


for _k in ("tree", "logistic"):
    _spam_model(_k)


# -- events ----------------------------------------------------------------------------------------------------------------


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", "event_windows")
def _event_windows(spark, d):
    rows = event_windows(table(spark, d, "events"))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


from quarry.plans import round_trips  # noqa: E402, F401  registers more queries
