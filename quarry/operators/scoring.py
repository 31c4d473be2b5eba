"""Ranked retrieval: one join of query terms with documents, and the models as expressions over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import index

PENALTY = -1000.0


def query_terms(queries: DataFrame, analyse=text.analyse_query) -> DataFrame:
    """(query_id, term, qtf, first, n): distinct terms with how often and where first, and the query's number of tokens."""
    tokens = queries.select("query_id", analyse(F.col("text")).alias("tokens"))
    rows = tokens.select("query_id", F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "term"))
    return rows.groupBy("query_id", "n", "term").agg(F.count("*").cast("int").alias("qtf"), F.min("pos").alias("first"))


def matches(source: DataFrame | index.Index, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, dl, term, qtf, n, tf, df, ttf): every query term in every document that holds it.

    From an index, whose lookups read the asked terms only, or from tokenised documents.
    """
    found = index.opened(source)
    stats = found.vocabulary(terms).select("term", "df", F.col("cf").alias("ttf"))
    return found.postings(terms).select("doc_id", "dl", "term", "tf").join(stats.join(terms, "term"), "term")


def okapi(tf: Column, dl: Column, avgdl: Column) -> Column:
    return F.when(avgdl > 0, tf / (tf + 0.5 + 1.5 * dl / avgdl)).otherwise(0.0)


def bm25_term(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column, k1: float, b: float = 0.75, k2: float = 100.0) -> Column:
    idf = F.ln((n + 0.5) / (df + 0.5))
    return idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / avgdl)) * (tf * (k2 + 1)) / (tf + k2)


def bm25_default_term(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + k1 * (1 - b + b * dl / avgdl))


def _models() -> dict[str, tuple[Column, bool, bool]]:
    """Model -> (score of one occurrence of a query term, are absent terms penalised, does it need the vocabulary)."""
    tf, df, dl, n, avgdl, ttf = (F.col(c) for c in ("tf", "df", "dl", "n_docs", "avgdl", "ttf"))
    bm25 = bm25_term(tf, df, dl, n, avgdl, 1.2)
    return {
        "okapi_tf": (okapi(tf, dl, avgdl), False, False),
        "tf_idf": (okapi(tf, dl, avgdl) * F.ln(n / df), False, False),
        "bm25_penalised": (F.when(bm25 == 0, PENALTY).otherwise(bm25), True, False),
        "bm25": (bm25_term(tf, df, dl, n, avgdl, 1.5), False, False),
        "bm25_default": (bm25_default_term(tf, df, dl, n, avgdl), False, False),
        "lm_laplace": (F.ln((tf + 1) / (dl + F.col("vocab"))), True, True),
        "lm_jelinek_mercer": (F.ln(0.5 * tf / dl + 0.5 * ttf / F.col("total")), True, False),
    }


MODELS = ("okapi_tf", "tf_idf", "bm25_penalised", "bm25", "bm25_default", "lm_laplace", "lm_jelinek_mercer")


def scores(tokenised: DataFrame | index.Index, terms: DataFrame, model: str = "bm25", candidates: DataFrame | None = None, penalise: bool | None = None) -> DataFrame:
    """(query_id, doc_id, score) of the documents that hold a query term, by one of MODELS.

    Terms count as often as the query repeats them. Models that penalise absent terms charge PENALTY for each token of
    the query that a document lacks; as that is a count, no grid of documents and terms is built. Zero scores are
    dropped. ``candidates`` (query_id, doc_id) restricts what is scored, e.g. to the best of another model.
    """
    term_score, absent, vocabulary = _models()[model]
    absent = absent if penalise is None else penalise
    rows = matches(tokenised, terms)
    if candidates is not None:
        rows = rows.join(candidates.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    stats = F.broadcast(index.opened(tokenised).statistics(vocabulary))  # one row
    rows = rows.crossJoin(stats)
    total = F.sum(F.col("qtf") * term_score)
    if absent:
        total = total + PENALTY * (F.first("n") - F.sum("qtf"))
    return rows.groupBy("query_id", "doc_id").agg(total.alias("score")).where("score <> 0")


def score_table(tokenised: DataFrame | index.Index, terms: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """(query_id, doc_id, one column per model), without penalties for absent terms, all from one join and one sum."""
    own = {m: x for m, x in _models().items() if m in models}
    stats = F.broadcast(index.opened(tokenised).statistics(any(x[2] for x in own.values())))  # one row
    rows = matches(tokenised, terms).crossJoin(stats)
    return rows.groupBy("query_id", "doc_id").agg(*[F.sum(F.col("qtf") * own[m][0]).alias(m) for m in models])


def ranked(scored: DataFrame, most: int | None = 1000, digits: int | None = None) -> DataFrame:
    """(query_id, doc_id, rank, score), best first, ties to smaller ids; ``most`` per query are kept before the sort ends."""
    score = F.round("score", digits) if digits is not None else F.col("score")
    rows = scored.select("query_id", "doc_id", score.alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    out = rows.withColumn("rank", F.row_number().over(w))
    return (out.where(F.col("rank") <= most) if most else out).select("query_id", "doc_id", "rank", "score")


def rescored(tokenised: DataFrame | index.Index, terms: DataFrame, model: str, first: str = "bm25_default", most: int = 1000) -> DataFrame:
    """Two stages: the ``most`` best of one model are scored by another."""
    best = ranked(scores(tokenised, terms, first), most)
    return ranked(scores(tokenised, terms, model, candidates=best), most)


def _places(tokenised: DataFrame | index.Index, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, at): per query and document its query terms' places in order. A document's own length bounds it."""
    rows = index.opened(tokenised).postings(terms).select("doc_id", "term", F.explode("pos").alias("pos")).join(terms.select("query_id", "term"), "term")
    return rows.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("at"))


def proximity(tokenised: DataFrame | index.Index, terms: DataFrame, distance: int = 5) -> DataFrame:
    """(query_id, doc_id, score): 1 / (1 + mean distance) over pairs of different query terms at most ``distance`` apart.

    A place has one term, so a pair is at most ``distance`` entries apart in the sorted list: no pairs beyond are formed.
    """
    at = F.col("at")

    def ahead(k):
        gap = lambda x, i: F.when(F.get(at, i + k)["term"] != x["term"], F.get(at, i + k)["pos"] - x["pos"])
        return F.transform(at, gap)

    gaps = F.filter(F.flatten(F.array(*[ahead(k) for k in range(1, distance + 1)])), lambda d: d <= distance)
    rows = _places(tokenised, terms).select("query_id", "doc_id", gaps.alias("gaps")).where(F.size("gaps") > 0)
    mean = F.aggregate("gaps", F.lit(0).cast("long"), lambda a, d: a + d) / F.size("gaps")
    return rows.select("query_id", "doc_id", (1 / (mean + 1)).alias("score"))


def nearest_pair(tokenised: DataFrame | index.Index, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): 1 / smallest distance of two different query terms; 0 if a document lacks a term.

    The nearest two stand next to each other in the sorted places. Queries of one term score 0.
    """
    at = F.col("at")
    gaps = F.transform(at, lambda x, i: F.when(F.get(at, i + 1)["term"] != x["term"], F.get(at, i + 1)["pos"] - x["pos"]))
    count = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    rows = _places(tokenised, terms).join(count, "query_id")
    has_all = F.size(F.array_distinct(F.transform(at, lambda x: x["term"]))) == F.col("n_terms")
    return rows.select("query_id", "doc_id", F.when(has_all, F.coalesce(1 / F.array_min(gaps), F.lit(0.0))).otherwise(0.0).alias("score"))
