"""Query expansion by pseudo-relevance feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import index, scoring, search
from quarry.operators.lineage import settled


def feedback_terms(tokenised: DataFrame | index.Index, terms: DataFrame, top_docs: int = 10, n_terms: int = 5) -> DataFrame:
    """(query_id, term, df, ttf, rank): terms of each query's best documents.

    A term's collection df and ttf are added once per best document that holds it; most df first, then least ttf, then
    by term. Only the best documents' tokens are counted per query; statistics are joined for their terms alone.
    """
    source = index.opened(tokenised)
    best = settled(search.match(source, terms, top_docs).select("query_id", "doc_id"))  # a few rows a query
    inside = source.documents(best).select("doc_id", F.explode(F.array_distinct("tokens")).alias("term"))
    found = settled(best.join(inside, "doc_id").groupBy("query_id", "term").agg(F.count("*").alias("docs")))
    stats = source.vocabulary(found)
    rows = found.join(stats, "term").select("query_id", "term", (F.col("docs") * F.col("df")).alias("df"), (F.col("docs") * F.col("cf")).alias("ttf"))
    w = Window.partitionBy("query_id").orderBy(F.desc("df"), "ttf", "term")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_terms)


def significant_terms(tokenised: DataFrame | index.Index, terms: DataFrame, k: int = 5, min_docs: int = 3, agreeing: int = 2) -> DataFrame:
    """(query_id, term, votes, rank): terms that several of a query's terms suggest.

    Each query term suggests the ``k`` terms whose share among its documents exceeds that in the corpus most, by
    (f - b) f / b with f and b the two shares, from at least ``min_docs`` documents. Kept are terms with ``agreeing``
    votes or more, in order of the first term and place that suggests them, ``k`` at most.
    """
    source = index.opened(tokenised)
    asked = [r["term"] for r in terms.select("term").distinct().limit(index.LITERALS + 1).collect()]
    if len(asked) <= index.LITERALS and index.once(source.forward, ["doc_id"]):  # a document's own row tells all
        held = F.array_intersect("tokens", F.array(*[F.lit(t) for t in asked]).cast("array<string>"))
        rows = source.forward.select(held.alias("held"), F.array_distinct("tokens").alias("tokens")).where(F.size("held") > 0)
        sizes = rows.select(F.explode("held").alias("asked")).groupBy("asked").agg(F.count("*").alias("n_front"))
        both = rows.select("held", F.explode("tokens").alias("term")).select(F.explode("held").alias("asked"), "term")
    else:
        front = source.postings(terms).select("doc_id", F.col("term").alias("asked"))
        sizes = front.groupBy("asked").agg(F.count("*").alias("n_front"))
        both = front.join(source.forward.select("doc_id", F.explode(F.array_distinct("tokens")).alias("term")), "doc_id")
    both = both.groupBy("asked", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= min_docs)
    df = source.vocabulary().select("term", "df")
    n = F.broadcast(source.statistics(False).select("n_docs"))  # one row
    f, b = F.col("n_both") / F.col("n_front"), F.col("df") / F.col("n_docs")
    scored = both.join(sizes, "asked").join(df, "term").crossJoin(n).withColumn("jlh", F.round((f - b) * (f / b), 9)).where(f > b)
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("jlh"), "term"))
    best = scored.withColumn("place", place).where(F.col("place") <= k).select("asked", "term", "place")
    votes = terms.select("query_id", F.col("term").alias("asked"), "first").join(best, "asked")
    kept = votes.groupBy("query_id", "term").agg(F.count("*").alias("votes"), F.min(F.struct("first", "place")).alias("seen")).where(F.col("votes") >= agreeing)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("seen", "term"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "term", "votes", "rank")


def expanded(terms: DataFrame, extra: DataFrame) -> DataFrame:
    """Query terms with the expansion's added, each once more."""
    one = terms.select("query_id", "term", "qtf", "first").unionByName(extra.select("query_id", "term", F.lit(1).alias("qtf"), (F.lit(1000) + F.col("rank")).alias("first")))
    rows = one.groupBy("query_id", "term").agg(F.sum("qtf").cast("int").alias("qtf"), F.min("first").alias("first"))
    return rows.join(rows.groupBy("query_id").agg(F.sum("qtf").cast("int").alias("n")), "query_id")


def rerun(tokenised: DataFrame | index.Index, terms: DataFrame, extra: DataFrame, model: str = "bm25_default", most: int = 1000, digits: int | None = None) -> DataFrame:
    """The ranking of the expanded queries. The expansion, a few rows per query, is computed once."""
    return scoring.ranked(scoring.scores(tokenised, settled(expanded(terms, extra)), model), most, digits)
