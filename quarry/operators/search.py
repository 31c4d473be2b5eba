"""Search requests: matching, phrases, several fields, pages of results, snippets, completion; judgements as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import index, scoring


def match(tokenised: DataFrame | index.Index, terms: DataFrame, most: int = 1000) -> DataFrame:
    """The ``most`` best documents of each query that hold any of its terms."""
    return scoring.ranked(scoring.scores(tokenised, terms, "bm25_default"), most)


def documents_of(tokenised: DataFrame, term: str) -> DataFrame:
    """(doc_id, tf) of the documents that hold a term; decided row by row."""
    tf = F.size(F.filter("tokens", lambda t: t == term)).alias("tf")
    return tokenised.where(F.array_contains("tokens", term)).select("doc_id", tf)


def phrase(tokenised: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, hits): documents with the words in a row; decided row by row. An empty phrase matches nothing."""
    if not words:
        return tokenised.where("false").select("doc_id", F.lit(0).alias("hits"))
    t = F.col("tokens")
    same = lambda x, i: (x == words[0]) & F.coalesce(F.slice(t, i + 1, len(words)) == index.literal_terms(words), F.lit(False))
    hits = F.size(F.filter(F.transform(t, same), lambda y: y))
    return tokenised.where(F.array_contains(t, words[0])).select("doc_id", hits.alias("hits")).where("hits > 0")


def best_fields(fields: list[DataFrame], terms: DataFrame, most: int | None = None) -> DataFrame:
    """Documents ranked by the larger of their scores in several tokenised fields, each with statistics of its own."""
    rows = [scoring.scores(f, terms, "bm25_default") for f in fields]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    return scoring.ranked(union.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), most)


def page(ranked: DataFrame, number: int, size: int = 10) -> DataFrame:
    """Results ``number`` x ``size`` + 1 and following (pages from 0)."""
    return ranked.where((F.col("rank") > number * size) & (F.col("rank") <= (number + 1) * size))


def snippet(text: Column, words: list[str], width: int = 100) -> Column:
    """The text around the first of the words, in any case of letters, all words marked; '' if none is there."""
    if not words:
        return F.lit("")
    places = [F.when(F.locate(w.lower(), F.lower(text)) > 0, F.locate(w.lower(), F.lower(text))) for w in words]
    first = F.least(*places) if len(places) > 1 else places[0]
    part = F.substring(text, F.greatest(first - width // 2, F.lit(1)), F.lit(width))
    for w in words:
        part = F.regexp_replace(part, "(?i)(" + "".join("\\" + c if not c.isalnum() else c for c in w) + ")", "<em>$1</em>")
    return F.when(first.isNotNull(), part).otherwise("")


def complete(fields: DataFrame, prefix: str, most: int = 5) -> DataFrame:
    """(doc_id, title): the first ``most`` documents, by id, with a term of title or text that starts with the prefix."""
    starts = lambda c: F.exists(c, lambda t: t.startswith(prefix.lower()))
    return fields.where(starts("title_tokens") | starts("tokens")).orderBy("doc_id").limit(most).select("doc_id", "title")


def search(tokenised: DataFrame | index.Index, terms: DataFrame, documents: DataFrame, number: int, words: list[str], size: int = 10) -> DataFrame:
    """A page of results with titles and snippets."""
    hits = page(match(tokenised, terms), number, size)
    return hits.join(documents, "doc_id").select("query_id", "rank", "doc_id", "score", "title", snippet(F.col("text"), words).alias("snippet"))


def assess(judgements: DataFrame, new: DataFrame) -> DataFrame:
    """Judgements with new ones added; of a pair judged again the new grade holds, of new ones for a pair the largest."""
    rows = judgements.withColumn("__new", F.lit(0)).unionByName(new.select(*judgements.columns).withColumn("__new", F.lit(1)))
    return rows.groupBy("query_id", "doc_id").agg(F.max(F.struct("__new", "grade"))["grade"].alias("grade"))


def upsert(table: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """``table`` with the rows of ``new`` in place of those of the same key."""
    return table.join(new.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def first_rows(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
