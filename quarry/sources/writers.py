"""Writers: runs, judgements, link files, graph reports, indexes, predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_line(query_id: Column, doc_id: Column, rank: Column, score: Column, tag: str = "Exp") -> Column:
    return F.concat_ws(" ", query_id.cast("string"), F.lit("Q0"), doc_id.cast("string"), rank.cast("string"), score.cast("string"), F.lit(tag))


def write_run(ranked: DataFrame, path: str, most: int = 1000, tag: str = "Exp", mode: str = "overwrite", constant_rank: bool = False) -> None:
    """Six-field lines of ranks up to ``most``, sorted by query and rank within each file.

    ``constant_rank``: every line says rank 1, for evaluators that go by the score.
    """
    rows = ranked.where(F.col("rank") <= most).repartitionByRange("query_id", "rank").sortWithinPartitions("query_id", "rank")
    rank = F.lit(1) if constant_rank else F.col("rank")
    rows.select(run_line(F.col("query_id"), F.col("doc_id"), rank, F.col("score"), tag)).write.mode(mode).text(path)


def append_judgements(rows: DataFrame, path: str, assessor: str = "assessor") -> None:
    """Adds ``query assessor doc grade`` lines; readers take the last grade of a pair."""
    rows.select(F.concat_ws(" ", F.col("query_id").cast("string"), F.lit(assessor), F.col("doc_id").cast("string"), F.col("grade").cast("string"))).write.mode("append").text(path)


def write_adjacency(edges: DataFrame, path: str) -> None:
    """``page link link ...`` lines, links in order."""
    lists = edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("links"))
    lists.select(F.concat_ws(" ", F.col("src").cast("string"), F.array_join(F.col("links").cast("array<string>"), " "))).write.mode("overwrite").text(path)


def write_link_map(adjacent: DataFrame, path: str) -> None:
    adjacent.select(F.concat("key", F.lit(": "), F.array_join("links", ", "))).write.mode("overwrite").text(path)


def write_crawled(pages: DataFrame, path: str) -> None:
    """One SGML record a page (url, title, text)."""
    tag = lambda t, c: F.concat(F.lit(f"<{t}>"), F.coalesce(F.col(c), F.lit("")), F.lit(f"</{t}>\n"))
    pages.select(F.concat(F.lit("<DOC>\n"), tag("DOCNO", "url"), tag("HEAD", "title"), tag("TEXT", "text"), F.lit("</DOC>"))).write.mode("overwrite").text(path)


def write_news(documents: DataFrame, path: str, blocks: list[str]) -> None:
    """SGML records of doc_id with one text block for each of the named columns."""
    texts = [F.concat(F.lit("<TEXT>\n"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n</TEXT>\n")) for c in blocks]
    documents.select(F.concat(F.lit("<DOC>\n<DOCNO> "), F.col("doc_id").cast("string"), F.lit(" </DOCNO>\n"), *texts, F.lit("</DOC>"))).write.mode("overwrite").text(path)


def write_headers(rows: DataFrame, path: str) -> None:
    """``id<tab>header`` lines; line breaks in a header become spaces."""
    rows.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.regexp_replace("header", r"[\r\n]+", " "))).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines, as ``json_records`` reads them; nulls are left out."""
    rows.write.mode("overwrite").json(path)


def graph_line(page: Column, rank: Column, n_out: Column, n_in: Column, width: int = 40) -> Column:
    """Fixed-width report line: page, score with 16 decimals, numbers of out- and in-links."""
    fixed = lambda c, n: F.rpad(c.cast("string"), n, " ")
    return F.concat(fixed(page, width), fixed(F.format_string("%.16f", rank), 25), fixed(n_out, 12), n_in.cast("string"))


def write_top_pages(ranks: DataFrame, path: str, most: int = 500) -> None:
    """The ``most`` best pages (page, rank, n_out, n_in) as fixed-width lines, best first."""
    top = ranks.orderBy(F.desc("rank"), "page").limit(most)
    top.select(graph_line(F.col("page"), F.col("rank"), F.col("n_out"), F.col("n_in"))).write.mode("overwrite").text(path)


def write_scores(scores: DataFrame, path: str, by: str, most: int = 500) -> None:
    """The ``most`` best (page, score) rows, tab separated."""
    scores.orderBy(F.desc(by), "page").limit(most).select("page", by).write.mode("overwrite").option("sep", "\t").csv(path)


def write_index(postings: DataFrame, path: str, partitions: int | None = None) -> None:
    """Postings as Parquet, dealt and sorted by term, so that a term's lookup prunes row groups."""
    dealt = postings.repartitionByRange(partitions, "term") if partitions else postings.repartitionByRange("term")
    dealt.sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def write_index_text(postings: DataFrame, path: str, compression: str = "gzip", dealt: bool = False) -> None:
    """``term: {json}`` lines with df, cf and postings, in order. ``dealt``: the lists come in ranges of terms already."""
    body = F.to_json(F.struct(F.col("df").alias("DF"), F.col("cf").alias("CF"), F.col("postings").alias("Postings")))
    rows = postings if dealt else postings.repartitionByRange("term")
    rows.sortWithinPartitions("term").select(F.concat("term", F.lit(": "), body)).write.mode("overwrite").option("compression", compression).text(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    """(id, probability with five decimals), highest first."""
    rows.orderBy(F.desc("probability"), "id").select("id", F.format_string("%.5f", F.col("probability")).alias("probability")).write.mode("overwrite").option("header", True).csv(path)


def write_documents(rows: DataFrame, path: str, key: str | None = None, required: list[str] = ()) -> tuple[int, int]:
    """Drop and recreate a table of documents; returns how many rows were written and how many not.

    With ``key`` a row's id is that column's SHA-256. Rows that lack a ``required`` column are not written.
    """
    out = rows.withColumn("_id", F.sha2(F.col(key).cast("string"), 256)) if key else rows
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull()
    out.where(whole).write.mode("overwrite").parquet(path)
    done = rows.sparkSession.read.schema(out.schema).parquet(path).count()
    return done, rows.count() - done


def folder_size(spark, path: str) -> tuple[int, float]:
    """Number of data files and their megabytes under a path, from Spark's file system layer."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed, n, size = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), 0, 0
    while listed.hasNext():
        f = listed.next()
        if not f.getPath().getName().startswith(("_", ".")):
            n, size = n + 1, size + f.getLen()
    return n, size / 1048576
