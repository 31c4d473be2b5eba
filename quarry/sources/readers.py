"""Readers: SGML news and crawl files, word lists, topics, judgements, runs, link files, mail, metric reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.functions.text import clean_mail


def _lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    if encoding.upper() in ("UTF-8", "UTF8"):
        return spark.read.text(path)
    # one column read as CSV, which knows other encodings; the separator and quotes never occur in text
    return spark.read.schema("value string").option("encoding", encoding).option("sep", "\u0001").option("quote", "\u0000").option("escape", "\u0000").option("comment", "").csv(path)


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with their place: file, then order inside it. Ids grow along a file, which the reader never reorders."""
    return lines.withColumn("line", F.monotonically_increasing_id())


def documents(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", blocks: str = "last", skip: str | None = "readme") -> DataFrame:
    """(doc_id, text) of SGML files in a folder: <DOC>, <DOCNO>, <TEXT> blocks.

    ``blocks``: "last" keeps the last text block of a document, "all" joins them by a space. Files called ``skip`` are
    passed over. Of documents with one number the last text by file and place stays. Whole files are read, so files
    should be of a size that a task can hold; documents without number are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if skip:
        files = files.where(~F.lower(F.element_at(F.split("path", "/"), -1)).contains(skip))
    docs = files.select("path", F.posexplode(F.regexp_extract_all(F.decode("content", encoding), F.lit(r"(?s)<DOC>(.*?)</DOC>"), F.lit(1))).alias("at", "doc"))
    texts = F.transform(F.regexp_extract_all("doc", F.lit(r"(?s)<TEXT>(.*?)</TEXT>"), F.lit(1)), F.trim)
    body = F.coalesce(F.element_at(F.when(F.size(texts) > 0, texts), -1), F.lit("")) if blocks == "last" else F.array_join(texts, " ")
    rows = docs.select(F.trim(F.regexp_extract("doc", r"<DOCNO>\s*(\S+)\s*</DOCNO>", 1)).alias("doc_id"), body.alias("text"), "path", "at").where("doc_id <> ''")
    return rows.groupBy("doc_id").agg(F.max_by("text", F.struct("path", "at")).alias("text"))


def crawled(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, url, title, text) of crawl files: DOCNO holds the URL, HEAD the title; doc_id is the URL's SHA-256."""
    files = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<DOC>(.*?)</DOC>"), F.lit(1))).alias("value"))
    part = lambda tag: F.trim(F.regexp_extract("value", rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    return files.select(part("DOCNO").alias("url"), part("HEAD").alias("title"), part("TEXT").alias("text")).where("url <> ''").select(F.sha2("url", 256).alias("doc_id"), "url", "title", "text")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(term): one word a line or between white space, lower case, each once."""
    return _lines(spark, path).select(F.explode(F.split(F.lower(F.trim("value")), r"\s+")).alias("term")).where("term <> ''").distinct()


def stem_classes(spark: SparkSession, path: str) -> DataFrame:
    """(word, root) from ``root | word word ...`` lines; lines of another form, the header among them, are passed over."""
    parts = F.split("value", r" \| ")
    # the root is cut out below the explode: above it, every word would carry its line and split it anew
    rows = _lines(spark, path).where(F.size(parts) == 2).select(F.trim(parts[0]).alias("root"), F.split(F.trim(parts[1]), r"\s+").alias("words"))
    return rows.select(F.explode("words").alias("word"), "root")


def topics(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) from ``51.   text`` lines."""
    number, text = F.regexp_extract("value", r"^\s*(\d+)\s*\.\s+(.*)$", 1), F.regexp_extract("value", r"^\s*(\d+)\s*\.\s+(.*)$", 2)
    return _lines(spark, path).where(number != "").select(number.cast("int").alias("query_id"), F.trim(text).alias("text"))


def _fields(spark: SparkSession, path: str, size: int, across_lines: bool) -> DataFrame:
    """(p, at): fields between white space in groups of ``size``, and when they were written (file time, file, order).

    Groups are lines of so many fields, or with ``across_lines`` every ``size`` fields of a whole file, wherever its lines
    end; what is left at its end is passed over.
    """
    if not across_lines:
        lines = _numbered(spark.read.text(path).select("value", "_metadata.file_modification_time", "_metadata.file_path"))
        rows = lines.select(F.split(F.trim("value"), r"\s+").alias("p"), F.struct("file_modification_time", "file_path", "line").alias("at"))
        return rows.where(F.size("p") == size)
    files = spark.read.text(path, wholetext=True).select("value", "_metadata.file_modification_time", "_metadata.file_path")
    words = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    n = F.floor(F.size("w") / size).cast("int")
    groups = files.withColumn("w", words).where(F.size("w") >= size).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("line"))
    return groups.select(F.slice("w", F.col("line") * size + 1, size).alias("p"), F.struct("file_modification_time", "file_path", "line").alias("at"))


def judgements(spark: SparkSession, path: str, across_lines: bool = False) -> DataFrame:
    """(query_id, doc_id, grade) from groups of four fields; of repeated pairs the last by file time and place stays.

    Lines of another form are passed over; ``across_lines``: see ``_fields``.
    """
    p = F.col("p")
    rows = _fields(spark, path, 4, across_lines).select(p[0].alias("query_id"), p[2].alias("doc_id"), p[3].try_cast("int").alias("grade"), "at").where("grade is not null")
    return rows.groupBy("query_id", "doc_id").agg(F.max_by("grade", "at").alias("grade"))


def run(spark: SparkSession, path: str, across_lines: bool = False) -> DataFrame:
    """(query_id, doc_id, rank, score, tag) from groups of six fields; of repeated pairs the last stays, as for judgements."""
    p = F.col("p")
    rows = _fields(spark, path, 6, across_lines).select(p[0].alias("query_id"), p[2].alias("doc_id"), F.struct(p[3].try_cast("int").alias("rank"), p[4].try_cast("double").alias("score"), p[5].alias("tag")).alias("x"), "at")
    return rows.groupBy("query_id", "doc_id").agg(F.max_by("x", "at").alias("x")).select("query_id", "doc_id", "x.*")


def adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(page, links) from ``page link link ...`` lines; repeated links stay repeated, pages without links have none."""
    p = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).where(F.trim("value") != "").select(p[0].alias("page"), F.slice(p, 2, F.size(p)).alias("links"))


def edges(adjacent: DataFrame, links_in: bool = False) -> DataFrame:
    """(src, dst) of an adjacency table; ``links_in``: the lists hold sources. Lists without links give no edge."""
    pairs = adjacent.select("page", F.explode("links").alias("other"))
    return pairs.select(F.col("other").alias("src"), F.col("page").alias("dst")) if links_in else pairs.select(F.col("page").alias("src"), F.col("other").alias("dst"))


def link_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, links) from ``key: a, b`` lines."""
    key, rest = F.regexp_extract("value", r"^(.*?): ?(.*)$", 1), F.regexp_extract("value", r"^(.*?): (.*)$", 2)
    return _lines(spark, path).where(key != "").select(key.alias("key"), F.filter(F.split(F.trim(rest), ", "), lambda x: x != "").alias("links"))


def document_links(spark: SparkSession, path: str) -> DataFrame:
    """(file, in_links, out_links) from ``Inlinks:a b, Outlinks:c d`` files."""
    part = lambda p: F.filter(F.split(F.trim(F.regexp_extract("value", p, 1)), r"\s+"), lambda x: x != "")
    files = spark.read.text(path, wholetext=True).select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    return files.select("file", part(r"(?s)Inlinks:(.*?)(?:, ?Outlinks:|$)").alias("in_links"), part(r"(?s)Outlinks:(.*)$").alias("out_links"))


def mail_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, label) from ``spam ../data/inmail.1`` lines; a label is spam or ham."""
    p = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).where(F.size(p) == 2).select(F.regexp_extract(p[1], r"/(\w+\.\w+)$", 1).alias("file"), F.when(F.lower(p[0]) == "spam", "spam").otherwise("ham").alias("label"))


def _payload(message) -> str:
    if message.is_multipart():
        return "".join(_payload(p) for p in message.get_payload())
    return message.get_payload()


def mails(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(file, text): the parts of each MIME mail joined as they stand, then ``clean_mail``."""
    from email.parser import Parser

    @F.pandas_udf("string")
    def body(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: _payload(Parser().parsestr(x.decode(encoding, "replace"))))

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), clean_mail(body("content")).alias("text"))


def mail_id(file: Column) -> Column:
    """A mail's id: its file name without the first seven characters (``inmail.``)."""
    return F.substring(file, 8, 1 << 30)


def index_text(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, cf, postings) from ``term: {json}`` lines, plain or compressed."""
    kind = "DF long, CF long, Postings array<struct<doc_id: long, tf: int, pos: array<int>>>"
    body = F.from_json(F.regexp_extract("value", r"^.*?: (\{.*\})$", 1), kind)
    rows = _lines(spark, path).select(F.regexp_extract("value", r"^(.*?): \{", 1).alias("term"), body.alias("x"))
    return rows.select("term", F.col("x.DF").alias("df"), F.col("x.CF").alias("cf"), F.col("x.Postings").alias("postings"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, header) from ``id<tab>header`` lines."""
    p = F.split("value", "\t", 2)
    return _lines(spark, path).where(F.size(p) == 2).select(p[0].alias("doc_id"), p[1].alias("header"))


def json_records(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines; with a schema nothing is inferred."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """(metric, cutoff, value) from ``Precision@5: 0.4`` lines of a report."""
    form = r"^\s*([A-Za-z1 -]+?)(?:@(\d+))?:\s*([0-9.]+)\s*$"
    get = lambda i: F.regexp_extract("value", form, i)
    return _lines(spark, path).where(get(1) != "").select(get(1).alias("metric"), F.when(get(2) != "", get(2)).cast("int").alias("cutoff"), get(3).try_cast("double").alias("number")).withColumnRenamed("number", "value")


def split_by_hash(key: Column, share: float = 0.8, seed: str = "") -> Column:
    """"train" or "test" by an MD5 of the key, so reruns and other engines agree."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.when(h < F.lit(int(share * 2**32)), "train").otherwise("test")


def split_by_place(rows: DataFrame, order: list[str], share: float = 0.8) -> DataFrame:
    """``rows`` with split: "train" for the first ``share`` of them in the given order, which tells all rows apart.

    Rows are numbered in ranges, so no task sorts them all.
    """
    from quarry.operators.index import dense_ids

    numbered = dense_ids(rows, order, "__at")
    n = F.broadcast(rows.agg(F.count("*").alias("__all")))  # one row
    split = F.when(F.col("__at") - 1 < F.lit(share) * F.col("__all"), "train").otherwise("test")
    return numbered.crossJoin(n).withColumn("split", split).drop("__at", "__all")


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
