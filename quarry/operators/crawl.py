"""Crawl decisions as DataFrame operations: gates, visited pages, the frontier over waves, records of crawled pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import urls
from quarry.operators import index
from quarry.operators.lineage import settled


def visit_key(url: Column) -> Column:
    """What a URL is known by among visited ones: no scheme, lower case."""
    return F.lower(urls.without_scheme(url))


def unvisited(rows: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    """The rows whose URL is not among ``visited`` (url), whatever its scheme and case."""
    seen = visited.select(visit_key(F.col("url")).alias("__seen")).distinct()
    return rows.join(seen, visit_key(F.col(url)) == F.col("__seen"), "left_anti")


def fetched_html(responses: DataFrame) -> DataFrame:
    """Responses of status 200 whose content type holds text/html (null: not)."""
    return responses.where((F.col("status") == 200) & F.col("content_type").contains("text/html"))


def in_language(documents: DataFrame, language: str = "en") -> DataFrame:
    """Documents marked with the language (null: not)."""
    return documents.where(F.col("lang") == language)


def has_named_host(url: Column) -> Column:
    """False for URLs without host or with a host of digits only."""
    host = urls.domain(url)
    return F.coalesce((host != "") & ~host.rlike("^[0-9]+$"), F.lit(False))


def records(documents: DataFrame, links: DataFrame, headers: DataFrame, key: str = "doc_id") -> DataFrame:
    """``documents`` with in_links, out_links (none: empty lists) and header (none: empty text) of the same key."""
    none = F.array().cast("array<string>")
    rows = documents.join(links.select(key, "in_links", "out_links"), key, "left").join(headers.select(key, "header"), key, "left")
    return rows.select(*documents.columns, F.coalesce("in_links", none).alias("in_links"), F.coalesce("out_links", none).alias("out_links"), F.coalesce("header", F.lit("")).alias("header"))


def crawl(links: DataFrame, seeds: DataFrame, keywords: list[str], waves: int, most: int | None = None) -> DataFrame:
    """(url, wave, in_links, priority, turn, place): a crawl of a known link table (src, dst, anchor) from seeds (url).

    Wave 0 is the seeds; each wave crawls what the one before discovered and no wave crawled yet. in_links counts the
    different crawled pages that link to a page, relevance the keywords in URL or anchor (the most of any link), and
    priority is wave - relevance - in_links, 10000 less for seeds: lower first. Within a wave the domains take turns: turn
    is a page's place in its domain. ``place`` is the order of the crawl, over wave, turn, priority and URL; ``most`` ends
    it. Pages are kept in the shared folder after each wave. Places are numbered in ranges, so no task sorts all pages.
    """
    pages = settled(seeds.select("url").distinct().withColumn("wave", F.lit(0)))
    for wave in range(1, waves):
        fresh = links.join(pages.where(F.col("wave") == wave - 1).select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        pages = settled(pages.unionByName(fresh.join(pages, "url", "left_anti").withColumn("wave", F.lit(wave))))
    crawled = links.join(pages.where(F.col("wave") < waves - 1).select(F.col("url").alias("src")), "src", "left_semi")
    relevance = urls.relevance(F.col("dst"), F.coalesce("anchor", F.lit("")), keywords)
    found = crawled.groupBy(F.col("dst").alias("url")).agg(F.count_distinct("src").alias("in_links"), F.max(relevance).alias("relevance"))
    own = F.coalesce("relevance", urls.relevance(F.col("url"), F.lit(""), keywords))
    rows = pages.join(found, "url", "left").withColumn("in_links", F.coalesce("in_links", F.lit(0))).withColumn("relevance", own)
    rows = rows.withColumn("priority", urls.frontier_priority(F.col("wave") == 0, F.col("relevance"), F.col("wave"), F.col("in_links")).cast("long"))
    turn = F.row_number().over(Window.partitionBy("wave", urls.domain(F.col("url"))).orderBy("priority", "url"))
    rows = index.dense_ids(rows.withColumn("turn", turn), ["wave", "turn", "priority", "url"], "place")
    return (rows.where(F.col("place") <= most) if most else rows).select("url", "wave", "in_links", "priority", "turn", "place")
