"""Link graphs: degrees, sinks, inversion, PageRank, root and base sets, HITS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.lineage import settled


def url_id(url: Column) -> Column:
    """SHA-256 of a URL; what already is one stays."""
    return F.when(url.rlike("^[0-9a-f]{64}$"), url).otherwise(F.sha2(url, 256))


def degrees(edges: DataFrame) -> DataFrame:
    """(page, n_in, n_out), repeated edges counted, one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("page"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("page"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.page").agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))


def sinks(edges: DataFrame) -> DataFrame:
    """(page) of link targets without out-links."""
    return degrees(edges).where("n_in > 0 AND n_out = 0").select("page")


def inverted(edges: DataFrame) -> DataFrame:
    """(page, links): out-links of each source, repeated ones kept, sorted."""
    return edges.groupBy(F.col("src").alias("page")).agg(F.array_sort(F.collect_list("dst")).alias("links"))


def _names(edges: DataFrame) -> DataFrame | None:
    """(key, page) of all pages that have text ids, the key a hash of eight bytes; None if ids are not texts or two share a key."""
    if dict(edges.dtypes)["src"] != "string":
        return None
    ends = edges.select(F.explode(F.array("src", "dst")).alias("page")).distinct()
    names = settled(ends.select(_key("page").alias("key"), "page"))
    return names if names.count() == names.select("key").distinct().count() else None


def _key(page: str) -> Column:
    return F.when(F.col(page).isNotNull(), F.xxhash64(page))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-4, every: int = 3) -> DataFrame:
    """(page, rank) over the N pages that are linked to.

    rank = (1 - d) / N + d * (mass of pages without out-links) / N + d * sum of rank(q) / out(q), repeated edges counted
    and sources that nobody links to giving nothing. Stops when the ranks change by ``tolerance`` or less in sum, or
    after ``iterations``; with no tolerance it runs them all and keeps a checkpoint ``every`` few. Edges are brought to
    one weighted row per pair first. One shuffle of contributions per iteration; one number reaches the driver. Text ids
    stay out of the iterations: hashes of eight bytes stand for them, if no two of them are equal.
    """
    names = _names(edges)
    if names is not None:
        keyed = edges.select(_key("src").alias("src"), _key("dst").alias("dst"))
        ranks = pagerank(keyed, damping, iterations, tolerance, every).withColumnRenamed("page", "own")
        return ranks.join(names, F.col("own").eqNullSafe(F.col("key"))).select("page", "rank")
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("w"))
    out = pairs.groupBy("src").agg(F.sum("w").alias("n_out"))
    weighted = settled(pairs.join(out, "src").select("src", "dst", (F.col("w") / F.col("n_out")).alias("share")))
    sources = weighted.select(F.col("src").alias("page")).distinct().withColumn("has_out", F.lit(True))
    pages = settled(weighted.select(F.col("dst").alias("page")).distinct().join(sources, "page", "left").select("page", F.col("has_out").isNull().alias("sink")))
    n = pages.count()
    if not n:
        return pages.select("page", F.lit(0.0).alias("rank"))
    ranks = pages.withColumn("rank", F.lit(1.0 / n))
    for i in range(iterations):
        given = weighted.join(ranks.select(F.col("page").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("page")).agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        mass = F.broadcast(ranks.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0)).alias("mass")))  # one row
        new = ranks.withColumnRenamed("rank", "was").join(given, "page", "left").crossJoin(mass)
        new = new.select("page", "sink", ((1 - damping) / n + damping * F.col("mass") / n + damping * F.coalesce("given", F.lit(0.0))).alias("rank"), "was")
        if tolerance is not None:
            new = settled(new)
            if new.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] <= tolerance:
                return new.select("page", "rank")
        elif (i + 1) % every == 0 and i + 1 < iterations:
            new = settled(new)
        ranks = new.drop("was")
    return ranks.select("page", "rank")


def base_set(roots: DataFrame, edges: DataFrame, rounds: int = 3, per_page: int = 200, target: int = 10_000, every: int = 1) -> DataFrame:
    """(page): the roots with neighbours, up to ``per_page`` out-links and in-links of each page and round.

    Which links stand in for a random choice is the order of the neighbours' SHA-256. Stops after ``rounds``, or before
    a round if ``target`` pages are reached.
    """
    links = settled(edges.select("src", "dst").distinct())
    ways = {"out": ("src", "dst"), "in": ("dst", "src")}
    kept = {way: _first_links(links.select(F.col(a).alias("page"), F.col(b).alias("other")), per_page) for way, (a, b) in ways.items()}
    pages = settled(roots.select("page").distinct())
    for _ in range(rounds):
        if pages.count() >= target:
            break
        found = pages
        for rows in kept.values():
            found = found.unionByName(rows.join(pages, "page", "left_semi").select(F.col("other").alias("page")))
        pages = settled(found.distinct())
    return pages


def _first_links(links: DataFrame, most: int) -> DataFrame:
    """(page, other): each page's first ``most`` links by SHA-256. Only pages of more links are sorted."""
    crowded = settled(links.groupBy("page").agg(F.count("*").alias("n")).where(F.col("n") > most).select("page"))
    if not crowded.count():
        return links
    w = Window.partitionBy("page").orderBy(F.sha2(F.col("other").cast("string"), 256), "other")
    cut = links.join(crowded, "page", "left_semi").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return settled(links.join(crowded, "page", "left_anti").unionByName(cut.select("page", "other")))


def hits(edges: DataFrame, base: DataFrame, iterations: int = 11, tolerance: float | None = None, every: int = 2) -> DataFrame:
    """(page, authority, hub) over links inside the base set, repeated links counted; both have norm 1.

    Authorities are sums of hubs that link in, hubs sums of the new authorities linked to. Scaling commutes with both
    sums, so hubs are brought to norm 1 only where a checkpoint ends a stretch of ``every`` iterations, and authorities
    at the end. ``tolerance``: stop when no authority moves further than that. One number a stretch reaches the driver.
    """
    ends = base.select("page")
    inside = edges.join(ends.select(F.col("page").alias("src")), "src", "left_semi").join(ends.select(F.col("page").alias("dst")), "dst", "left_semi")
    pairs = settled(inside.groupBy("src", "dst").agg(F.count("*").alias("w")))
    pages = settled(ends.distinct())

    def side(given: DataFrame, frm: str, to: str, value: str, name: str) -> DataFrame:
        rows = pairs.join(given.select(F.col("page").alias(frm), F.col(value).alias("x")), frm)
        return rows.groupBy(F.col(to).alias("page")).agg(F.sum(F.col("w") * F.col("x")).alias(name))

    def unit(rows: DataFrame, name: str) -> DataFrame:
        rows = settled(rows)
        norm = rows.agg(F.sqrt(F.sum(F.col(name) * F.col(name)))).first()[0]
        return rows.select("page", (F.col(name) / F.lit(norm)).alias(name)) if norm else rows.select("page", F.lit(0.0).alias(name))

    hubs, last = pages.withColumn("hub", F.lit(1.0)), None
    for i in range(iterations):
        authorities = side(hubs, "src", "dst", "hub", "authority")
        if tolerance is not None or i + 1 == iterations:
            authorities = unit(authorities, "authority")
        hubs = side(authorities, "dst", "src", "authority", "hub")
        if tolerance is not None or i + 1 == iterations or (i + 1) % every == 0:
            hubs = unit(hubs, "hub")
        if tolerance is not None:
            if last is not None:
                moved = authorities.join(last.withColumnRenamed("authority", "was"), "page", "full").agg(F.max(F.abs(F.coalesce("authority", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
                if moved is None or moved < tolerance:
                    break
            last = authorities
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return pages.join(authorities, "page", "left").join(hubs, "page", "left").select("page", zero("authority"), zero("hub"))


def report(ranks: DataFrame, edges: DataFrame, most: int = 500) -> DataFrame:
    """(page, rank, n_out, n_in) of the ``most`` best pages."""
    top = ranks.orderBy(F.desc("rank"), "page").limit(most)
    return top.join(degrees(edges), "page", "left").select("page", "rank", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))
