"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, stored, table, whole_rows

#: Weights of the sources in code point order (null last), repeated as often as needed.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size), by filling to a common level.

    A source gets min(max_copies x size, weight x level), where the level makes the targets add up to the sum of all
    sizes; that is what resharing the excess by weight until none is above comes to. Works on the table of sources.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(max_copies).cast("long") * F.col("source_size"))
    total = F.sum("source_size").over(Window.partitionBy())
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("__level", (total - full) / left).withColumn("__ratio", F.col("cap") / F.col("weight"))
    # the level is that of the first source, by ratio, that is not filled to its cap
    open_ = F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__level"))).over(Window.partitionBy())
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("weight") * open_["__level"]), F.lit(0.0))
    return level.withColumn("target", target).select("source", "source_size", "weight", "target")


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source, in [0, 1): 32 bits of an MD5, so reruns agree."""
    digest = F.md5(F.concat(F.coalesce(source, F.lit("\0null")), F.lit(f"|{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 0, text: str = "text") -> DataFrame:
    """``documents`` with ``__size``, ``__source_size``, ``__target`` and ``__copies``: how often the mix takes each row.

    Within a source the rows stand in a fixed order: by a logarithmic size class, so that the taken words come near the
    target, then by a bucket from a hash of doc_id (or of the text where that is null), size, doc_id and a hash of the
    text. A row's place k of a source with r = target / size expected copies a row covers (k r, (k+1) r]; it is taken
    once per integer boundary that u + this interval crosses. The place is a prefix sum in three steps (classes of a
    source, buckets of a class, rows of a bucket), so no task holds a source or a class. Null text: size 0. Null source: a
    source of its own, last. Sources without words: target 0, no row taken. Repeated rows are rows of their own. Empty
    table: empty result. Other columns are kept, whatever their names; ones of the four names are replaced.
    """
    placed = _copies(_measured(documents, F.col(text).cast("string"), whole_rows(documents).alias("row")), weights, max_copies, seed)
    own = {"__size": "size", "__source_size": "source_size", "__target": "target", "__copies": "copies"}
    kept = [F.col("row.`" + c.replace("`", "``") + "`") for c in documents.columns if c.lower() not in own]
    return placed.select(*kept, *(F.col(c).alias(n) for n, c in own.items()))


def _measured(documents: DataFrame, body: Column, *others: Column) -> DataFrame:
    bucket = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), body, F.lit("")).cast("binary")), 1, 2)
    return documents.select("doc_id", "source", word_count(body).alias("size"), F.xxhash64(body).alias("tie"), bucket.alias("bucket"), *others)


def _copies(rows: DataFrame, weights: tuple[int, ...], max_copies: int, seed: int) -> DataFrame:
    """``rows`` (source, doc_id, size, tie, bucket and others) with source_size, target and copies; see ``copies``."""
    bits = F.bin("size")
    rows = rows.withColumn("class", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 3)))
    cells = stored(rows.groupBy("source", "class", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-cells")
    classes = cells.groupBy("source", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(sizes, weights, max_copies)
    before = lambda *by: Window.partitionBy("source", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    first_of_class = classes.select("source", "class", F.coalesce(F.sum("n").over(before("class")), F.lit(0)).alias("a"))
    first_of_bucket = cells.select("source", "class", "bucket", F.coalesce(F.sum("n").over(before("class", "bucket")), F.lit(0)).alias("b"))
    starts = first_of_bucket.alias("x").join(first_of_class.alias("y"), F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x.class") == F.col("y.class"))).select("x.source", "x.class", "x.bucket", (F.col("a") + F.col("b")).alias("start"))
    starts = starts.alias("x").join(goal.alias("y"), F.col("x.source").eqNullSafe(F.col("y.source"))).select(
        F.col("x.source").alias("source_"), F.col("class").alias("class_"), F.col("bucket").alias("bucket_"), "start", "source_size", "target"
    )
    within = Window.partitionBy("source", "class", "bucket").orderBy("size", "doc_id", "tie")
    placed = rows.withColumn("place", F.row_number().over(within) - 1)
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("source_")) & (F.col("class") == F.col("class_")) & (F.col("bucket") == F.col("bucket_")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place, u = F.col("start") + F.col("place"), offset(F.col("source"), seed)
    crossed = F.floor((place + 1) * rate + u) - F.floor(place * rate + u)
    return joined.withColumn("copies", F.least(crossed, F.lit(max_copies)).cast("long"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 0) -> DataFrame:
    """The mix itself: every row of ``documents`` as many times as it is taken, with its columns as they were."""
    rows = _measured(documents, F.col("text").cast("string"), whole_rows(documents).alias("row"))
    taken = _copies(rows, weights, max_copies, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts are read once: their sizes and hashes are stored, and the rest works on those."""
    rows = _measured(table(spark, sf_dir, "documents"), F.col("text").cast("string"))
    taken = _copies(stored(rows, "mix-sizes"), WEIGHTS, MAX_COPIES, 0)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = {
    "op9_mixing": r"""
WITH w AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM w GROUP BY source
), c AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio,
         ((sum(source_size) OVER ()) - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 3 * source_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), t AS (
  SELECT source, source_size,
         coalesce(least(cap::DOUBLE, weight * (SELECT arg_min(level, ratio) FROM c WHERE level <= ratio)), 0.0) AS target,
         ('0x' || substr(md5(coalesce(source, chr(0) || 'null') || '|0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM c
), o AS (
  SELECT w.*, t.source_size, t.target, t.u, row_number() OVER (
    PARTITION BY w.source ORDER BY lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 3), substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 2), size, doc_id NULLS FIRST) - 1 AS place
  FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * least(3, CASE WHEN source_size = 0 THEN 0 ELSE floor((place + 1) * (target / source_size) + u) - floor(place * (target / source_size) + u) END))::BIGINT AS taken
FROM o
"""
}
QUERIES = {"op9_mixing": op9_mixing}
