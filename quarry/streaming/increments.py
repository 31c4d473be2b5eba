"""Index increments, judgement logs and event windows as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import index


def document_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Documents as Parquet files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def index_increments(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's postings as an index generation of its own (``generation=<batch>``).

    A batch that is run again after a failure replaces its generation, so no posting is counted twice. ``merged_index``
    reads all generations as one index.
    """

    def write(batch: DataFrame, number: int) -> None:
        index.positions(index.tokenised(batch)).write.mode("overwrite").parquet(f"{path}/generation={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_index(spark: SparkSession, path: str) -> DataFrame:
    return index.merged(spark.read.parquet(path))


def statistics_stream(documents: DataFrame) -> DataFrame:
    """Running df and cf per term, for a complete or update sink; exact if each document arrives once."""
    rows = index.tokenised(documents).select(F.explode(index.counted(F.col("tokens"))).alias("x"))
    return rows.groupBy("x.term").agg(F.sum("x.tf").alias("cf"), F.count("*").alias("df"))


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """(start, event_type, n, total): tumbling windows; rows later than ``late`` behind the newest are left out."""
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
