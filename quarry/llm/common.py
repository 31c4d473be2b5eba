"""What the operators share: stored intermediate tables, word rules, held-out folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.lineage import new_folder

#: A word is a run of characters outside space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, so its lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_rows(df: DataFrame) -> Column:
    """All columns of ``df`` in one struct, so that columns beside it can have any name."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def held_out(doc_id: Column) -> Column:
    """True for the fold that no label is learned from: crc32(doc_id as text) mod 5 = 0 (null ids: true)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def labelled_rows(documents: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled documents outside the held-out fold.

    The rows taken are those of smallest hash of doc_id, whatever the order or layout of the tables. Labels
    that are null or disagree for one doc_id are left out; of a repeated doc_id the smallest text counts, so no more than
    ``max_rows`` rows come back. The bound makes the broadcast safe.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(label).alias("__lo"), F.max(label).alias("__hi"))
        .where("__lo = __hi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        .select("doc_id", F.col("__lo").cast("int").alias("label"))
    )
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # a few hundred texts a task, whatever the adaptive plan would merge: models hold the features of a batch
    return texts.repartition(max(1, max_rows // 256), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
