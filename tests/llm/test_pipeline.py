"""The pipeline and its stages: each on odd tables, and the whole against the stages' brute force."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import mixing, toxicity
from tests.llm.brute import SCHEMA, brute_kept, odd_rows


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]


@pytest.fixture()
def folder(spark, tmp_path):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "p1 p2 p3 p4 p5")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_odd_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, folder)
            assert name == "sharding" or out.columns == docs.columns
            assert out.count() >= 0
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_run_on_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert out.count() == 0 and out.columns == ["shard", "doc_id", "tier", "shard_rows", "shard_bytes"]


def test_whole(spark, small):
    """The result's doc_ids are the mix of what toxicity, near-duplicates (five words, Jaccard 0.8) and decontamination leave."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    source = pd.read_parquet(f"{small}/documents.parquet").set_index("doc_id")
    bench = pd.read_parquet(f"{small}/benchmark.parquet").text.tolist()
    model = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    left = {i: t for i, t in source.text.items() if model.document(t) < 0.5}
    clean = [int(i) for i in brute_kept(left.items()) if not any(b in (left[i] or "") for b in bench)]
    got = corpus_pipeline.run(spark, small).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    want = mixing.copies(docs.where(F.col("doc_id").isin(clean))).select("doc_id", "__copies").toPandas().set_index("doc_id")["__copies"]
    assert got.to_dict() == want[want > 0].to_dict()
