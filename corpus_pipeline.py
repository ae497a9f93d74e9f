"""A corpus pipeline over the training-data operators: each stage works on what the one before kept.

toxicity: documents judged toxic go. near_duplicates: of each group of linked documents the one with the smallest doc_id stays. decontamination: documents that hold benchmark passages go.
mixing: documents are taken as often as systematic sampling says (a document taken twice is there twice, one not taken goes). sharding: every document gets its shard and slot, and digests of its text.

Null, empty and repeated rows: a null or empty text is not toxic, links with nothing, holds no benchmark passage and has size 0, so mixing takes it as often as its offset says; of repeated rows near_duplicates keeps one;
a null doc_id goes through all stages as a row of its own. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import read, shared_dir
from quarry.llm.decontamination import find_contamination
from quarry.llm.jaccard import keep_one_of_each
from quarry.llm.mixing import mix_sources
from quarry.llm.sharding import shard_with_digests
from quarry.llm.toxicity import score_documents, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents scored under 0.3; learns from the labels of the documents given."""
    model = train(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return score_documents(docs, model).where("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return find_contamination(docs, read(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mix_sources(docs).where("mix_copies > 0")
    return taken.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_with_digests(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Toxicity scores come from a trained model and shards from random draws, so no SQL gives these rows; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    before = None
    base = f"{shared_dir(spark)}/quarry-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{base}/{i}-{name}"
        out.write.parquet(path)
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
        docs, done, before = spark.read.parquet(path), before, jvm_path
        if done is not None:  # what the stage before last wrote is read no more
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs
