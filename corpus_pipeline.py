"""From raw documents to packed training sequences: five stages, each on what the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Nulls, empty
texts, ties, repeated rows, empty tables and further columns are treated as the operators' modules say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import decontam, minhash, packing, quality, suffix
from lexforge.llm.common import delete, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.quality_filter(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.dedup(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that came before."""
    return suffix.dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES one after the other. What a stage keeps is written to the shared folder and read again by the next, until that
    has written its own; the last stage keeps what it needs of its input by itself."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if held:
            delete(spark, held)
        docs, held = spark.read.parquet(path), path
    out = STAGES[-1][1](spark, docs, sf_dir)
    delete(spark, held)
    return out


#: MinHash sketches, BM25 retrieval after them and the rounded linear program aren't expressible in SQL.
ORACLE_SQL = None
