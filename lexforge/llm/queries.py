"""One query for each operator over its whole table, and SQL for those that SQL expresses."""

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, minhash, mixing, packing, quality, shards, suffix, tokens, urls


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a shard in a query that cuts small tables too.
SMALL_SHARD = 128 << 10

QUERIES = {
    "op1_suffix_array_dedup": lambda spark, d: suffix.repeated_passages(_t(spark, d, "documents")),
    "op2_quality_rules": lambda spark, d: quality.quality_report(_t(spark, d, "documents")),
    "op3_minhash_near_dedup": lambda spark, d: minhash.near_pairs(_t(spark, d, "documents")),
    "op4_best_fit_packing": lambda spark, d: packing.pack(_t(spark, d, "documents")),
    "op5_chat_formatting": lambda spark, d: chat.chat_format(_t(spark, d, "conversations")),
    "op6_sharding": lambda spark, d: shards.assign_shards(_t(spark, d, "documents").select("doc_id", "text")),
    "op7_token_ids": lambda spark, d: tokens.token_blocks(_t(spark, d, "documents")),
    "op8_url_filter": lambda spark, d: urls.url_report(_t(spark, d, "pages")),
    "op9_benchmark_decontamination": lambda spark, d: decontam.contaminated(_t(spark, d, "documents"), _t(spark, d, "benchmark")),
    "op10_lm_scoring": lambda spark, d: mixing.bits_per_byte(_t(spark, d, "documents")),
    "token_spans": lambda spark, d: tokens.spans(tokens.token_blocks(_t(spark, d, "documents"))).select("doc_id", "n_ids"),
    "sharding_small_shards": lambda spark, d: shards.assign_shards(_t(spark, d, "documents").select("doc_id", "text"), target_bytes=SMALL_SHARD),
}

ORACLE_SQL = {
    "op1_suffix_array_dedup": suffix.ORACLE_SQL,
    "op2_quality_rules": quality.oracle_sql(),
    "op5_chat_formatting": chat.ORACLE_SQL,
    "op6_sharding": shards.ORACLE_SQL,
    "op9_benchmark_decontamination": decontam.ORACLE_SQL,
    "sharding_small_shards": shards.ORACLE_SQL.replace(str(shards.TARGET_BYTES), str(SMALL_SHARD)),
}
