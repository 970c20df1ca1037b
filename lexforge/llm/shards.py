"""Sharding by global prefix sums of byte sizes.

Rows are put into a global order by range partitioning of a narrow table (keys and sizes); the table is cut into the shared
folder with its partition numbers. Partition totals, one number a partition, are summed up on the driver; a running sum within
each partition adds the rest. Cuts lie at equal targets of ceil(total / shards) bytes; a row belongs to the shard in which it starts,
so shards are contiguous and differ from the target by less than one row.

Defined results: null and empty texts have 0 bytes and still get a shard; null keys come first; rows that tie in key order go by
size, so repeated rows get consecutive places; an empty table gives an empty result; other columns are kept only if asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast

#: Most bytes a shard aims at.
TARGET_BYTES = 8 << 20


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", target_bytes: int = TARGET_BYTES, carry: tuple = ()) -> DataFrame:
    """(doc_id, n_bytes, byte_offset, shard) and the columns in carry."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), *carry)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("n_bytes")]
    ranged = cut(narrow.repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id()))
    totals = {r.pid: r.b for r in ranged.groupBy("pid").agg(F.sum("n_bytes").alias("b")).collect()}
    before, rows = 0, []
    for pid in sorted(totals):
        rows.append((pid, before))
        before += totals[pid]
    n_shards = max(1, -(-before // target_bytes))
    target = max(1, -(-before // n_shards))
    starts = maybe_broadcast(spark.createDataFrame(rows, "pid int, before long"), len(rows), 16)
    w = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("before") + F.sum("n_bytes").over(w) - F.col("n_bytes")
    out = ranged.join(starts, "pid").withColumn("byte_offset", at)
    shard = F.least(F.lit(n_shards - 1).cast("long"), F.expr(f"byte_offset div {target}"))
    return out.select("doc_id", "n_bytes", "byte_offset", shard.alias("shard"), *carry)


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", target_bytes: int = TARGET_BYTES) -> None:
    """Writes docs below path, one folder shard=N for each shard."""
    rest = [c for c in docs.columns if c != key]
    clash = {"n_bytes", "byte_offset", "shard"} & set(rest)
    renamed = docs.withColumnsRenamed({c: f"_in_{c}" for c in clash})
    out = assign_shards(renamed, key, text, target_bytes, tuple(f"_in_{c}" if c in clash else c for c in rest))
    out.withColumnRenamed("doc_id", key).repartition("shard").write.partitionBy("shard").parquet(path)


ORACLE_SQL = f"""
WITH a AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
t AS (SELECT coalesce(sum(n_bytes), 0)::BIGINT AS total FROM a),
u AS (SELECT greatest(1, (total + {TARGET_BYTES} - 1) // {TARGET_BYTES}) AS n, total FROM t),
b AS (SELECT doc_id, n_bytes, (sum(n_bytes) OVER (ORDER BY doc_id NULLS FIRST, n_bytes ROWS UNBOUNDED PRECEDING) - n_bytes)::BIGINT AS byte_offset FROM a)
SELECT doc_id, n_bytes, byte_offset, least(n - 1, byte_offset // greatest(1, (total + n - 1) // n))::BIGINT AS shard FROM b, u"""
