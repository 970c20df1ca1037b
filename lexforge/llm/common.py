"""What the operators share: the shared folder, row keys and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id in row keys.
NO_ID = -(2**63)
#: Bytes up to which a table may be broadcast.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset (tests), a folder of this machine is set, if no other machine has a part."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lexforge-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, from which lost executors' parts are read again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if that many rows are small enough; else Catalyst chooses a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(did, th, text) for each row. did: doc_id, NO_ID if it is null. th: hash of the text. Both together name a row;
    rows that agree in doc_id and text count as one document, whose decision holds for all of them."""
    return docs.select(did(doc_id).alias("did"), text_hash(text).alias("th"), F.col(text).alias("text"))


def did(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.col(text), F.col(text).isNull())


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores if df has such a column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name
