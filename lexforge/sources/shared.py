"""The folder that executors share, and tables kept there."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (tests), a folder of this machine, if no other machine has a part."""
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
    """df, computed once, its lineage replaced by files of the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with a column that counts its rows from 0 in that order. Rows are range-partitioned and sorted; only the partitions' sizes go through the driver."""
    part, place = "_part_of_" + name, "_place_of_" + name
    rows = cut(df.orderBy(*order).withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = sorted(tuple(r) for r in rows.groupBy(part).count().collect())
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    first = F.broadcast(df.sparkSession.createDataFrame(starts or [(0, 0)], f"{part} int, {name} long"))
    return rows.drop(name).join(first, part).withColumn(name, F.col(name) + F.col(place)).drop(part, place)
