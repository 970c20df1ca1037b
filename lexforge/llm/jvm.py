"""Functions in Java from the sources beside this module; see sources.jvm."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from ..sources import jvm


def function(spark: SparkSession, source: str, name: str, returns: str, *args: object):
    """Columns -> column, by the class of that name in the source."""
    return jvm.function(spark, Path(__file__).parent / source, name, returns, *args)
