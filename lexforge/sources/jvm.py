"""Functions in Java for what whole-stage expressions can't say and numpy can't do a bit at a time.

A source is compiled once a Spark application, by the compiler that Spark itself uses for generated code. The classes
go to the executors as a jar from the shared folder, so that they need no copy of this package.
"""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir

_LOADED: dict = {}


def _loader(spark: SparkSession, source: Path):
    """The class loader of the compiled source; the jar is with the executors."""
    key = spark.sparkContext.applicationId, spark.sparkContext.startTime, source
    if key not in _LOADED:
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(source.read_text())
        path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/functions-{uuid.uuid4().hex}.jar")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        jar = jvm.java.util.jar.JarOutputStream(fs.create(path))
        code = compiler.getBytecodes()
        for name in code:
            jar.putNextEntry(jvm.java.util.zip.ZipEntry(name.replace(".", "/") + ".class"))
            jar.write(code[name])
            jar.closeEntry()
        jar.close()
        spark.sparkContext._jsc.sc().addJar(fs.makeQualified(path).toString())
        _LOADED[key] = compiler.getClassLoader()
    return _LOADED[key]


def made(spark: SparkSession, source: Path, name: str, *args: object):
    """An object of the class of that name in the source. args: ints, strings, or what Spark's JVM side holds."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    values = gateway.new_array(jvm.java.lang.Object, len(args))
    for i, a in enumerate(args):
        values[i] = a
    return _loader(spark, source).loadClass(name).getConstructors()[0].newInstance(values)


def function(spark: SparkSession, source: Path, name: str, returns: str, *args: object):
    """Columns -> column, by the class of that name in the source."""
    own = f"{name.rpartition('.')[2].lower()}_{uuid.uuid4().hex}"
    spark._jsparkSession.udf().register(own, made(spark, source, name, *args), spark._jvm.org.apache.spark.sql.types.DataType.fromDDL(returns))

    def call(*columns: Column) -> Column:
        return F.call_function(own, *columns)

    return call


def over_partitions(df: DataFrame, function, returns: str) -> DataFrame:
    """What a MapPartitionsFunction of rows makes of each partition."""
    jvm = df.sparkSession._jvm
    return DataFrame(df._jdf.mapPartitions(function, jvm.org.apache.spark.sql.Encoders.row(jvm.org.apache.spark.sql.types.StructType.fromDDL(returns))), df.sparkSession)
