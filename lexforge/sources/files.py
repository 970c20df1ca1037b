"""Source trees as tables of files; manifests; sinks for text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.profiles import language_of

SKIPPED = ("__pycache__", "build", "coverage", "dist", "node_modules", "target", "vendor", "venv")
SCANNED = sorted("c cjs cpp cs go h hpp java js jsx kt mjs php py rb rs swift ts tsx".split())
SCHEMA = "path string, relative_path string, language string, content string, size long"
ENTRY_PATHS = [f"{d}index.{e}" for d in ("src/", "") for e in ("ts", "js")] + [f"main.{e}" for e in ("ts", "py", "go")] + ["cmd/main.go", "lib.rs"]


def extensions_of(patterns: Iterable[str] | None) -> list[str]:
    """Glob patterns count only by what follows their last dot."""
    return sorted({p.rsplit(".", 1)[-1].replace("*", "") for p in patterns}) if patterns else SCANNED


def not_skipped(relative: Column) -> Column:
    """False below a skipped or hidden folder."""
    return ~relative.rlike(f"(^|/)({'|'.join(SKIPPED)})/") & ~relative.rlike("(^|/)\\.[^/]*/")


def scan(spark: SparkSession, root: str, include: Iterable[str] | None = None, max_file_size: int = 1_000_000, max_files: int | None = None) -> DataFrame:
    """Text files below root. Name and size are tested before contents are read; malformed bytes become U+FFFD."""
    base = root.rstrip("/") + "/"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:/+", "/") if "://" not in root else F.col("path")
    relative = F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)
    df = df.withColumn("relative_path", relative)
    df = df.filter(F.lower(F.element_at(F.split("relative_path", "\\."), -1)).isin(extensions_of(include)) & not_skipped(F.col("relative_path")) & (F.col("length") <= max_file_size))
    if max_files is not None:
        df = df.orderBy("relative_path").limit(max_files)
    text = F.decode(F.col("content"), "UTF-8")
    return df.select(path.alias("path"), "relative_path", language_of(F.col("relative_path")).alias("language"), text.alias("content"), F.col("length").alias("size"))


def of_texts(spark: SparkSession, files: Iterable[tuple[str, str]]) -> DataFrame:
    """(path, text) pairs as a table of files."""
    df = spark.createDataFrame(list(files), "relative_path string, content string")
    return df.select(F.col("relative_path").alias("path"), "relative_path", language_of(F.col("relative_path")).alias("language"), "content", F.octet_length("content").cast("long").alias("size"))


def one_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.lit(path).alias("relative_path"), language_of(F.lit(path)).alias("language"), F.col("value").alias("content"), F.octet_length("value").cast("long").alias("size"))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(content) of the manifest in that folder, whatever scan() keeps; no row without one."""
    try:
        return spark.read.text(f"{root.rstrip('/')}/package.json", wholetext=True).select(F.col("value").alias("content"))
    except AnalysisException:  # there is no such file
        return spark.createDataFrame([], "content string")


def entry_points(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """(ord, entry): files that the manifest's main and module name, then common ones, if a file has that path or ends in it after a slash. A manifest with an
    `exports` entry, or one that isn't JSON, names none."""
    spark = files.sparkSession
    if manifest is None:
        manifest = files.filter(F.col("relative_path") == "package.json").select("content")
    keys = [F.struct(F.lit(i - 10).alias("ord"), F.get_json_object("content", f"$.{k}").alias("entry")) for i, k in enumerate(("main", "module"))]
    named = manifest.filter(F.get_json_object("content", "$.exports").isNull()).select(F.explode(F.array(*keys)).alias("e")).select("e.*").filter("entry is not null")
    parts = F.filter(F.split("entry", "/"), lambda p: ~p.isin("", "."))
    back = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(p))))
    named = named.select("ord", F.array_join(back, "/").alias("entry"))
    common = spark.createDataFrame(list(enumerate(ENTRY_PATHS)), "ord int, entry string")
    both = named.unionByName(common)
    paths = files.select("relative_path").distinct()
    hit = (F.col("relative_path") == F.col("entry")) | ((F.col("ord") >= 0) & F.col("relative_path").endswith(F.concat(F.lit("/"), F.col("entry"))))
    return both.join(paths, hit, "left_semi").orderBy("ord")


def totals(files: DataFrame) -> DataFrame:
    from ..functions.text import ceil_div, units

    return files.agg(F.count(F.lit(1)).alias("files"), F.sum(F.size(F.split("content", "\n"))).alias("lines"), F.sum(ceil_div(units(F.col("content")), 3.5)).alias("tokens"))


def languages(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def write_texts(df: DataFrame, path: str, text: str = "code") -> None:
    """One text file a row, below path."""
    df.select(F.col(text).alias("value")).write.text(path, lineSep="\n")


def ranked(df: DataFrame, *by: Column) -> DataFrame:
    """df with `ordinal` from 0 within file_id."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy("file_id").orderBy(*by)) - 1)
