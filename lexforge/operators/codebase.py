"""Whole code bases: imports across files, relevance of symbols to a prompt, context text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ceil_div, split_words, units
from .ranking import context_fill

SCRIPT = r"from\s+['\"][^'\"]+['\"]|require\(['\"][^'\"]+['\"]\)"
SCANS = {"python": (r"from\s+\S+\s+import|import\s+\S+", r"(?:from|import)\s+(\S+)"), "go": ('"[^"]+"', '"([^"]+)"')}


def _first(pattern: str):
    return lambda s: F.regexp_extract(s, pattern, 1)


def import_paths(files: DataFrame) -> DataFrame:
    """(file_id, relative_path, import_path, resolved): each import of each file, without a leading ./"""
    pattern, inner = F.regexp_extract_all("content", F.lit(SCRIPT), F.lit(0)), lambda s: F.regexp_extract(s, r"['\"]([^'\"]+)['\"]", 1)
    paths = F.transform(pattern, inner)
    for language, (one, part) in SCANS.items():
        found = F.regexp_extract_all("content", F.lit(one), F.lit(0))
        paths = F.when(F.col("language") == language, F.transform(found, _first(part))).otherwise(paths)
    df = files.select("file_id", "relative_path", F.explode(F.array_distinct(paths)).alias("p")).withColumn("import_path", F.regexp_replace("p", r"^\./", "")).filter("import_path != ''")
    folder = F.regexp_extract("relative_path", r"^(.*)/[^/]*$", 1)
    rest = F.expr("substring(import_path, 3)")
    resolved = F.when(F.col("import_path").startswith("."), F.when(folder != "", F.concat(folder, F.lit("/"), rest)).otherwise(rest)).otherwise(F.col("import_path"))
    return df.withColumn("resolved", resolved).drop("p")


def import_links(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst): every symbol of an importing file with every symbol that it imports from another file: those named like the path's last part (an equi join), and
    those of files whose path without extension occurs in the resolved path (a substring join over distinct paths)."""
    imp = import_paths(files)
    target = symbols.select(F.col("id").alias("dst"), F.col("file_path").alias("to_file"), "name")
    by_name = imp.withColumn("name", F.element_at(F.split("import_path", "/"), -1)).join(target, "name").select("file_id", "relative_path", "dst", "to_file")
    stems = files.select(F.col("relative_path").alias("to_file"), F.regexp_replace("relative_path", r"\.[A-Za-z0-9_]+$", "").alias("stem")).distinct()
    hits = imp.join(stems, F.col("resolved").contains(F.col("stem"))).select("file_id", "relative_path", "to_file").distinct()
    by_path = hits.join(target.drop("name"), "to_file").select("file_id", "relative_path", "dst", "to_file")
    found = by_name.union(by_path).filter("to_file != relative_path").select(F.col("relative_path").alias("file_path"), "dst").distinct()
    return found.join(symbols.select("file_path", F.col("id").alias("src")), "file_path").select("src", "dst").distinct()


def prompt_score(name: Column, path: Column, exported: Column, page_rank: Column, prompt: str) -> Column:
    score = F.lit(0.0)
    for w in split_words(prompt):
        low = F.lower(name)
        score = score + F.when(low.contains(w), 10.0).otherwise(0.0) + F.when(low == w, 5.0).otherwise(0.0) + F.when(F.lower(path).contains(w), 3.0).otherwise(0.0)
    return score + F.when(exported, 2.0).otherwise(0.0) + F.coalesce(page_rank, F.lit(0.0)) * 20


def prompt_context(symbols: DataFrame, prompt: str, target_tokens: int, entries: DataFrame | None = None, totals: tuple[int, int] = (0, 0)) -> DataFrame:
    """(context, relevant_files, relevant_symbols, token_count) of one code base. symbols: ordinal, name, file_path, full_source, is_exported, page_rank."""
    from ..functions.text import tokens

    s = symbols.withColumn("score", prompt_score(F.col("name"), F.col("file_path"), F.col("is_exported"), F.col("page_rank"), prompt)).withColumn("one", F.lit(1))
    hits = s.filter("score > 0")
    n_hits = hits.limit(10).count()
    budget = max(50, target_tokens - -(-(40 + len(prompt)) * 2 // 7) - n_hits * 12)
    picked = context_fill(hits, budget, ("one",))
    chosen = s.join(picked.select("ordinal", "position"), "ordinal")
    if entries is not None:
        used = chosen.agg(F.coalesce(F.sum(ceil_div(units(F.col("full_source")), 3.5)), F.lit(0))).first()[0]
        rest = s.join(entries.select(F.col("entry").alias("file_path"), "ord"), "file_path").join(chosen.select("ordinal"), "ordinal", "left_anti")
        if not rest.isEmpty():
            w = Window.partitionBy("one").orderBy("ord", "ordinal")
            rest = rest.withColumn("score", -F.row_number().over(w).cast("double"))
            more = context_fill(rest, budget - used, ("one",), least=0)
            base = chosen.count()
            chosen = chosen.unionByName(s.join(more.select("ordinal", (F.col("position") + base).alias("position")), "ordinal"))
    files = chosen.groupBy("file_path").agg(F.min("position").alias("at"), F.sort_array(F.collect_list(F.struct("position", "full_source", "name"))).alias("x"))
    part = F.concat(F.lit("// 📁 "), F.col("file_path"), F.lit("\n"), F.array_join(F.transform("x", lambda e: e["full_source"]), "\n"), F.lit("\n"))
    whole = files.agg(F.sort_array(F.collect_list(F.struct("at", "file_path", part.alias("part")))).alias("f"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "file_path", "x"))), lambda f: F.transform(f["x"], lambda e: F.struct(e["position"].alias("p"), F.concat(f["file_path"], F.lit(":"), e["name"]).alias("n"))))).alias("s"))
    head = f"// Codebase context for: {prompt}\n// {totals[0]} files · {totals[1]} symbols\n"
    out = whole.select(F.concat(F.lit(head), F.when(F.size("f") > 0, F.lit("\n")).otherwise(""), F.array_join(F.transform("f", lambda e: e["part"]), "\n")).alias("context"), F.transform("f", lambda e: e["file_path"]).alias("relevant_files"), F.transform(F.array_sort("s"), lambda e: e["n"]).alias("relevant_symbols"))
    return out.withColumn("token_count", tokens(F.col("context")))
