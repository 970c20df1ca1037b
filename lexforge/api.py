"""Calls on single texts, for use without tables. Each runs one small plan."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import compress as C
from .functions import text as T
from .operators import parse, serialize
from .plans import optimize as plans
from .sources import files as sources


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("lexforge").getOrCreate()


def _file(code: str, language: str = "typescript") -> DataFrame:
    return _spark().createDataFrame([("0", code, language)], "file_id string, content string, language string")


def optimize_context(code: str, options: plans.Options = plans.Options()) -> dict:
    return plans.optimize(_file(code, options.language or "typescript"), options).drop("file_id").first().asDict(recursive=True)


def optimize_context_sync(code: str, options: plans.Options = plans.Options()) -> dict:
    return plans.optimize_sync(_file(code, options.language or "typescript"), options).drop("file_id").first().asDict(recursive=True)


def optimize_multi_file(texts: list[tuple[str, str]], options: plans.Options = plans.Options()) -> list[dict]:
    """Results in the order of texts, with their paths: one job for all."""
    df = sources.of_texts(_spark(), texts).withColumn("file_id", F.col("relative_path"))
    rows = {r.file_id: r.asDict(recursive=True) for r in plans.optimize(df, options).collect()}
    return [rows[p] for p, _ in texts]


def extract_diff(original: str, modified: str, language: str = "typescript") -> dict:
    df = _spark().createDataFrame([("0", original, modified, language)], "file_id string, original string, modified string, language string")
    return plans.extract_diff(df).drop("file_id").first().asDict(recursive=True)


def compress(code: str, options: C.Options = C.Options(), language: str | None = None) -> str:
    return _file(code).select(C.compress(F.col("content"), options, language)).first()[0]


def count_tokens(code: str) -> int:
    return _file(code).select(T.tokens(F.col("content"))).first()[0]


def estimate_tokens(code: str) -> dict:
    return _file(code).select(*[c.alias(n) for n, c in T.breakdown(F.col("content")).items()]).first().asDict()


def split_to_fit(code: str, most: int) -> list[str]:
    return _file(code).select(T.split_to_fit(F.col("content"), most)).first()[0]


def parse_code(code: str, language: str = "typescript") -> dict:
    """Symbols with imports attached, imports, exports, and a diagnostic if there are no symbols."""
    f = _file(code, language)
    imports = parse.imports_of(f)
    rows = lambda df: [r.asDict(recursive=True) for r in df.orderBy("ordinal").collect()]
    symbols = rows(parse.attach_imports(parse.parse_symbols(f), imports, f)) if code else []
    notes = [{"level": "warning", "code": "NO_SYMBOLS"}] if code and not symbols else []
    return {"symbols": symbols, "imports": rows(imports), "exports": rows(parse.exports_of(f)), "diagnostics": notes}


class Visualizer:
    """Budgets of chunk tables (see serialize.chunks)."""

    breakdown = staticmethod(serialize.budget_breakdown)
    symbols = staticmethod(serialize.per_symbol)
    text = staticmethod(serialize.budget_text)
    json = staticmethod(serialize.budget_json)

    @staticmethod
    def estimate(code: str, language: str = "typescript") -> dict:
        n = len(parse.symbols_of(code, language))
        x = F.col("content")
        some = F.length(F.trim(x)) > 0
        cols = serialize.savings(F.when(some, T.tokens(x)).otherwise(F.lit(0).cast("long")), F.lit(n), T.units(x))
        return _file(code).select(*[c.alias(k) for k, c in cols.items()]).first().asDict()


class Restore:
    """Restore maps as tables (see serialize.restore_map)."""

    create = staticmethod(serialize.restore_map)
    create_from_code = staticmethod(serialize.restore_map_from_code)
    symbol = staticmethod(serialize.restore_symbol)
    chunk = staticmethod(serialize.restore_chunk)
    text = staticmethod(serialize.restore_text)


def write_context(root: str, prompt: str, target_tokens: int = 8000, name: str = "optimized-context.txt") -> str:
    """Writes the context of a folder into it, and its path as a step output where GITHUB_OUTPUT names a file."""
    text = plans.codebase_context(sources.scan(_spark(), root), prompt, target_tokens, sources.manifest(_spark(), root)).first().context
    path = os.path.join(root, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    if out := os.environ.get("GITHUB_OUTPUT"):
        with open(out, "a", encoding="utf-8") as f:
            f.write(f"optimized-context={path}\n")
    return path
