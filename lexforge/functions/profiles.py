"""Profiles of strategies, tasks and models as small tables, and the expressions that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: strategy -> body, comment and import weight, graph depth, minify
STRATEGIES = {
    "adaptive": (0.4, 0.3, 0.6, 2, False),
    "aggressive": (0.1, 0.0, 0.3, 1, True),
    "balanced": (0.4, 0.2, 0.6, 2, False),
    "preservative": (0.8, 0.7, 0.9, 3, False),
    "semantic": (0.3, 0.1, 0.5, 2, False),
}
#: task -> factors of body, comment and import weight, minify
TASKS = {
    "general": (1.0, 0.5, 0.8, 0), "bug-fix": (0.7, 0.2, 0.5, 1), "code-review": (1.0, 0.8, 0.9, 0), "document": (0.4, 1.0, 0.5, 0),
    "explain": (0.5, 1.0, 0.6, 0), "feature-add": (0.9, 0.5, 0.8, 0), "refactor": (0.8, 0.4, 0.7, 0), "test-write": (0.8, 0.3, 0.8, 0),
}
_CL = "cl100k_base"
#: model -> window, recommended tokens, encoding, penalty, recommended strategy
MODELS = {
    **{f"claude-{m}": (200_000, t, _CL, p, s) for names, t, p, s in ((("3-opus", "opus-4"), 180_000, 1, "preservative"), (("3-sonnet", "3-haiku", "sonnet-4", "haiku-4"), 150_000, 2, "balanced")) for m in names},
    "gpt-4-turbo": (128_000, 100_000, "o200k_base", 2, "balanced"),
    "gpt-4": (8_192, 6_000, _CL, 4, "aggressive"),
    "gpt-3.5-turbo": (16_385, 12_000, _CL, 4, "aggressive"),
    "gemini-pro": (30_720, 25_000, _CL, 3, "balanced"),
    "local": (8_192, 4_000, _CL, 5, "aggressive"),
}
LARGE = [m for m in MODELS if m.startswith("claude") or m == "gpt-4-turbo"]
TIGHT = ["local", "gpt-4", "gpt-3.5-turbo"]
CAREFUL, BOLD = ["code-review", "feature-add", "refactor"], ["bug-fix", "test-write"]
#: Importance of symbol types; 5 for any other.
TYPE_IMPORTANCE = {"class": 10, "interface": 9, **dict.fromkeys(("typeAlias", "enum", "module"), 8), **dict.fromkeys(("function", "method", "constructor"), 7), "constant": 5, "variable": 4, "property": 3, "parameter": 1}
_BY_LANGUAGE = {
    "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs", "python": "py pyw", "ruby": "rb", "go": "go", "rust": "rs", "java": "java class",
    "cpp": "cpp cc cxx hpp hh hxx", "c": "c h", "php": "php phtml", "csharp": "cs", "swift": "swift", "kotlin": "kt kts",
}
EXTENSIONS = {e: k for k, es in _BY_LANGUAGE.items() for e in es.split()}
DISPLAY = {k: k.capitalize() for k in _BY_LANGUAGE} | {"typescript": "TypeScript", "javascript": "JavaScript", "cpp": "C++", "php": "PHP", "csharp": "C#"}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def language_of(path: Column) -> Column:
    """By the text after the last dot; typescript if that is unknown."""
    return F.coalesce(F.try_element_at(_map(EXTENSIONS), F.lower(F.substring_index(path, ".", -1))), F.lit("typescript"))


def display_name(language: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(DISPLAY), language), language)


def type_importance(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(TYPE_IMPORTANCE), kind), F.lit(5))


def table(spark: SparkSession, which: str) -> DataFrame:
    """strategies, tasks or models as a table."""
    rows, schema = {
        "strategies": (STRATEGIES, "strategy string, body double, comment double, imports double, depth int, minify boolean"),
        "tasks": (TASKS, "task string, body_factor double, comment_factor double, imports_factor double, minify_flag int"),
        "models": (MODELS, "model string, max_tokens int, recommended int, encoding string, penalty int, recommended_strategy string"),
    }[which]
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], schema).coalesce(1)


def allocate(total: Column, comment: Column, penalty: Column | None = None) -> dict[str, Column]:
    """Five parts of a budget. penalty: a model's, or null or None."""
    d = lambda v: F.lit(float(v))
    factor = d(1) if penalty is None else F.coalesce(d(1) - (penalty - 1) * d(0.1), d(1))
    critical, important, deps, doc = d(0.25) * factor, d(0.35) * factor, d(0.15), d(0.05) * comment
    rest = d(1) - critical - important - deps - doc
    parts = {"critical": critical, "important": important, "relevant": rest, "dependency": deps, "documentation": doc}
    return {k: F.floor(total * v).cast("long") for k, v in parts.items()}


def auto_strategy(model: Column, task: Column, size: Column, budget: Column) -> Column:
    """The strategy that adaptive stands for."""
    by_model = F.when(model.isin(LARGE), 2).when(model.isin(TIGHT), -1).otherwise(0)
    by_task = F.when(task.isin(CAREFUL), 1).when(task.isin(BOLD), -1).otherwise(0)
    pressure = F.ceil(size / F.lit(3.5)) / budget
    by_size = F.when(~((size > 0) & (budget > 0)), 0).when(pressure > 3, -2).when(pressure > 1.5, -1).when(pressure < 0.5, 1).otherwise(0)
    score = by_model + by_task + by_size
    return F.when(score >= 2, "preservative").when(score >= 0, "balanced").when(score >= -1, "semantic").otherwise("aggressive")


def select_strategy(requests: DataFrame) -> DataFrame:
    """requests (strategy, model, task, budget, size, ...) with the chosen strategy's figures. The profiles are a few rows."""
    spark = requests.sparkSession
    chosen = F.when(F.col("strategy") == "adaptive", auto_strategy(F.col("model"), F.col("task"), F.col("size"), F.col("budget"))).otherwise(F.col("strategy"))
    s = table(spark, "strategies").withColumnRenamed("strategy", "chosen")
    df = requests.withColumn("chosen", chosen).withColumn("task_key", F.when(F.col("task").isin(list(TASKS)), F.col("task")).otherwise("general"))
    df = df.join(F.broadcast(s), "chosen").join(F.broadcast(table(spark, "tasks").withColumnRenamed("task", "task_key")), "task_key")
    clamp = lambda a: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(a) * F.col(f"{a}_factor")))
    df = df.withColumns({"body": clamp("body"), "comment": clamp("comment"), "imports": clamp("imports"), "minify": (F.col("minify_flag") == 1) & F.col("minify")})
    df = df.withColumns({"body_threshold": F.lit(1.0) - F.col("body"), "keep_comments": F.col("comment") > 0.3, "keep_docstrings": F.col("comment") > 0.5})
    return df.withColumns(allocate(F.col("budget"), F.col("comment"))).drop("task_key", "body_factor", "comment_factor", "imports_factor", "minify_flag")


def token_limit(model: str, target: int | None = None, most: int | None = None) -> tuple[int, int]:
    """(target, most) tokens; unknown models count as the default one."""
    window, recommended, *_ = MODELS.get(model, MODELS["claude-3-sonnet"])
    return target or recommended, most or window
