"""From files to budgeted context: parse, graph, rank, fill, serialize, measure. One plan over all files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compress as C
from ..functions import profiles
from ..functions.text import tokens, units
from ..operators import codebase, graph, parse, ranking, serialize
from ..sources import files as sources
from ..sources import jvm
from ..sources.shared import numbered


@dataclass(frozen=True)
class Options:
    """A request. prompt adds relevance; symbols are entry points of depths."""

    model: str = "claude-3-sonnet"
    strategy: str = "adaptive"
    task: str = "general"
    target_tokens: int | None = None
    max_tokens: int | None = None
    include_imports: bool = True
    include_documentation: bool = False
    maximal: bool = False
    prompt: str | None = None
    use_graph: bool = True
    language: str | None = None


def _requests(files: DataFrame, o: Options) -> DataFrame:
    target, _ = profiles.token_limit(o.model, o.target_tokens, o.max_tokens)
    r = files.select("file_id", F.lit(o.strategy).alias("strategy"), F.lit(o.model).alias("model"), F.lit(o.task).alias("task"), F.lit(target).alias("budget"), units(F.col("content")).alias("size"))
    return profiles.select_strategy(r)


def optimize(files: DataFrame, o: Options = Options()) -> DataFrame:
    """files (file_id, content, language) -> a row each: code, tokens before and after, savings, names, coverage. Without use_graph neither graph
    nor minification is applied, only the emitted form is compact, and a blank text costs nothing and counts as complete. Each file's strategy decides its own form, whatever other files there are."""
    files = files.withColumn("file_id", F.col("file_id").cast("string"))
    plan = _requests(files, o).select("file_id", "chosen", "body_threshold", "minify", "budget", "depth")
    plan = plan.withColumn("mode", F.lit("maximal") if o.maximal else F.when(F.col("minify"), "minify").otherwise("standard"))
    symbols = parse.parse_symbols(files).select("file_id", "name", "full_source", "ordinal", "type", "signature", "visibility", "is_exported")
    symbols = parse.with_defaults(graph.cut((_ranked_by_file(symbols) if o.use_graph else symbols).repartition("file_id")))
    if o.use_graph:
        symbols = parse.attach_imports(symbols, parse.imports_of(files), files)
    else:
        symbols = symbols.withColumns({"page_rank": F.lit(0.0), "import_statements": F.array().cast("array<string>")})
    ranked = ranking.rank(symbols.join(plan, "file_id"), F.col("body_threshold"), o.prompt, F.col("page_rank"))
    filled = ranking.fill(ranked, F.col("budget")).select("file_id", "position", "form", "rank", "name", "type", "signature", "full_source", "import_statements", "mode")
    filled = graph.cut(filled.repartition("file_id"))
    imports = filled.filter("form != 'excluded'").groupBy("file_id").agg(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("position", "import_statements"))), lambda e: e["import_statements"]))).alias("imports"))
    head = files.select("file_id", F.lit(o.task).alias("task"), F.lit(o.strategy).alias("strategy"), "content", "language").join(plan.select("file_id", "mode"), "file_id").join(imports, "file_id", "left")
    if not o.include_imports:
        head = head.withColumn("imports", F.lit(None).cast("array<string>"))
    chunk_rows = serialize.chunks(filled, F.col("mode"), name_only=o.strategy == "aggressive")
    out = serialize.code_of(chunk_rows, head, F.col("mode")).join(head.select("file_id", "content", "mode"), "file_id")
    code = F.col("code")
    if o.use_graph and not o.maximal:
        code = F.when(F.col("mode") == "minify", C.compress(code, C.Options(minify=True))).otherwise(code)
    blank = F.lit(False) if o.use_graph else F.length(C.trim(F.coalesce("content", F.lit("")))) == 0
    took = filled.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("total_symbols"), F.count(F.when(F.col("form") != "excluded", 1)).alias("included"), F.sum("rank").alias("all_rank"), F.sum(F.when(F.col("form") != "excluded", F.col("rank"))).alias("kept_rank"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("form") != "excluded", F.struct("position", "name")))), lambda e: e["name"]).alias("included_symbols"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("form") == "excluded", F.struct("position", "name")))), lambda e: e["name"]).alias("excluded_symbols"),
    )
    df = out.join(took, "file_id", "left").withColumn("code", code).withColumns({"original_tokens": F.when(blank, F.lit(0).cast("long")).otherwise(tokens(F.col("content"))), "optimized_tokens": tokens(F.col("code"))})
    df = df.withColumns(serialize.metrics(F.col("original_tokens"), F.col("optimized_tokens")))
    share = lambda a, b: F.when(b > 0, F.floor(a / b * 100 + 0.5)).otherwise(F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    return df.select(
        "file_id", "code", "original_tokens", "optimized_tokens", "reduction_tokens", "reduction_percent", "compression_ratio", F.coalesce("total_symbols", F.lit(0)).alias("total_symbols"),
        F.coalesce("included_symbols", none).alias("included_symbols"), F.coalesce("excluded_symbols", none).alias("excluded_symbols"),
        *[F.when(blank, F.lit(100)).otherwise(F.coalesce(share(F.col(a), F.col(b)), F.lit(0))).cast("long").alias(n) for n, a, b in (("completeness", "included", "total_symbols"), ("semantic_coverage", "kept_rank", "all_rank"))],
    )


def _ranked_by_file(symbols: DataFrame) -> DataFrame:
    """symbols with page_rank, each file a graph of its own: calls, parents and interfaces among its symbols as in operators.graph. A file's symbols come from one text, so one file is held at a time."""
    first = ["file_id", "name", "full_source"]
    rows = symbols.select(*first, F.lower("name").alias("_name"), F.lower("full_source").alias("_source"), *[c for c in symbols.columns if c not in first])
    rows = rows.repartition("file_id").sortWithinPartitions("file_id", "ordinal")
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_name", "_source").schema)
    return jvm.over_partitions(rows, jvm.made(symbols.sparkSession, ranking.SOURCE, "lexforge.symbols.Ranks", graph.ROUNDS, graph.DAMPING), f"{named}, page_rank double")


def optimize_sync(files: DataFrame, o: Options = Options()) -> DataFrame:
    from dataclasses import replace

    return optimize(files, replace(o, use_graph=False))


def compress_context(files: DataFrame, language: str | None = None) -> DataFrame:
    """Comments, blank lines and white space only."""
    code = C.compress(F.col("content"), C.Options(), language)
    df = files.select("file_id", code.alias("code"), tokens(F.col("content")).alias("original_tokens")).withColumn("optimized_tokens", tokens(F.col("code")))
    return df.withColumns(serialize.metrics(F.col("original_tokens"), F.col("optimized_tokens")))


def extract_diff(pairs: DataFrame, strategy: str = "semantic", task: str = "general") -> DataFrame:
    """pairs (file_id, original, modified, language) -> code of new and changed symbols, their names, the other old names, savings against the modified text."""
    pairs = pairs.withColumn("file_id", F.col("file_id").cast("string"))
    old, new = (graph.cut(parse.parse_symbols(pairs.select("file_id", F.col(c).alias("content"), "language")).select("file_id", "ordinal", "name", "type", "signature", "full_source").repartition("file_id")) for c in ("original", "modified"))
    changed = graph.cut(serialize.changed_symbols(old, new).repartition("file_id"))
    rest = serialize.unchanged_symbols(old, changed)
    full = changed.withColumns({"form": F.lit("body"), "position": F.col("ordinal")})
    head = pairs.select("file_id", F.lit(task).alias("task"), F.lit(strategy).alias("strategy"))
    code = serialize.code_of(serialize.chunks(full), head)
    names = lambda df, n: df.groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "name"))), lambda e: e["name"]).alias(n))
    df = code.join(pairs.select("file_id", tokens(F.col("modified")).alias("original_tokens")), "file_id").join(names(changed, "included_symbols"), "file_id", "left").join(names(rest, "excluded_symbols"), "file_id", "left")
    none = F.array().cast("array<string>")
    df = df.withColumns({"included_symbols": F.coalesce("included_symbols", none), "excluded_symbols": F.coalesce("excluded_symbols", none), "optimized_tokens": tokens(F.col("code"))})
    return df.withColumns(serialize.metrics(F.col("original_tokens"), F.col("optimized_tokens")))


def analyze_codebase(files: DataFrame, manifest: DataFrame | None = None) -> dict[str, DataFrame]:
    """symbols with page_rank, edges (with imports added after ranking), degrees over all of these, entries, languages, totals of a table of files. manifest: see sources.manifest."""
    f = files.withColumn("file_id", F.col("relative_path"))
    symbols = graph.cut(parse.parse_symbols(f).withColumn("file_path", F.col("file_id")).withColumn("in_file", F.col("ordinal")))
    symbols = graph.cut(numbered(symbols, "ordinal", "file_path", "in_file"))
    edges = graph.cut(graph.all_edges(symbols))
    ranked = symbols.join(graph.page_rank(symbols, edges), "id")
    linked = graph.cut(graph.add_imports(edges, codebase.import_links(f, symbols)))
    return {
        "symbols": ranked, "edges": linked, "degrees": graph.degrees(symbols, linked), "entries": sources.entry_points(files, manifest),
        "languages": sources.languages(files), "totals": sources.totals(files),
    }


def codebase_context(files: DataFrame, prompt: str, target_tokens: int = 8000, manifest: DataFrame | None = None) -> DataFrame:
    a = analyze_codebase(files, manifest)
    return codebase.prompt_context(a["symbols"], prompt, target_tokens, a["entries"], (files.count(), a["symbols"].count()))
