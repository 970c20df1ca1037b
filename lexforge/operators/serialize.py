"""Selected symbols as text and chunks; differences between versions; budgets by category; restore maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import at_least, ceil_div, js_round, units


def bare_signature(sig: Column, name_only: bool = False) -> Column:
    """On one line, without braces, types of parameters and results. name_only: just the declared name."""
    x = F.trim(F.regexp_replace(F.regexp_replace(sig, r"\s*[{]\s*[.]{3}\s*[}]\s*\z", ""), r"\s+", " "))
    inner = F.regexp_extract(x, r"\(([^)]*)\)", 1)
    last = lambda p: F.element_at(F.split(F.trim(F.split(F.trim(p), ":")[0]), r"\s+"), -1)
    names = F.array_join(F.filter(F.transform(F.split(inner, ","), last), lambda s: s != ""), ", ")
    place = F.regexp_instr(x, F.lit(r"\([^)]*\)"))
    left, right = F.substring(x, F.lit(1), place - 1), F.substring(x, place + F.length(inner) + 2, F.length(x))
    x = F.when(place > 0, F.concat(left, F.lit("("), names, F.lit(")"), right)).otherwise(x)
    x = F.regexp_replace(x, r"\)\s*:\s*[^{]+\z", ")")
    if not name_only:
        return x
    name = F.regexp_extract(x, r"(?:type|enum|interface|class|function)\s+([A-Za-z0-9_$]+)", 1)
    return F.when(name != "", name).otherwise(x)


def header(task: Column, strategy: Column) -> Column:
    return F.concat(F.lit("// Optimized for "), task, F.lit(" task · "), strategy, F.lit(" strategy"))


def _mode(mode: Column | str) -> Column:
    return F.lit(mode) if isinstance(mode, str) else mode


def _pieces(filled: DataFrame, mode: Column | str, name_only: bool) -> DataFrame:
    """content, the lines it becomes, and how many line numbers it takes. mode: maximal, minify or standard, for all or by row."""
    content = F.when(F.col("form") == "body", F.col("full_source")).otherwise(F.col("signature"))
    df = filled.filter("form != 'excluded'").withColumn("content", content).filter("content != ''")
    n = F.size(F.split("content", "\n"))
    doc = F.col("documentation") if "documentation" in filled.columns else F.lit(None).cast("string")
    lead = F.when(doc.isNotNull(), F.array(F.concat(F.lit("/** "), doc, F.lit(" */")))).otherwise(F.array().cast("array<string>"))
    forms = {
        "maximal": (F.array(bare_signature(F.col("signature"), name_only)), F.lit(1)),
        "minify": (F.array(F.concat(F.lit("// "), F.col("name"), F.lit(": "), F.col("type")), F.trim(F.regexp_replace("content", "\\n+", " "))), F.lit(2)),
    }
    own, used = F.array(F.col("content"), F.lit("")), n + 1
    for m, (o, u) in forms.items():
        own, used = F.when(_mode(mode) == m, o).otherwise(own), F.when(_mode(mode) == m, u).otherwise(used)
    return df.withColumns({"emitted": F.concat(lead, own), "used": (F.size(lead) + used).cast("long")})


def chunks(filled: DataFrame, mode: Column | str = "standard", import_lines: Column | None = None, name_only: bool = False, by: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """A row for each emitted symbol: position, content, start_line, end_line, token_count, symbol, priority, chunk_type. Line numbers are a
    running sum of the lines before. import_lines: how many lines the import block takes."""
    df = _pieces(filled, mode, name_only)
    first = F.when(_mode(mode) == "standard", 2).otherwise(1) + (import_lines if import_lines is not None else F.lit(0))
    w = Window.partitionBy(*by).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("used").over(w), F.lit(0)) + first
    return df.withColumns({"start_line": start, "end_line": start + F.col("used") - 1}).select(
        *by, "position", "content", "start_line", "end_line", at_least(F.col("content"), 1).alias("token_count"), F.col("name").alias("symbol"),
        F.when(F.col("form") == "body", 10).otherwise(5).alias("priority"), F.lit("symbol").alias("chunk_type"), "emitted",
    )


def code_of(chunk_rows: DataFrame, files: DataFrame, mode: Column | str = "standard", by: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """(by..., code): files (by..., task, strategy, imports array or null) with the chunks' lines under header and imports."""
    body = chunk_rows.groupBy(*by).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("position", "emitted"))), lambda e: e["emitted"])).alias("body"))
    df = files.join(body, list(by), "left")
    lines = F.coalesce("body", F.array().cast("array<string>"))
    lines = F.when((_mode(mode) == "standard") & (F.size(lines) > 0), F.concat(F.array(header(F.col("task"), F.col("strategy"))), lines)).otherwise(lines)
    block = F.lit("")
    if "imports" in files.columns:
        block = F.when((_mode(mode) != "maximal") & (F.size(F.coalesce("imports", F.array().cast("array<string>"))) > 0), F.concat(F.array_join(F.array_distinct("imports"), "\n"), F.lit("\n\n"))).otherwise("")
    return df.select(*by, F.regexp_replace(F.concat(block, F.array_join(lines, "\n")), r"\A\s+|\s+\z", "").alias("code"))


def metrics(before: Column, after: Column) -> dict[str, Column]:
    """Savings of a text of `before` tokens that became `after`."""
    return {
        "reduction_tokens": before - after,
        "reduction_percent": F.when(before > 0, js_round((F.lit(1.0) - after / before) * 100)).otherwise(F.lit(0)).cast("long"),
        "compression_ratio": F.when(after > 0, js_round(before / after * 100) / 100).otherwise(F.lit(1.0)),
    }


# --- differences


def changed_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new (file_id, ordinal, name, full_source) whose name is new or has another source. Of old symbols with the same name the last counts."""
    last = Window.partitionBy("file_id", "name").orderBy(F.desc("ordinal"))
    o = old.withColumn("r", F.row_number().over(last)).filter("r = 1").select("file_id", "name", F.col("full_source").alias("was"))
    return new.join(o, ["file_id", "name"], "left").filter(~F.col("full_source").eqNullSafe(F.col("was"))).drop("was")


def unchanged_symbols(old: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of old whose names aren't among the changed ones: unchanged and deleted."""
    return old.join(changed.select("file_id", "name"), ["file_id", "name"], "left_anti")


# --- budgets

CATEGORY = {"header": "header", "import": "imports", "symbol": "symbols", "dependency": "dependencies"}
CATEGORIES = ["symbols", "imports", "header", "dependencies", "overhead"]


def category(kind: Column) -> Column:
    out = F.lit("overhead")
    for k, c in CATEGORY.items():
        out = F.when(kind == k, c).otherwise(out)
    return out


def inferred_type(content: Column) -> Column:
    x = F.ltrim(content)
    starts = lambda *ws: F.greatest(*[x.startswith(f"{w} ") for w in ws]) if len(ws) > 1 else x.startswith(f"{ws[0]} ")
    out = F.when(starts("class"), "class").when(starts("interface"), "interface").when(starts("type"), "typeAlias").when(starts("enum"), "enum")
    out = out.when(starts("function", "async function"), "function").when(starts("const", "let", "var"), F.when(x.contains("=>"), "arrowFunction").otherwise("variable"))
    return out.when(x.contains("()") & x.contains("{"), "method").otherwise("symbol")


def has_body(token_count: Column, name: Column) -> Column:
    sig = F.when(F.coalesce(F.length(name), F.lit(0)) == 0, F.lit(20)).otherwise(ceil_div(units(name), 3.5))
    return token_count > sig * 2


def budget_breakdown(chunk_rows: DataFrame, by: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Tokens by category, a column each."""
    c = category(F.col("chunk_type"))
    return chunk_rows.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(c == k, F.col("token_count"))), F.lit(0)).cast("long").alias(k) for k in CATEGORIES])


def per_symbol(chunk_rows: DataFrame, by: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Each symbol chunk with its share of the symbols' tokens, one decimal."""
    s = chunk_rows.filter("chunk_type = 'symbol'")
    total = F.sum("token_count").over(Window.partitionBy(*by))
    pct = F.when(total > 0, js_round(F.col("token_count") / total * 1000) / 10).otherwise(F.lit(0.0))
    return s.select(*by, "position", F.col("symbol").alias("name"), inferred_type(F.col("content")).alias("type"), F.col("token_count").alias("tokens"), pct.alias("pct"), has_body(F.col("token_count"), F.col("symbol")).alias("has_body"))


def bar(pct: Column, width: int = 20) -> Column:
    n = js_round(pct / 100 * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def budget_text(breakdown: DataFrame, symbols: DataFrame, totals: DataFrame, by: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """(by..., report). totals: by..., total, reduction."""
    number = lambda c: F.lpad(F.format_number(c, 0), 6, " ")
    top = symbols.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("tokens"), "position"))).filter("r <= 10")
    line = F.concat(F.lit("  "), F.when(F.length("name") < 24, F.rpad("name", 24, " ")).otherwise(F.col("name")), F.lit(" "), number(F.col("tokens")), F.format_string(" tok (%.1f%%)", "pct"), F.when(F.col("has_body"), " ●").otherwise(" ○"))
    top = top.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", line.alias("l")))), lambda e: e["l"]).alias("top"))
    df = totals.join(breakdown, list(by)).join(top, list(by), "left")
    rows = []
    for c in CATEGORIES:
        pct = F.col(c) / F.col("total") * 100
        rows.append(F.concat(F.rpad(F.lit(c), 12, " "), F.lit(" "), bar(F.least(pct, F.lit(100.0))), F.lit(" "), F.lpad(F.format_string("%.1f", pct), 5, " "), F.lit("% ("), number(F.col(c)), F.lit(" tok)")))
    tail = F.array(F.lit(""), F.concat(F.lit("total        "), number(F.col("total")), F.lit(" tokens")), F.concat(F.lit("reduction    "), F.format_string("%.1f%%", F.col("reduction").cast("double"))))
    listed = F.when(F.size(F.coalesce("top", F.array().cast("array<string>"))) > 0, F.concat(F.array(F.lit(""), F.lit("Top symbols by tokens:")), F.col("top"))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.array(*rows), tail, listed), "\n")
    return df.select(*by, F.when(F.col("total") == 0, "No tokens to visualize (empty result)").otherwise(text).alias("report"))


def budget_json(breakdown: DataFrame, symbols: DataFrame, by: tuple[str, ...] = ("file_id",)) -> DataFrame:
    each = symbols.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col("tokens")).alias("o"), "position", "name", "type", "tokens", "pct", F.col("has_body").alias("hasBody")))).alias("x"))
    lean = F.transform("x", lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type"), e["tokens"].alias("tokens"), e["pct"].alias("pct"), e["hasBody"].alias("hasBody")))
    return breakdown.join(each, list(by), "left").select(*by, F.to_json(F.struct(*CATEGORIES, lean.alias("perSymbol")), {"pretty": "true"}).alias("json"))


def savings(original: Column, n_symbols: Column, chars: Column) -> dict[str, Column]:
    """What an aggressive run would leave of `original` tokens."""
    up = lambda c: F.ceil(c).cast("long")
    head, imp = up(original * F.lit(0.03)), up(original * F.lit(0.05))
    left = head + imp + (n_symbols - up(n_symbols * F.lit(0.2))) * 20 + up((original - head - imp) * F.lit(0.2))
    some = original > 0
    return {
        "original_tokens": original,
        "chars_per_token": F.when(some, js_round(chars / original * 100) / 100).otherwise(F.lit(0.0)),
        "estimated_tokens": F.when(some, F.greatest(F.lit(1).cast("long"), left)).otherwise(F.lit(0).cast("long")),
        "savings_percent": F.when(some, js_round((F.lit(1.0) - left / original) * 1000) / 10).otherwise(F.lit(0.0)),
    }


# --- restore maps


def restore_map(chunk_rows: DataFrame, symbols: DataFrame, plain_names: bool = False) -> DataFrame:
    """A row for each chunk: chunk_id, symbol_names, original_sources, start_line, token_count, original_tokens. Sources are found by
    "file path:name" (the last such symbol); chunks that carry bare names find none unless plain_names is set."""
    last = Window.partitionBy("file_id", "key").orderBy(F.desc("ordinal"))
    key = F.col("name") if plain_names else F.concat_ws(":", F.coalesce("file_path", F.lit("")), F.col("name"))
    s = symbols.withColumn("key", key).withColumn("r", F.row_number().over(last)).filter("r = 1").select("file_id", "key", "full_source")
    c = chunk_rows.select("file_id", "position", F.concat(F.lit("chunk:"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")).alias("chunk_id"), F.col("symbol").alias("key"), "start_line", "token_count")
    df = c.join(s, ["file_id", "key"], "left")
    found = F.when(F.col("full_source").isNull(), F.array().cast("array<string>")).otherwise(F.array("full_source"))
    cost = F.when(F.col("full_source").isNull(), F.lit(0)).otherwise(ceil_div(units(F.col("full_source")), 3.5)).cast("long")
    return df.select("file_id", "position", "chunk_id", F.array("key").alias("symbol_names"), found.alias("original_sources"), "start_line", "token_count", cost.alias("original_tokens"))


def restore_map_from_code(files: DataFrame, chunk_rows: DataFrame, plain_names: bool = False) -> DataFrame:
    """restore_map() of files (file_id, content, language), which are parsed here."""
    from . import parse

    return restore_map(chunk_rows, parse.parse_symbols(files).withColumn("file_path", F.lit("")), plain_names)


def restore_symbol(symbols: DataFrame, key: str) -> DataFrame:
    """(full_source) of the last symbol with that "file path:name"."""
    hit = symbols.filter(F.concat_ws(":", F.coalesce("file_path", F.lit("")), F.col("name")) == key)
    return hit.orderBy(F.desc("ordinal")).limit(1).select("full_source")


def restore_chunk(entries: DataFrame, chunk_id: str) -> DataFrame:
    return entries.filter(F.col("chunk_id") == chunk_id).select("original_sources")


def restore_text(entries: DataFrame) -> DataFrame:
    """(file_id, report)"""
    line = F.concat(F.format_string("  %s (%d tok):\n", "chunk_id", "token_count"), F.array_join(F.transform("symbol_names", lambda n: F.concat(F.lit("    - "), n)), "\n"))
    df = entries.groupBy("file_id").agg(F.sum("original_tokens").alias("o"), F.sum("token_count").alias("c"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("position", line.alias("l")))).alias("x"))
    head = F.format_string("=== Context restore map ===\nTotal original tokens: %d\nTotal compressed tokens: %d\nCompression ratio: %.2fx\nEntries: %d\n\nEntries:\n", "o", "c", F.col("o") / F.greatest(F.lit(1), F.col("c")), "n")
    return df.select("file_id", F.concat(head, F.array_join(F.transform("x", lambda e: e["l"]), "\n")).alias("report"))

