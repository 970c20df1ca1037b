"""Named tools over JSON arguments, a line-delimited JSON-RPC adapter, and a command line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import compress as C
from .functions import text as T
from .operators import graph, parse
from .plans import optimize as plans
from .sources import files as sources


def _tool(text: str, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict:
    kinds = {"targetTokens": "number", "maxTokens": "number", "maximal": "boolean", "aggressive": "boolean"}
    fields = {k: {"type": kinds.get(k, "string")} for k in (*required, *optional)}
    return {"description": text, "inputSchema": {"type": "object", "properties": fields, "required": list(required)}}


TOOLS = {
    "optimize_context": _tool("Code as context within a token budget", ("code",), ("language", "model", "strategy", "taskType", "taskPrompt", "targetTokens", "maxTokens", "maximal")),
    "compress_code": _tool("Code without comments, blank lines and needless white space", ("code",), ("language", "aggressive")),
    "count_tokens": _tool("Estimated tokens of a text", ("code",), ("encoding",)),
    "extract_diff": _tool("Symbols that differ between two versions", ("original", "modified"), ("language",)),
    "parse_code": _tool("Symbols of a text", ("code",), ("language",)),
    "analyze_context": _tool("Lines, tokens, symbols and graph of a text", ("code",), ("language",)),
}


def _file(spark: SparkSession, args: dict, key: str = "code") -> DataFrame:
    return spark.createDataFrame([("0", args[key], args.get("language") or "typescript")], "file_id string, content string, language string")


def _one(df: DataFrame) -> dict:
    row = df.first()
    return row.asDict(recursive=True) if row else {}


def _optimize(spark, a):
    o = plans.Options(model=a.get("model", "claude-3-sonnet"), strategy=a.get("strategy", "adaptive"), task=a.get("taskType", "general"), prompt=a.get("taskPrompt"), target_tokens=a.get("targetTokens"), max_tokens=a.get("maxTokens"), maximal=bool(a.get("maximal")))
    return _one(plans.optimize(_file(spark, a), o).drop("file_id"))


def _compress(spark, a):
    cols = C.compress_full(F.col("content"), C.Options(minify=bool(a.get("aggressive"))), a.get("language"))
    return _one(_file(spark, a).select(*[c.alias(n) for n, c in cols.items()]))


def _count(spark, a):
    b = T.breakdown(F.col("content"))
    return _one(_file(spark, a).select(*[b[k].alias(k) for k in ("tokens", "characters", "words", "lines")], F.lit(a.get("encoding", "cl100k_base")).alias("encoding")))


def _diff(spark, a):
    df = spark.createDataFrame([("0", a["original"], a["modified"], a.get("language") or "typescript")], "file_id string, original string, modified string, language string")
    return _one(plans.extract_diff(df).drop("file_id"))


def _parse(spark, a):
    rows = parse.parse_symbols(_file(spark, a)).orderBy("ordinal").select("name", "type", "start_line", "end_line", "signature", "visibility", "is_exported").collect()
    return {"count": len(rows), "symbols": [r.asDict() for r in rows]}


def _analyze(spark, a):
    f = _file(spark, a)
    line = F.trim("line")
    kind = F.when(line == "", "blank").when(line.startswith("//") | line.startswith("*") | line.startswith("/*"), "comment").otherwise("code")
    lines = {r.k: r.n for r in f.select(F.explode(F.split("content", "\n")).alias("line")).groupBy(kind.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    s = parse.parse_symbols(f).cache()
    kinds = {r.type: r["count"] for r in s.groupBy("type").count().collect()}
    nodes, edges = graph.build(s)
    out = {"lines": lines, "tokens": f.select(T.tokens(F.col("content"))).first()[0], "symbols_by_type": kinds, "exported": s.filter("is_exported").count(), "graph": _one(graph.stats(nodes, edges))}
    s.unpersist()
    return out


HANDLERS: dict[str, Callable] = {"optimize_context": _optimize, "compress_code": _compress, "count_tokens": _count, "extract_diff": _diff, "parse_code": _parse, "analyze_context": _analyze}


def call(spark: SparkSession, name: str, args: dict) -> dict:
    """The tool's result as text content; errors are content too."""
    try:
        if name not in HANDLERS:
            raise ValueError(f"Unknown tool: {name}")
        return {"content": [{"type": "text", "text": json.dumps(HANDLERS[name](spark, args), ensure_ascii=False, default=str)}]}
    except Exception as e:  # the protocol carries errors in the answer
        return {"content": [{"type": "text", "text": f"Error: {e}"}], "isError": True}


def serve(spark: SparkSession, lines: Iterable[str]) -> Iterator[str]:
    """Answers JSON-RPC requests, one a line."""
    for line in lines:
        if not line.strip():
            continue
        rid = None
        try:
            r = json.loads(line)
            rid = r.get("id")
            method = r.get("method")
            if method == "initialize":
                result = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "lexforge", "version": "0.1"}}
            elif method == "tools/list":
                result = {"tools": [{"name": n, **t} for n, t in TOOLS.items()]}
            elif method == "tools/call":
                result = call(spark, r["params"]["name"], r["params"].get("arguments", {}))
            else:
                yield json.dumps({"jsonrpc": "2.0", "id": rid, "error": {"code": -32601, "message": f"Method not found: {method}"}})
                continue
            yield json.dumps({"jsonrpc": "2.0", "id": rid, "result": result})
        except ValueError as e:
            yield json.dumps({"jsonrpc": "2.0", "id": rid, "error": {"code": -32700, "message": str(e)}})
        except Exception as e:  # any other failure is an internal error of the protocol
            yield json.dumps({"jsonrpc": "2.0", "id": rid, "error": {"code": -32603, "message": str(e)}})


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexforge")
    sub = p.add_subparsers(dest="command", required=True)
    o = sub.add_parser("optimize", help="one file as context within a budget")
    o.add_argument("file")
    o.add_argument("-o", "--output")
    o.add_argument("-t", "--target-tokens", type=int)
    o.add_argument("-s", "--strategy", default="adaptive")
    o.add_argument("-m", "--model", default="claude-3-sonnet")
    c = sub.add_parser("count", help="estimated tokens of a file")
    c.add_argument("file")
    d = sub.add_parser("diff", help="symbols that differ between two files")
    d.add_argument("original")
    d.add_argument("modified")
    b = sub.add_parser("context", help="context of a folder for a prompt")
    b.add_argument("root")
    b.add_argument("prompt")
    b.add_argument("-t", "--target-tokens", type=int, default=8000)
    b.add_argument("-o", "--output")
    sub.add_parser("serve", help="JSON-RPC on standard input")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lexforge").getOrCreate()
    if a.command == "serve":
        for answer in serve(spark, sys.stdin):
            print(answer, flush=True)
        return 0
    if a.command == "context":
        text = plans.codebase_context(sources.scan(spark, a.root), a.prompt, a.target_tokens).first().context
    elif a.command == "count":
        f = sources.one_file(spark, a.file).select(T.tokens(F.col("content")).alias("t"), T.units(F.col("content")).alias("u"), T.lines(F.col("content")).alias("l")).first()
        text = f"{f.t} tokens, {f.u} characters, {f.l} lines, {f.u / max(f.t, 1):.2f} characters a token"
    elif a.command == "diff":
        old, new = (sources.one_file(spark, x).first() for x in (a.original, a.modified))
        text = _diff(spark, {"original": old.content, "modified": new.content, "language": new.language})["code"]
    else:
        f = sources.one_file(spark, a.file).first()
        text = _optimize(spark, {"code": f.content, "language": f.language, "strategy": a.strategy, "model": a.model, "targetTokens": a.target_tokens})["code"]
    if getattr(a, "output", None):
        with open(a.output, "w", encoding="utf-8") as out:
            out.write(text)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
