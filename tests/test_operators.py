"""Operators against hand-derived values and laws."""

import math

import pytest
from pyspark.sql import functions as F

from lexforge.functions import compress as C
from lexforge.functions import profiles as P
from lexforge.functions import text as T
from lexforge.operators import graph as G
from lexforge.operators import parse, ranking, semantic, serialize


def values(spark, texts, **cols):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").coalesce(1)
    rows = df.select("i", *[c.alias(n) for n, c in cols.items()]).orderBy("i").collect()
    return [{n: r[n] for n in cols} if len(cols) > 1 else r[1] for r in rows]


def X():
    return F.col("x")


def test_token_estimates(spark):
    texts = ["", "x = 1", 'function hello() { return "world"; }', "const x: number = 42; export function foo() {}"]
    assert values(spark, texts, t=T.tokens(X())) == [0, 6, 20, 26]
    fast = values(spark, ["a" * 36], **{e: T.fast_tokens(X(), e) for e in T.RATIOS})[0]
    assert fast == {"cl100k_base": 11, "p50k_base": 12, "r50k_base": 12, "o200k_base": 9}
    assert values(spark, ["a😀é"], u=T.units(X())) == [4]
    assert values(spark, ["x"], c=T.chars_of_tokens(F.lit(100))) == [350]


def plain_tokens(code):
    """A scan from the description: lexeme by lexeme."""
    import re

    if not code:
        return 0
    n, i = 0, 0
    while i < len(code):
        c = code[i]
        if c in "\n\r \t":
            n, i = n + 1, i + 1
        elif ord(c) < 128:
            if code.startswith("...", i):
                n, i = n + 2, i + 3
                continue
            k = re.match(r"(?:%s)\b" % "|".join(T.KEYWORDS), code[i:], re.ASCII)
            if k:
                n, i = n + (2 if len(k[0]) <= 5 else 3), i + len(k[0])
                continue
            d = re.match(r"[0-9]+\.?[0-9]*(?:[Ee][-+]?[0-9]+)?(?:n\b)?", code[i:], re.ASCII)
            w = re.match(r"[A-Za-z_$#][A-Za-z0-9_$\u0080-\U0010ffff]*", code[i:])
            if d:
                n, i = n + (2 if len(d[0]) <= 4 else 3), i + len(d[0])
            elif w:
                n, i = n + max(1, math.ceil(len(w[0].encode("utf-16-le")) / 2 / 3.2)), i + len(w[0])
            else:
                n, i = n + 1, i + 1
        else:
            n, i = n + {2: 2, 3: 3, 4: 8}[len(c.encode())], i + 1
    return max(1, math.ceil(n * 0.88))


def test_token_estimates_equal_a_scan(spark):
    texts = ["a!==b ====> c", "....x ??= 1e5 12345.6n 7n", "ofé of$ of.", "日本 😀 é$", "instanceof in interface int", "#priv $x _y", "\t\r\n  "]
    assert values(spark, texts, t=T.tokens(X())) == [plain_tokens(t) for t in texts]


def test_breakdown_and_splitting(spark):
    b = values(spark, ["// comment\nconst x = 1; /* block */"], **T.breakdown(X()))[0]
    assert b["lines"] == 2 and b["comment_tokens"] == 7 and b["words"] == 9
    code = "\n".join(f"function f{i}() {{ return {i}; }}" for i in range(100))
    chunks = values(spark, [code, "short"], c=T.split_to_fit(X(), 50))
    assert "\n".join(chunks[0]) == code and len(chunks[0]) > 5 and chunks[1] == ["short"]
    assert max(plain_tokens(c) for c in chunks[0]) <= 70


def test_compression(spark):
    texts = ["const x = 1; // note\n\n\nconst y = '// kept';", "/* a */ let  z = 1;", ""]
    assert values(spark, texts, c=C.compress(X())) == ["const x = 1;\nconst y = '// kept';", "let z = 1;", ""]
    o = C.Options(minify=True)
    assert values(spark, ["function f() {\n  return 'a  b';\n}\n"], c=C.compress(X(), o)) == ["function f(){return 'a  b'}"]
    assert values(spark, ["x = '$$1'  // c"], c=C.compress(X())) == ["x = '$1'"]
    assert values(spark, ["#!/bin/sh\nx = 1"], c=C.smart_compress(X(), C.Options(), "python")) == ["#!/bin/sh\nx = 1"]
    assert values(spark, ["debugger; console.log(1); y"], c=C.remove_debug(C.remove_console(X()))) == ["y"]
    assert values(spark, ["return 1; dead(); x"], c=C.remove_dead_code(X())) == ["return; x"]


def test_languages_and_profiles(spark):
    assert values(spark, ["a/b.PY", "x.tsx", "Makefile", "c.kts"], c=P.language_of(X())) == ["python", "typescript", "typescript", "kotlin"]
    total, comment = F.lit(10000), F.lit(0.2)
    for penalty, want in ((None, [2500, 3500, 2400, 1500, 100]), (2, [2250, 3150, 3000, 1500, 100]), (5, [1500, 2100, 4800, 1500, 100])):
        p = None if penalty is None else F.lit(penalty)
        assert list(values(spark, ["x"], **P.allocate(total, comment, p))[0].values()) == want
    rows = [("adaptive", "gpt-3.5-turbo", "bug-fix", 12000, 48000), ("adaptive", "claude-3-opus", "code-review", 180000, 100), ("balanced", "local", "nonsense", 8000, 0)]
    got = P.select_strategy(spark.createDataFrame(rows, "strategy string, model string, task string, budget int, size int")).collect()
    by = {r.task: r for r in got}
    assert by["bug-fix"].chosen == "aggressive" and by["bug-fix"].minify and abs(by["bug-fix"].body_threshold - 0.93) < 1e-9
    assert by["code-review"].chosen == "preservative" and not by["code-review"].minify
    assert [by["nonsense"][k] for k in ("critical", "important", "relevant", "dependency", "documentation")] == [2000, 2800, 1960, 1200, 40]
    assert P.token_limit("gpt-4") == (6000, 8192) and P.token_limit("other", 5) == (5, 200000)


def symbol(name, body="", sig="", ordinal=0, file="f", **k):
    return {"file_id": file, "ordinal": ordinal, "id": f"{file}{ordinal}", "name": name, "type": "function", "full_source": body, "signature": sig, "visibility": "public", "is_exported": False, "call_count": 0, "dependents": 0, "complexity": 1, "file_path": "", **k}


def frame(spark, rows):
    return spark.createDataFrame(rows).withColumns({c: F.col(c).cast("int") for c in ("ordinal", "call_count", "dependents", "complexity")})


def test_ranking(spark):
    (r,) = ranking.rank(frame(spark, [symbol("main", is_exported=True, call_count=5, complexity=2)]), 0.6).collect()
    assert abs(r["rank"] - 79.5) < 1e-9 and r.keep_body and r.reason == "rank 80/100 — callFrequency dominant (50)"
    (r,) = ranking.rank(frame(spark, [symbol("parseUser", "reads the user token")]), 0.6, "fix user token token").collect()
    assert abs(r.f_taskRelevance - (0.5 + 0.1 + 0.1) * 30) < 1e-9


def test_fill_skips_and_goes_on(spark):
    # costs (body, signature): (60, 10), (50, 20), (30, 5), (100, 99) with 100 to spend
    rows = [symbol(f"s{i}", "b" * int(b * 3.5), "s" * int(s * 3.5), i, rank=float(9 - i), keep_body=True) for i, (b, s) in enumerate([(60, 10), (50, 20), (30, 5), (100, 99)])]
    got = ranking.fill(frame(spark, rows), 100).orderBy("position").collect()
    assert [r.form for r in got] == ["body", "signature", "signature", "excluded"] and got[0].left_over == 15


def test_graph(spark):
    s = spark.createDataFrame([("0", "main", "main() helper() util()", 0, True), ("1", "helper", "x", 1, False), ("2", "util", "y", 2, False), ("3", "solo", "z", 3, False)], "id string, name string, full_source string, ordinal int, is_exported boolean")
    edges = G.all_edges(s).cache()
    assert {(r.src, r.dst) for r in edges.collect()} == {("0", "1"), ("0", "2")}
    pr = {r.id: round(r.page_rank, 6) for r in G.page_rank(s, edges).collect()}
    assert pr == {"0": 0.206186, "1": 0.293814, "2": 0.293814, "3": 0.206186}
    assert {r.id: r.cluster for r in G.components(s, edges).collect()} == {"0": 0, "1": 0, "2": 0, "3": 1}
    assert [r.id for r in G.orphans(s, edges).collect()] == ["3"]
    assert [r.id for r in G.entry_candidates(s, edges).collect()] == ["0"]
    assert {r.id: r.depth for r in G.depths(s, edges, s.filter("name = 'helper'")).collect()} == {"0": 1, "1": 0, "2": 2, "3": 0}
    e = edges.withColumn("ordinal", F.col("dst").cast("int"))
    (p,) = G.shortest_paths(s, e, "helper", "util").collect()
    assert (p.path, p.total_weight, p.depth) == (["helper", "main", "util"], 2.0, 2)
    assert G.hot_path(s.join(G.page_rank(s, edges), "id"), e) == ["helper"]
    imp = spark.createDataFrame([("0", "1"), ("3", "0")], "src string, dst string")
    assert {(r.src, r.dst) for r in G.add_imports(edges, imp).filter("type = 'import'").collect()} == {("3", "0")}


def test_inheritance(spark):
    s = spark.createDataFrame([("0", "A", "class A extends B implements I, J {", 0), ("1", "B", "", 1), ("2", "I", "", 2), ("3", "J", "", 3)], "id string, name string, full_source string, ordinal int")
    assert [(r.src, r.dst, r.weight) for r in G.inheritance_edges(s).collect()] == [("0", "1", 2.0)]
    assert sorted((r.dst, r.weight) for r in G.implementation_edges(s).collect()) == [("2", 1.5), ("3", 1.5)]


def test_relevance(spark):
    docs = spark.createDataFrame([(1, "parse csv file rows"), (2, "render html table"), (3, "parse json data"), (4, "")], "id int, text string").withColumn("ordinal", F.col("id"))
    tf = semantic.term_counts(docs)
    idfs = semantic.idf(tf, 4)
    got = {r.term: r.idf for r in idfs.collect()}
    assert abs(got["csv"] - (math.log(5 / 2) + 1)) < 1e-9 and abs(got["parse"] - (math.log(5 / 3) + 1)) < 1e-9
    w = semantic.weights(tf, idfs)
    order = semantic.ranked_by(docs, semantic.scores(docs, w, idfs, "render html table")).collect()
    assert order[0].id == 2 and abs(order[0].score - 1) < 1e-9 and order[-1].score == 0
    rel = semantic.related(w).collect()
    assert {(r.id, r.other) for r in rel} == {(1, 3), (3, 1)} and abs(rel[0].score - rel[1].score) < 1e-12
    assert values(spark, ["The quick-brown FOX is it"], t=semantic.terms(X())) == [["quick", "brown", "fox"]]
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    assert values(spark, ["x"], a=semantic.map_cosine(m(a=1.0, b=2.0), m(a=1.0, b=2.0)), b=semantic.map_cosine(m(a=1.0), m(b=1.0)))[0] == pytest.approx({"a": 1.0, "b": 0.0})


TS = """import d, { a as b, c } from './m';
export class UserService extends Base implements Api {
  private cache = "}";
  async load(id: string): Promise<void> { if (id) { this.x = '{'; } }
}
export interface Api { run(): void }
export async function main(a: number): number {
  return helper(a);
}
enum Color { Red }
export type Id = string;
"""
PY = "class Foo(Base):\n    def run(self, x):\n        return x\n\ndef main():\n    pass\n"
GO = "package main\n\nfunc Add(a int, b int) int {\n  return a + b\n}\n\nfunc main() {\n}\n"


def test_parser():
    s = {x["name"]: x for x in parse.symbols_of(TS, "typescript")}
    assert s["UserService"]["type"] == "class" and s["UserService"]["end_line"] == 5 and s["UserService"]["is_exported"]
    assert s["main"]["is_async"] and s["main"]["full_source"].endswith("helper(a);\n}") and s["main"]["signature"] == "export async function main(a: number): number { ... }"
    assert s["Api"]["type"] == "interface" and s["Color"]["type"] == "enum" and s["Id"]["type"] == "typeAlias" and s["load"]["type"] == "method"
    assert {x["name"] for x in parse.symbols_of(PY, "python")} >= {"Foo", "main", "run"}
    assert {x["name"] for x in parse.symbols_of(GO, "go")} >= {"Add", "main"}
    assert parse.symbols_of("x", "swift") == [] and parse.symbols_of("", "go") == []
    assert [x["name"] for x in parse.symbols_of("pub struct P { x: i32 }\nfn go() {}", "rust")][:2] == ["P", "go"]
    assert parse.symbols_of("public class A { }", "java")[0]["name"] == "A"


def test_imports_and_exports(spark):
    f = spark.createDataFrame([("1", TS, "typescript"), ("2", "import os\nfrom a.b import c\n", "python"), ("3", 'import "fmt"', "go")], "file_id string, content string, language string")
    got = {(r.file_id, r.path): r for r in parse.imports_of(f).collect()}
    assert set(got) == {("1", "./m"), ("2", "os"), ("2", "a.b")} and got["1", "./m"].named == ["a", "c"]
    assert [r.names for r in parse.exports_of(f).filter("file_id = '1'").orderBy("ordinal").collect()] == [["UserService"], ["Api"], ["Id"]]
    line = parse.attach_imports(parse.parse_symbols(f), parse.imports_of(f), f).filter("name = 'main' and file_id = '1'").first().import_statements
    assert line == ["import { a, c } from './m'"]


def test_serializer_and_budgets(spark):
    rows = [symbol("foo", "function foo(a: A) {\n  return 1;\n}", "function foo(a: A, b?: B): C { ... }", 0, position=0, form="body"), symbol("bar", "", "class bar { ... }", 1, position=1, form="signature"), symbol("no", "x", "y", 2, position=2, form="excluded")]
    df = frame(spark, rows)
    c = serialize.chunks(df).orderBy("position").collect()
    assert [(r.start_line, r.end_line, r.priority) for r in c] == [(2, 5, 10), (6, 7, 5)]
    head = spark.createDataFrame([("f", "general", "balanced", ["import x", "import x"])], "file_id string, task string, strategy string, imports array<string>")
    code = serialize.code_of(serialize.chunks(df), head).first().code
    assert code == "import x\n\n// Optimized for general task · balanced strategy\nfunction foo(a: A) {\n  return 1;\n}\n\nclass bar { ... }"
    assert serialize.code_of(serialize.chunks(df, "maximal"), head, "maximal").first().code == "function foo(a, b?)\nclass bar"
    assert serialize.code_of(serialize.chunks(df, "maximal", name_only=True), head, "maximal").first().code == "foo\nbar"
    b = serialize.budget_breakdown(serialize.chunks(df)).first()
    assert b.symbols == sum(r.token_count for r in c) and b.imports == 0
    p = {r.name: r for r in serialize.per_symbol(serialize.chunks(df)).collect()}
    assert p["foo"].type == "function" and p["foo"].has_body and p["bar"].type == "class" and abs(p["foo"].pct + p["bar"].pct - 100) < 0.11
    m = serialize.restore_map(serialize.chunks(df), df)
    assert [r.original_sources for r in m.collect()] == [[], []]
    m = serialize.restore_map(serialize.chunks(df), df, plain_names=True).orderBy("position").collect()
    assert m[0].original_sources == [rows[0]["full_source"]] and m[0].chunk_id == "chunk:2-5"
    assert values(spark, ["x"], **serialize.metrics(F.lit(100), F.lit(40)))[0] == {"reduction_tokens": 60, "reduction_percent": 60, "compression_ratio": 2.5}
    assert values(spark, ["x"], **serialize.metrics(F.lit(8), F.lit(10)))[0]["reduction_percent"] == -25


def test_fill_of_a_large_group_is_one_pass(spark):
    """Against a loop; null flags and budgets included. Nothing gathers a group into a row."""
    n = 30_000
    rows = spark.range(n).selectExpr(
        "id % 2 as file_id", "id as ordinal", "cast(hash(id) % 50 as double) as rank", "if(id % 11 = 0, null, id % 3 = 0) as keep_body", "repeat('b', cast(id * 7 % 900 as int)) as full_source", "repeat('s', cast(id * 5 % 120 as int)) as signature", "if(id % 2 = 0, 5000, null) as budget"
    )
    done = ranking.filled(rows, F.col("budget"))
    assert "collect_list" not in done._jdf.queryExecution().toString()
    want, left, order = {}, 5000, sorted((r for r in rows.collect() if r.file_id == 0), key=lambda r: (-r.rank, r.ordinal))
    for k, r in enumerate(order):
        body, sig = max(5, math.ceil(len(r.full_source) / 3.5)), max(2, math.ceil(len(r.signature) / 3.5))
        form = "excluded" if left <= 0 else "body" if r.keep_body and body <= left else "signature" if sig <= left else "excluded"
        left -= {"body": body, "signature": sig, "excluded": 0}[form]
        want[r.ordinal] = k, form
    got = done.collect()
    assert {r.ordinal: (r.position, r.form) for r in got if r.file_id == 0} == want and {r.left_over for r in got if r.file_id == 0} == {left}
    assert {(r.form, r.left_over) for r in got if r.file_id == 1} == {("excluded", None)} and len(got) == n
