"""Whole pipelines, sources, tools and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from lexforge import tools
from lexforge.functions import text as T
from lexforge.plans import optimize as P
from lexforge.sources import files as S
from lexforge.streaming.incremental import changes


def many(n):
    return "\n".join(f"export function fn{i}(a: number): number {{\n  const value{i} = a + {i};\n  return value{i};\n}}\n" for i in range(n))


def files(spark, *codes):
    return spark.createDataFrame([(str(i), c, "typescript") for i, c in enumerate(codes)], "file_id string, content string, language string")


def test_budgets_hold(spark):
    f = files(spark, many(30), "", "no symbols here")
    r = {x.file_id: x for x in P.optimize_sync(f, P.Options(target_tokens=150, strategy="balanced")).collect()}
    assert r["0"].total_symbols == 30 and 0 < len(r["0"].included_symbols) < 30 and r["0"].excluded_symbols
    assert r["0"].optimized_tokens < r["0"].original_tokens and r["0"].reduction_percent > 0
    assert r["1"].code == "" and r["1"].original_tokens == 0 and r["2"].total_symbols == 0


def test_graph_and_minification(spark):
    f = files(spark, "// note\nexport function main() {\n  helper();\n}\nfunction helper() {\n  return 1;\n}\n")
    r = P.optimize(f, P.Options(model="local", task="bug-fix", strategy="aggressive")).first()
    assert r.completeness == 100 and "\n" not in r.code and "//" not in r.code


def test_a_batch_is_like_its_files(spark):
    """Large and small files take different strategies; neither changes the other."""
    codes = [many(400), many(2), "function main() {\n  return 1;\n}\n"]
    o = P.Options(model="gpt-4", task="bug-fix", strategy="adaptive")
    whole = {r.file_id: r.asDict() for r in P.optimize_sync(files(spark, *codes), o).collect()}
    for i, c in enumerate(codes[:2]):
        assert {**P.optimize_sync(files(spark, c), o).first().asDict(), "file_id": str(i)} == whole[str(i)]
    assert whole["1"]["code"].startswith("// Optimized for") != whole["0"]["code"].startswith("// Optimized for")


def test_blank_input(spark):
    r = P.optimize_sync(files(spark, "", " \n\t ")).collect()
    assert [(x.code, x.original_tokens, x.optimized_tokens, x.completeness, x.semantic_coverage, x.compression_ratio) for x in r] == [("", 0, 0, 100, 100, 1.0)] * 2


def test_diff(spark):
    old = "function old() { return 1; }\nfunction stable() { return 2; }\nfunction helper() { return 3; }"
    new = "function old() { return 9; }\nfunction stable() { return 2; }\nfunction newFunc() { return 4; }"
    r = P.extract_diff(spark.createDataFrame([("1", old, new, "typescript")], "file_id string, original string, modified string, language string")).first()
    assert r.included_symbols == ["old", "newFunc"] and r.excluded_symbols == ["stable", "helper"] and "return 9" in r.code and "return 2" not in r.code


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    d = tmp_path_factory.mktemp("tree")
    texts = {
        "src/utils.ts": "export function formatDate(d: Date) { return d; }\nexport function parseInput(x: string) { return x; }\n",
        "src/app.ts": "import { formatDate } from './utils';\nexport class UserService { go() { formatDate(1); } }\n",
        "src/lib/math.ts": "export function add(a: number) { return a; }\n",
        "node_modules/fake.ts": "export function fake() { return 0; }\n",
        ".git/x.ts": "export function hidden() { return 0; }\n",
    }
    for p, t in texts.items():
        (d / p).parent.mkdir(parents=True, exist_ok=True)
        (d / p).write_text(t)
    (d / "src/notes.txt").write_text("not code")
    return str(d)


def test_code_base(spark, tree):
    f = S.scan(spark, tree)
    assert {r.relative_path for r in f.collect()} == {"src/utils.ts", "src/app.ts", "src/lib/math.ts"}
    assert [r.asDict() for r in S.languages(f).collect()] == [{"language": "typescript", "files": 3}]
    a = P.analyze_codebase(f)
    names = {r.id: r.name for r in a["symbols"].collect()}
    assert set(names.values()) >= {"formatDate", "parseInput", "UserService", "add"}
    edges = {(names[r.src], names[r.dst], r.type) for r in a["edges"].collect()}
    assert ("UserService", "formatDate", "call") in edges
    r = P.codebase_context(f, "format the date", 400).first()
    assert r.relevant_symbols[0] == "src/utils.ts:formatDate" and "src/utils.ts" in r.relevant_files and "// 📁 src/utils.ts" in r.context
    assert r.token_count <= 400


def test_manifest(spark, tmp_path):
    for p in ("lib/core.ts", "src/index.ts", "other.ts"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("export const a = 1;\n")
    f = S.scan(spark, str(tmp_path))
    named = lambda: [r.entry for r in S.entry_points(f, S.manifest(spark, str(tmp_path))).collect()]
    assert named() == ["src/index.ts", "index.ts"]
    for text, want in (('{"main": "./lib/../lib/core.ts", "module": "no.ts"}', ["lib/core.ts"]), ('{"main": "lib/core.ts", "exports": {}}', []), ("{", []), ('{"module": "other.ts"}', ["other.ts"])):
        (tmp_path / "package.json").write_text(text)
        assert named() == [*want, "src/index.ts", "index.ts"], text
    assert "lib/core.ts" not in [r.entry for r in P.analyze_codebase(f, S.manifest(spark, str(tmp_path)))["entries"].collect()] and "other.ts" in [r.entry for r in P.analyze_codebase(f, S.manifest(spark, str(tmp_path)))["entries"].collect()]


def test_missing_root(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.scan(spark, "/no/such/folder").collect()


def test_tools(spark):
    def run(name, **args):
        out = tools.call(spark, name, args)
        assert "isError" not in out, out
        return json.loads(out["content"][0]["text"])

    assert run("count_tokens", code="x = 1")["tokens"] == 6
    assert run("parse_code", code="export function f() {}")["symbols"][0]["name"] == "f"
    assert run("compress_code", code="a  // b")["code"] == "a"
    assert tools.call(spark, "nothing", {})["isError"]
    lines = [json.dumps({"jsonrpc": "2.0", "id": 1, "method": m}) for m in ("initialize", "tools/list", "bad")] + ["{"]
    a = [json.loads(x) for x in tools.serve(spark, lines)]
    assert len(a[1]["result"]["tools"]) == 6 and a[2]["error"]["code"] == -32601 and a[3]["error"]["code"] == -32700


def test_stream_of_versions(spark, tmp_path):
    rows = [("a.ts", 1, "typescript", "function f() { return 1; }\nfunction g() { return 2; }"), ("a.ts", 2, "typescript", "function f() { return 3; }")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "path string, version long, language string, content string").write.parquet(str(tmp_path / "in" / str(i)))
    s = spark.readStream.schema("path string, version long, language string, content string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = changes(s).writeStream.format("memory").queryName("versions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.version, r.name, r.change) for r in spark.table("versions").collect()}
    assert got == {(1, "f", "added"), (1, "g", "added"), (2, "f", "changed"), (2, "g", "removed")}


def test_texts_as_files(spark):
    f = S.of_texts(spark, [("src/index.ts", "a"), ("b.py", "b")])
    assert [r.entry for r in S.entry_points(f).collect()] == ["src/index.ts", "index.ts"]
    assert f.select(T.tokens(F.col("content")).alias("t")).agg(F.sum("t")).first()[0] == 2


def test_files_are_ranked_as_graphs_of_their_own(spark):
    from lexforge.operators import graph as G
    from lexforge.operators import parse

    codes = ["export class A extends B implements I, J {\n  run(a: string) { return b1(); }\n}\nexport class B {\n  go() { this.run(1); }\n}\nexport interface I { x: number }\nexport interface J { y: number }\nfunction b1() { return new A(); }\n", many(7) + "function all() { return FN1() + fn2(); }\n", "let x = 1;"]
    rows = parse.parse_symbols(files(spark, *codes)).select("file_id", "name", "full_source", "ordinal", "id", "is_exported")
    got = {r.id: r.page_rank for r in P._ranked_by_file(rows).collect()}
    assert len(got) == rows.count() and len(set(map(lambda x: round(x, 9), got.values()))) > 4
    for k in ("0", "1"):
        own = G.cut(rows.filter(rows.file_id == k))
        for r in G.page_rank(own, G.cut(G.all_edges(own))).collect():
            assert got[r.id] == pytest.approx(r.page_rank, abs=1e-12)


def test_a_pipeline_parses_each_text_once(spark):
    """What is asked for reads symbols that are kept, instead of parsing for each of its parts."""
    f = files(spark, many(3), many(2))
    pairs = f.select("file_id", F.col("content").alias("original"), F.replace("content", F.lit("return"), F.lit("return 1 +")).alias("modified"), "language")
    for df in (P.optimize(f), P.optimize_sync(f), P.extract_diff(pairs)):
        assert "InArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
