"""Calls on single texts."""

from lexforge import api
from lexforge.plans.optimize import Options

CODE = "import { x } from './x';\nexport function one(a: number) {\n  return x(a);\n}\nfunction two() {\n  return one(1);\n}\n"


def test_single_texts(spark):
    assert api.count_tokens("x = 1") == 6 and api.estimate_tokens("a\nb")["lines"] == 2
    assert api.split_to_fit("a\nb", 50) == ["a\nb"] and api.compress("a // b") == "a"
    p = api.parse_code(CODE)
    assert [s["name"] for s in p["symbols"]] == ["one", "two"] and p["symbols"][0]["import_statements"] == ["import { x } from './x'"] and not p["diagnostics"]
    assert api.parse_code("nothing")["diagnostics"] and api.parse_code("")["symbols"] == []
    r = api.optimize_context_sync(CODE, Options(strategy="balanced"))
    assert r["included_symbols"] == ["one", "two"] and r["completeness"] == 100
    assert [r["file_id"] for r in api.optimize_multi_file([("b.ts", CODE), ("a.ts", "")], Options(use_graph=False))] == ["b.ts", "a.ts"]
    assert api.extract_diff(CODE, CODE.replace("x(a)", "a"))["included_symbols"] == ["one"]
    e = api.Visualizer.estimate(CODE)
    assert e["original_tokens"] > e["estimated_tokens"] - 60 and api.Visualizer.estimate(" ")["original_tokens"] == 0


def test_context_file(spark, tmp_path, monkeypatch):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/index.ts").write_text(CODE)
    monkeypatch.setenv("GITHUB_OUTPUT", str(tmp_path / "out"))
    path = api.write_context(str(tmp_path), "call two", 500)
    assert "function two" in open(path).read() and path in (tmp_path / "out").read_text()
