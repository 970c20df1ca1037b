"""The pipeline against brute-force versions of its stages, and each stage on odd rows."""

import re

import duckdb
import pytest
from test_decontam import brute as leaks
from test_minhash import brute_groups
from test_packing import holds
from test_suffix import brute as passages

import corpus_pipeline
from lexforge.llm import packing, quality

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The smallest tables, and documents that hold items nothing else holds."""
    d = tmp_path_factory.mktemp("tables")
    con = duckdb.connect()
    leak = f"SELECT 1000 + item_id, 'the story of the house ' || item_id || ' and its ' || text || ' is at the end of it', 'en', 's', 0 FROM '{D}/benchmark.parquet' WHERE item_id < 6"
    words = lambda x, n: f"(SELECT string_agg('the ' || {x} || 'word' || chr(97 + (i // 26)::INT) || chr(97 + (i % 26)::INT), ' ' ORDER BY i) FROM range({n}) t(i))"
    twice = f"SELECT 2000 + k, {words("'x' || k", 200)} || ' ' || {words("'shared'", 40)}, 'en', 's', 0 FROM range(3) r(k)"
    con.execute(f"COPY (SELECT * FROM '{D}/documents.parquet' UNION ALL {leak} UNION ALL {twice}) TO '{d}/documents.parquet'")
    con.execute(f"COPY (SELECT * FROM '{D}/benchmark.parquet') TO '{d}/benchmark.parquet'")
    return str(d)


def expected(d):
    """{doc_id: tokens of the text that is left}"""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    kept = {r[0] for r in con.execute(quality.oracle_sql()).fetchall()}
    rows = [r for r in con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall() if r[0] in kept]
    gone = brute_groups(rows)[0]
    rows = [r for r in rows if r[0] not in gone]
    cuts = {}
    for i, _, a, b in passages(rows):
        cuts.setdefault(i, set()).update(range(a, b))
    left = [(i, " ".join(w for p, w in enumerate(t.split()) if p not in cuts.get(i, ()))) for i, t in rows]
    left = [(i, t) for i, t in left if t]
    bad = {r[0] for r in leaks(left, con.execute(f"SELECT item_id, text FROM '{D}/benchmark.parquet'").fetchall())}
    assert gone and cuts and bad
    return {i: len(re.findall(r"\S+", t)) + 1 for i, t in left if i not in bad}


def test_run_equals_brute_force(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    holds(rows, packing.CAPACITY)
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n
    assert got == expected(tables)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did int, m string"


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_odd_rows(spark, stage):
    name, f = stage
    fine = "the cat and the dog went to the house of a man that was in it for the night"
    rows = [(1, None, None, None, None, 1, "x"), (2, "", "en", "s", 0, 2, "x"), (None, fine, "en", "s", 1, None, None), (4, fine + " now", None, "s", 1, 4, "x"), (4, fine + " now", None, "s", 1, 4, "x"), (5, (fine + " ") * 3000, "en", "s", 1, 5, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = f(spark, docs, D)
    n = out.count()
    assert n > 0
    if name != "best_fit_packing":
        assert out.columns == docs.columns and [x.dataType for x in out.schema] == [x.dataType for x in docs.schema]
    assert f(spark, docs.limit(0), D).count() == 0


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None
