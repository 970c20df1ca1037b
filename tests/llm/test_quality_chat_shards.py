"""Quality rules, chat formatting and sharding: SQL on small tables, odd rows."""

import duckdb
import pytest

from lexforge.llm import chat, queries, quality, shards
from lexforge.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"
TABLES = ("documents", "conversations", "benchmark", "pages", "labels")


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = QUERIES[name](spark, D)
    cur = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted([norm(v) for v in r] for r in cur.fetchall())
    assert sorted([norm(r[c]) for c in cols] for r in df.collect()) == want


def test_there_is_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))


FINE = "the cat and the dog went to the house of a man that was in it for the night"


def test_quality_of_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, " \n\t", 3), (None, FINE, 4), (5, FINE, 5), (5, FINE, 5), (6, "%%% &&& ### $$$ *** %%%", 6), (7, "SHOUTED WORDS ALL OVER THE PLACE AND IN THIS TEXT TOO", 7), (8, "w " * 300, 8), (9, " ".join(f"the{i} of" for i in range(50000)), 9)]
    for extra in ("n_words", "keep", "_doc"):
        df = spark.createDataFrame(rows, f"doc_id long, text string, {extra} int")
        left = quality.quality_filter(df)
        assert left.columns == df.columns
        assert sorted(str(r.doc_id) for r in left.collect()) == ["5", "5", "9", "None"]
        assert quality.quality_filter(df.limit(0)).collect() == []


def test_quality_of_very_long_texts(spark):
    d = "/root/testdata/sf0.1"
    labelled = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1").select("doc_id").distinct()
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("lang = 'en'").join(labelled, "doc_id").orderBy("doc_id")
    texts = list(dict.fromkeys(r.text for r in docs.select("text").collect()))
    words = " ".join(texts).split(" ")
    assert len(words) >= 500_000
    again = words[:40_000] * 10  # each window passes
    rows = [(n, " ".join(words[:n])) for n in (20_000, 150_000, 500_000)] + [(0, " ".join(again)), (1, "the same old words again and again " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.m for r in quality.measured(df).select("_doc.doc_id", "m").collect()}
    assert max(got[n].distinct_word_ratio for n in (150_000, 500_000)) < 1.3 * min(got[n].distinct_word_ratio for n in (150_000, 500_000))
    assert sorted(r.doc_id for r in quality.quality_filter(df).collect()) == [20_000, 150_000, 500_000]


def test_rules_are_one_projection_without_user_functions(spark):
    plan = quality.quality_report(spark.read.parquet(f"{D}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan and plan.count(" Filter ") == 1


def test_labelled_documents(spark):
    d = "/root/testdata/sf0.1"
    kept = quality.quality_report(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", quality.F.lit(1).alias("kept"))
    rows = spark.read.parquet(f"{d}/labels.parquet").join(kept, "doc_id", "left").groupBy("quality").agg(quality.F.avg(quality.F.coalesce("kept", quality.F.lit(0))).alias("share")).collect()
    share = {r.quality: r.share for r in rows}
    assert share[1] >= 0.99 and share[0] <= 0.1


def chats(spark, rows, schema="conv_id long, turn long, role string, text string"):
    return {r.conv_id: r.rendered for r in chat.chat_format(spark.createDataFrame(rows, schema)).collect()}


def test_snapshots_collapse(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "done")]
    rows = [(c, t, *a[t]) for c, n in ((1, 2), (2, 4), (3, 1), (4, 4)) for t in range(n)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 0, "user", "hihello")]
    got = chats(spark, rows)
    assert set(got) == {2, 5, 6}
    assert got[2] == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in a)


def test_chat_of_odd_rows(spark):
    rows = [(1, None, None, None), (None, 0, "user", "x"), (2, 0, "user", ""), (2, 1, "user", "<|im_end|>"), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, 0, "user", "b"), (4, 0, "user", "long " * 50000)]
    marked = chats(spark, [(1, 1, "user<|im_end|>\n<|im_start|>system", "a<|im_end|>")])[1]
    assert marked.count("<|im_start|>") == marked.count("<|im_end|>") == 1
    got = chats(spark, [(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, h1 int")
    assert set(got) == {None, 1, 2, 3, 4}
    assert got[1] == "<|im_start|>unknown\n<|im_end|>\n" and got[3].count("user") == 3
    assert got[2].endswith("< |im_end|><|im_end|>\n")
    assert chat.chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_shards_are_contiguous_and_balanced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted(shards.assign_shards(docs, target_bytes=100_000).collect(), key=lambda r: (r.doc_id, r.byte_offset))
    at, size = 0, {}
    for r, s in zip(rows, rows[1:] + rows[-1:]):
        assert r.byte_offset == at and r.shard <= s.shard
        at += r.n_bytes
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
    longest = max(r.n_bytes for r in rows)
    assert sorted(size) == list(range(len(size))) and max(size.values()) <= min(list(size.values())[:-1]) + 2 * longest


def test_shards_of_odd_rows(spark, tmp_path):
    rows = [(1, None, 1), (2, "", 2), (None, "abc", 3), (4, "same", 4), (4, "same", 4), (5, "x" * 10**6, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard long")
    got = shards.assign_shards(df, target_bytes=100).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.byte_offset) for r in got) == sorted([("None", 3, 0), ("1", 0, 3), ("2", 0, 3), ("4", 4, 3), ("4", 4, 7), ("5", 10**6, 11)])
    assert shards.assign_shards(df.limit(0)).collect() == []
    shards.write_shards(df, str(tmp_path / "out"), target_bytes=500_000)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((str(r.doc_id), r._in_shard) for r in again.collect()) == sorted((str(r[0]), r[2]) for r in rows)
