"""Benchmark decontamination against brute-force BM25."""

import math
from collections import Counter

import numpy as np
import pytest

from lexforge.llm import decontam as D


def brute(docs, items, stride=D.STRIDE):
    norm = lambda t: "".join(c for c in (t or "").lower() if c.isalnum() or c.isspace() or ord(c) > 127).split()
    its = [(i, norm(t), t) for i, t in items if norm(t)]
    if not its:
        return set()
    n, mean = len(its), sum(len(w) for _, w, _ in its) / len(its)
    df = Counter(t for _, w, _ in its for t in set(w))
    out = set()
    for d, text in docs:
        w = norm(text)
        best = {}
        for x, (i, iw, t) in enumerate(its):
            step = stride
            while step < len(iw):
                step *= 2
            for a in range(0, len(w), step):
                own = w[a : a + 2 * step]
                have = set(own)
                tf = Counter(iw)
                s = {u: math.log(1 + (n - df[u] + 0.5) / (df[u] + 0.5)) * c * (D.K1 + 1) / (c + D.K1 * (1 - D.B + D.B * len(iw) / mean)) for u, c in tf.items()}
                score = sum(v for u, v in s.items() if u in have) / (D.TAU * sum(s.values()))
                if score < 1:
                    continue
                head = D.item_words(t)[1]
                part = []
                for p in (iw[:head], iw[head:]):
                    k = min(D.GRAM, len(p))
                    g = {tuple(p[y : y + k]) for y in range(len(p) - k + 1)} if k else set()
                    og = {tuple(own[y : y + k]) for y in range(len(own) - k + 1)}
                    part.append(len(g & og) / len(g) if g else 1.0)
                if min(part) >= D.OVERLAP and score > best.get(x, (0,))[0]:
                    best[x] = (score, *part)
        out |= {(d, its[x][0], *(round(v, 3) for v in b)) for x, b in best.items()}
    return out


def rows(df):
    return {(r.doc_id, r.item_id, round(r.score, 3), round(r.question, 3), round(r.answer, 3)) for r in df.collect()}


def case(seed, vocab=400, n_items=90):
    rng = np.random.default_rng(seed)
    make = lambda k: [f"v{int(x)}" for x in (vocab * rng.random(k) ** 2)]
    items = [(i, " ".join(make(int(rng.integers(3, 60))))) for i in range(n_items)]
    docs = []
    for d in range(60):
        w = make(int(rng.integers(0, 700)))
        if d % 3 == 0:
            own = items[int(rng.integers(n_items))][1].split()
            for _ in range(d % 5):
                own[int(rng.integers(len(own)))] = "other"
            p = int(rng.integers(0, len(w) + 1))
            w[p:p] = own
        docs.append((d, " ".join(w)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs, items = case(seed)
    want = brute(docs, items)
    assert len(want) > 5
    got = {r[:2]: r[2:] for r in rows(D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))}
    want = {r[:2]: r[2:] for r in want}
    assert got.keys() == want.keys()
    assert all(abs(x - y) < 0.002 for k in got for x, y in zip(got[k], want[k]))


def test_wand_finds_all_above_threshold():
    rng = np.random.default_rng(3)
    docs, items = case(4, vocab=120, n_items=150)
    its = [(i, *D.item_words(t)) for i, t in items]
    df = Counter(h for _, w, _ in its for h in set(w.tolist()))
    ix = D.Index(its, df, len(its), sum(len(w) for _, w, _ in its) / len(its), 64)
    for _ in range(200):
        ts = sorted(rng.choice(len(ix.in_block), int(rng.integers(1, 40)), replace=False).tolist())
        want = Counter()
        for t in ts:
            for _, p in ix.in_block[t].values():
                for x, s in p:
                    want[x] += s
        got = dict(ix.search(ts, set(range(ix.blocks))))
        assert set(got) == {x for x, s in want.items() if s >= 1}
        assert all(abs(got[x] - want[x]) < 1e-9 for x in got)


def test_shards_give_the_same(spark, monkeypatch):
    docs, items = case(5)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = rows(D.contaminated(d, i))
    monkeypatch.setattr(D, "SHARD_CHARS", 3000)
    assert len(list(D.shards(i))) > 3 and rows(D.contaminated(d, i)) == whole
    gone = {r[0] for r in whole}
    assert {r.doc_id for r in D.decontaminate(d, i).collect()} == {k for k, _ in docs} - gone


def test_a_long_item_changes_no_other(spark):
    docs, items = case(6)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rng = np.random.default_rng(7)
    long = " ".join(f"long{int(x)}" for x in rng.integers(0, 300, 400))
    docs.append((99, "some words " + long + " and more"))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    with_long = rows(D.contaminated(d, spark.createDataFrame([*items, (999, long)], "item_id long, text string")))
    assert with_long >= {x for x in with_long if x[1] == 999} and (99, 999) in {x[:2] for x in with_long}
    found = lambda r: {x[:2] for x in r if x[1] != 999}
    assert found(with_long) == found({tuple(x) for x in brute(docs, [*items, (999, long)])})
    assert {r.doc_id for r in D.decontaminate(d, spark.createDataFrame([*items, (999, long)], "item_id long, text string")).collect()} == {k for k, _ in docs} - {x[0] for x in with_long}


def test_ties_go_to_the_first_passage(spark):
    item = "which word comes first here? the one that stands before"
    docs = spark.createDataFrame([(1, item + " pad" * 400 + " " + item)], "doc_id long, text string")
    got = D.contaminated(docs, spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")).collect()
    assert sorted((r.item_id, r.score, r.question, r.answer) for r in got) == [(1, 2.0, 1.0, 1.0), (2, 2.0, 1.0, 1.0)]


def test_question_and_answer_split():
    w, head = D.item_words("What is it? A thing.")
    assert (len(w), head) == (5, 3)
    assert D.item_words("Question: x y Answer: z")[1] == 3
    assert D.item_words("a b c d e f g h")[1] == 6 and D.item_words("one")[1] == 1


def test_odd_rows(spark):
    item = "the very rare question words here? and its own answer"
    schema = "doc_id long, text string, low string, n long"
    long = "pad " * 30000 + item + " pad" * 100
    rows_ = [(1, None, "a", 1), (2, "", "b", 2), (None, "so " + item.upper() + "!", "c", 3), (4, long, "d", 4), (4, long, "d", 4), (5, "nothing to see", None, None)]
    docs = spark.createDataFrame(rows_, schema)
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "  "), (None, "nothing")], "item_id long, text string")
    got = sorted(((r.doc_id or 0), r.item_id or 0) for r in D.contaminated(docs, items).collect())
    assert got == [(0, 7), (0, 7), (4, 7), (4, 7), (4, 7), (4, 7), (5, 0)]
    left = D.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(tuple(r) for r in left.collect()) == [rows_[0], rows_[1]]
    assert {r.doc_id for r in left.collect()} == {1, 2}
    assert D.decontaminate(docs, items.limit(0)).count() == 6 and D.contaminated(docs, items.limit(0)).collect() == []
    assert D.contaminated(docs.limit(0), items).collect() == []
