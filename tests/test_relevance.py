"""Searches by TF-IDF against all pairs; counts of repeated ids; rare terms by a shuffle."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexforge.operators import semantic as S


def corpus(n=300):
    rng = random.Random(5)
    return [(i, " ".join(rng.choices(["The", "of", "alpha", "beta", "Gamma", "delta", f"w{i % 40}", f"x{i}", "é"], k=rng.randint(0, 30)))) for i in range(n)]


def expected(rows):
    """(id, term) -> weight, id -> norm"""
    tf = {i: Counter(w for w in x.lower().replace("é", " ").split() if w not in S.STOP_WORDS) for i, x in rows}
    df = Counter(t for c in tf.values() for t in c)
    w = {i: {t: k * (math.log((len(rows) + 1) / (df[t] + 1)) + 1) for t, k in c.items()} for i, c in tf.items()}
    return w, {i: math.sqrt(sum(u * u for u in v.values())) for i, v in w.items()}


def best(rows, top=5):
    w, norm = expected(rows)
    out = {}
    for q in (i for i in w if i % 10 == 0):
        s = [(sum(u * w[o].get(t, 0) for t, u in w[q].items()) / (norm[q] * norm[o]), o) for o in w if o != q and norm[q] and norm[o]]
        for k, (_, o, x) in enumerate(sorted((-round(x, 9), o, x) for x, o in s if x > 0)[:top]):
            out[q, k + 1] = o, x
    return out


@pytest.mark.parametrize("head,block", [(1 << 16, 1 << 15), (3, 7)])
def test_related_texts_are_those_of_all_pairs(spark, monkeypatch, head, block):
    """Scores are whole: rounding to nine decimals and then to six may differ from rounding once."""
    monkeypatch.setattr(S, "HEAD_TERMS", head)
    monkeypatch.setattr(S, "POSTED_QUERIES", block)
    rows = corpus()
    docs = spark.createDataFrame(rows, "id long, text string")
    got = {(r.id, r.rank): (r.other, r.score) for r in S.related_texts(docs, docs.filter("id % 10 = 0")).collect()}
    want = best(rows)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-14) for k in want)


def test_rare_terms_weigh_as_frequent_ones(spark, monkeypatch):
    monkeypatch.setattr(S, "HEAD_TERMS", 3)
    rows = corpus()
    docs = spark.createDataFrame(rows, "id long, text string")
    tf = S.term_counts(docs)
    got = {(r.id, r.term): r.w for r in S.weights(tf, S.idf(tf, len(rows))).collect()}
    want = {(i, t): u for i, v in expected(rows)[0].items() for t, u in v.items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_rows_of_an_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a Fox fox"), (1, "fox dog"), (None, "dog"), (None, "dog"), (2, None), (3, "the")], "id long, text string")
    assert sorted(S.term_counts(docs).collect(), key=str) == sorted(spark.createDataFrame([(1, "fox", 3), (1, "dog", 1), (None, "dog", 2)], "id long, term string, tf long").collect(), key=str)
    assert S.term_counts(docs).schema["tf"].dataType.typeName() == "long"
    assert {(r.id, r.other) for r in S.related_texts(docs.filter("id is not null"), docs.select(F.lit(1).alias("id"))).collect()} == set()
