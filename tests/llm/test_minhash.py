"""MinHash near-dedup against brute force."""

import itertools
import re

import numpy as np
import pytest

from lexforge.llm import minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text, k=minhash.SHINGLE):
    t = "".join(c for c in (text or "").lower() if c.isalnum() or c.isspace() or ord(c) > 127)
    w = t.split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_groups(rows, threshold=minhash.THRESHOLD):
    """{doc_id: least doc_id of its component} for the documents that go."""
    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
            pairs += 1
    return {i: find(i) for i in sets if find(i) != i}, pairs


def test_recall_and_precision_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, _ = brute_groups(rows)
    got = {r.doc_id: r.kept_doc_id for r in minhash.near_pairs(docs).collect()}
    assert want
    assert len(want.items() & got.items()) >= 0.9 * len(want)
    assert not set(got) - set(want)


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 10**6, n)]


def test_planted_copies_chain_into_one_group(spark):
    rng = np.random.default_rng(1)
    base = words(rng, 300)
    rows = [(i, " ".join(words(rng, 300))) for i in range(100, 140)]
    for i in range(30):
        w = list(base)
        for p in rng.integers(0, 300, i % 6):
            w[p] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    want, _ = brute_groups(rows)
    got = {r.doc_id: r.kept_doc_id for r in minhash.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and set(got) == set(range(1, 30))


def test_every_coordinate_is_filled_and_estimates_similarity():
    rng = np.random.default_rng(2)
    for n in (1, 3, 50, 1000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(0, 2**63, n - n // 2).astype(np.uint64)])
        s = minhash.sketch(np.concatenate([a, b]), np.repeat([0, 1], n), 2)
        assert (s < np.iinfo(np.uint64).max).all()
        j = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs((s[0] == s[1]).mean() - j) < 0.2


def test_sketch_equals_a_loop():
    rng = np.random.default_rng(3)
    g = rng.integers(0, 2**63, 40).astype(np.uint64)
    t, M = 16, 2**64
    want = [None] * t

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 % M
        x ^= x >> 27
        x = x * 0x94D049BB133111EB % M
        return x ^ (x >> 31)

    for i in range(2 * t):
        for e in g.tolist():
            x = mix((e + mix(i + 1)) % M)
            b = (x >> 32) * t >> 32 if i < t else i - t
            v = (i << 32) | (x & 0xFFFFFFFF)
            if want[b] is None or v < want[b]:
                want[b] = v
    assert minhash.sketch(g, np.zeros(40, np.int64), 1, t)[0].tolist() == want


def test_odd_rows(spark):
    long = " ".join(f"a{i}" for i in range(60000))
    rows = [
        (1, None, "en", None, None), (2, None, None, "s", 0), (3, "", "en", "s", 0), (4, " \n", "en", "s", 2),
        (None, "one two three four", "en", "s", 18), (6, "One, two three four!", None, None, 20),
        (7, "solo", "en", "s", 4), (8, "Solo.", "en", "s", 5), (9, long, "en", "s", len(long)), (10, long + " b", "en", "s", len(long) + 2),
        (11, "same row", "en", "s", 8), (11, "same row", "en", "s", 8), (12, None, "en", "s", 0), (12, None, "en", "s", 0),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {(r.doc_id, r.kept_doc_id) for r in minhash.near_pairs(docs).collect()} == {(6, None), (8, 7), (10, 9)}
    left = minhash.dedup(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, i) for i in (1, 2, 3, 4, 7, 9, 11, 12)] + [(True, 0)]


@pytest.mark.parametrize("extra", ["did", "th", "text_a"])
def test_clashing_columns_and_empty_table(spark, extra):
    docs = spark.createDataFrame([(1, "a b c d", 5), (2, "a b c d", 6)], f"doc_id long, text string, {extra} long")
    assert [tuple(r) for r in minhash.dedup(docs).collect()] == [(1, "a b c d", 5)]
    assert minhash.dedup(docs.limit(0)).collect() == []
    assert minhash.near_pairs(docs.limit(0)).collect() == []


def test_pattern_of_signs():
    assert re.sub(r"[^\w\s]", "", "a-b, c") == "ab c"
    assert grams("a-b, c d") == grams("AB c! d")
