"""Suffix-array dedup against brute force over all windows."""

import numpy as np
import pytest

from lexforge.llm import suffix

W = suffix.MIN_WORDS


def brute(rows):
    """{(doc_id, first_doc_id, start, end)} from all windows. Rows that repeat count once."""
    docs = {i: (t or "").split() for i, t in rows}
    first, later = {}, {}
    for i in sorted(docs):
        w = docs[i]
        for p in range(len(w) - W + 1):
            k = tuple(w[p : p + W])
            f = first.setdefault(k, (i, p))
            if f != (i, p):
                later.setdefault((i, f[0]), []).append(p)
    out = set()
    for (i, f), ps in later.items():
        lo = hi = ps[0]
        for p in ps[1:]:
            if p > hi + W:
                out.add((i, f, lo, hi + W))
                lo = p
            hi = p
        out.add((i, f, lo, hi + W))
    return out


def found(docs):
    return sorted(tuple(r) for r in suffix.repeated_passages(docs).collect())


def planted(seed, n=40, words=400):
    rng = np.random.default_rng(seed)
    make = lambda k: [f"w{x}" for x in rng.integers(0, 5000, k)]
    shared = [make(k) for k in (49, 50, 51, 60, 75, 76, 120)]
    rows = []
    for i in range(n):
        w = make(int(rng.integers(0, words)))
        for s in range(int(rng.integers(0, 4))):
            p = int(rng.integers(0, len(w) + 1))
            w[p:p] = shared[int(rng.integers(len(shared)))]
        if i % 9 == 0:
            w += ["la"] * 130
        rows.append((i, " ".join(w)))
    return rows + [(n, rows[3][1]), (n + 1, rows[3][1] + " end"), (n + 2, "\n".join(rows[5][1].split()))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_windows(spark, seed):
    rows = planted(seed)
    want = sorted(brute(rows))
    assert len(want) > 20
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()]))
    assert want and found(docs) == want


def test_removal_keeps_each_passage_once(spark):
    rows = planted(3)
    left = {r.doc_id: r.text for r in suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = {}
    for i, _, a, b in brute(rows):
        spans.setdefault(i, set()).update(range(a, b))
    for i, t in rows:
        w = t.split()
        rest = [x for p, x in enumerate(w) if p not in spans.get(i, ())]
        if rest or not w:
            assert left[i].split() == rest
        else:
            assert i not in left
    assert not brute(left.items()) or max(b - a for _, _, a, b in brute(left.items())) < 130


def test_merge_orders_and_never_compares_known_prefixes(monkeypatch):
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 7, 8, 20):
        runs = []
        for _ in range(n):
            s = sorted(bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(int(rng.integers(0, 30))))
            shared, rest = suffix.front_code(s)
            assert suffix.front_decode(np.array(shared, int), np.array([len(x) for x in s], int), rest) == s
            runs.append((s, shared))
        order, shared = suffix.merge(runs)
        out = [runs[k][0][i] for k, i in order]
        assert out == sorted(x for s, _ in runs for x in s)
        for i in range(1, len(out)):
            assert shared[i] == suffix.common(out[i - 1], out[i], 0)

    class Seen(bytes):
        looked = 0

        def __getitem__(self, s):
            Seen.looked += len(bytes.__getitem__(self, s))
            return bytes.__getitem__(self, s)

    prefix = b"p" * 1000
    runs = []
    for _ in range(8):
        s = sorted(prefix + bytes(rng.integers(97, 123, 6).astype(np.uint8)) for _ in range(50))
        runs.append(([Seen(x) for x in s], suffix.front_code(s)[0]))
    suffix.merge(runs)
    assert Seen.looked < 7 * 2 * 1010 + 400 * 3 * 2 * 10  # the prefix once in each first match, tails afterwards


def test_run_round_trip():
    right, left = [b"a b ", b"a b ", b"a c "], [b"", b"x ", b"x y "]
    cols = np.arange(15).reshape(5, 3)
    r, shared, l, c = suffix.unpack_run(suffix.pack_run(right, left, cols))
    assert (r, shared.tolist(), l) == (right, [0, 4, 2], left) and (c == cols).all()


def test_odd_rows(spark):
    p = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"q{i % 7919}" for i in range(40000))
    schema = "doc_id long, text string, n_chars long, spans string, did int"
    rows = [
        (1, p, len(p), "s", 1), (1, p, len(p), "s", 1), (None, "x " + p + "\ty", 1, None, None), (3, None, None, "n", 3), (4, "", 0, "e", 4), (5, "short text", 10, "k", 5), (6, "short text", 10, "k", 6), (7, long, len(long), "l", 7),
    ]
    docs = spark.createDataFrame(rows, schema)
    got = found(docs.filter("doc_id != 7 or doc_id is null"))
    assert got == [(1, None, 0, 60)]
    assert {r[:2] for r in found(docs.filter("doc_id = 7"))} == {(7, 7)}
    left = suffix.dedup(docs.filter("doc_id != 7 or doc_id is null"))
    assert left.columns == docs.columns
    rest = {(r.doc_id, r.text, r.n_chars, r.spans, r.did) for r in left.collect()}
    assert rest == {tuple(r) for r in rows if r[0] not in (1, 7)}
    one = spark.createDataFrame([(1, p, 0, "a", 0), (2, "b  " + p + "\nend", 9, "b", 0)], schema)
    assert {(r.doc_id, r.text, r.n_chars) for r in suffix.dedup(one).collect()} == {(1, p, 0), (2, "b  end", 6)}
    assert suffix.dedup(docs.limit(0)).collect() == [] and found(docs.limit(0)) == []
