"""Best-fit packing: capacity, coverage, and bins against plain best-fit decreasing."""

import re
from collections import Counter

import numpy as np

from lexforge.llm import packing


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(capacity - n)
        else:
            rooms.remove(fit)
            rooms.append(fit - n)
    return len(rooms)


def holds(rows, capacity):
    """Every placed piece lies within its bin and overlaps no other."""
    by = {}
    for r in rows:
        by.setdefault(r.bin, []).append((r.offset, r.n))
    for b in by.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at = o + n
        assert at <= capacity
    assert sorted(by) == list(range(len(by)))
    return len(by)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs).collect()
    bins = holds(rows, packing.CAPACITY)
    want = []
    for r in docs.collect():
        n = len(re.findall(r"[^ \t\n\r\f]+", r.text or "")) + 1
        want += [(r.doc_id, k, k * 2048, min(2048, n - k * 2048)) for k in range(-(-n // 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.n) for r in rows) == sorted(want)
    assert bins <= best_fit_decreasing([w[3] for w in want], 2048) * 1.02 + 1


def test_plans_of_many_histograms():
    rng = np.random.default_rng(4)
    for case in range(12):
        cap = 256
        size = [rng.integers(1, cap + 1, 400), rng.integers(80, 130, 500), np.full(300, 129), rng.geometric(0.02, 900).clip(1, cap), np.array([cap]), rng.integers(1, 4, 50)][case % 6]
        rows, bins = packing.plan(dict(Counter(size.tolist())), cap)
        fill, seen = np.zeros(bins, int), Counter()
        for n, low, high, first, per, at in rows:
            k = (high - low + 1) // per
            fill[first : first + k] += n * per
            seen[n] += high - low + 1
        assert seen == Counter(size.tolist()) and fill.max() <= cap and fill.min() > 0
        assert bins <= best_fit_decreasing(size.tolist(), cap) * 1.05 + 2


def test_configuration_pricing_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(20):
        size, value = rng.integers(2, 12, 5), rng.random(5)
        a = packing.best_configuration(value, size, 30)
        best = [0.0] * 31
        for c in range(1, 31):
            best[c] = max([best[c - 1], *(best[c - s] + v for s, v in zip(size, value) if s <= c)])
        assert (a * size).sum() <= 30 and abs((a * value).sum() - best[30]) < 1e-9


def test_odd_rows(spark):
    rows = [(1, None, 1), (None, "a b", 2), (3, "", 3), (4, "x " * 5000, 4), (5, "same", 5), (5, "same", 5)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()
    holds(out, packing.CAPACITY)
    assert Counter((r.doc_id, r.n) for r in out) == Counter({(1, 1): 1, (None, 3): 1, (3, 1): 1, (4, 2048): 2, (4, 905): 1, (5, 2): 2})
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, bin long")).collect() == []
