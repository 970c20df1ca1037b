"""URL filter: models against a plain implementation, and held-out accuracy."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexforge.llm import urls as U


def plain_model(texts):
    n = defaultdict(Counter)
    for t in texts:
        t = [U.START] * U.ORDER + list(t)
        for i in range(U.ORDER, len(t)):
            for k in range(U.ORDER + 1):
                n["".join(t[i - k : i]), k][t[i]] += 1
    return n


def plain_ll(n, text):
    t, out = [U.START] * U.ORDER + list(text), 0.0
    for i in range(U.ORDER, len(t)):
        p = U.FLOOR
        for k in range(U.ORDER + 1):
            c = n.get(("".join(t[i - k : i]), k))
            if c:
                p = (c[t[i]] + len(c) * p) / (sum(c.values()) + len(c))
        out += math.log(p)
    return out


def fit(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ctx = U.contexts(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    seen = Counter(zip(ctx.reshape(-1).tolist(), np.tile(data, U.ORDER + 1).tolist()))
    keys = list(seen)
    return U.Model.of(np.array([k[0] for k in keys], np.uint64), np.array([k[1] for k in keys]), np.array([seen[k] for k in keys]))


def test_likelihoods_equal_a_plain_model():
    good, bad = ["example.com/a/b", "example.org/about", "site.net/x"], ["casino-win.com", "win-casino.net/win"]
    new = ["example.com/about", "casino.org", "zzz", "", "casino-win.com"]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in new])])
    got = U.ratios(fit(good), fit(bad), np.frombuffer("".join(new).encode(), np.uint8), offs)
    a, b = plain_model(good), plain_model(bad)
    want = [(plain_ll(a, t) - plain_ll(b, t)) / max(1, len(t)) for t in new]
    assert np.allclose(got, want)


def test_probabilities_sum_to_one():
    m = fit(["abcab", "abd", "xyz"])
    for before in ("", "ab", "zz"):
        total = 0.0
        for c in range(256):
            data = np.frombuffer(before.encode() + bytes([c]), np.uint8)
            total += math.exp(m.log_likelihood(data, U.contexts(data, np.array([0, len(data)])))[-1])
        assert abs(total - 1) < 1e-9


def test_held_out_accuracy(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    part = pages.filter("page_id % 2 = 0").withColumn("label", U.seed_label(pages["url"]))
    rest = pages.filter("page_id % 2 = 1")
    want = {r.page_id: r.label for r in rest.withColumn("label", U.seed_label(pages["url"])).collect()}
    got = {r.page_id: r.keep for r in U.url_report(rest, part.select("url", "label")).collect()}
    assert got.keys() == want.keys() and 0 < sum(want.values()) < len(want)
    for k in (0, 1):
        own = [got[p] == bool(v) for p, v in want.items() if v == k]
        assert sum(own) >= 0.95 * len(own)


def test_bound_is_the_best_cut():
    rng = np.random.default_rng(1)
    s, y = rng.normal(size=60), (rng.random(60) < 0.6).astype(int)
    acc = lambda b: ((s >= b) & (y == 1)).sum() / y.sum() + ((s < b) & (y == 0)).sum() / (1 - y).sum()
    assert acc(U.bound_of(s, y)) >= max(acc(b) for b in [-9, *s + 1e-9]) - 1e-9


@pytest.mark.parametrize("extra", ["u", "llr", "row"])
def test_odd_rows(spark, extra):
    base = [(i, f"https://site{i}.example.com/page/{i}", i) for i in range(40)] + [(100 + i, f"http://casino-win{i}.example.net/bet", i) for i in range(40)]
    rows = base + [(200, None, 1), (201, "", 2), (202, "https://ok.example.com/" + "x" * 20000, 3), (1, base[1][1], 1), (None, "https://site5.example.com", None)]
    df = spark.createDataFrame(rows, f"page_id long, url string, {extra} int")
    label = df.withColumn("label", U.F.when(U.F.col("url").contains("casino"), 0).otherwise(1)).select("url", "label")
    left = U.url_filter(df, label)
    assert left.columns == df.columns
    ids = sorted(r.page_id if r.page_id is not None else -1 for r in left.collect())
    assert [i for i in ids if i < 100] == sorted([-1, 1, *range(40)]) and not [i for i in ids if 100 <= i < 200]
    assert U.url_filter(df.limit(0), label).collect() == []
    assert U.url_filter(df, label.limit(0)).count() == len(rows)


def canonical(url):
    return re.sub("[0-9]", "0", re.sub("^[a-z]+://", "", url.lower()))


@pytest.mark.parametrize("size", [1 << 19, 60])
def test_report_counts_every_labelled_url(spark, monkeypatch, size):
    """Brute force over all labels: none is left out of the models, and each takes part in the bound by models without its fold."""
    monkeypatch.setattr(U, "PACK_BYTES", size)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeé/-.", k=rng.randint(1, 9)))
    good = [f"https://shop{word()}.org/{word()}{i}" for i in range(90)] + ["", "HTTP://Shop.org/1", "http://shop.org/2", "both.org"]
    bad = [f"http://win{word()}bet.net/{word()}" for _ in range(60)] + ["both.org"]
    pages = [*good[:50], *bad[:30], "http://shopper.net/win", "zzz", "", None, "ü", "shop.org/" + "ab/c" * 5000]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(pages)], "page_id long, url string")
    labelled = spark.createDataFrame([(u, 1) for u in good] + [(u, 0) for u in bad] + [(None, 1), ("other.org", 2), ("another.org", None)], "url string, label int")
    got = {r.page_id: r for r in U.url_report(frame, labelled).collect()}

    # Characters of the plain model are bytes here.
    of = {1: sorted({canonical(u) for u in good}), 0: sorted({canonical(u) for u in bad})}
    asbytes = lambda u: u.encode().decode("latin-1")
    every = spark.createDataFrame([(u,) for u in {*of[0], *of[1]}], "u string")
    fold = {r.u: r.f for r in every.selectExpr("u", f"pmod(xxhash64('held', u), {U.FOLDS}) f").collect()}
    model = {(k, f): plain_model([asbytes(u) for u in of[k] if fold[u] != f]) for k in of for f in range(U.FOLDS + 1)}
    score = lambda u, f: (plain_ll(model[1, f], asbytes(u)) - plain_ll(model[0, f], asbytes(u))) / max(1, len(u.encode()))
    held = [(score(u, fold[u]), k) for k in of for u in of[k]]
    bound = U.bound_of(np.round([s for s, _ in held], 8), np.array([k for _, k in held]))
    assert len(got) == len(pages) and len({r.keep for r in got.values()}) == 2
    for i, u in enumerate(pages):
        want = score(canonical(u or ""), U.FOLDS)
        assert got[i].llr == pytest.approx(want, abs=2e-6) and got[i].keep == (want >= bound), u


def test_no_number_of_labels_is_left_out(spark):
    good = ["".join(x) + ".org" for x in itertools.product("abcdefghijkl", repeat=4)]
    bad, pages = [f"win{x[:2]}.net" for x in good[::144]], ["llll.org", "aaaa.org", "winab.net"]
    labelled = spark.createDataFrame([(u, 1) for u in good] + [(u, 0) for u in bad], "url string, label int")
    a, b = plain_model(good), plain_model(sorted(set(bad)))
    for r in U.url_report(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string"), labelled).collect():
        assert r.llr == pytest.approx((plain_ll(a, r.url) - plain_ll(b, r.url)) / len(r.url), abs=2e-6)
        assert r.keep == (r.url in good)


def test_cut_over_ranges_is_the_best_cut(spark):
    rng = np.random.default_rng(2)
    for values in (3, 40, 10_000):
        s, y = rng.integers(0, values, 200) / 8, (rng.random(200) < 0.6).astype(int)
        rows = spark.createDataFrame([(float(a), int(b), 1 - int(b)) for a, b in zip(s, y)], "held double, good long, bad long")
        bound = U.best_cut(rows)
        acc = lambda b: ((s >= b) & (y == 1)).sum() / y.sum() + ((s < b) & (y == 0)).sum() / (1 - y).sum()  # noqa: B023, E731
        assert bound == U.bound_of(s, y) and acc(bound) >= max(acc(b) for b in [-9, *s + 1e-9]) - 1e-9
    assert U.best_cut(rows.filter("good = 1")) == 0.0
