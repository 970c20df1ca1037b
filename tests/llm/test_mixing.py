"""LM scoring against a loop over single bits, and what it must tell apart."""

import collections
import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from lexforge.llm import mixing as M

M32, M64 = 2**32 - 1, 2**64 - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def letter(c):
    return c >= 128 or chr(c).isalnum()


def pieces(text):
    cuts = [i for i in range(len(text)) if i == 0 or letter(text[i]) and not letter(text[i - 1])]
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def runs(text):
    """The runs of 1, 2 and 3 pieces that end with each piece; None stands before the first."""
    p = [None, None, *pieces(text)]
    return [[tuple(p[i - k + 1 : i + 1]) for k in (1, 2, 3)] for i in range(2, len(p))]


def tree(texts):
    often = [0] * 256
    for t in texts:
        for c in t:
            often[c] += 1
    heap = [(n or 1e-9, i) for i, n in enumerate(often)]
    heapq.heapify(heap)
    parent = {}
    for made in range(256, 511):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (made, 0), (made, 1)
        heapq.heappush(heap, (a + b, made))
    walks = []
    for c in range(256):
        walk, x = [], c
        while x != 510:
            walk.append((parent[x][0] - 256, parent[x][1]))
            x = parent[x][0]
        walks.append(walk[::-1])
    return walks


def squash(t):
    i = min(4095, max(0, int(t * 170 + 2048.5)))
    return 1 / (1 + math.exp(-(i - 2048) / 170))


def stretch(cell):
    i = cell[1] >> 4
    return 0.0 if i == 2048 else math.log((i + 0.5) / 4096 / (1 - (i + 0.5) / 4096))


def learn(cell, bit, limit):
    n, p = cell
    cell[1] = p + ((bit * 65535 - p) * int(65536 / (n + 1.6)) >> 16)
    cell[0] = min(n + 1, limit)


class Mixer:
    def __init__(self, first, rate):
        self.first, self.rate = first, rate
        self.weights, self.curves = {}, {}

    def code(self, x, gate, curve, bit):
        w = self.weights.setdefault(gate, list(self.first))
        points = self.curves.setdefault(curve, [squash((i - 16) / 2) for i in range(33)])
        t = max(-11.9, min(11.9, sum(a * b for a, b in zip(w, x))))
        p = squash(t)
        at = max(-7.999, min(7.999, t)) * 2 + 16
        low = int(at)
        share = at - low
        last = (p + points[low] + share * (points[low + 1] - points[low])) / 2
        for i, v in enumerate(x):
            w[i] += (bit - p) * self.rate * v
        near = low + (share >= 0.5)
        points[near] += (bit - points[near]) * 0.02
        return -math.log2(max(1 / 4096, last if bit else 1 - last))


def log2(n):
    return n.bit_length() if n > 0 else 0


def logit(n, key):
    zeros, ones = n[(*key, 0)], n[(*key, 1)]
    return max(-12, min(12, math.log((ones + 0.4) / (zeros + 0.4)))) if zeros + ones else 0.0


def plain(texts):
    """Bits of each text. Contexts are told apart by what they are, not by hashes, so cells never collide."""
    walks = tree(texts)
    bits_seen = collections.Counter()
    counts = collections.Counter()
    for t in texts:
        for i, c in enumerate(t):
            one, two = (t[i - 1] if i else 0), (t[i - 2] if i > 1 else 0)
            for node, turn in walks[c]:
                bits_seen[one, node, turn] += 1
                bits_seen[two, one, node, turn] += 1
        for r in runs(t):
            counts.update(r)
            counts[()] += 1
    out = []
    for t in texts:
        own = collections.Counter(x for r in runs(t) for x in [*r, ()])
        known_runs = collections.Counter(counts)
        known_runs.subtract(own)
        flags, spelling = Mixer([0.4, 0.4, 0.4, 0.3], 0.02), Mixer([0.15, 0.35, 0.25, 0.3, 0.35, 0.35, 0.1], 0.015)
        flag_cells, cells = {}, {}
        total, history, at, last = 0.0, 0, 0, None
        for piece, r in zip(pieces(t), runs(t)):
            spelled = 0.0
            for j, c in enumerate(piece):
                i = at + j
                back = [t[i - k] if i >= k else 0 for k in range(1, 5)]
                ctx = [("2", *back[:2]), ("3", *back[:3]), ("4", *back), ("word", piece[:j])]
                for k, (node, turn) in enumerate(walks[c]):
                    own_cells = [cells.setdefault((x, node), [0, 32768]) for x in ctx]
                    seen = sum(x[0] > 0 for x in own_cells)
                    x = [logit(bits_seen, (back[0], node)), logit(bits_seen, (back[1], back[0], node)), *(stretch(x) for x in own_cells), 0.3]
                    spelled += spelling.code(x, (seen, min(k, 7)), node, turn)
                    for o in own_cells:
                        learn(o, turn, 120)
            at += len(piece)
            known, order = False, 0
            for k in (3, 2, 1):
                if known:
                    break
                before = known_runs[()] if k == 1 else known_runs[last[k - 2]] - 1 if last else 0
                if before <= 0:
                    continue
                known = known_runs[r[k - 1]] > 0
                size = min(15, log2(before))
                own_cells = [flag_cells.setdefault(x, [0, 32768]) for x in ((k, "s", size), (k, "h", history), (k, "b", size, history & 15))]
                total += flags.code([*(stretch(x) for x in own_cells), 0.3], (k, size), k, int(known))
                for o in own_cells:
                    learn(o, int(known), 60)
                if known:
                    total -= math.log2(known_runs[r[k - 1]] / before)
                    order = k
            if not known:
                total += spelled
            history = (history << 2 | order) & 255
            last = r
            known_runs.update([*r, ()])
        out.append(total)
    return out


def texts(seed=3, n=12):
    rng = random.Random(seed)
    words = [rng.choice(["er", "tion", "an", "blé", "x", "42"]) + rng.choice(["the", "of", "ing", "ß", ""]) for _ in range(40)]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) + rng.choice([".", "", "\n"]) for _ in range(n)]
    return [*made, made[0], made[1] + " more", "  ..  ", "日本語" * 30, "aaaa" * 50]


def scored(spark, rows, parts=1, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return {(r.doc_id, r.n_bytes): r for r in M.bits_per_byte(df).collect()}


def test_equal_to_the_loop(spark):
    t = texts()
    want = plain([x.encode() for x in t])
    got = scored(spark, list(enumerate(t)))
    for i, (x, w) in enumerate(zip(t, want)):
        assert got[i, len(x.encode())].bits == pytest.approx(w, rel=0.01, abs=2), (i, x)  # hashed contexts now and then take over each other's cells


def test_partitions_and_ranges_change_nothing(spark, monkeypatch):
    rows = list(enumerate(texts(5, 40)))
    one = scored(spark, rows)
    monkeypatch.setattr(M, "CHUNK", 600)
    monkeypatch.setattr(M, "RANGE", 500)
    many = scored(spark, rows, 3)
    monkeypatch.setattr(M, "RANGE", 4)  # more ranges than a chunk has keys
    sparse = scored(spark, rows, 3)
    assert {k: r.bits for k, r in one.items()} == {k: r.bits for k, r in many.items()} == {k: r.bits for k, r in sparse.items()}


def test_twice_is_told_from_once(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9)))
    docs = [" ".join(word() for _ in range(150)) for _ in range(30)]
    got = scored(spark, list(enumerate(docs + docs[:5])))
    by = {k[0]: r.bits_per_byte for k, r in got.items()}
    twice = [by[i] for i in (*range(5), *range(30, 35))]
    assert max(twice) * 3 < min(by[i] for i in range(5, 30))


def test_learns_within_a_text(spark):
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefgh ") for _ in range(300))
    got = scored(spark, [(0, line), (1, "".join(rng.choice("abcdefgh ") for _ in range(300)) * 8)])
    assert got[1, 2400].bits_per_byte < got[0, 300].bits_per_byte / 3


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, "a"), (2, "a"), (3, None), (None, "null id"), (4, "word " * 60_000), (5, "\x00\x01 𝄞")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bits", F.lit("x")).withColumn("chunk", F.lit(1))
    got = M.bits_per_byte(df).collect()
    assert len(got) == len(rows)
    assert sum(r.n_bytes == 0 and r.bits == 0 and r.bits_per_byte is None for r in got) == 3
    two = [r for r in got if r.doc_id == 2]
    assert two[0] == two[1]
    assert next(r for r in got if r.doc_id == 4).bits_per_byte < 0.1
    assert M.bits_per_byte(df.limit(0)).collect() == []
    assert M.bits_per_byte(df).columns == ["doc_id", "n_bytes", "bits", "bits_per_byte"]


def test_held_out_order(spark):
    """Text like the corpus costs less than text unlike it."""
    rng = random.Random(2)
    words = ["the", "cat", "sat", "on", "a", "mat", "and", "slept", "while", "rain", "fell"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(80))) for i in range(50)]
    rows.append((50, "".join(chr(rng.randint(33, 126)) for _ in range(400))))
    by = {k[0]: r.bits_per_byte for k, r in scored(spark, rows).items()}
    assert max(by[i] for i in range(50)) < by[50] / 2
