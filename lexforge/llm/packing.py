"""Best-fit packing by a configuration linear program over the length histogram.

Each document takes its words and one end mark. Longer ones than CAPACITY are cut into full pieces and a rest; full pieces are
bins of their own. The histogram of the other lengths (at most CAPACITY numbers, whatever the data) goes to the driver:

1. Lengths are grouped into at most GROUPS classes of about equal mass, rounded up to the largest of the class. The shortest
   lengths, FILL of all tokens, are kept back as filling.
2. The covering program "fewest bins of configurations that cover every class" is solved by multiplicative weights: the weights of
   the classes are prices, an unbounded-knapsack dynamic program over the capacity prices out the best configuration, which is
   taken until a class is covered by a further share EPS; weights of covered classes shrink.
3. The fractional solution is scaled and rounded down; bins take the actual lengths of their classes, longest first; what is left and the
   filling go by best fit, longest first, into the tightest bin with room, counted over whole runs of equal bins.

The outcome is a table of (length, rank range, bin, offset) rows whose number depends on CAPACITY and GROUPS only. Documents
get their rank within their length (salted ranks plus prefix sums, so that no length is ranked by one task), and join the table.

Defined results: null and blank texts have length 1 (the end mark); repeated rows are packed each; ties within a length go by
salt, doc_id and piece; a null doc_id is packed like any other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast

CAPACITY, GROUPS, FILL, EPS, UNITS = 2048, 48, 0.08, 0.2, 256


def n_tokens(text: str = "text") -> Column:
    """Words and the end mark."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^ \\t\\n\\r\\f]+")), F.lit(0)).cast("long") + 1


def classes(counts: np.ndarray, groups: int = GROUPS, fill: float = FILL) -> tuple[list[tuple[int, int]], int]:
    """([(shortest, longest)] of each class, longest length kept back as filling). counts[l]: how many of length l."""
    mass = counts * np.arange(len(counts))
    upto = np.cumsum(mass)
    total = upto[-1]
    kept_back = int(np.searchsorted(upto, fill * total, "right")) - 1
    rest = total - upto[kept_back]
    out, low = [], kept_back + 1
    for g in range(groups):
        high = int(np.searchsorted(upto, upto[kept_back] + rest * (g + 1) / groups))
        high = min(high, len(counts) - 1)
        if high >= low and counts[low : high + 1].sum():
            out.append((low, high))
            low = high + 1
    return out, kept_back


def best_configuration(value: np.ndarray, size: np.ndarray, room: int) -> np.ndarray:
    """The multiset of classes that fits into room with the most value: how many of each."""
    best = np.zeros(room + 1)
    pick = np.full(room + 1, -1)
    order = np.arange(len(size))
    for c in range(1, room + 1):
        fits = order[size <= c]
        best[c] = best[c - 1]
        if len(fits):
            v = best[c - size[fits]] + value[fits]
            k = int(v.argmax())
            if v[k] > best[c]:
                best[c], pick[c] = v[k], fits[k]
    out, c = np.zeros(len(size), np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[pick[c]] += 1
            c -= int(size[pick[c]])
    return out


def solve(demand: np.ndarray, size: np.ndarray, room: int, eps: float = EPS) -> dict[tuple, float]:
    """{configuration: bins}: a fractional cover of demand, near the fewest bins."""
    m = len(demand)
    weight, covered = np.ones(m), np.zeros(m)
    goal = np.log(max(m, 2)) / eps
    bins: dict[tuple, float] = {}
    while covered.min() < goal:
        live = covered < goal
        value = np.where(live, weight / weight[live].max() / demand, 0.0)
        a = best_configuration(value, size, room)
        used = a > 0
        take = eps * (demand[used] / a[used]).min() * 4
        gain = np.where(used, a * take / demand, 0.0)
        covered += gain
        weight *= np.exp(-eps * gain)
        bins[tuple(a)] = bins.get(tuple(a), 0.0) + take
    low = covered.min()
    return {a: x / low for a, x in bins.items()}


class Bins:
    """Runs of equal bins: how many, the lengths in each (length, how many, rank of the first), the room left."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.runs = capacity, [], []

    def add(self, n: int, items: list[tuple[int, int, int]]) -> None:
        room = self.capacity - sum(l * k for l, k, _ in items)
        self.runs.append((n, items))
        if room > 0:
            insort(self.open, (room, len(self.runs) - 1))

    def put(self, length: int, n: int, rank: int) -> None:
        """n items of that length, from that rank, by best fit."""
        while n:
            at = bisect_left(self.open, (length, -1))
            if at == len(self.open):
                per = self.capacity // length
                if n >= per:
                    self.add(n // per, [(length, per, rank)])
                    rank += n // per * per
                    n %= per
                else:
                    self.add(1, [(length, n, rank)])
                    n = 0
                continue
            room, k = self.open.pop(at)
            bins, items = self.runs[k]
            per = room // length
            whole = min(bins, n // per)
            if whole:
                self.runs[k] = (whole, self._with(items, length, per, rank))
                if room - per * length > 0:
                    insort(self.open, (room - per * length, k))
                n, rank = n - whole * per, rank + whole * per
                if bins > whole:
                    self.add(bins - whole, self._shifted(items, whole))
            else:  # fewer than fill one bin
                self.runs[k] = (1, self._with(items, length, n, rank))
                if room - n * length > 0:
                    insort(self.open, (room - n * length, k))
                if bins > 1:
                    self.add(bins - 1, self._shifted(items, 1))
                n = 0

    @staticmethod
    def _with(items, length, per, rank):
        return [*items, (length, per, rank)]

    @staticmethod
    def _shifted(items, bins):
        return [(l, k, r + bins * k) for l, k, r in items]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """([(length, first rank, last rank, first bin, items of the length in a bin, offset)], bins) for a histogram of lengths."""
    n = np.zeros(capacity + 1, np.int64)
    for length, k in counts.items():
        n[length] += k
    bins = Bins(capacity)
    taken = np.zeros(capacity + 1, np.int64)
    if n.sum():
        groups, _ = classes(n)
        unit = max(1, capacity // UNITS)
        size = np.array([-(-h // unit) for _, h in groups])
        fits = size <= capacity // unit
        groups, size = [g for g, f in zip(groups, fits) if f], size[fits]
        if groups:
            demand = np.array([n[lo : hi + 1].sum() for lo, hi in groups], float)
            left = {g: hi for g, (_, hi) in enumerate(groups)}  # the longest length not used up
            for a, x in sorted(solve(demand, size, capacity // unit).items(), key=lambda p: -p[1]):
                _take(bins, n, taken, groups, left, a, int(x))
    for length in range(capacity, 0, -1):
        if n[length] > taken[length]:
            bins.put(length, int(n[length] - taken[length]), int(taken[length]))
    rows, first = [], 0
    for k, items in bins.runs:
        offset = 0
        for length, per, rank in items:
            rows.append(tuple(map(int, (length, rank, rank + k * per - 1, first, per, offset))))
            offset += length * per
        first += int(k)
    return rows, first


def _take(bins: Bins, n, taken, groups, left, a, count: int) -> None:
    """count bins of configuration a, from the lengths that are left of each class, longest first, in runs of equal bins."""
    while count > 0:
        items, run, held = [], count, {}
        for g, k in enumerate(a):
            while k:
                lo, h = groups[g][0], left[g]
                while h >= lo and n[h] <= taken[h] + held.get(h, 0):
                    h -= 1
                if not held:
                    left[g] = h
                if h < lo:
                    return  # a class is used up: the rest goes by best fit
                have = int(n[h] - taken[h])
                per = min(k, have)
                run = min(run, have // per)
                if per < k:
                    held[h] = per
                items.append((h, per))
                k -= per
        bins.add(run, [(h, per, int(taken[h])) for h, per in items])
        for h, per in items:
            taken[h] += per * run
        count -= run


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, n): every document in pieces of at most capacity tokens."""
    whole = docs.select("doc_id", n_tokens().alias("total"))
    split = whole.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {capacity}"))).alias("piece"))
    start = F.col("piece") * capacity
    return split.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("total") - start).cast("int").alias("n"))


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, n, bin, offset): where each piece lies. Bins are numbered from 0; pieces don't overlap."""
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))).cast("int")
    p = cut(pieces(docs, capacity).withColumn("salt", salt))
    by_salt = p.groupBy("n", "salt").count()
    starts = by_salt.withColumn("before", F.sum("count").over(Window.partitionBy("n").orderBy("salt")) - F.col("count")).drop("count")
    counts = {r.n: r["count"] for r in p.groupBy("n").count().collect()}
    rows, bins = plan(counts, capacity)
    table = spark.createDataFrame(rows, "n int, low long, high long, first long, per long, at long")
    local = F.row_number().over(Window.partitionBy("n", "salt").orderBy("doc_id", "piece")) - 1
    ranked = p.withColumn("local", local).join(starts, ["n", "salt"]).withColumn("rank", F.col("local") + F.col("before")).drop("salt", "local", "before")
    placed = ranked.join(maybe_broadcast(table, len(rows), 64), (ranked["n"] == table["n"]) & F.col("rank").between(F.col("low"), F.col("high")))
    nth = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "piece", "start", ranked["n"].cast("long").alias("n"), (F.col("first") + F.expr("(rank - low) div per")).alias("bin"), (F.col("at") + nth % F.col("per") * ranked["n"]).alias("offset")
    )
