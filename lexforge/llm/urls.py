"""URL filter by the ratio of two character language models.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, score each URL; it stays if the difference
of log-likelihoods per character is at least a calibrated bound. A model interpolates orders 0 to ORDER (Witten-Bell): the
estimate of each context gives way to the next shorter one by the share of distinct characters that followed it, down to a
uniform floor.

Every labelled URL counts, once for all that agree in canonical form and label. The URLs are in FOLDS folds by hash. The models that
score pages count all folds; the bound is the best cut (most balanced accuracy) of the scores of all labelled URLs, each by
models that leave its own fold out. Labels come from a table, or from seed words in the host name. Every URL is scored.

Nothing has to fit one machine. A byte with the ORDER bytes before it is a gram; grams are counted once for each class and fold, and
shorter contexts are sums over grams. Counts of one byte of context (at most 2^16 times the classes and folds) are sent to all
tasks; grams that share their last two or three bytes of context are weighted in one task, which gives each gram the difference of its two
log-probabilities. URLs are read in packs of PACK_BYTES; a pack is sent the weights of its grams once, however often
they occur. Weights are whole multiples of 1 / STEP, so sums don't depend on their order. The bound is found in score ranges.

Defined results: a null or empty URL has no evidence, scores 0 and stays if the bound is at most 0; rows that repeat are judged alike; other
columns pass through url_filter(); without labelled URLs of both classes every score is 0 and everything stays; a fold without which a
class has no URLs takes no part in the bound, which is 0 if no URLs of a class are left. Long URLs are scored whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import cut

ORDER, FOLDS = 5, 5
FLOOR = 1 / 256
#: Bytes of the URLs that are read together, about.
PACK_BYTES = 1 << 19
#: Counts that a task weights at once, about; parts into which the grams of a two-byte context may fall.
TASK_ROWS, SLOTS = 1 << 18, 16
#: A weight of 1.
STEP = 1 << 30
#: Words of a host name that mark a seed of the rejected class.
SEEDS = ("casino", "bets", "pills", "ads", "track", "porn", "xxx", "viagra", "lottery", "poker", "spam")
START = "\x02"


def canonical(url: Column) -> Column:
    """Lower case without scheme; digits become 0."""
    return F.regexp_replace(F.regexp_replace(F.lower(url), "^[a-z]+://", ""), "[0-9]", "0")


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), "^(?:[a-z]+://)?([^/?#]*)", 1)


def seed_label(url: Column) -> Column:
    """1 for an accepted, 0 for a rejected URL, by seed words between dots and hyphens of its host."""
    return F.when(host(url).rlike("(^|[.-])(" + "|".join(map(re.escape, SEEDS)) + ")([.-]|$)"), 0).otherwise(1)


def contexts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Keys of the contexts of each byte, ORDER + 1 rows. Bytes before the text count as START."""
    n = len(data)
    start = np.repeat(offs[:-1], np.diff(offs))
    at = np.arange(n)
    key = np.full(n, 0x5EED, np.uint64)
    out = [key]
    with np.errstate(over="ignore"):
        for k in range(1, ORDER + 1):
            prev = np.full(n, ord(START), np.uint64)
            ok = at - k >= start
            prev[ok] = data[at[ok] - k]
            key = W.mix(key * W.P + prev + np.uint64(k << 8))
            out.append(key)
    return np.array(out)


class Model:
    """Counts of (context, character) in sorted arrays: a model in one process, for checks."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, totals_of: np.ndarray, total: np.ndarray, distinct: np.ndarray):
        self.keys, self.counts, self.contexts, self.total, self.distinct = keys, counts, totals_of, total, distinct

    @staticmethod
    def of(context: np.ndarray, char: np.ndarray, count: np.ndarray) -> Model:
        with np.errstate(over="ignore"):
            keys = W.mix(context ^ W.mix(char.astype(np.uint64) + np.uint64(1)))
        o = np.argsort(keys)
        c, back = np.unique(context, return_inverse=True)
        total, distinct = np.bincount(back, weights=count), np.bincount(back)
        return Model(keys[o], count[o].astype(np.float64), c, total, distinct.astype(np.float64))

    def log_likelihood(self, data: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Natural logarithm of each byte's probability."""
        p = np.full(len(data), FLOOR)
        if not len(self.keys):
            return np.log(p)
        char = W.mix(data.astype(np.uint64) + np.uint64(1))
        for c in ctx:
            i = np.minimum(np.searchsorted(self.contexts, c), len(self.contexts) - 1)
            seen = self.contexts[i] == c
            k = W.mix(c ^ char)
            j = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            n = np.where(self.keys[j] == k, self.counts[j], 0.0)
            p = np.where(seen, (n + self.distinct[i] * p) / (self.total[i] + self.distinct[i]), p)
        return np.log(p)


def ratios(accepted: Model, rejected: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Difference of log-likelihoods a byte, for each text."""
    if not len(data):
        return np.zeros(len(offs) - 1)
    ctx = contexts(data, offs)
    upto = np.concatenate([[0.0], np.cumsum(accepted.log_likelihood(data, ctx) - rejected.log_likelihood(data, ctx))])
    return (upto[offs[1:]] - upto[offs[:-1]]) / np.maximum(np.diff(offs), 1)


def grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER bytes before it, the farthest as the most significant. Bytes before the text count as START."""
    back = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
    out = data.astype(np.int64)
    for k in range(1, ORDER + 1):
        prev = np.full(len(data), ord(START), np.int64)
        prev[k:] = np.where(back[k:] >= k, data[:-k], ord(START))
        out |= prev << 8 * k
    return out


def _packed(batches):
    """Adds the number of the pack; all of a pack's URLs are of one fold."""
    done = np.zeros(FOLDS, np.int64)
    for b, _, offs in W.chunks(batches, "u"):
        fold, size = b.column("fold").to_numpy(), np.diff(offs)
        pack = np.zeros(len(fold), np.int64)
        for f in np.unique(fold):
            upto = done[f] + np.cumsum(size[fold == f])
            pack[fold == f] = upto // PACK_BYTES * FOLDS + f
            done[f] = upto[-1]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pack)], [*b.schema.names, "pack"])


def _counted(batches):
    """(gram and class and fold in one key, n). Grams of URLs without a label are of class 2 and count 0."""
    for b, data, offs in W.chunks(batches, "u"):
        g, size = grams(data, offs) << 4, np.diff(offs)
        good, bad = (b.column(k).to_numpy(zero_copy_only=False) for k in ("good", "bad"))
        fold = b.column("fold").to_numpy().astype(np.int64)
        for own, cls, n in ((bad, fold, 1), (good, FOLDS + fold, 1), (~good & ~bad, np.full(len(fold), 2 * FOLDS), 0)):
            key, many = np.unique((g | np.repeat(cls, size))[np.repeat(own, size)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(many * n)], ["key", "n"])


def _needed(batches):
    """(pack, fold, g), once for each gram of a pack in the batch."""
    for b, data, offs in W.chunks(batches, "u"):
        pack, own = np.unique(b.column("pack").to_numpy(), return_inverse=True)
        fold = np.zeros(len(pack), np.int32)
        fold[own] = b.column("fold").to_numpy()
        pair = np.unique(np.repeat(own.astype(np.int64), np.diff(offs)) << 48 | grams(data, offs))
        at = pair >> 48
        yield pa.RecordBatch.from_arrays([pa.array(pack[at]), pa.array(fold[at]), pa.array(pair & (1 << 48) - 1)], ["pack", "fold", "g"])


def _smoothed(n: np.ndarray, ctx: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probabilities of (context, character) pairs with counts n, from those without the context's first character."""
    total, distinct = np.bincount(ctx, n)[ctx], np.bincount(ctx, n > 0)[ctx]
    return np.where(total > 0, (n + distinct * p) / np.maximum(total + distinct, 1), p)


def _of(counts: np.ndarray, label: int, left_out: int) -> np.ndarray:
    """Counts of a class without a fold (FOLDS: with all), from those by class and fold in the first axis."""
    own = counts[label * FOLDS : (label + 1) * FOLDS]
    return own.sum(0) - (own[left_out] if left_out < FOLDS else 0)


def _short(counts: np.ndarray) -> np.ndarray:
    """Probabilities of order 1 by left-out fold, class, context and character."""
    out = np.empty((FOLDS + 1, 2, 256, 256))
    for f, label in np.ndindex(FOLDS + 1, 2):
        n = _of(counts, label, f)
        zero = _smoothed(n.sum(0), np.zeros(256, np.int64), np.full(256, FLOOR))
        out[f, label] = _smoothed(n.reshape(-1), np.arange(1 << 16) >> 8, np.tile(zero, 256)).reshape(256, 256)
    return out


def _weighted(short):
    """(g, w) from the counts of whole contexts of three bytes and, where `two`, of all contexts of two bytes that end them. w: by left-out fold."""

    def matrix(keys: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros((2 * FOLDS + 1, len(keys)), np.int64)
        out[key & 15, np.searchsorted(keys, key >> 4)] = n
        return out

    def run(batches):
        t = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if t is None:
            return
        key, n, two = (t.column(k).to_numpy() for k in ("key", "n", "two"))
        keys = {k: np.unique(key[~two] >> 4 & (1 << 8 * k + 8) - 1) for k in range(3, ORDER + 1)} | {2: np.unique(key[two] >> 4)}
        ctx = {k: np.unique(x >> 8, return_inverse=True)[1] for k, x in keys.items()}
        g = keys[ORDER]
        up = {k: np.searchsorted(keys[k], g & (1 << 8 * k + 8) - 1) for k in range(3, ORDER)} | {ORDER: np.arange(len(g))}
        down = {k: np.searchsorted(keys[k - 1], keys[k] & (1 << 8 * k) - 1) for k in range(3, ORDER + 1)}
        n2, n5 = matrix(keys[2], key[two], n[two]), matrix(g, key[~two], n[~two])
        w = np.empty((len(g), FOLDS + 1), np.int64)
        for f in range(FOLDS + 1):
            log = []
            for label in (0, 1):
                p = _smoothed(_of(n2, label, f), ctx[2], short.value[f, label][keys[2] >> 8 & 255, keys[2] & 255])
                own = _of(n5, label, f)
                for k in range(3, ORDER + 1):
                    p = _smoothed(np.bincount(up[k], own, len(keys[k])), ctx[k], p[down[k]])
                log.append(np.log(p))
            w[:, f] = np.rint((log[1] - log[0]) * STEP)
        for i in range(0, len(g), 10_000):
            part = w[i : i + 10_000]
            lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, FOLDS + 1, dtype=np.int32), part.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(g[i : i + 10_000]), lists], ["g", "w"])
        W.release()

    return run


def _summed(urls: pa.Table, weights: pa.Table) -> pa.Table:
    """Scores of a pack's URLs by all labelled URLs (llr) and without their own fold (held)."""
    t = urls.combine_chunks()
    data, offs = W.text_buffers(t.column("u").combine_chunks() if t.num_rows else pa.array([], pa.string()))
    key = weights.column("g").to_numpy()
    o = np.argsort(key)
    at = o[np.searchsorted(key, grams(data, offs), sorter=o)] if len(data) else np.zeros(0, np.int64)
    out = []
    for k in ("all", "rest"):
        upto = np.concatenate([[0], np.cumsum(weights.column(k).to_numpy()[at])])
        out.append(pa.array((upto[offs[1:]] - upto[offs[:-1]]) / STEP / np.maximum(np.diff(offs), 1)))
    return pa.table([t.column("u"), t.column("fold"), t.column("good"), t.column("bad"), *out], ["u", "fold", "good", "bad", "llr", "held"])


def _marked(pages: DataFrame, labelled: DataFrame | None, url: str) -> DataFrame:
    """(u, good, bad, fold): the canonical URLs, once each, and whether they are labelled as accepted and as rejected."""
    own = pages.select(F.col(url).alias("url"), F.lit(None).cast("int").alias("label"))
    rows = own.withColumn("label", seed_label(F.col("url"))) if labelled is None else own.unionByName(labelled.filter("label in (0, 1)").select("url", F.col("label").cast("int")))
    has = [F.max(F.coalesce(F.col("label") == k, F.lit(False))).alias(name) for k, name in ((1, "good"), (0, "bad"))]
    u = rows.filter("url is not null").groupBy(canonical(F.col("url")).alias("u")).agg(*has)
    return u.withColumn("fold", F.pmod(F.xxhash64(F.lit("held"), "u"), F.lit(FOLDS)).cast("int"))


def _weights(counts: DataFrame, short: np.ndarray) -> DataFrame:
    """(g, w): weights of all counted grams, by left-out fold."""
    spark = counts.sparkSession
    two = counts.groupBy(F.col("key").bitwiseAND((1 << 28) - 1).alias("key")).agg(F.sum("n").alias("n"))
    two = two.select("key", "n", F.lit(True).alias("two"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long"))).alias("slot"))
    long = counts.select("key", "n", F.lit(False).alias("two"), F.shiftright("key", 28).bitwiseAND(SLOTS - 1).alias("slot"))
    rows = long.unionByName(two).withColumn("ctx", F.shiftright("key", 12).bitwiseAND((1 << 16) - 1))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // TASK_ROWS))
    sent = spark.sparkContext.broadcast(short)
    return rows.repartition(parts, "ctx", "slot").select("key", "n", "two").mapInArrow(_weighted(sent), "g long, w array<long>")


def train(pages: DataFrame, labelled: DataFrame | None = None, url: str = "url") -> tuple[DataFrame, float] | None:
    """((u, fold, good, bad, llr, held) of all canonical URLs of pages and labels, bound); nothing without URLs of both classes."""
    marked = _marked(pages, labelled, url).mapInArrow(_packed, "u string, good boolean, bad boolean, fold int, pack long")
    packs = cut(marked.withColumn("pack", F.col("pack") + F.shiftleft(F.spark_partition_id().cast("long"), 40)))
    counts = cut(packs.mapInArrow(_counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    got = counts.groupBy(F.col("key").bitwiseAND((1 << 20) - 1).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    key, n = got.column("key").to_numpy(), got.column("n").to_numpy()
    first = np.zeros((2 * FOLDS + 1, 256, 256), np.int64)
    first[key & 15, key >> 12, key >> 4 & 255] = n
    if not all(_of(first, label, FOLDS).any() for label in (0, 1)):
        return None
    weights = _weights(counts, _short(first))
    wanted = packs.select("u", "fold", "pack").mapInArrow(_needed, "pack long, fold int, g long")
    sent = wanted.join(weights, "g").select("pack", "g", F.col("w")[FOLDS].alias("all"), F.col("w")[F.col("fold")].alias("rest")).distinct()
    pair = packs.groupBy("pack").cogroup(sent.groupBy("pack"))
    scores = cut(pair.applyInArrow(_summed, "u string, fold int, good boolean, bad boolean, llr double, held double"))
    usable = [f for f in range(FOLDS) if all(_of(first, label, f).any() for label in (0, 1))]
    labels = scores.filter((F.col("good") | F.col("bad")) & F.col("fold").isin(usable)).select("held", F.col("good").cast("long"), F.col("bad").cast("long"))
    return scores, best_cut(labels)


def _values(score: np.ndarray, good: np.ndarray, bad: np.ndarray, before: tuple, total: tuple, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """(values, cuts) below each of the rising scores, if last also above them. before: URLs of both classes below the first, and the score below it."""
    g, b = (x + np.concatenate([[0], np.cumsum(y)]) for x, y in zip(before, (good, bad)))
    below = np.concatenate([[score[0] - 2e-6 if before[2] is None else before[2]], score])
    cuts = (below + np.concatenate([score, [score[-1] + 2e-6]])) / 2
    return (b * total[0] - g * total[1])[: len(score) + last], cuts[: len(score) + last]


def bound_of(score: np.ndarray, label: np.ndarray) -> float:
    """The midpoint between neighbouring scores with the most balanced accuracy (of ties, the middle one)."""
    s, at = np.unique(score, return_inverse=True)
    good, bad = np.bincount(at, label).astype(np.int64), np.bincount(at, 1 - label).astype(np.int64)
    value, cuts = _values(s, good, bad, (0, 0, None), (int(good.sum()), int(bad.sum())), True)
    best = np.flatnonzero(value == value.max())
    return float(cuts[best[len(best) // 2]])


def best_cut(labels: DataFrame) -> float:
    """bound_of() the rows (held, good, bad), range by range; 0 without rows of both classes."""
    parts = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = labels.groupBy("held").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    rows = cut(rows.repartitionByRange(parts, "held").withColumn("pid", F.spark_partition_id()))
    totals = sorted(map(tuple, rows.groupBy("pid").agg(F.sum("good"), F.sum("bad"), F.max("held")).collect()))
    total = tuple(sum(t[i] for t in totals) for i in (1, 2))
    if not all(total):
        return 0.0
    before, at = {}, (0, 0, None)
    for pid, g, b, most in totals:
        before[pid], at = at, (at[0] + g, at[1] + b, most)
    last = totals[-1][0]

    def within(wanted=None):
        def run(key, t):
            pid, t = key[0].as_py(), t.sort_by("held")
            value, cuts = _values(*(t.column(k).to_numpy() for k in ("held", "good", "bad")), before[pid], total, pid == last)
            best = np.flatnonzero(value == value.max())
            return pa.table([[pid], [int(value.max())], [len(best)], [float(cuts[best[wanted or 0]])]], ["pid", "value", "many", "cut"])

        return run

    schema = "pid long, value long, many long, cut double"
    found = sorted(map(tuple, rows.groupBy("pid").applyInArrow(within(), schema).collect()))
    found = [f for f in found if f[1] == max(x[1] for x in found)]
    middle = sum(f[2] for f in found) // 2
    for pid, _, many, _ in found:
        if middle < many:
            return rows.filter(F.col("pid") == pid).groupBy("pid").applyInArrow(within(middle), schema).first().cut
        middle -= many


def scored(pages: DataFrame, labelled: DataFrame | None = None, url: str = "url") -> tuple[DataFrame, float]:
    """(rows as struct `row` with `llr`, bound)."""
    rows = pages.select(F.struct(*pages.columns).alias("row"), canonical(F.col(url)).alias("u"))
    fitted = train(pages, labelled, url)
    if fitted is None:
        return rows.select("row", F.lit(0.0).alias("llr")), 0.0
    scores, bound = fitted
    return rows.join(scores.select("u", "llr"), "u", "left").select("row", F.coalesce("llr", F.lit(0.0)).alias("llr")), bound


def url_filter(pages: DataFrame, labelled: DataFrame | None = None, url: str = "url") -> DataFrame:
    """The rows of pages whose URLs are nearer to the accepted ones, with the columns of pages."""
    df, bound = scored(pages, labelled, url)
    return df.filter(F.col("llr") >= bound).select(*[F.col(f"row.`{c}`").alias(c) for c in pages.columns])


def url_report(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, url, llr, keep) of every page."""
    df, bound = scored(pages.select("page_id", "url"), labelled)
    return df.select("row.page_id", "row.url", F.round("llr", 6).alias("llr"), (F.col("llr") >= bound).alias("keep"))
