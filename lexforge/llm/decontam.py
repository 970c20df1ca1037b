"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items.

Index: item-ordered postings of normalised words (lower case, no ASCII signs) with BM25 impacts divided by the item's own
threshold, TAU times its score against itself, so that "above threshold" is 1 for all items. Items lie in at most BLOCKS blocks;
each term has its largest impact (WAND) and its largest impact in each block in which it occurs (block-max).

Query: passages are windows of 2 * stride words, every stride words, where stride is STRIDE or, for longer items, STRIDE times the least power of two that
is their length or more. So each item that occurs lies whole within a passage, and what an item matches doesn't depend on other items' lengths. Whole batches of passages are tested at once against the sums of largest
impacts; those that may reach 1 are tested block by block; within the blocks that remain, document-at-a-time WAND with the block's
impacts as bounds finds exactly the items that score 1 or more.

Verification: the item is split into question and answer, after its last question mark (or "answer:") or, without one, after three quarters of
its words. At least OVERLAP of each one's runs of GRAM words (fewer, if it is shorter) must occur in the passage.

The index is broadcast. Items of one stride are held in shards of at most SHARD_CHARS characters (or one item), with document frequencies over all items. Of several
shards one at a time is built, broadcast, searched in a pass of its own, whose result is kept in the shared folder, and taken away again. Documents aren't shuffled. The driver
holds the document frequencies of the items' words, and one shard.

Defined results: equal scores of one item's passages: the first passage is reported; null or wordless texts match nothing, on both sides; a null doc_id or item_id stays null; rows that repeat, on
either side, are reported or dropped each; decontaminate() passes other columns, and drops every row whose text holds an item. Empty
tables give empty results (without items, all documents stay). Texts are searched whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import NO_ID, cut, did, free_name, text_hash

STRIDE, TAU, OVERLAP, GRAM, BLOCKS = 128, 0.5, 0.6, 5, 128
K1, B = 1.2, 0.75
SHARD_CHARS = 4 << 20


def item_words(text: str) -> tuple[np.ndarray, int]:
    """(hashes of the normalised words, where the answer begins)."""
    low = text.lower()
    data = np.frombuffer(low.encode(), np.uint8)

    def hashes(d):
        d, offs = W.normalised(d, np.array([0, len(d)]))
        start, end, _ = W.spans(d, offs)
        return W.word_hashes(d, start, end)

    w = hashes(data)
    mark = low.rfind("answer:")
    mark = mark if mark >= 0 else low.rfind("?") + 1
    head = len(hashes(np.frombuffer(low[:mark].encode(), np.uint8))) if mark > 0 else 0
    if not 0 < head < len(w):
        head = -(-3 * len(w) // 4)
    return w, head


def grams(w: np.ndarray, k: int) -> np.ndarray:
    return W.gram_hashes(w, k)


class Index:
    """Postings of some items. df, n and mean hold for all items."""

    def __init__(self, items: list[tuple], df: dict[int, int], n: int, mean: float, stride: int):
        self.stride = stride
        self.ids = [i for i, _, _ in items]
        vocab: dict[int, int] = {}
        self.post: list[list[tuple[int, float]]] = []
        self.parts = []
        for x, (_, w, head) in enumerate(items):
            u, tf = np.unique(w, return_counts=True)
            freq = np.array([df[h] for h in u.tolist()])
            impact = np.log(1 + (n - freq + 0.5) / (freq + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            impact /= TAU * impact.sum()
            for h, s in zip(u.tolist(), impact.tolist()):
                t = vocab.setdefault(h, len(vocab))
                if t == len(self.post):
                    self.post.append([])
                self.post[t].append((x, s))
            q, a = w[:head], w[head:]
            parts = []
            for p in (q, a):
                k = min(GRAM, len(p))
                parts.append((k, np.unique(grams(p, k)) if k else np.zeros(0, np.uint64)))
            self.parts.append(parts)
        self.per_block = max(1, -(-len(items) // BLOCKS))
        blocks = -(-len(items) // self.per_block) if items else 0
        self.blocks = blocks
        self.in_block: list[dict[int, tuple[float, list]]] = []
        for p in self.post:
            own: dict[int, list] = {}
            for x, s in p:
                own.setdefault(x // self.per_block, []).append((x, s))
            self.in_block.append({b: (float(max(np.float32(s) for _, s in q) * np.float32(1.000001)), q) for b, q in own.items()})
        del self.post
        # of each term the blocks in which it occurs, with its largest impact there
        self.block_from = np.concatenate([[0], np.cumsum([len(own) for own in self.in_block])]).astype(np.int64)
        self.block_of = np.array([b for own in self.in_block for b in own], np.int64)
        self.block_top = np.array([top for own in self.in_block for top, _ in own.values()], np.float64)
        self.most = np.array([max(top for top, _ in own.values()) for own in self.in_block], np.float32)
        # chained hash table: slot -> term, term -> next term of the slot
        self.bits = max(10, int(len(vocab) * 8).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.next = np.full(max(1, len(vocab)), -1, np.int32)
        self.hash = np.array(list(vocab), np.uint64)
        for t, h in enumerate(vocab):
            s = h >> (64 - self.bits)
            self.next[t], self.slot[s] = self.slot[s], t

    def terms(self, w: np.ndarray) -> np.ndarray:
        """The term of each word, or -1."""
        t = self.slot[(w >> np.uint64(64 - self.bits)).astype(np.int64)]
        open_ = np.flatnonzero(t >= 0)
        while len(open_):
            wrong = self.hash[t[open_]] != w[open_]
            open_ = open_[wrong]
            t[open_] = self.next[t[open_]]
            open_ = open_[t[open_] >= 0]
        return t

    def search(self, terms: list[int], blocks: set[int]) -> list[tuple[int, float]]:
        """All items of those blocks with a score of at least 1."""
        found = []
        for b in sorted(blocks):
            own = [p for t in terms if (p := self.in_block[t].get(b)) is not None]
            if sum(ub for ub, _ in own) >= 1:
                found += self._wand([ub for ub, _ in own], [p for _, p in own])
        return found

    @staticmethod
    def _wand(most: list[float], lists: list[list[tuple[int, float]]]) -> list[tuple[int, float]]:
        """Document-at-a-time WAND over one block's postings, with the terms' largest impacts in the block as bounds."""
        at = [0] * len(lists)
        live = sorted(range(len(lists)), key=lambda k: lists[k][0][0])
        found = []
        while True:
            bound, pivot = 0.0, -1
            for j, k in enumerate(live):
                bound += most[k]
                if bound >= 1:
                    pivot = j
                    break
            if pivot < 0:
                return found
            x = lists[live[pivot]][at[live[pivot]]][0]
            if lists[live[0]][at[live[0]]][0] == x:
                score = 0.0
                for k in live:
                    item, s = lists[k][at[k]]
                    if item != x:
                        break
                    score += s
                    at[k] += 1
                if score >= 1:
                    found.append((x, score))
            else:
                for k in live[:pivot]:
                    p, i = lists[k], at[k]
                    while i < len(p) and p[i][0] < x:
                        i += 1
                    at[k] = i
            live = sorted((k for k in live if at[k] < len(lists[k])), key=lambda k: lists[k][at[k]][0])

    def matches(self, w: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(document, item, score, overlap of question and answer): for each pair the verified passage with the largest score."""
        n = np.diff(first)
        if not len(w) or not len(self.ids):
            return []
        step = self.stride
        halves = -(-n // step)
        base = np.concatenate([[0], np.cumsum(halves)])
        doc = np.repeat(np.arange(len(n)), n)
        half = base[doc] + (np.arange(len(w)) - first[doc]) // step
        t = self.terms(w)
        hit = np.flatnonzero(t >= 0)
        v = np.int64(len(self.hash))
        here = half[hit] * v + t[hit]
        before = here[half[hit] > base[doc[hit]]] - v  # passage j has the halves j and j + 1
        pair = np.unique(np.concatenate([here, before]))
        passage, term = pair // v, pair % v
        total = int(base[-1])
        may = np.bincount(passage, weights=self.most[term], minlength=total) >= 1
        keep = may[passage]
        passage, term = passage[keep], term[keep]
        if not len(passage):
            return []
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        begin = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        stop = np.append(begin[1:], len(passage))
        size = max(1, (1 << 21) // max(1, self.blocks))
        at = 0
        while at < len(begin):
            to = at + 1
            while to < len(begin) and stop[to] - begin[at] <= size:
                to += 1
            lo = begin[at]
            own = term[lo : stop[to - 1]]
            many = self.block_from[own + 1] - self.block_from[own]
            entry = W.ranges(self.block_from[own], many)
            row = np.repeat(np.repeat(np.arange(to - at), stop[at:to] - begin[at:to]), many)
            bound = np.bincount(row * self.blocks + self.block_of[entry], weights=self.block_top[entry], minlength=(to - at) * self.blocks).reshape(to - at, self.blocks)
            for j in np.flatnonzero((bound >= 0.99999).any(axis=1)).tolist():
                g = int(passage[begin[at + j]])
                ts = term[begin[at + j] : stop[at + j]].tolist()
                hits = self.search(ts, set(np.flatnonzero(bound[j] >= 0.99999).tolist()))
                if hits:
                    d = int(np.searchsorted(base, g, "right")) - 1
                    a = first[d] + (g - base[d]) * step
                    own = w[a : min(a + 2 * step, first[d + 1])]
                    for x, score in hits:
                        q, r = (float(np.isin(s, grams(own, k)).mean()) if k else 1.0 for k, s in self.parts[x])
                        if q >= OVERLAP and r >= OVERLAP and score > best.get((d, x), (0.0,))[0]:
                            best[d, x] = (score, q, r)
            at = to
        return [(d, x, *s) for (d, x), s in best.items()]


def stride_of(n: int, stride: int = STRIDE) -> int:
    """The stride for an item of n words."""
    while stride < n:
        stride *= 2
    return stride


def shards(items: DataFrame, stride: int = STRIDE) -> Iterator[tuple[Index, bool]]:
    """(index, whether it is the only one) of all items that have words, one after the other. The items are streamed to the driver once to be counted, and once for each stride."""
    rows = lambda: items.select("item_id", "text").filter("text is not null").toLocalIterator()
    df: dict[int, int] = {}
    chars: dict[int, int] = {}
    n = words = 0
    for r in rows():
        w, _ = item_words(r.text)
        if len(w):
            n, words = n + 1, words + len(w)
            s = stride_of(len(w), stride)
            chars[s] = chars.get(s, 0) + len(r.text)
            for h in np.unique(w).tolist():
                df[h] = df.get(h, 0) + 1
    only = len(chars) == 1 and sum(chars.values()) <= SHARD_CHARS
    for s in sorted(chars):
        held, size = [], 0
        for r in rows():
            w, head = item_words(r.text)
            if len(w) and stride_of(len(w), stride) == s:
                if held and size + len(r.text) > SHARD_CHARS:
                    yield Index(held, df, n, words / n, s), only
                    held, size = [], 0
                held.append((r.item_id, w, head))
                size += len(r.text)
        yield Index(held, df, n, words / n, s), only


def _words(data, offs):
    data, offs = W.normalised(data, offs)
    start, end, first = W.spans(data, offs)
    return W.word_hashes(data, start, end), first


def _report(index):
    def run(batches):
        ix = pickle.loads(index.value)
        for b, data, offs in W.chunks(batches):
            found = ix.matches(*_words(data, offs))
            d = pa.array([m[0] for m in found], pa.int64())
            cols = [pa.array([ix.ids[m[1]] for m in found], pa.int64())] + [pa.array([m[k] for m in found], pa.float64()) for k in (2, 3, 4)]
            own = [b.column(b.schema.get_field_index(c)).take(d) for c in ("doc_id", "th")]
            yield pa.RecordBatch.from_arrays([*own, *cols], ["doc_id", "th", "item_id", "score", "question", "answer"])

    return run


def _clean(index, low: str):
    def run(batches):
        ix = pickle.loads(index.value)
        for b, data, offs in W.chunks(batches, low):
            keep = np.ones(b.num_rows, bool)
            keep[[m[0] for m in ix.matches(*_words(data, offs))]] = False
            k = b.schema.get_field_index(low)
            cols = [i for i in range(b.num_columns) if i != k]
            yield b.select(cols).filter(pa.array(keep))

    return run


_FOUND = "doc_id long, {}item_id long, score double, question double, answer double"


def _found(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """What contaminated() returns, unrounded, with th, the text's hash, or nothing without items."""
    sc = docs.sparkSession.sparkContext
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), F.lower("text").alias("text"))
    out = None
    for ix, only in shards(items):
        sent = sc.broadcast(cloudpickle.dumps(ix))  # by value: workers may lack this package
        found = src.mapInArrow(_report(sent), _FOUND.format("th long, "))
        if not only:
            found = cut(found)
            sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question, answer): score in multiples of the item's threshold, overlaps as shares."""
    out = _found(docs, items)
    if out is None:
        return docs.sparkSession.createDataFrame([], _FOUND.format(""))
    return out.select("doc_id", "item_id", *[F.round(c, 4).alias(c) for c in ("score", "question", "answer")])


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without test items, with the columns of docs. One shard filters as it reads; several leave their findings, which are joined against."""
    first = next(shards(items), None)
    if first is None:
        return docs
    if first[1]:
        low = free_name(docs, "low")
        sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(first[0]))
        return docs.withColumn(low, F.lower("text")).mapInArrow(_clean(sent, low), docs.schema)
    found = _found(docs, items).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_did"), F.col("th").alias("_th")).distinct()
    did_, th_ = free_name(docs, "did"), free_name(docs, "th")
    named = docs.withColumn(did_, did()).withColumn(th_, text_hash())
    on = (named[did_] == found["_did"]) & (named[th_] == found["_th"])
    return named.join(found, on, "left_anti").drop(did_, th_)


_SIGNS = "[\\x00-\\x08\\x0E-\\x1F!-/:-@\\[-`{-~\\x7F]"
_BLANK = "[ \\t\\n\\r\\f\\x0B]+"


def _norm(x: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '{_SIGNS}', '', 'g'), '{_BLANK}'), lambda w: w <> '')"


ORACLE_SQL = f"""
WITH i0 AS (SELECT row_number() OVER (ORDER BY item_id, text) AS x, item_id, text, {_norm("text")} AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT x, item_id, w, len(w) AS n,
  CASE WHEN h > 0 AND h < len(w) THEN h ELSE CAST(ceil(3 * len(w) / 4.0) AS INT) END AS head
  FROM (SELECT *, CASE WHEN contains(lower(text), 'answer:') THEN len({_norm("left(text, length(text) - length(regexp_replace(lower(text), '(?s)^.*answer:', '')) - 7)")})
    WHEN contains(text, '?') THEN len({_norm("left(text, length(text) - length(regexp_replace(text, '(?s)^.*[?]', '')))")}) ELSE 0 END AS h FROM i0) WHERE len(w) > 0),
c AS (SELECT count(*) AS total, avg(n) AS mean FROM i),
st AS (SELECT x, CAST({STRIDE} * pow(2, greatest(0, ceil(log2(n / {STRIDE}::DOUBLE)))) AS BIGINT) AS s FROM i),
tf AS (SELECT x, n, t, count(*) AS tf FROM (SELECT x, n, unnest(w) AS t FROM i) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
im AS (SELECT x, t, ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * n / mean)) AS impact FROM tf JOIN df USING (t), c),
th AS (SELECT x, sum(impact) * {TAU}::DOUBLE AS need FROM im GROUP BY x),
d AS (SELECT row_number() OVER () AS r, doc_id, {_norm("coalesce(text, '')")} AS w FROM documents),
pa AS (SELECT r, doc_id, s, j, w[j * s + 1 : (j + 2) * s] AS w FROM (SELECT *, unnest(range(0, CAST(ceil(len(w) / s::DOUBLE) AS BIGINT))) AS j FROM d, (SELECT DISTINCT s FROM st))),
pt AS (SELECT r, s, j, unnest(list_distinct(w)) AS t FROM pa),
sc AS (SELECT r, s, j, x, sum(impact) / any_value(need) AS score FROM pt JOIN im USING (t) JOIN st USING (x, s) JOIN th USING (x) GROUP BY r, s, j, x HAVING sum(impact) >= any_value(need)),
g AS (SELECT pa.doc_id, sc.r, sc.j, i.item_id, i.x, score, pa.w AS pw, i.w[1:head] AS q, i.w[head + 1 :] AS a FROM sc JOIN pa USING (r, s, j) JOIN i USING (x)),
o AS (SELECT *, least({GRAM}, len(q)) AS kq, least({GRAM}, len(a)) AS ka FROM g),
e AS (SELECT *, list_distinct([array_to_string(q[y : y + kq - 1], ' ') for y in range(1, len(q) - kq + 2)]) AS gq, [array_to_string(pw[y : y + kq - 1], ' ') for y in range(1, len(pw) - kq + 2)] AS pq,
  list_distinct([array_to_string(a[y : y + ka - 1], ' ') for y in range(1, len(a) - ka + 2)]) AS ga, [array_to_string(pw[y : y + ka - 1], ' ') for y in range(1, len(pw) - ka + 2)] AS pg FROM o),
v AS (SELECT doc_id, r, j, item_id, x, score, CASE WHEN kq = 0 THEN 1.0 ELSE len(list_intersect(gq, pq)) / len(gq)::DOUBLE END AS question, CASE WHEN ka = 0 THEN 1.0 ELSE len(list_intersect(ga, pg)) / len(ga)::DOUBLE END AS answer FROM e)
SELECT doc_id, item_id, round(score, 4) AS score, round(question, 4) AS question, round(answer, 4) AS answer
FROM v WHERE question >= {OVERLAP} AND answer >= {OVERLAP} QUALIFY row_number() OVER (PARTITION BY r, x ORDER BY score DESC, j) = 1"""
