"""Suffix-array dedup: repeated passages of at least MIN_WORDS words.

A passage is a run of whole words (as written; blanks don't matter). A window of MIN_WORDS words repeats if it occurs at another
place of the corpus; the occurrence with the least (doc_id, text hash, position) is the first, and stays. A repeated passage is a
longest stretch of later occurrences in a document whose first occurrences lie in the same document.

The array is sparse and loses nothing: each window is represented by the suffix that begins at its anchor, the leftmost least
of the hashes of its runs of KEY_WORDS words. Equal windows have their anchor at the same place, so it is enough to sort the
suffixes at anchors, about one word in 13, each with at most MIN_WORDS words to its right and the words to its left that its
windows reach. Then:

1. Round of duplicate detection, as in prefix doubling: the hashes of all anchors' first KEY_WORDS words are exchanged; a suffix
   whose prefix is unique in the corpus is settled and never sent.
2. The other suffixes are sorted within each task, cut into buckets by the range of their hash, and sent as front-coded
   runs: bytes shared with the run's previous suffix are only counted.
3. Each bucket merges its runs with a loser tree that carries common-prefix lengths: suffixes that differ from the last output at
   different places are ordered by those lengths alone, others are compared beyond their common prefix only.
4. The merged order and its common prefixes give classes of suffixes that agree in their first r words; the sorted
   left contexts give classes that agree in the d words before. Windows with d words before the anchor are equal iff both classes
   agree (d and MIN_WORDS - d), and the least of each class is the first occurrence.

Texts are never shuffled whole as long as the candidates' keys can be broadcast (their size is checked).

Defined results: null texts and texts of fewer than MIN_WORDS words have no passages. Rows that agree in doc_id and text are
one document, so they don't repeat each other and lose the same passages. A null doc_id counts as the least. Passages may repeat
within a document too. dedup() drops later occurrences from the text (with the blanks after them), sets n_chars anew if there is
such a column, drops documents of which nothing is left, and passes other rows and columns as they are. Empty tables give empty
results; texts are used whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import NO_ID, cut, did, free_name, keyed, maybe_broadcast, text_hash

MIN_WORDS, KEY_WORDS = 50, 25
#: Suffixes a run holds at most, and suffixes a bucket should hold.
RUN, BUCKET = 25_000, 40_000
SPAN = "did long, th long, first_did long, start int, stop int"


# --- anchors


def anchors(w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, anchor, lowest window, highest window, key): word indexes count over all documents, whose first words are given."""
    n = np.diff(first)
    g = W.gram_hashes(w, KEY_WORDS)
    width = MIN_WORDS - KEY_WORDS + 1
    p = W.ranges(first[:-1], np.maximum(n - MIN_WORDS + 1, 0))
    none = np.zeros(0, np.int64)
    if not len(p):
        return none, none, none, none, np.zeros(0, np.uint64)
    U = np.uint64
    x = (g & U(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    pad = -len(x) % width
    x = np.concatenate([x, np.full(pad + width, np.iinfo(np.uint64).max)])
    blocks = x.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    at = (np.minimum(back[p], ahead[p + width - 1]) & U(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), np.maximum(n - MIN_WORDS + 1, 0))
    new = np.empty(len(p), bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    i = np.flatnonzero(new)
    last = np.append(i[1:], len(p)) - 1
    return doc[i], at[i], p[i], p[last], g[at[i]]


def _keys(batches):
    for b, data, offs in W.chunks(batches):
        start, end, first = W.spans(data, offs)
        doc, a, _, _, key = anchors(W.word_hashes(data, start, end), first)
        at = pa.array(doc)
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array((a - first[doc]).astype(np.int32)), pa.array(key.view(np.int64))], ["did", "th", "a", "key"])


# --- front-coded runs


def common(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix of a and b, known to be at least h."""
    n = min(len(a), len(b))
    x, y = a[h:n], b[h:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[list[int], bytes]:
    """(bytes shared with the string before, the rest of all strings)."""
    shared, rest, before = [], [], b""
    for s in strings:
        h = common(before, s, 0)
        shared.append(h)
        rest.append(s[h:])
        before = s
    return shared, b"".join(rest)


def front_decode(shared: np.ndarray, lengths: np.ndarray, rest: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for h, n in zip(shared.tolist(), lengths.tolist()):
        before = before[:h] + rest[at : at + n - h]
        at += n - h
        out.append(before)
    return out


def pack_run(right: list[bytes], left: list[bytes], cols: np.ndarray) -> bytes:
    """A run in order of right. cols: one int64 row for each number carried along."""
    s1, t1 = front_code(right)
    s2, t2 = front_code(left)
    nums = np.array([s1, [len(x) for x in right], s2, [len(x) for x in left]], np.int32)
    body = nums.tobytes() + np.ascontiguousarray(cols, np.int64).tobytes() + t1 + t2
    head = np.array([len(right), len(cols), len(t1), len(body)], np.int64).tobytes()
    return head + pa.compress(body, codec="zstd", asbytes=True)


def unpack_run(run: bytes) -> tuple[list[bytes], np.ndarray, list[bytes], np.ndarray]:
    """(right, bytes shared, left, cols)."""
    n, k, t1, size = np.frombuffer(run, np.int64, 4).tolist()
    body = pa.decompress(run[32:], decompressed_size=size, codec="zstd", asbytes=True)
    s1, l1, s2, l2 = np.frombuffer(body, np.int32, 4 * n).reshape(4, n)
    at = 16 * n
    cols = np.frombuffer(body, np.int64, k * n, at).reshape(k, n)
    at += 8 * k * n
    return front_decode(s1, l1, body[at : at + t1]), s1, front_decode(s2, l2, body[at + t1 :]), cols


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merges sorted runs (strings, bytes shared with the string before). Gives ([(run, place)], bytes shared with the output
    before). Each head carries the length of its common prefix with the last output: of two heads, the one with the longer
    is less; if they are as long, bytes after it decide, and the loser takes the length of its common prefix with the winner."""
    runs = [(k, s, h) for k, (s, h) in enumerate(runs) if s]
    if not runs:
        return [], []
    size = 1
    while size < len(runs):
        size *= 2
    names = [k for k, _, _ in runs] + [-1] * (size - len(runs))
    strings = [s for _, s, _ in runs] + [[] for _ in range(size - len(runs))]
    shares = [h for _, _, h in runs] + [[] for _ in range(size - len(runs))]
    head = [s[0] if s else None for s in strings]
    h = [0] * size
    pos = [0] * size
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        ha, hb = h[a], h[b]
        if ha > hb:
            return a, b
        if hb > ha:
            return b, a
        n = min(len(x), len(y))
        u, v = x[ha:n], y[ha:n]
        if u == v:
            c = n
            first = len(x) < len(y) or (len(x) == len(y) and a < b)
        else:
            c = n - ((int.from_bytes(u, "big") ^ int.from_bytes(v, "big")).bit_length() + 7) // 8
            first = u < v
        if first:
            h[b] = c
            return a, b
        h[a] = c
        return b, a

    level = list(range(size))
    node = size
    while len(level) > 1:
        node //= 2
        up = []
        for i in range(0, len(level), 2):
            w, lo = play(level[i], level[i + 1])
            loser[node + i // 2] = lo
            up.append(w)
        level = up
    w = level[0]
    order, shared = [], []
    while head[w] is not None:
        order.append((names[w], pos[w]))
        shared.append(h[w])
        pos[w] += 1
        if pos[w] < len(strings[w]):
            head[w] = strings[w][pos[w]]
            h[w] = int(shares[w][pos[w]])
        else:
            head[w] = None
        i = (w + size) // 2
        while i:
            w, loser[i] = play(w, loser[i])
            i //= 2
    return order, shared


# --- exchange and merge


def _runs(buckets: int):
    def flush(held):
        held.sort(key=lambda x: (x[0], x[1]))
        at = 0
        out_b, out_r = [], []
        while at < len(held):
            end = at
            while end < len(held) and held[end][0] == held[at][0]:
                end += 1
            part = held[at:end]
            out_b.append(part[0][0])
            out_r.append(pack_run([x[1] for x in part], [x[2] for x in part], np.array([x[3] for x in part], np.int64).T))
            at = end
        return pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out_r, pa.binary())], ["bucket", "run"])

    def run(batches):
        held: list = []
        for b, data, offs in W.chunks(batches):
            names = b.schema.names
            start, end, first = W.spans(data, offs)
            doc, a, lo, hi, key = anchors(W.word_hashes(data, start, end), first)
            wanted = b.column(names.index("at"))
            flat = wanted.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            per = np.diff(wanted.offsets.to_numpy())
            flat += first[np.repeat(np.arange(len(per)), per)]
            keep = np.isin(a, flat)
            doc, a, lo, hi, key = doc[keep], a[keep], lo[keep], hi[keep], key[keep]
            if not len(a):
                continue
            size = end - start
            ahead, back = _joined(data, start, size), _joined(data, start[::-1], size[::-1])
            at = np.concatenate([[0], np.cumsum(size + 1)])
            back_at = np.concatenate([[0], np.cumsum(size[::-1] + 1)])
            n = len(size)
            cut1, cut2 = at[a].tolist(), at[hi + MIN_WORDS].tolist()
            cut3, cut4 = back_at[n - a].tolist(), back_at[n - lo].tolist()
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64).tolist()
            base = first[doc]
            dids = b.column(0).to_numpy(zero_copy_only=False)[doc].tolist()
            ths = b.column(1).to_numpy(zero_copy_only=False)[doc].tolist()
            nums = zip(dids, ths, (a - base).tolist(), (lo - base).tolist(), (hi - base).tolist())
            for bk, c1, c2, c3, c4, x in zip(bucket, cut1, cut2, cut3, cut4, nums):
                held.append((bk, ahead[c1:c2], back[c3:c4], x))
            if len(held) >= RUN:
                yield flush(held)
                held = []
        if held:
            yield flush(held)

    return run


def _joined(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """The words, each with a blank after it."""
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    at = np.cumsum(size + 1) - size - 1
    out[W.ranges(at, size)] = data[W.ranges(start, size)]
    return out.tobytes()


def repeats(right: list[bytes], shared: list[int], left: list[bytes], cols: np.ndarray) -> np.ndarray:
    """Rows (did, th, did of the first, first window, last window) for later occurrences, from suffixes in sorted order with
    their common prefixes. cols: did, th, anchor, lowest window, highest window."""
    did_, th, a, lo, hi = cols
    n = len(a)
    words_shared = np.array([s.count(b" ", 0, h) for s, h in zip(right, shared)])
    by_left = sorted(range(n), key=left.__getitem__)
    left_shared = np.zeros(n, np.int64)
    before = b""
    for i, k in enumerate(by_left):
        s = left[k]
        left_shared[i] = s.count(b" ", 0, common(before, s, 0))
        before = s
    by_left = np.array(by_left)
    order = np.lexsort((a, th, did_))
    same = np.zeros(n, bool)
    same[1:] = (np.diff(a[order]) == 0) & (np.diff(th[order]) == 0) & (np.diff(did_[order]) == 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    again = np.zeros(n, bool)
    again[order] = same
    found = []
    for d in range(MIN_WORDS - KEY_WORDS + 1):
        x = np.flatnonzero((a - d >= lo) & (a - d <= hi) & ~again)
        if len(x) < 2:
            continue
        r = np.cumsum(words_shared < MIN_WORDS - d)
        l = np.empty(n, np.int64)
        l[by_left] = np.cumsum(left_shared < d) if d else 0
        k = r[x] * (n + 1) + l[x]
        o = np.lexsort((rank[x], k))
        x, k = x[o], k[o]
        new = np.append(True, k[1:] != k[:-1])
        lead = x[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = ~new
        found.append(np.array([x[later], a[x[later]] - d, did_[lead[later]]]))
    if not found:
        return np.zeros((5, 0), np.int64)
    x, p, f = np.concatenate(found, axis=1)
    o = np.lexsort((p, f, x))
    x, p, f = x[o], p[o], f[o]
    new = np.append(True, (x[1:] != x[:-1]) | (f[1:] != f[:-1]) | (p[1:] != p[:-1] + 1)) if len(x) else np.zeros(0, bool)
    i = np.flatnonzero(new)
    last = np.append(i[1:], len(x)) - 1 if len(i) else i
    return np.array([did_[x[i]], th[x[i]], f[i], p[i], p[last]])


def _merged(table: pa.Table) -> pa.Table:
    runs = [unpack_run(r) for r in table.column("run").to_pylist()]
    order, shared = merge([(r[0], r[1]) for r in runs])
    right = [runs[k][0][i] for k, i in order]
    left = [runs[k][2][i] for k, i in order]
    base = np.cumsum([0] + [len(r[0]) for r in runs])
    at = np.array([base[k] + i for k, i in order], np.int64)
    cols = np.concatenate([r[3] for r in runs], axis=1)[:, at]
    d, t, f, p, q = repeats(right, shared, left, cols)
    return pa.table([pa.array(d), pa.array(t), pa.array(f), pa.array(p.astype(np.int32)), pa.array((q + MIN_WORDS).astype(np.int32))], ["did", "th", "first_did", "start", "stop"])


def later_passages(docs: DataFrame) -> DataFrame:
    """(did, th, first_did, start, stop): words from start to before stop repeat words of the document first_did."""
    base = keyed(docs)
    k = base.mapInArrow(_keys, "did long, th long, a int, key long")
    w = Window.partitionBy("key")
    for c in ("did", "th", "a"):
        k = k.withColumn(f"lo_{c}", F.min(c).over(w)).withColumn(f"hi_{c}", F.max(c).over(w))
    k = k.filter("lo_did != hi_did or lo_th != hi_th or lo_a != hi_a")
    wanted = cut(k.groupBy("did", "th").agg(F.collect_set("a").alias("at")))
    n_docs, n = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("at")), F.lit(0))).first()
    small = maybe_broadcast(wanted, n_docs * 80 + n * 4, 1)
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET))
    runs = base.join(small, ["did", "th"]).mapInArrow(_runs(buckets), "bucket int, run binary")
    return cut(runs.groupBy("bucket").applyInArrow(_merged, SPAN))


def _islands(spans: DataFrame, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return marked.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, first_doc_id, start_word, end_word): each later occurrence, with the document that has the first."""
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = _islands(later_passages(docs), "did", "th", "first_did")
    return out.select(real("did").alias("doc_id"), real("first_did").alias("first_doc_id"), F.col("start").alias("start_word"), F.col("stop").alias("end_word"))


def _without(position: int):
    def run(batches):
        for b, data, offs in W.chunks(batches, "text"):
            names = b.schema.names
            start, end, first = W.spans(data, offs)
            spans = b.column(names.index("spans")).to_pylist()
            out = []
            for i, own in enumerate(spans):
                lo, stop = int(offs[i]), int(offs[i + 1])
                gone, at, kept = first[i], lo, []
                for s in sorted(own, key=lambda s: s["start"]):
                    b0 = int(start[first[i] + s["start"]])
                    e = first[i] + s["stop"]
                    b1 = int(start[e]) if e < first[i + 1] else stop
                    if b0 > at:
                        kept.append(data[at:b0].tobytes())
                    at = max(at, b1)
                if at < stop:
                    kept.append(data[at:stop].tobytes())
                out.append(b"".join(kept).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else b.column(k) for k, n in enumerate(names) if n != "spans"], [n for n in names if n != "spans"])

    return run


def dedup(docs: DataFrame) -> DataFrame:
    """docs without later occurrences of repeated passages; columns as in docs."""
    spans = _islands(later_passages(docs), "did", "th").groupBy("did", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    d, t, s = free_name(docs, "did"), free_name(docs, "th"), free_name(docs, "spans")
    spans = cut(spans.select(F.col("did").alias(d), F.col("th").alias(t), F.col("spans").alias(s)))
    n_docs, n = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(s)), F.lit(0))).first()
    spans = maybe_broadcast(spans, n_docs * 80 + n * 16, 1)
    named = docs.withColumns({d: did(), t: text_hash()})
    untouched = named.join(spans.select(d, t), [d, t], "left_anti").select(*docs.columns)
    rest = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    touched = named.join(spans, [d, t]).select("text", F.col(s).alias("spans"), rest.alias("rest"))
    schema = touched.drop("spans").schema
    left = touched.mapInArrow(_without(0), schema).filter(F.col("text").rlike("[^ \\t\\n\\r\\f\\x0B]"))
    cols = {c: F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"rest.`{c}`") for c in docs.columns}
    return untouched.unionByName(left.select(*[e.alias(c) for c, e in cols.items()]))


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(w) - {MIN_WORDS - 1})) AS p, w FROM t WHERE len(w) >= {MIN_WORDS}),
k AS (SELECT doc_id, p, md5(array_to_string(w[p + 1 : p + {MIN_WORDS}], ' ')) AS k FROM p),
f AS (SELECT doc_id, p, first_value({{'d': doc_id, 'p': p}}) OVER (PARTITION BY k ORDER BY doc_id, p) AS o FROM k),
l AS (SELECT doc_id, o.d AS first_doc_id, p, lag(p) OVER (PARTITION BY doc_id, o.d ORDER BY p) AS q FROM f WHERE o.d <> doc_id OR o.p <> p),
i AS (SELECT *, sum(CASE WHEN p <= q + {MIN_WORDS} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, first_doc_id ORDER BY p) AS island FROM l)
SELECT doc_id, first_doc_id, min(p)::INT AS start_word, (max(p) + {MIN_WORDS})::INT AS end_word FROM i GROUP BY doc_id, first_doc_id, island"""
