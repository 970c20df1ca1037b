"""MinHash near-dedup: fast similarity sketching, banding, exact verification.

Sketch: a document's set is that of its runs of SHINGLE normalised words (lower case, no ASCII signs; a shorter document is one
run). Following the fast similarity sketch, coordinate j holds the least of values round + hash that fall into bin j: in rounds
0 to T-1 every element is thrown into one hashed bin, in rounds T to 2T-1 every element goes to bin round - T, so every
coordinate is filled whatever the size of the set, in expected time O(n + T log T), with the concentration of T draws.

Documents with the same normalised words are collapsed first. The sketches of the others are cut into BANDS bands; in each
bucket, all are paired with the bucket's least key, and the pairs' exact Jaccard similarity is computed from their whole texts.
Verified pairs make components (alternating large-star and small-star). A bucket that still holds several components has all
its other pairs across components verified, so no partner is dropped; then components are final. The document with the least
key of each component stays.

Shuffles: sketches on the words' hash, (band, key) rows on the band, candidates' texts on the key; texts of documents without a
partner are never shuffled while the candidates' keys can be broadcast (their size is checked).

Defined results: null and blank texts have no words and never are duplicates. Rows that agree in doc_id and text are one
document: all but one of them go, whatever the text. A null doc_id counts as the least. Ties go by doc_id, then by the text's hash. Other
columns pass through dedup(). Empty tables give empty results; texts are used whole.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import NO_ID, cut, delete, did, free_name, keyed, maybe_broadcast, shared_dir, text_hash

SHINGLE, BANDS, ROWS, THRESHOLD = 3, 24, 4, 0.6
SKETCH_SCHEMA = "did long, th long, f1 long, f2 long, bands array<long>"


def shingles(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, document of each, words, first): the runs of k words of each document, or its only run if it has fewer words."""
    data, offs = W.normalised(data, offs)
    start, end, first = W.spans(data, offs)
    w = W.word_hashes(data, start, end)
    n = np.diff(first)
    grams = W.gram_hashes(np.concatenate([w, np.zeros(k, np.uint64)]), k)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = W.ranges(first[:-1], counts)
    doc = np.repeat(np.arange(len(n)), counts)
    g = grams[at]
    short = np.flatnonzero((n > 0) & (n < k))
    for i in short.tolist():  # a run that is the whole of a short document
        own = np.zeros(k, np.uint64)
        own[: n[i]] = w[first[i] : first[i + 1]]
        g[np.searchsorted(doc, i)] = W.gram_hashes(own, k)[0] ^ np.uint64(n[i])
    return g, doc, w, first


def sketch(g: np.ndarray, doc: np.ndarray, n_docs: int, t: int = BANDS * ROWS) -> np.ndarray:
    """n_docs x t values round << 32 | hash. Rows of documents without elements stay at the largest value."""
    out = np.full(n_docs * t, np.iinfo(np.uint64).max, np.uint64)
    U = np.uint64
    live_g, live_doc = g, doc
    for i in range(2 * t):
        if not len(live_g):
            break
        x = W.mix(live_g + W.mix(np.array([i + 1], np.uint64)))
        v = (x & U(0xFFFFFFFF)) | U(i << 32)
        b = ((x >> U(32)) * U(t) >> U(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, live_doc * t + b, v)
        full = (out.reshape(n_docs, t) < np.iinfo(np.uint64).max).all(axis=1)
        more = ~full[live_doc]
        if not more.all():
            live_g, live_doc = live_g[more], live_doc[more]
    return out.reshape(n_docs, t)


def band_keys(s: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    x = s.reshape(len(s), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(s), bands)).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = W.mix(key * W.P + x[:, :, r])
    return key


def _sketches(batches):
    for b, data, offs in W.chunks(batches):
        g, doc, w, first = shingles(data, offs)
        n = np.diff(first)
        keys = band_keys(sketch(g, doc, len(n)))
        with np.errstate(over="ignore"):
            prints = []
            for p in (W.P, W.Q):
                c = np.zeros(len(w) + 1, np.uint64)
                np.cumsum(W.mix(w ^ p) * W.powers(p, len(w)), out=c[1:])
                back = W.powers(W.inverse(p), len(w) + 1)
                prints.append(W.mix((c[first[1:]] - c[first[:-1]]) * back[first[:-1]] + n.astype(np.uint64)).view(np.int64))
        has = np.flatnonzero(n > 0)
        flat = pa.array(keys[has].reshape(-1).view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * BANDS), flat)
        b = b.take(pa.array(has))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints[0][has]), pa.array(prints[1][has]), lists], ["did", "th", "f1", "f2", "bands"])


def jaccards(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Exact Jaccard similarity of the documents of two (bytes, offsets), pair by pair."""
    n = len(a[1]) - 1
    parts = []
    for data, offs in (a, b):
        g, doc, _, _ = shingles(data, offs)
        u, at = np.unique(g ^ W.mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)
        parts.append((u, doc[at]))
    (ua, da), (ub, db) = parts
    _, i, _ = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = np.bincount(da[i], minlength=n)
    either = np.bincount(da, minlength=n) + np.bincount(db, minlength=n) - both
    return both / np.maximum(either, 1)


def _verified(threshold: float):
    def run(batches):
        for b in batches:
            names = b.schema.names
            step = 256
            for at in range(0, b.num_rows, step):
                s = b.slice(at, step)
                j = jaccards(W.text_buffers(s.column(names.index("text_a"))), W.text_buffers(s.column(names.index("text_b"))))
                ok = pa.array(np.flatnonzero(j >= threshold))
                yield pa.RecordBatch.from_arrays([s.column(names.index(c)).take(ok) for c in ("a", "b")], ["a", "b"])

    return run


NODE = "struct<did:long,th:long>"


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of edges (a, b) but the roots, with the least node of its component. Alternates large-star and
    small-star until all edges point to roots. Least neighbours are aggregated and joined, so that a node with very many edges is combined before it is
    shuffled, and its join can be split."""
    edges = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        bad = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
        chained = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").select("a")
        if bad.union(chained).isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(both.groupBy("a").agg(F.min("b").alias("m")), "a").filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        small = cut(large.filter("a != b").distinct())
        small = small.join(small.groupBy("a").agg(F.min("b").alias("m")), "a")
        new = small.select("a", F.col("m").alias("b")).union(small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = cut(new.distinct())


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    first = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    second = first.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    return second.select("a", "b", "text_a", "text_b").mapInArrow(_verified(threshold), f"a {NODE}, b {NODE}")


def duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root): keys (did, th) of documents that aren't kept, each with the key of the one that is."""
    spark = docs.sparkSession
    low = keyed(docs).withColumn("text", F.lower("text"))
    key = F.struct("did", "th")
    s = cut(low.mapInArrow(_sketches, SKETCH_SCHEMA).select(key.alias("key"), "f1", "f2", "bands"))
    # equal texts: all but the least key go; groups are aggregated before they are shuffled, and only those of two or more are joined
    alike = cut(s.groupBy("f1", "f2").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"))
    again = s.select("key", "f1", "f2").join(maybe_broadcast(alike, alike.count(), 64), ["f1", "f2"])
    copies = cut(again.filter("key != least").select(F.col("key").alias("a"), F.col("least").alias("b")).distinct())
    gone = maybe_broadcast(copies.select(F.col("a").alias("key")), copies.count(), 48)
    # the (band, key) rows of buckets that hold two or more
    banded = s.join(gone, "key", "left_anti").select("key", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    member = cut(banded.join(buckets, "band"))
    stars = cut(member.filter("key != least").select(F.col("key").alias("a"), F.col("least").alias("b")).distinct())
    keys = cut(member.select("key").distinct())
    n = keys.count()
    if not n:
        return components(copies)
    wanted = maybe_broadcast(keys.select("key.did", "key.th"), n, 64)
    path = f"{shared_dir(spark)}/near-dedup-{uuid.uuid4().hex}"
    low.join(wanted, ["did", "th"], "left_semi").dropDuplicates(["did", "th"]).select(key.alias("key"), "text").write.option("compression", "zstd").parquet(path)
    texts = spark.read.parquet(path)
    found = cut(_verify(stars, texts, threshold))
    groups = components(copies.union(found))
    # buckets that still hold several components: all other pairs across them
    label = member.join(groups, F.col("key") == F.col("node"), "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    several = label.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("band")
    mixed = label.join(several, "band")
    other = mixed.select("band", F.col("key").alias("key2"), F.col("root").alias("root2"))
    rest = mixed.join(other, "band").filter("root != root2 and key > key2").select(F.col("key").alias("a"), F.col("key2").alias("b")).distinct()
    more = cut(_verify(rest.join(stars, ["a", "b"], "left_anti"), texts, threshold))
    delete(spark, path)
    return groups if more.isEmpty() else components(copies.union(found).union(more))


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept_doc_id): each document that goes, with the one of its group that stays."""
    out = duplicates(docs, threshold)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("node.did").alias("doc_id"), real("root.did").alias("kept_doc_id"))


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stay, with the columns of docs. Of rows that agree in doc_id and text, one stays."""
    d, t = free_name(docs, "did"), free_name(docs, "th")
    gone = duplicates(docs, threshold).select(F.col("node.did").alias(d), F.col("node.th").alias(t))
    gone = maybe_broadcast(gone, gone.count(), 64)
    left = docs.withColumns({d: did(), t: text_hash()}).join(gone, [d, t], "left_anti")
    again = cut(left.groupBy(d, t).count().filter("count > 1").select(d, t))
    n = again.count()
    if n:
        again = maybe_broadcast(again, n, 64)
        left = left.join(again, [d, t], "left_anti").unionByName(left.join(again, [d, t], "left_semi").dropDuplicates([d, t]))
    return left.select(*docs.columns)
