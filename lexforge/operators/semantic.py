"""TF-IDF relevance: postings, inverse document frequencies, cosine scores."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import jvm
from ..sources.shared import cut

STOP_WORDS = sorted("a an and are be did do does for how in is it of on or that the this to was were what where which who why with".split())
NAME_WEIGHT, BODY_UNITS = 3, 500
SOURCE = Path(__file__).parent / "relevance.java"
#: Terms whose frequencies are broadcast, and bytes up to which norms are.
HEAD_TERMS, BROADCAST_BYTES = 1 << 16, 64 << 20


def terms(x: Column) -> Column:
    """Lower-case runs of ASCII word characters that aren't stop words."""
    return F.filter(F.split(F.lower(x), "[^A-Za-z0-9_]+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))


def once(docs: DataFrame) -> bool:
    """Whether no id is repeated."""
    return docs.groupBy("id").count().filter("count > 1").limit(1).count() == 0


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, term, tf). A text's terms are counted where it is read; only those of repeated ids meet."""
    count = jvm.function(docs.sparkSession, SOURCE, "lexforge.relevance.Terms", "map<string,int>", " ".join(STOP_WORDS))
    each = docs.select("id", F.explode(count(F.lower(text))).alias("term", "tf")).withColumn("tf", F.col("tf").cast("long"))
    return each if once(docs) else each.groupBy("id", "term").agg(F.sum("tf").alias("tf"))


def symbol_counts(symbols: DataFrame) -> DataFrame:
    """(id, term, tf): names count NAME_WEIGHT times; signatures and the head of the body, BODY_UNITS characters, once."""
    body = F.concat(F.col("signature"), F.lit(" "), F.substring("full_source", 1, BODY_UNITS))
    both = symbols.select("id", F.explode(terms(F.col("name"))).alias("term"), F.lit(NAME_WEIGHT).alias("w")).union(symbols.select("id", F.explode(terms(body)).alias("term"), F.lit(1).alias("w")))
    return both.groupBy("id", "term").agg(F.sum("w").alias("tf"))


def idf(counts: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf): ln((n + 1) / (df + 1)) + 1; n counts documents without terms too."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log((F.lit(float(n_docs)) + 1) / (F.col("df") + 1)) + 1)


def weights(counts: DataFrame, idfs: DataFrame) -> DataFrame:
    """(id, term, w). The HEAD_TERMS most frequent terms, most of all counts, are broadcast; only counts of the others meet their frequencies by a shuffle."""
    w = (F.col("tf") * F.col("idf")).alias("w")
    head = cut(idfs.orderBy(F.desc("df"), "term").limit(HEAD_TERMS).select("term", "idf"))
    known = counts.join(F.broadcast(head), "term").select("id", "term", w)
    if head.count() < HEAD_TERMS:
        return known
    rest = counts.join(F.broadcast(head.select("term")), "term", "left_anti").join(idfs.select("term", "idf"), "term")
    return known.unionByName(rest.select("id", "term", w))


def norms(w: DataFrame) -> DataFrame:
    return w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def scores(docs: DataFrame, w: DataFrame, idfs: DataFrame, prompt: str) -> DataFrame:
    """(id, score): cosine of every document with the prompt; 0 where nothing is shared. The prompt is a handful of terms."""
    spark = docs.sparkSession
    q = spark.range(1).select(F.explode(terms(F.lit(prompt))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    q = q.join(idfs, "term").select("term", (F.col("n") * F.col("idf")).alias("q"))
    length = F.broadcast(q.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn")))
    both = w.join(F.broadcast(q), "term", "left").groupBy("id").agg(F.sum(F.col("w") * F.col("q")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    hit = both.filter("dot is not null").crossJoin(length).select("id", (F.col("dot") / (F.col("norm") * F.col("qn"))).alias("score"))
    return docs.select("id").join(hit, "id", "left").na.fill(0.0, ["score"])


def ranked_by(docs: DataFrame, scored: DataFrame) -> DataFrame:
    return docs.join(scored, "id").orderBy(F.desc("score"), "ordinal")


#: Queries, and numbers of their vectors, that are held and broadcast at once.
BLOCK_QUERIES, BLOCK_NUMBERS = 2048, 4 << 20
#: Queries that are held as postings at once.
POSTED_QUERIES = 1 << 15
FOUND = "id long, other long, near double, score double"


def _blocks(queries: DataFrame, size: Column, most: int = BLOCK_QUERIES) -> Iterator[list]:
    """Rows of the queries, as many at once as the bounds allow."""
    held, numbers = [], 0
    for r in queries.withColumn("_size", size).toLocalIterator():
        if held and (len(held) >= most or numbers + r["_size"] > BLOCK_NUMBERS):
            yield held
            held, numbers = [], 0
        held.append(r)
        numbers += r["_size"]
    if held:
        yield held


def _best(ids: np.ndarray, others: np.ndarray, scores: np.ndarray, top: int) -> pa.RecordBatch:
    """Of a queries x others matrix the best of each row, ties by the lesser id. Scores of other - id pairs that are the same row, or not above 0, don't count."""
    out = []
    scores = np.where(others[None, :] == ids[:, None], -np.inf, np.round(scores, 9))
    for q in range(len(ids)):
        own = scores[q]
        if len(own) > top:
            at = np.flatnonzero(own >= np.partition(own, -top)[-top])
        else:
            at = np.arange(len(own))
        at = at[np.lexsort((others[at], -own[at]))][:top]
        at = at[own[at] > -np.inf]
        out.append((np.repeat(ids[q], len(at)), others[at], own[at]))
    cols = [np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.float64))], ["id", "other", "score"])


def _searched(rows: DataFrame, blocks: Iterator, search, top: int) -> DataFrame:
    """(id, other, score, rank): each block is broadcast and meets all rows, of which each batch leaves its best; the best of these count."""
    out = None
    for block in blocks:
        sent = rows.sparkSession.sparkContext.broadcast(block)
        found = rows.mapInArrow(search(sent, top), "id long, other long, score double")
        if out is not None:
            found = cut(found)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "id long, other long, score double")
    return _ranked(out, top)


def _ranked(out: DataFrame, top: int, by: str = "score") -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc(by), "other")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _by_product(sent, top: int):
    def run(batches):
        ids, m = sent.value
        for b in batches:
            other = b.column(0).to_numpy(zero_copy_only=False)
            v = np.array(b.column(1).to_pylist(), np.float64).reshape(len(other), -1)
            size = np.sqrt((v * v).sum(axis=1))
            v /= np.where(size > 0, size, 1)[:, None]
            if len(other):
                yield _best(ids, other, m @ v.T, top)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """(id, other, score, rank): for each of the queries (id, vector) the nearest other vectors (id, vector) by cosine, to nine decimals. Blocks of queries are
    multiplied with whole batches of vectors."""

    def blocks():
        for rows in _blocks(queries.filter("vector is not null"), F.size("vector")):
            m = np.array([r.vector for r in rows], np.float64)
            size = np.sqrt((m * m).sum(axis=1))
            yield np.array([r.id for r in rows]), m / np.where(size > 0, size, 1)[:, None]

    return _searched(vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null"), blocks(), _by_product, top)


def _postings(rows: list) -> bytes:
    """Queries (id, terms, w) as relevance.java reads them: ids, then for each term its queries and weights."""
    size = np.array([len(r.terms) for r in rows])
    code = pa.array([t for r in rows for t in r.terms], pa.string()).dictionary_encode()
    own, names = code.indices.to_numpy(), code.dictionary
    order = np.argsort(own, kind="stable")
    at, w = np.repeat(np.arange(len(rows)), size)[order], np.array([u for r in rows for u in r.w], np.float64)[order]
    first = np.searchsorted(own[order], np.arange(len(names) + 1))
    text = [n.encode() for n in names.to_pylist()]
    cuts = np.cumsum([0, *map(len, text)])
    head = np.array([len(rows), len(names), len(at)], "<i4"), np.array([r.id for r in rows], "<i8")
    return b"".join([*(h.tobytes() for h in head), *(x.astype("<i4").tobytes() for x in (first, cuts, at)), w.astype("<f8").tobytes(), *text])


def _found(rows: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """(id, other, score, rank). rows: (id, terms, w), or (id, lower-case text, norm) whose weights are counts by norm; asked: queries (id, terms, w). Blocks of queries are held as
    postings, shared by an executor's tasks; each row is added up against all queries of a block at once, and each task gives its best. No term's rows are ever paired with each other."""
    spark = rows.sparkSession
    rows = rows.coalesce(2 * spark.sparkContext.defaultParallelism)
    out = None
    for block in _blocks(asked, F.size("terms"), POSTED_QUERIES):
        sent = spark.sparkContext._jsc.broadcast(_postings(block))
        found = jvm.over_partitions(rows, jvm.made(spark, SOURCE, "lexforge.relevance.Search", sent, top, " ".join(STOP_WORDS)), FOUND)
        out = cut(found) if out is None else out.unionByName(cut(found))
        sent.destroy()
    return _ranked(spark.createDataFrame([], FOUND) if out is None else out, top, "near").drop("near")


def related(w: DataFrame, top: int = 5, queries: DataFrame | None = None) -> DataFrame:
    """(id, other, score, rank): for each document, or for those that queries (id) name, the most similar others with scores above 0, ranked by nine decimals."""
    each = w.groupBy("id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("w"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = cut(each.select(F.col("id").cast("long").alias("id"), "terms", F.transform("w", lambda x: x / F.col("norm")).alias("w")))
    return _found(unit, unit if queries is None else unit.join(queries.select("id").distinct(), "id", "left_semi"), top)


def related_texts(docs: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """related() of docs (id, text) by TF-IDF. Texts stay where they are read: a document's weights are its counts by its norm, and those of queries are multiplied by the
    square of the inverse frequency; terms of a single document count in norms only."""
    counts = term_counts(docs)
    idfs = cut(idf(counts, docs.count()))
    w = weights(counts, idfs)
    if not once(docs):
        return related(w, top, queries)
    length = cut(norms(w))
    n = length.count()
    near = F.broadcast(length) if n * 16 <= BROADCAST_BYTES else length
    own = cut(queries.select("id").distinct())
    own = F.broadcast(own) if own.count() * 16 <= BROADCAST_BYTES else own
    asked = term_counts(docs.join(own, "id", "left_semi")).join(idfs.filter("df > 1"), "term").join(length, "id")
    asked = asked.groupBy(F.col("id").cast("long").alias("id")).agg(F.collect_list("term").alias("terms"), F.collect_list(F.col("tf") * F.col("idf") * F.col("idf") / F.col("norm")).alias("w"))
    return _found(docs.select("id", F.lower("text").alias("text")).join(near, "id").select(F.col("id").cast("long").alias("id"), "text", "norm"), asked, top)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; 0 if either is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    d = size(a) * size(b)
    return F.when(d > 0, dot / d).otherwise(F.lit(0.0))


def map_cosine(a: Column, b: Column) -> Column:
    """Of two maps from term to weight."""
    dot = F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))
    size = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    d = size(a) * size(b)
    return F.when(d > 0, dot / d).otherwise(F.lit(0.0))
