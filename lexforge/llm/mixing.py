"""LM scoring by online logistic context mixing: bits per byte of every document.

A text is read in pieces, a word with the signs after it. Before each piece, flags say whether it is one that followed the two pieces before
anywhere (in another text, or earlier in this one), else whether it is one that followed the piece before, else whether it occurred at all. A known
piece then costs what its share of the occurrences after its context leaves; an unknown one is spelled bit by bit. Every flag and every bit has a chance that is
mixed from several hashed contexts' predictors: for flags how often the context was seen, what became of the last flags, and both; for bits the corpus' bytes
after one and two bytes, and the text's own bits after 2, 3, 4 and 6 bytes and within the word, which learn bit by bit. Mixing is logistic: a gate (of flags the order
and how often the context was seen; of bits the number of the text's contexts that are known, and the place in the byte) chooses one of the sets of weights, which moves
against the error, and a final stage of adaptive curves refines the mixed chance. All of that starts anew with each text and goes on to its last bit.

Gathered from the corpus, all of it, by key: (1) how often each run of 1, 2 and 3 pieces occurs. Each chunk of texts sends its distinct keys with their numbers, sorted, as
differences, cut into ranges; where the ranges meet, numbers are added, and each chunk gets back the totals of its own keys. So the tables grow with the corpus and no task and no driver
ever holds one whole; hot keys come once a chunk. Keys have 2^11 times as many values as the corpus has bytes. A text's own occurrences are taken out before it is scored, so a
text that occurs twice is told from one that occurs once. (2) How often each byte follows two bytes: 2^24 numbers at most, by the alphabet, which are broadcast.

Chunks are kept as a table in the shared folder, bucketed by chunk, so that texts aren't shuffled and lost executors' parts are read again. A text's own table of bit predictors
has 64 cells a byte, 2^24 at most: in texts beyond 256 KB, cells are taken over by newer contexts (cells hold a check of theirs).

Defined results: null and empty texts have 0 bytes, 0 bits and null bits a byte; a repeated row is scored alike each time, as a text that occurs elsewhere; a null doc_id is
scored; ties don't arise; other columns, of any name, are ignored; an empty table gives an empty result. Texts are scored whole. Results don't depend on how rows are
partitioned.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jvm
from . import words as W
from .common import cut, delete, shared_dir

#: Bytes of text read at once (unless one text is longer), of text a range of keys, and of a bucket.
CHUNK, RANGE, BUCKET = 8 << 20, 8 << 20, 16 << 20
CHUNKS = "chunk long, ids array<long>, sizes array<long>, offsets binary, data binary"


def _chunks(batches):
    task, nth = TaskContext.get().partitionId(), 0
    held, size = [], 0

    def row():
        data = b"".join(d.tobytes() for _, d, _ in held)
        sizes = np.concatenate([np.diff(o) for _, _, o in held])
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<i4").tobytes()
        ids = pa.concat_arrays([i for i, _, _ in held])
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([pa.array([task << 32 | nth], pa.int64()), whole(ids), whole(pa.array(sizes)), pa.array([offsets], pa.binary()), pa.array([data], pa.binary())], ["chunk", "ids", "sizes", "offsets", "data"])

    for b, data, offs in W.chunks(batches, size=CHUNK):
        if held and size + len(data) > CHUNK:
            yield row()
            held, size, nth = [], 0, nth + 1
        held.append((b.column(0), data.copy(), offs))
        size += len(data)
    if held:
        yield row()


class Chunks:
    """The texts, bucketed by chunk, in the shared folder."""

    def __init__(self, docs: DataFrame):
        spark = self.spark = docs.sparkSession
        self.name, self.path = f"chunks_{uuid.uuid4().hex}", f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
        src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        made = src.mapInArrow(_chunks, CHUNKS)
        buckets = self.buckets = max(8, made.rdd.getNumPartitions())
        made.write.option("path", self.path).option("compression", "zstd").format("parquet").bucketBy(buckets, "chunk").saveAsTable(self.name)
        self.table = spark.table(self.name)
        self.bytes = self.table.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def _function(spark: SparkSession, name: str, returns: str, *args: object):
    return jvm.function(spark, "mixing.java", f"lexforge.mixing.{name}", returns, *args)


def key_bits(n_bytes: int) -> int:
    """Bits of a key: 2^11 values a byte of the corpus, 2^62 at most."""
    return min(62, max(24, int(n_bytes).bit_length() + 11))


def triples(chunks: DataFrame) -> bytes:
    """(two bytes before, byte) as an int, and its number as a double, in ascending order."""
    f = _function(chunks.sparkSession, "Triples", "array<bigint>")
    one = chunks.select(F.explode(f(F.col("data"), F.col("offsets"))).alias("x"))
    total = one.groupBy(F.shiftrightunsigned("x", 40).cast("int").alias("key")).agg(F.sum(F.col("x").bitwiseAND(F.lit((1 << 40) - 1))).cast("double").alias("n"))
    return b"".join(struct.pack("<id", r[0], r[1]) for r in sorted(total.collect()))


def totals(chunks: DataFrame, bits: int, parts: int, buckets: int) -> DataFrame:
    """(chunk, blobs): how often each key of a chunk occurs in the corpus, by ascending range; ranges of which the chunk has no key are never sent. Partitioned as the bucketed chunks are."""
    spark = chunks.sparkSession
    keys, summed = _function(spark, "Keys", "array<binary>", bits, parts), _function(spark, "Totals", "array<binary>")
    sent = chunks.select("chunk", F.posexplode(keys(F.col("data"), F.col("offsets"))).alias("part", "blob")).filter("blob is not null")
    met = sent.groupBy("part").agg(F.collect_list(F.struct("chunk", "blob")).alias("g"))
    back = met.select("part", F.explode(F.arrays_zip(F.col("g.chunk").alias("chunk"), summed(F.col("g.blob")).alias("blob"))).alias("x"))
    return back.select("part", "x.*").repartition(buckets, "chunk").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "blob"))).alias("g")).select("chunk", F.col("g.blob").alias("blobs"))


def bits_per_byte(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) of each text, under what the other texts and its own beginning tell."""
    spark = docs.sparkSession
    held = Chunks(docs)
    try:
        bits, parts = key_bits(held.bytes), max(0, (held.bytes // RANGE).bit_length())
        model = spark.sparkContext._jsc.broadcast(triples(held.table))
        score = _function(spark, "Score", "array<double>", bits, model)
        both = held.table.join(totals(held.table, bits, parts, held.buckets).hint("shuffle_hash"), "chunk")
        each = both.select(F.explode(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("sizes").alias("n_bytes"), score(*(F.col(c) for c in ("data", "offsets", "blobs"))).alias("bits"))).alias("x")).select("x.*")
        out = cut(each)
    finally:
        held.drop()
    per = F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes"))
    return out.select("doc_id", "n_bytes", F.round("bits", 2).alias("bits"), F.round(per, 4).alias("bits_per_byte"))
