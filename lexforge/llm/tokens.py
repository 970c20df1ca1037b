"""Token-ID / binary output: concatenated ids with Elias-Fano document boundaries.

Byte-level BPE of a public vocabulary, given by its path; the file is read on the driver and broadcast. Texts are cut into pieces
(contractions, letters, numbers, signs, white space; each with a blank before it) by whole-array numpy operations over code
points; each distinct piece of a task is merged once, and ids are gathered from a table of pieces. Every document ends with
the id END. The outcome is a row for each block of about BLOCK_IDS ids: the documents' ids in order, the token ids as one
little-endian array of 16 or 32 bits, and the documents' ends as an Elias-Fano sequence: low bits packed, high bits in
unary, and every SAMPLE-th one's place, from which select(i) gives document i's end in constant expected time in about
2 + log2(ids / documents) bits a document. Nothing is shuffled.

Defined results: null and empty texts are documents with only END; repeated rows are repeated; a null doc_id stays null in the
list; a document longer than a block gets a block of its own; other columns are ignored; an empty table gives no blocks.
"""

from __future__ import annotations

import base64
import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
BLOCK_IDS, SAMPLE = 1 << 20, 64
SCHEMA = "doc_ids array<long>, n_docs int, n_ids long, width int, ids binary, low_width int, low binary, high binary, samples binary"
LETTER, NUMBER, SPACE, SIGN = 1, 2, 3, 0


def _kept(name: str, make):
    """A value that this process makes once."""
    box = sys.modules.setdefault("_lexforge_kept", types.ModuleType("_lexforge_kept"))
    if not hasattr(box, name):
        setattr(box, name, make())
    return getattr(box, name)


def _classes() -> np.ndarray:
    t = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            t[c] = LETTER
        elif k == "N":
            t[c] = NUMBER
    t[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return t


def piece_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin, in code points of concatenated documents; first: where documents begin, and the total."""
    n = len(cp)
    cls = _kept("classes", _classes)[cp]
    new_doc = np.zeros(n + 1, bool)
    new_doc[first] = True
    st = np.ones(n, bool)
    st[1:] = (cls[1:] != cls[:-1]) | new_doc[1:n]
    run = st.copy()
    e = np.flatnonzero(run[1:] & (cls[1:] != SPACE) & (cls[:-1] == SPACE) & ~new_doc[1:n]) + 1
    st[e - 1] = True  # the last white space before a word is apart from the rest
    st[e] = cp[e - 1] != 32  # and belongs to the word if it is a blank
    q = np.flatnonzero((cp[:-1] == 39) & st[:-1] & run[1:] & (cls[1:] == LETTER) & ~new_doc[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(q):
        c1 = cp[q + 1]
        two = np.minimum(q + 2, n - 1)
        c2 = np.where((q + 2 < n) & ~new_doc[two] & (cls[two] == LETTER), cp[two], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        both = ((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108))
        for hit, k in ((one, 2), (both, 3)):
            x = q[hit]
            st[x + 1] = False
            st[x[x + k < n] + k] = True
    return np.flatnonzero(st)


def load_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class Encoder:
    """Ids of whole batches. Pieces seen before are looked up."""

    def __init__(self, raw: bytes):
        import tiktoken

        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(raw), special_tokens={})._core_bpe
        self.known: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.len = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, h: int, piece: bytes) -> int:
        ids = self.bpe.encode_single_piece(piece)
        k = len(self.known)
        if k == len(self.at):
            self.at, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.len))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[k], self.len[k] = self.used, len(ids)
        self.used += len(ids)
        self.known[h] = k
        return k

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents without END, how many of each)."""
        n_docs = len(offs) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_docs, np.int64)
        if len(self.known) > 2_000_000:
            self.known.clear()
            self.used = 0
        raw = data.tobytes()
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(lead, offs)
        cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        start = lead[piece_starts(cp, first)]
        end = np.append(start[1:], len(data))
        h = W.word_hashes(data, start, end)
        u, at, back = np.unique(h, return_index=True, return_inverse=True)
        known, ids = self.known, np.empty(len(u), np.int64)
        for i, (x, s, e) in enumerate(zip(u.tolist(), start[at].tolist(), end[at].tolist())):
            k = known.get(x)
            ids[i] = self._add(x, raw[s:e]) if k is None else k
        piece = ids[back]
        size = self.len[piece]
        upto = np.concatenate([[0], np.cumsum(size)])
        per = np.diff(upto[np.searchsorted(start, offs)])
        return self.flat[W.ranges(self.at[piece], size)], per


def elias_fano(values: np.ndarray, universe: int) -> tuple[int, bytes, bytes, bytes]:
    """(width of low bits, low bits, high bits, samples) for nondecreasing values up to universe."""
    n = len(values)
    low = max(0, int(universe // max(n, 1)).bit_length() - 1)
    v = values.astype(np.uint64)
    bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1)
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros((universe >> low) + n + 1, np.uint8)
    high[ones] = 1
    return low, np.packbits(bits, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes()


class Ends:
    """select() over an Elias-Fano sequence."""

    def __init__(self, n: int, low_width: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.width = n, low_width
        self.low = low
        self.high, self.samples = high, np.frombuffer(samples, "<u4")

    def select(self, i: int) -> int:
        """Value i."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, word = at >> 3, self.high[at >> 3] >> (at & 7) << (at & 7)
        while (k := word.bit_count()) <= left:
            left -= k
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        first = i * self.width
        low = int.from_bytes(self.low[first >> 3 : (first + self.width + 7) >> 3], "little") >> (first & 7)
        return (one - i) << self.width | low & ((1 << self.width) - 1)

    def all(self) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")
        ones = np.flatnonzero(bits)[: self.n] - np.arange(self.n)
        out = ones << self.width
        if self.width:
            b = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.width]
            out |= (b.reshape(self.n, self.width).astype(np.int64) << np.arange(self.width)).sum(axis=1)
        return out


def decode_block(row) -> list[tuple[int | None, np.ndarray]]:
    """(doc_id, ids with END) of each document of a block."""
    ids = np.frombuffer(row["ids"], "<u2" if row["width"] == 16 else "<u4")
    ends = Ends(row["n_docs"], row["low_width"], row["low"], row["high"], row["samples"]).all()
    return [(d, ids[a:b]) for d, a, b in zip(row["doc_ids"], np.concatenate([[0], ends[:-1]]).astype(int), ends)]


def _blocks(vocabulary, width: int, end: int):
    def block(docs, ids, counts):
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        ends = np.cumsum(counts)
        low_width, low, high, samples = elias_fano(ends, int(ends[-1]))
        body = ids.astype("<u2" if width == 16 else "<u4").tobytes()
        d = pa.concat_arrays(docs)
        lists = pa.ListArray.from_arrays(pa.array([0, len(d)], pa.int32()), d)
        cols = [lists, pa.array([len(d)], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([width], pa.int32()), pa.array([body], pa.binary())]
        cols += [pa.array([low_width], pa.int32()), *(pa.array([x], pa.binary()) for x in (low, high, samples))]
        return pa.RecordBatch.from_arrays(cols, ["doc_ids", "n_docs", "n_ids", "width", "ids", "low_width", "low", "high", "samples"])

    def run(batches):
        enc = Encoder(vocabulary.value)
        docs, ids, counts, held = [], [], [], 0
        for b, data, offs in W.chunks(batches, size=1 << 20):
            own, per = enc.encode(data, offs)
            full = np.insert(own, np.cumsum(per), end)
            docs.append(b.column(b.schema.get_field_index("doc_id")))
            ids.append(full)
            counts.append(per + 1)
            held += len(full)
            if held >= BLOCK_IDS:
                yield block(docs, ids, counts)
                docs, ids, counts, held = [], [], [], 0
        if docs:
            yield block(docs, ids, counts)

    return run


def token_blocks(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """One row a block, as described above."""
    with open(vocabulary, "rb") as f:
        raw = f.read()
    most = max(end, *load_ranks(raw).values())
    sc = docs.sparkSession.sparkContext
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(_blocks(sc.broadcast(raw), 16 if most < 1 << 16 else 32, end), SCHEMA)


def read_tokens(blocks: DataFrame) -> DataFrame:
    """(doc_id, ids): a row for each document of the blocks, END included."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                got = decode_block(row)
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([x.astype(np.int32) for _, x in got], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return blocks.mapInArrow(run, "doc_id long, ids array<int>")


def spans(blocks: DataFrame) -> DataFrame:
    """(doc_id, first, n_ids): where each document's ids lie in its block, by select; the ids aren't read."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ends = Ends(row["n_docs"], row["low_width"], row["low"], row["high"], row["samples"])
                cuts = np.array([0, *(ends.select(i) for i in range(row["n_docs"]))], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(cuts[:-1]), pa.array(np.diff(cuts))], ["doc_id", "first", "n_ids"])

    return blocks.drop("ids").mapInArrow(run, "doc_id long, first long, n_ids long")


def plain_pieces(text: str) -> list[str]:
    """The pattern's pieces of one text, for comparison."""
    import regex

    return regex.findall(PATTERN, text)
