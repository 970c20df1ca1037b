"""Words of UTF-8 text and hashes over them, in whole Arrow batches with numpy.

A word is a longest run of bytes other than blank, tab, newline, carriage return and form feed; documents never run into each
other. All hashes are 64-bit and wrap around.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLANK_BYTES = b" \t\n\r\f\v"
#: Bytes of text taken at once, unless one document is longer.
CHUNK_BYTES = 1 << 19


def _blank_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(BLANK_BYTES)] = True
    return t


BLANK = _blank_table()
#: ASCII signs, which normalised text leaves out.
SIGN = np.array([c < 128 and not chr(c).isalnum() and not b for c, b in enumerate(BLANK)])
BYTE_VALUE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
P, Q = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def inverse(p: int) -> int:
    return pow(int(p), -1, 2**64)


def powers(p: int, n: int) -> np.ndarray:
    """p to the 0, 1, ... n - 1. The longest such array of this process is kept."""
    box = sys.modules.setdefault("_lexforge_powers", types.ModuleType("_lexforge_powers")).__dict__
    have = box.get(int(p))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), p, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=np.uint64)
        if n <= 8 << 20:
            box[int(p)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have no bytes. Offsets start at 0."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return data[first : int(offsets[-1])], offsets - first


def release() -> None:
    """Gives memory that this process holds and doesn't use back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # a C library without it


def chunks(batches, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about size bytes of text each: (slice, bytes, offsets)."""
    for b in batches:
        if not b.num_rows:
            continue
        data, offs = text_buffers(b.column(b.schema.get_field_index(text)))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
            yield b.slice(at, end - at), data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
            at = end
    release()


def normalised(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without ASCII signs."""
    keep = ~SIGN[data]
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return data[keep], at[offs]


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of the words, and the index of each document's first word with the total at the end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    blank = BLANK[data]
    before = np.empty(n + 1, bool)
    before[0] = True
    before[1:] = blank
    before[offs] = True
    after = np.empty(n, bool)
    after[:-1] = blank[1:]
    after[-1] = True
    inner = offs[(offs > 0) & (offs <= n)] - 1
    after[inner] = True
    word = ~blank
    start = np.flatnonzero(word & before[:n])
    end = np.flatnonzero(word & after) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A mixed hash of each word's bytes."""
    with np.errstate(over="ignore"):
        c = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * powers(P, len(data)), out=c[1:])
        back = powers(inverse(P), len(data))
        return mix((c[end] - c[start]) * back[start] + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of all runs of k words in the sequence, whatever the documents: one for each of the first len - k + 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        c = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(Q, len(words)), out=c[1:])
        return mix((c[k:] - c[:-k]) * powers(inverse(Q), n))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of starts[i], starts[i] + 1, ... of counts[i] numbers each."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
