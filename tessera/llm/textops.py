"""Vectorised tokenisation of Arrow string columns with numpy.

A column's bytes are cut into chunks of whole documents (a quarter of a megabyte each, or one
document if that is longer), so that memory is bounded by the chunk or the longest text, never by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 18
LONG_WORD = 256  # bytes; longer words are hashed one by one
_START = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def byte_set(wanted) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(wanted)] = True
    return out


#: Bytes of a word `[^\x20\x09-\x0D]+`: all but ASCII white space.
NOT_SPACE = byte_set(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in lower-cased text: digits, a-z, non-ASCII.
ALNUM_LOWER = byte_set(b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Lower-cases A-Z and leaves every other byte.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xE9846AF9B1A615D)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xE9846AF9B1A615D)
    x ^= x >> np.uint64(28)
    return x


@dataclass
class Words:
    """Words of a chunk of documents. first[d]:first[d + 1] are the words of document d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null texts have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, row after the last, bytes, offsets from 0)."""
    data, offsets = text_buffer(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE, fold: bool = False) -> Words:
    if fold:
        data = FOLD[data]
    n = len(data)
    inside = kind[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(offsets, start, "right") - 1, np.searchsorted(start, offsets), word_hashes(data, start, end))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length: eight bytes at a time are put in and mixed, so
    that it is not linear in them, as a polynomial would be (which has equal values for some pairs of
    words whatever its base). Words of eight bytes or fewer and of one length never collide; very long
    ones, of which a step for each eight bytes would be slow, are hashed by XXH3."""
    size = end - start
    with np.errstate(over="ignore"):
        code = mix(size.astype(np.uint64) * _START + _START)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        lanes = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place
        at = np.flatnonzero(size <= LONG_WORD)
        step = 0
        while len(at):
            left = size[at] - step
            lane = lanes[start[at] + step]
            short = left < 8
            lane[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            code[at] = mix(code[at] ^ lane)
            step += 8
            at = at[left > 8]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        code[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), int(_START) & 0xFFFFFFFF)
    return code


def grams(code: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive codes; the caller drops those that cross documents."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = code[:n].copy()
        for j in range(1, k):
            out *= _GRAM
            out += code[j : j + n]
        return mix(out)


def within(doc: np.ndarray, k: int) -> np.ndarray:
    """Whether k consecutive words from here are all of one document."""
    return doc[: len(doc) - k + 1] == doc[k - 1 :] if len(doc) >= k else np.zeros(0, bool)


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of each maximal run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Flags of the n words that a window of ``width`` words from one of ``starts`` covers."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + width, n), -1)
    return np.cumsum(delta[:n]) > 0
