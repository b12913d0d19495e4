"""Words and word hashes of whole batches of texts, on their UTF-8 bytes.

Everything works on one byte array that holds the texts of a batch end to end, so
that finding words and hashing windows of words are a few numpy passes however many
texts there are. No word ever reaches over the end of its text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U = np.uint64
MOST_ROWS = 1 << 16  # in one slice, so that a row number fits into 16 bits

# Word characters of the plain rule: all but blank, tab, line feed, vertical tab,
# form feed and carriage return.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
# Word characters of the normalised rule: ASCII letters and digits, and every byte
# of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Words of ``n`` texts: byte offsets, the text of each, and where each text's words begin."""

    data: np.ndarray    # uint8, eight zero bytes behind the last text
    start: np.ndarray   # int64
    end: np.ndarray     # int64, exclusive
    first: np.ndarray   # int64, n + 1 entries: index of each text's first word

    @property
    def n(self) -> int:
        return len(self.first) - 1

    def text_of(self) -> np.ndarray:
        """Index of the text each word belongs to."""
        return np.repeat(np.arange(self.n), np.diff(self.first))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column end to end (padded), and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, at = len(column), column.offset
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(8, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[at:at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.concatenate([raw, np.zeros(8, np.uint8)]), off - off[0]


def find_words(data: np.ndarray, off: np.ndarray, chars: np.ndarray = PLAIN) -> Words:
    """Maximal runs of ``chars`` within each text."""
    size = int(off[-1])
    inside = chars[data[:size]]
    if size:
        before = np.concatenate([[False], inside[:-1]])
        edge = np.zeros(size + 1, bool)
        edge[off] = True
        begin = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate([inside[1:], [False]])
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    else:
        begin = end = np.zeros(0, np.int64)
    return Words(data, begin, end, np.searchsorted(begin, off))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions ``start[i] .. start[i] + length[i] - 1``, one range after the other."""
    skipped = np.cumsum(length) - length
    return np.repeat(start - skipped, length) + np.arange(int(length.sum()))


def joined(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words with one blank behind each, and where each begins; the last entry is where all end."""
    length = words.end - words.start
    begin = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(int(begin[-1]), 0x20, np.uint8)
    out[ranges(begin[:-1], length)] = words.data[ranges(words.start, length)]
    return out, begin


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time."""
    if not len(words.start):
        return np.zeros(0, U)
    eight = np.ndarray(len(words.data) - 7, U, words.data, 0, (1,))
    length = words.end - words.start
    out = np.full(len(length), 0x9E3779B97F4A7C15, U) * (length.astype(U) + U(1))
    todo = np.arange(len(length))
    for at in range(0, int(length.max()), 8):
        if at:
            todo = todo[length[todo] > at]
        left = np.minimum(length[todo] - at, 8).astype(U)
        part = eight[words.start[todo] + at] & (~U(0) >> (U(64) - left * U(8)))
        out[todo] = mix(out[todo] * U(0xD6E8FEB86659FD93) ^ part)
    return out


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of every window of ``size`` words, and the text it lies in."""
    counts = np.maximum(np.diff(words.first) - size + 1, 0)
    text = np.repeat(np.arange(words.n), counts)
    skipped = np.cumsum(counts) - counts
    return words.first[:-1][text] + np.arange(len(text)) - skipped[text], text


def window_hashes(hashes: np.ndarray, at: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``size`` words from each index in ``at``."""
    if not len(at):
        return np.zeros(0, U)
    total = np.full(len(hashes) - size + 1, 0x632BE59BD9B4E019 + seed, U)
    for k in range(size):
        total *= U(0x2545F4914F6CDD1D)
        total += hashes[k:len(hashes) - size + 1 + k]
        total ^= total >> U(29)
    return mix(total[at])


def shingles(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles with the text of each; a text of fewer words has one shingle of all its words."""
    at, text = windows(words, size)
    out = window_hashes(hashes, at, size)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return out, text
    extra = np.array([int(mix(np.bitwise_xor.reduce(mix(hashes[words.first[i]:words.first[i + 1]]
                     + np.arange(1, counts[i] + 1, dtype=U))).reshape(1) + U(counts[i]))[0]) for i in short], U)
    return np.concatenate([out, extra]), np.concatenate([text, short])


def counted(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes of each text (48 bits of them), ordered, and how often each occurs."""
    key = np.sort((text.astype(U) << U(48)) | (hashes >> U(16)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return (key[at] >> U(48)).astype(np.int64), key[at] & U((1 << 48) - 1), np.diff(at, append=len(key))


def bounded(df: DataFrame, rows: int = 512) -> DataFrame:
    """``df``, in a session that hands Python at most ``rows`` rows at a time.

    Spark's own limit of 10,000 is a limit for rows of numbers; that many texts would not
    fit next to a task's other memory.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= rows:
        df.sparkSession.conf.set(key, rows)
    return df


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, dealt anew so that ``column`` has about ``most`` bytes in each; one row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        off = buffers(batch.column(batch.schema.get_field_index(column)))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, min(int(np.searchsorted(off, off[at] + most - size, "right")) - 1, at + MOST_ROWS))
            held.append(batch.slice(at, to - at))
            size += int(off[to] - off[at])
            at = to
            if size >= most * 3 // 4 or sum(b.num_rows for b in held) > MOST_ROWS - 512:
                yield from _joined(held)
                held, size = [], 0
    yield from _joined(held)
    if not isinstance(batches, list):
        held = []
        give_back()  # the worker stays for later tasks; what its allocators keep would add to theirs


def give_back() -> None:
    """Return memory that is free, but kept, to the system; once a task or a large group."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def _joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if held:
        whole = pa.concat_batches(held) if len(held) > 1 else held[0]
        for at in range(0, whole.num_rows, MOST_ROWS):
            yield whole.slice(at, MOST_ROWS)


def binaries(data: np.ndarray, first: np.ndarray) -> pa.Array:
    """One binary value per range ``first[i]:first[i + 1]`` of an array."""
    width = data.dtype.itemsize
    offs = pa.py_buffer((first * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, offs, pa.py_buffer(np.ascontiguousarray(data))])
