"""Arrow text columns as numpy arrays: word spans, word hashes and rolling window hashes.

Everything here works on one Arrow batch, in pieces of a quarter of a megabyte, so that the temporary
arrays stay small whatever the batch or the text. A null text is an empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 18
U = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of the texts in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes; a longer text is a piece by itself."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def give_back() -> None:
    """Memory that a task no longer needs goes back to the system: Python workers stay for the next tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true for the bytes in the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: White space that ends a word: space and the bytes 9 to 13.
SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words made of digits, letters and everything beyond ASCII.
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    flags = in_word[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, flags[:-1]
    starts = np.flatnonzero(flags & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, flags[1:]
    ends = np.flatnonzero(flags & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def _powers_to(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    one = np.ones(1, np.uint64)
    return np.cumprod(np.concatenate([one, np.full(n, base, np.uint64)])), np.cumprod(np.concatenate([one, np.full(n, inverse, np.uint64)]))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n at least."""
    return _powers_to(base, max(PIECE_BYTES, 1 << int(n).bit_length()))


#: One odd 64-bit value for each byte, so that a word's hash is no plain polynomial of its bytes.
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(_BYTE_BASE)) | U(1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from one prefix sum over the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(_BYTE_BASE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of the `width` words from each word on; the last width - 1 words have none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(_WORD_BASE, len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[:n])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0] + 1, ... of all the ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out_at = np.cumsum(lengths) - lengths
    return np.repeat(starts - out_at, lengths) + np.arange(total)


def fresh(name: str, taken: list[str]) -> str:
    """`name`, with underscores after it as long as it is taken."""
    while name in taken:
        name += "_"
    return name
