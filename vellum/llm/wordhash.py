"""Vectorised word and shingle hashing over Arrow string buffers.

Words are maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``; A-Z is
lower-cased.  Every word gets a 64-bit hash (a polynomial over a random byte
table, finalised), every window of ``k`` words a 64-bit hash of its words.
Equality of words and shingles is equality of these hashes.

All functions work on one bounded chunk of text (``CHUNK_BYTES``), so memory
doesn't grow with the batch; a longer document makes a chunk of its own, which
takes some 40 bytes a word beside its text.

Arrow's memory comes from the system's allocator, which gives it back: worker
processes live on from stage to stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

pa.set_memory_pool(pa.system_memory_pool())

CHUNK_BYTES = 1 << 20
SHINGLE = 5

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GENERATOR = 0x9E3779B97F4A7C15 | 1


def _byte_table() -> np.ndarray:
    table = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=_U)
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


_BYTES = _byte_table()
_STEP = np.random.default_rng(7).integers(1, 2**64, 128, dtype=_U) | _U(1)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the generator and of its inverse for the bytes of a chunk: 16 MB."""
    inverse = pow(_GENERATOR, -1, 2**64)
    out = []
    for g in (_GENERATOR, inverse):
        p = np.full(CHUNK_BYTES, _U(g), dtype=_U)
        p[0] = _U(1)
        np.multiply.accumulate(p, out=p)
        out.append(p)
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


@dataclass
class Chunk:
    """Some consecutive rows: raw bytes, and for each row where its bytes and words start."""

    first: int
    rows: int
    data: np.ndarray
    at: np.ndarray  # rows + 1 byte offsets
    starts: np.ndarray  # of words
    ends: np.ndarray
    word_at: np.ndarray  # rows + 1 word offsets
    words: np.ndarray  # hashes


def _segment(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = ~_SPACE[data]
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner] = solid[inner]
    closes[inner - 1] = solid[inner - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _polynomial(data: np.ndarray) -> int:
    """The polynomial of one word of any length, a part at a time."""
    power, total, shift = _powers()[0], 0, 1
    for at in range(0, len(data), CHUNK_BYTES):
        part = data[at : at + CHUNK_BYTES]
        total += int((_BYTES[part] * power[: len(part)]).sum(dtype=_U)) * shift
        shift = shift * pow(_GENERATOR, len(part), 2**64) % 2**64
    return total % 2**64


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words at these places, which are in order; some CHUNK_BYTES at a time."""
    out = np.empty(len(starts), _U)
    power, inverse = _powers()
    i = 0
    while i < len(starts):
        base = starts[i]
        last = int(np.searchsorted(ends, base + CHUNK_BYTES, side="right"))
        if last <= i:  # one word fills a chunk
            out[i] = _polynomial(data[base : ends[i]])
            i += 1
            continue
        part = data[base : ends[last - 1]]
        total = np.zeros(len(part) + 1, dtype=_U)
        np.cumsum(_BYTES[part] * power[: len(part)], out=total[1:])
        out[i:last] = (total[ends[i:last] - base] - total[starts[i:last] - base]) * inverse[starts[i:last] - base]
        i = last
    return mix(out)


def chunk_of(first: int, data: np.ndarray, at: np.ndarray) -> Chunk:
    starts, ends = _segment(data, at)
    return Chunk(first, len(at) - 1, data, at, starts, ends, np.searchsorted(starts, at), hash_words(data, starts, ends))


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return at - at[0], raw


def chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[Chunk]:
    """The rows of a text column in chunks of at most CHUNK_BYTES, or one longer row."""
    at, raw = string_buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK_BYTES, side="right")) - 1)
        yield chunk_of(row, raw[at[row] : at[last]], at[row : last + 1] - at[row])
        row = last


def shingles(c: Chunk, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of k words inside a segment; segments of fewer words have one, of all their words.

    Returns hashes, the word each starts at, and per segment the offset of its first hash (rows + 1).
    """
    count = np.diff(c.word_at)
    n = len(c.words)
    if n >= k:
        h = np.zeros(n - k + 1, dtype=_U)
        for i in range(k):
            h += c.words[i : n - k + 1 + i] * _STEP[i]
        seg = np.repeat(np.arange(c.rows), count)
        keep = seg[: n - k + 1] == seg[k - 1 :]
        at_word, h = np.flatnonzero(keep), mix(h[keep])
    else:
        at_word, h = np.empty(0, np.int64), np.empty(0, _U)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), dtype=_U)
        for i in range(k - 1):
            has = count[short] > i
            extra[has] += c.words[c.word_at[short[has]] + i] * _STEP[i + k]
        extra = mix(extra + count[short].astype(_U) * _STEP[3 * k])
        at_word, h = np.concatenate([at_word, c.word_at[short]]), np.concatenate([h, extra])
        order = np.argsort(at_word, kind="stable")
        at_word, h = at_word[order], h[order]
    return h, at_word, np.searchsorted(at_word, c.word_at)
