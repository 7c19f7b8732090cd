"""Vectorised helpers on the UTF-8 bytes of Arrow text columns.

Used inside ``mapInArrow`` tasks. A batch is cut into chunks of about
``CHUNK_BYTES`` (whole rows, never part of a text), so that the numpy arrays of
a task stay bounded by one chunk or by the longest single text. A null text is
an empty one.

Substring hashes come from prefix sums of ``table[byte] * B**position`` modulo
2**64, shifted back by ``B**-start`` and mixed, so that equal strings have equal
64-bit hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
BASE = 0x9E3779B97F4A7C15 | 1
U64 = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def byte_table(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * U64(BASE) + U64(seed))


class Powers:
    """``B**i`` and ``B**-i`` modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, CHUNK_BYTES + (CHUNK_BYTES >> 2))
            up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)


POWERS = Powers()
TABLES: dict[int, np.ndarray] = {}


class PrefixHash:
    """64-bit hashes of any stretches of ``buf``: of bytes, or of 64-bit numbers that stand for words."""

    def __init__(self, buf: np.ndarray, seed: int = 1) -> None:
        POWERS.upto(len(buf) + 1)
        if seed not in TABLES:
            TABLES[seed] = byte_table(seed)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        terms = TABLES[seed][buf] if buf.dtype == np.uint8 else mix(buf + U64(seed))
        terms *= POWERS.up[:len(buf)]
        np.cumsum(terms, out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * POWERS.down[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Chunk:
    """Rows ``first`` to ``first + n`` of a batch: their bytes (or word numbers) and the place of each text in them."""

    first: int
    buf: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """Sum of a mask over the bytes of each row."""
        total = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def row_of(self, starts: np.ndarray) -> np.ndarray:
        """Row number in the chunk of each sorted start of a non-empty span."""
        counts = np.diff(np.searchsorted(starts, self.offsets))
        return np.repeat(np.arange(self.n), counts)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole rows of a string column in chunks of about ``limit`` bytes."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield Chunk(at, raw[bounds[at]:bounds[to]], (bounds[at:to + 1] - bounds[at]).astype(np.int64))
        at = to


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that cross no row bound."""
    n = len(inside)
    start, end = inside.copy(), inside.copy()
    if n:
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cut = offsets[(offsets > 0) & (offsets < n)]
        start[cut] = inside[cut]
        end[cut - 1] = inside[cut - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``."""
    return runs(~SPACE[chunk.buf], chunk.offsets)


def word_chunk(chunk: Chunk) -> Chunk:
    """The chunk with a 64-bit hash for each word in place of the bytes."""
    starts, ends = words(chunk)
    return Chunk(chunk.first, PrefixHash(chunk.buf).of(starts, ends), np.searchsorted(starts, chunk.offsets))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more, equal to an earlier one) for each key."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    s = keys[order]
    same[1:-1] = s[1:] == s[:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def row_keys(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a row."""
    return mix(hashes ^ mix(rows.astype(np.uint64) + U64(0x51ED270B)))
