"""Vectorised scanning of UTF-8 texts: words, lines and their 64-bit hashes.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  All of these are ASCII, so scanning bytes
and scanning code points give the same words.  Texts of a chunk are joined by line feeds, and one running
polynomial sum over the chunk gives the hash of any span by a subtraction and a multiplication.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 20
_M, _SEED = 0x9E3779B97F4A7C15, 0x8CB92BA72F3D8DD7


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: By the number of bytes that count, which bits of a block do.
_INSIDE = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
#: For running sums over spans far shorter than 1,024 bytes.
_BYTE = mix(np.arange(1, 257, dtype=U) * U(_M))
_pow = np.empty(0, U)
_inv = np.empty(0, U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        _pow, _inv = np.full(size, U(_M)), np.full(size, U(pow(_M, -1, 1 << 64)))
        _pow[0] = _inv[0] = 1
        np.cumprod(_pow, out=_pow)
        np.cumprod(_inv, out=_inv)
    return _pow, _inv


def values(*columns: pa.Array, rows: int = 256) -> Iterator[tuple]:
    """Rows of Python values, converted a few at a time, so that texts of a batch are never all held twice."""
    for at in range(0, len(columns[0]), rows):
        yield from zip(*(c.slice(at, rows).to_pylist() for c in columns), strict=True)


def texts_of(column: pa.Array) -> Iterator[bytes]:
    return (t for (t,) in values(column))


def settle() -> None:
    """Give freed memory back, as idle Python workers keep theirs beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(texts: Iterable[bytes], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Runs of whole texts of about ``limit`` bytes; a longer text makes a run of its own."""
    out: list[bytes] = []
    held = 0
    for t in texts:
        if out and held + len(t) > limit:
            yield out
            out, held = [], 0
        out.append(t)
        held += len(t) + 1
    if out:
        yield out


class Scan:
    """Words of a run of texts.  ``first[d]:first[d + 1]`` are the words of text d."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.buf = buf = LOWER[buf] if lower else buf
        self.n = len(texts)
        lens = np.fromiter(map(len, texts), np.int64, self.n)
        self.doc_start = np.zeros(self.n, np.int64)
        np.cumsum(lens[:-1] + 1, out=self.doc_start[1:])
        self.doc_end = self.doc_start + lens
        self.space = space = SPACE[buf]
        self.starts = np.flatnonzero(np.concatenate(([not space[0]], space[:-1] & ~space[1:])))
        self.ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        self.first = np.append(np.searchsorted(self.starts, self.doc_start), len(self.starts))
        self.n_words = np.diff(self.first)
        self.doc_of_word = np.repeat(np.arange(self.n), self.n_words)
        padded = np.concatenate((buf, np.zeros(8, np.uint8)))
        self._blocks = np.ndarray((len(buf),), "<u8", padded, 0, (1,))  # the eight bytes from each byte on

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        h = self._block(starts, size, np.zeros(1, np.int64))
        long = np.flatnonzero(size > 8)
        if len(long):
            n = (size[long] - 1) // 8  # blocks after the first
            first = np.cumsum(n) - n
            k = np.arange(n.sum()) - np.repeat(first, n) + 1
            h[long] += np.add.reduceat(self._block(np.repeat(starts[long], n) + 8 * k, np.repeat(size[long], n) - 8 * k, k), first)
        return mix(h ^ size.astype(U) * U(0xD6E8FEB86659FD93))

    def _block(self, at: np.ndarray, left: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Mixed: of the bytes at ``at`` eight at most, ``left`` of them inside, the span's ``k``-th block."""
        return mix((self._blocks[at] & _INSIDE[np.minimum(left, 8)]) ^ mix(k.astype(U) * U(_M) + U(_SEED)))

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def per_doc(self, of_byte: np.ndarray) -> np.ndarray:
        """Sums of a value of each byte by text; separators count, so they must be zero."""
        return np.add.reduceat(of_byte.astype(np.int64), self.doc_start)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive word hashes; windows across texts are the caller's to drop."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U)
    h = np.full(n, U(k))
    for i in range(k):
        h = (h ^ words[i : i + n]) * U(0xFF51AFD7ED558CCD)
        h ^= h >> U(32)
    return mix(h)
