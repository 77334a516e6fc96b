"""Byte-level BPE encoding and decoding.

A text is split by the tokenizer's pattern, with the tokenizer library's own classes of characters.  A pre-token that is in the vocabulary is resolved whole by a
minimal perfect hash; any other is merged by a heap of pair ranks over a linked list of its bytes, in
O(n log n) for n bytes.  Results are kept per pre-token in a bounded cache of the worker.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restitch.llm.textscan import values

_M64 = (1 << 64) - 1
#: Pre-tokens whose ids a worker keeps; beyond, the older half goes and is worked out again when met.
CACHE = 300_000


class PerfectHash:
    """A minimal perfect hash of byte strings to their values, by hash and displace.

    Keys fall into buckets of about two.  Buckets with two or more keys, the largest first, get the first
    displacement that sends all their keys to free slots; a bucket of one key names its slot.  There are as many
    slots as keys, and a lookup compares the key in its slot.  What was found for each bucket can be handed on
    (``found``), so that others only put keys in their slots.
    """

    def __init__(self, values: dict[bytes, int], found: bytes | None = None):
        self.n = n = len(values)
        self.buckets = b = max(1, n // 2)
        if found is not None:
            self.shift, self.keys, self.values = array("q", found).tolist(), [None] * n, [0] * n
            for key, v in values.items():
                h = xxhash.xxh3_64_intdigest(key)
                s = self._slot(h, self.shift[h % b])
                self.keys[s], self.values[s] = key, v
            return
        held: list[list[tuple[int, bytes]]] = [[] for _ in range(b)]
        for key in values:
            h = xxhash.xxh3_64_intdigest(key)
            held[h % b].append((h, key))
        self.shift, self.keys, self.values = [0] * b, [None] * n, [0] * n
        free = bytearray(b"\1" * n)
        order = sorted(range(b), key=lambda i: -len(held[i]))
        at = 0
        for i in order:
            own = held[i]
            if len(own) > 1:
                d = 0
                while True:
                    slots = {self._slot(h, d) for h, _ in own}
                    if len(slots) == len(own) and all(free[s] for s in slots):
                        break
                    d += 1
                self.shift[i] = d
            elif own:
                at = free.index(1, at)
                self.shift[i] = -1 - at
            for h, key in own:
                s = self._slot(h, self.shift[i])
                free[s], self.keys[s], self.values[s] = 0, key, values[key]

    def found(self) -> bytes:
        return array("q", self.shift).tobytes()

    def _slot(self, h: int, d: int) -> int:
        return -1 - d if d < 0 else (((h ^ d * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & _M64) >> 24) % self.n

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        s = self._slot(h, self.shift[h % self.buckets])
        return self.values[s] if self.keys[s] == key else None


_CLASSES = (r"\p{L}", r"\p{N}", r"\s")


@lru_cache(maxsize=1)
def _library_classes() -> dict[str, str]:
    """The characters of each class of patterns, as the tokenizer library tells them."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = {}
    for c in _CLASSES:
        library = tiktoken.Encoding("class", pat_str=f"{c}+", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        out[c] = library.decode_bytes(library.encode_ordinary(every)).decode()
    return out


def _ranges(chars: set[str]) -> str:
    """The inside of a character set."""
    runs: list[list[int]] = []
    for p in sorted(map(ord, chars)):
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@lru_cache(maxsize=2)
def split_patterns(pattern: str) -> tuple[str, str, str] | None:
    """The pattern with the tokenizer library's own classes written out, and what finds texts that need it; None if none does."""
    told = _library_classes()
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    differ = set().union(*(set(told[c]) ^ set(regex.findall(c, every)) for c in _CLASSES))
    if not differ:
        return None
    sets = {c: _ranges(set(told[c])) for c in _CLASSES}
    out, inside = [], False
    for m in re.finditer(r"\\p\{[LN]\}|\\.|.", pattern):
        t = m[0]
        inside = (inside or t == "[") and t != "]"
        out.append((sets[t] if inside else f"[{sets[t]}]") if t in sets else f"[^{sets[_CLASSES[2]]}]" if t == r"\S" else t)
    return "".join(out), f"[{min(differ)}-\U0010ffff]", f"[{_ranges(differ)}]"


def splitter(pattern: str, patterns: tuple[str, str, str] | None) -> Callable[[str], list[str]]:
    """Finds the matches of a pattern as the tokenizer library does; ``patterns`` are its ``split_patterns``.

    The two libraries at hand know different versions of Unicode: a text with a character whose class they don't
    agree on is split by a pattern with the library's own classes written out, any other by the pattern as it is.
    """
    plain = regex.compile(pattern).findall
    if patterns is None:
        return plain
    whole, beyond, disputed = re.compile(patterns[0]).findall, re.compile(patterns[1]).search, re.compile(patterns[2]).search
    return lambda text: whole(text) if beyond(text) and disputed(text) else plain(text)


#: What takes long to find, and is found once on the driver: of the perfect hash, and of the pattern.
Tables = tuple[bytes, tuple[str, str, str] | None]


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, tables: Tables | None = None):
        found, patterns = tables or (None, split_patterns(pattern))
        self.ranks, self.hash, self.split = ranks, PerfectHash(ranks, found), splitter(pattern, patterns)
        self.longest = max(map(len, ranks))
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a pre-token: the pair of least rank, the leftmost of equals, is merged until none is left."""
        n, ranks, longest = len(piece), self.ranks, self.longest
        get = ranks.get
        end = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n))
        rank = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # of the pair whose first part starts here
        rank.append(-1)
        heap = [r * n + i for i, r in enumerate(rank) if r >= 0]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            if rank[i] != r:
                continue
            j = end[i]
            k = end[i] = end[j]  # parts i and j become one
            before[k] = i
            rank[j] = -1
            r = get(piece[i : end[k]], -1) if k < n and end[k] - i <= longest else -1
            rank[i] = r
            if r >= 0:
                heappush(heap, r * n + i)
            h = before[i]
            if h >= 0:
                r = get(piece[h:k], -1) if k - h <= longest else -1
                rank[h] = r
                if r >= 0:
                    heappush(heap, r * n + h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : (i := end[i])]])
        return out

    def _learn(self, tokens: set[str]) -> None:
        new, old = self.new, self.old
        if len(new) > CACHE:
            self.old = old = new
            self.new = new = {}
        for t in tokens:
            if t not in new:
                if (ids := old.get(t)) is None:
                    piece = t.encode()
                    whole = self.hash.get(piece)
                    ids = array("I", self.merged(piece) if whole is None else [whole]).tobytes()
                new[t] = ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        tokens = self.split(text)
        try:
            return b"".join(map(self.new.__getitem__, tokens))
        except KeyError:
            self._learn(set(tokens))
            return b"".join(map(self.new.__getitem__, tokens))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}


@lru_cache(maxsize=2)
def tables(path: str, pattern: str) -> Tables:
    return PerfectHash(read_ranks(path)).found(), split_patterns(pattern)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, told: Tables | None = None) -> Codec:
    return Codec(read_ranks(path), pattern, told)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, as an array of long) of each row of ``docs``.

    Ids are those of the rank file, each match of the pattern merged by itself; no special tokens.  A null text
    is an empty one, with no ids; a very long one is encoded whole, in O(n log n).  Repeated rows and ids are encoded
    alike; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>" if keep_ids else "")

    told = tables(ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern, told)
        for b in batches:
            n, ids_sha, text_sha, kept = [], [], [], []
            for (text,) in values(b.column(1)):
                ids = own.encode(text)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(np.frombuffer(ids, "<u4").astype(np.int64))
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes (binary) of rows with doc_id and ids; null ids decode to nothing."""

    told = tables(ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern, told)
        for b in batches:
            out = [own.decode(np.array(ids or [], "<u4").tobytes()) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")
