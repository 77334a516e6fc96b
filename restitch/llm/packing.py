"""Hierarchical multi-length packing of token sequences.

Documents are cut into whole windows of the longest context plus a tail.  Tails are routed to the smallest
context tier that holds them, tiers are packed from the longest to the shortest, and what a tier leaves open is
filled from shorter tiers; the last piece that goes in may be cut.  Sequences are then dealt to step groups so
that every group has about the same number of tokens and the same mixture of tiers.

Packing runs inside the tasks that read and encode the documents: no token is shuffled.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restitch.llm.textscan import values

TIERS = (128, 256, 512, 1024)
#: Tokens of open tails that a task holds before it packs them.
WINDOW_TOKENS = 1 << 21
STEP_SEQUENCES = 64
#: Below this code point both tokenizer libraries split alike (tests compare them); texts beyond go to the first.
_PLAIN = 0x250

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


@lru_cache(maxsize=2)
def _tokenizers(json_path: str, ranks_path: str | None):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    slow.encode_special_tokens = True
    fast = None
    if ranks_path:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return slow, fast


def encoder(json_path: str, ranks_path: str | None):
    """A function from a list of texts to their id arrays, each closed by id 0.

    The ids are those of ``tokenizers``.  Where a file with the same vocabulary as ranks is given, texts of
    Latin letters are encoded from it, about four times as fast and with the same ids.
    """
    slow, fast = _tokenizers(json_path, ranks_path)

    def encode(text: str) -> np.ndarray:
        if fast is not None and (text.isascii() or max(text) < chr(_PLAIN)):
            ids = fast.encode_ordinary(text)
        else:
            ids = slow.encode(text, add_special_tokens=False).ids
        ids.append(0)
        return np.array(ids, "<u4")

    return encode


class Sequence:
    __slots__ = ("pieces", "room", "size", "tier")

    def __init__(self, tier: int):
        self.tier, self.room, self.size, self.pieces = tier, tier, 0, []

    def put(self, piece: tuple) -> None:
        self.pieces.append((*piece, self.size))
        self.size += len(piece[2])
        self.room -= len(piece[2])


def pack(tails: list[tuple], tiers: tuple[int, ...] = TIERS) -> list[Sequence]:
    """Pack (doc, start, ids) tails, none longer than the last tier, into sequences of exact power-of-two sizes.

    A sequence of a tier holds the longest tail left and then, while it has room, the longest shorter tail that
    fits; when none fits, the shortest tail is cut.  So only the last sequence can fall short, and it is cut
    into descending powers of two.
    """
    top = tiers[-1]
    by_len: list[list[tuple]] = [[] for _ in range(top + 1)]
    for t in tails:
        by_len[len(t[2])].append(t)
    have = [i for i in range(1, top + 1) if by_len[i]]  # ascending lengths that are in stock
    out = []

    def take(at: int) -> tuple:
        t = by_len[have[at]].pop()
        if not by_len[have[at]]:
            have.pop(at)
        return t

    from bisect import bisect_right, insort

    while have:
        tier = next(t for t in tiers if t >= have[-1])
        seq = Sequence(tier)
        while seq.room and have:
            at = bisect_right(have, seq.room) - 1
            if at >= 0:
                seq.put(take(at))
                continue
            doc, start, ids = take(0)  # cut the shortest
            room = seq.room
            seq.put((doc, start, ids[:room]))
            rest = (doc, start + room, ids[room:])
            if not by_len[len(rest[2])]:
                insort(have, len(rest[2]))
            by_len[len(rest[2])].append(rest)
        out += [seq] if not seq.room else _exact(seq)
    return out


def _exact(short: Sequence) -> list[Sequence]:
    """A sequence that is not full, as sequences of descending powers of two."""
    out, left = [], [(d, s, i) for d, s, i, _ in short.pieces]
    size = short.size
    while size:
        power = 1 << size.bit_length() - 1
        seq = Sequence(power)
        while seq.room:
            doc, start, ids = left.pop(0)
            room = seq.room
            seq.put((doc, start, ids[:room]))
            if len(ids) > room:
                left.insert(0, (doc, start + room, ids[room:]))
        out.append(seq)
        size -= power
    return out


def balance(sequences: list[Sequence], group: int = STEP_SEQUENCES, top: int = TIERS[-1]) -> list[int]:
    """A step group for each sequence: longest first, each to the group with the fewest tokens so far."""
    total = sum(s.size for s in sequences)
    heap = [(0, g) for g in range(max(1, -(-total // (group * top))))]
    out = [0] * len(sequences)
    for i in sorted(range(len(sequences)), key=lambda i: -sequences[i].size):
        tokens, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (tokens + sequences[i].size, g))
    return out


def packed(rows: Iterable[tuple[int | None, np.ndarray]], base: int, tiers: tuple[int, ...] = TIERS, window: int = WINDOW_TOKENS) -> Iterator[tuple]:
    """Piece rows of (doc_id, ids) rows; sequence and group numbers start at ``base``."""
    top = tiers[-1]
    seq_no = group_no = base

    def emit(sequences: list[Sequence]) -> Iterator[tuple]:
        nonlocal seq_no, group_no
        groups = balance(sequences, top=top)
        for seq, g in zip(sequences, groups, strict=True):
            for (doc, tokens), start, ids, offset in seq.pieces:
                yield doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, seq_no, offset, seq.tier, group_no + g
            seq_no += 1
        group_no += max(groups, default=-1) + 1

    held: list[tuple] = []
    whole: list[Sequence] = []
    size = 0
    for doc, ids in rows:
        n = len(ids)
        for start in range(0, n - n % top, top):
            seq = Sequence(top)
            seq.put(((doc, n), start, ids[start : start + top]))
            whole.append(seq)
        if n % top:
            held.append(((doc, n), n - n % top, ids[n - n % top :]))
        size += n
        if size >= window:
            yield from emit(whole + pack(held, tiers))
            held, whole, size = [], [], 0
    yield from emit(whole + pack(held, tiers))


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    Every document, one without text or with a null text too, ends with id 0, so each has a piece.  Rows that
    repeat an id are packed as documents of their own; a very long text is encoded whole and cut into full sequences and
    a rest.  Only id and text are read, whatever other columns there are.  A sequence is as long as its tier or, at the end of a
    task's rows, a smaller power of two: nothing is padded.  An empty table gives no pieces.  ``tiers`` are
    ascending powers of two.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be ascending powers of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        rows = ((i, encode(t)) for b in batches for i, t in values(*b.columns))
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int32() if c.endswith("int") else pa.int64() for c in SCHEMA.split(", ")]
        held: list[tuple] = []
        for r in packed(rows, base, tiers):
            held.append(r)
            if len(held) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
