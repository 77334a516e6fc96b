"""Exact deduplication by Grace hashing.

Records are partitioned by a hash of their content; a partition that does not fit the memory budget is split
into spill files by further hash bits, again and again, until each file fits.  A bucket that fits is resolved by
an open-addressing table which compares complete contents, so no two different texts are ever merged.  Texts of
a scan partition are resolved before the shuffle, so of a text repeated in a third of all rows one row a scan
partition is shuffled.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restitch.llm.textscan import settle, texts_of, values

MEMORY_BYTES = 48 << 20
FANOUT = 16
_GROUP = "h long, content binary, keep_id long, group_size long"
_ROWS = 4096


class OpenTable:
    """Linear probing over a power of two of slots; keys are whole contents, compared byte by byte."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.keep: list[int | None] = []
        self.sizes: list[int] = []

    def _slot(self, h: int, content: bytes) -> int:
        slots, mask = self.slots, len(self.slots) - 1
        at = (h ^ h >> 32) & mask
        while (e := slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                break
            at = (at + 1) & mask
        return at

    def add(self, h: int, content: bytes, keep: int | None, size: int) -> None:
        at = self._slot(h, content)
        if (e := self.slots[at]) >= 0:
            if keep is not None and (self.keep[e] is None or keep > self.keep[e]):
                self.keep[e] = keep
            self.sizes[e] += size
            return
        self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.keep.append(keep)
        self.sizes.append(size)
        if 2 * len(self.contents) > len(self.slots):
            old, self.slots = self.hashes, [-1] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for e, h in enumerate(old):
                at = (h ^ h >> 32) & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = e

    def rows(self) -> Iterator[tuple[int, bytes, int | None, int]]:
        return zip(self.hashes, self.contents, self.keep, self.sizes, strict=True)


def grace(records: Iterable[tuple[int, bytes, int | None, int]], memory: int = MEMORY_BYTES, level: int = 0, hash_of=None) -> Iterator[tuple[int, bytes, int | None, int]]:
    """Merge (hash, content, keep_id, size) records of equal content, in about ``memory`` bytes.

    Contents that fill the table are spilled with all that follows, dealt by four further hash bits, and each
    spill file is resolved in the same way.  Files live in a folder of the task and go with it.  After sixteen
    levels all hash bits are used; records that still differ then are resolved in memory.
    """
    table, held, it = OpenTable(), 0, iter(records)
    for r in it:
        before = len(table.contents)
        table.add(*r)
        if len(table.contents) > before:
            held += len(r[1]) + 120
            if held > memory and level < 16 and len(table.contents) > 1:
                break
    else:
        yield from table.rows()
        return
    folder = tempfile.mkdtemp(prefix="grace-")
    try:
        paths = [os.path.join(folder, str(i)) for i in range(FANOUT)]
        files = [open(p, "wb", buffering=1 << 16) for p in paths]  # noqa: SIM115
        try:
            put = [pickle.Pickler(f, 5) for f in files]
            shift = 4 * (level % 16)
            for part in (table.rows(), it):
                for r in part:
                    p = put[(r[0] >> shift) & (FANOUT - 1)]
                    p.dump(r)
                    p.clear_memo()
        finally:
            for f in files:
                f.close()
        del table
        for p in paths:
            if os.path.getsize(p):
                with open(p, "rb", buffering=1 << 16) as f:
                    yield from grace(_read(f), memory, level + 1)
            os.remove(p)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _read(f) -> Iterator[tuple]:
    read = pickle.Unpickler(f).load
    while True:
        try:
            yield read()
        except EOFError:
            return


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _batches(rows: Iterable[tuple], names: list[str], types: list[pa.DataType], width: int | None = None, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
    for r in rows:
        held.append(r)
        size += 0 if width is None else len(r[width])
        if len(held) >= _ROWS or size > limit:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records():
        for b in batches:
            for i, t in values(*b.columns):
                t = t.lower()  # bytes: A-Z only
                yield xxhash.xxh3_64_intdigest(t), t, i, 1

    rows = ((_signed(h), t, k, n) for h, t, k, n in grace(records()))
    yield from _batches(rows, ["h", "content", "keep_id", "group_size"], [pa.int64(), pa.binary(), pa.int64(), pa.int64()], 1)
    settle()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records():
        for b in batches:
            for h, t, k, n in values(*b.columns):
                yield h & (1 << 64) - 1, t, k, n

    rows = ((hashlib.sha256(t).digest(), k, n) for _, t, k, n in grace(records()))
    yield from _batches(rows, ["sha", "keep_id", "group_size"], [pa.binary(), pa.int64(), pa.int64()])
    settle()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sha = [hashlib.sha256(t.lower()).digest() for t in texts_of(b.column(2))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sha, pa.binary())], names=["doc_id", "at", "sha"])


def _row_hash(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text, F.lit("")))


def _judged(rows: DataFrame, at: Column) -> DataFrame:
    """doc_id, at, sha, keep_id and group_size of each of ``rows`` (doc_id, content)."""
    groups = rows.select("doc_id", "content").mapInArrow(_local, _GROUP).repartition(F.col("h")).mapInArrow(_merge, "sha binary, keep_id long, group_size long")
    return rows.select("doc_id", at.alias("at"), "content").mapInArrow(_digest, "doc_id long, at long, sha binary").join(groups, "sha")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z, however long; a null text equals an empty one.  The row
    with the largest id of a group stays.  Rows that repeat an id and a text are all kept if that id is the largest; a
    null id is never larger than another.  An empty table gives an empty result; other columns, whatever their
    names, are ignored.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("content"))
    return _judged(rows, F.lit(0).cast("long")).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row with a larger doc_id repeats (columns as they were, whatever their names).

    Of rows that repeat an id and a text, all stay or all go: nothing tells which one is meant.  Rows that repeat
    an id, or have none, with other texts are judged by their own text.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("content"), _row_hash(F.col("doc_id"), F.col("text")).alias("at"))
    gone = _judged(rows, F.col("at")).where("not (doc_id <=> keep_id)").select(F.col("doc_id").alias("_gone"), F.col("at").alias("_at"), F.lower(F.hex("sha")).alias("_sha")).distinct()
    own = F.sha2(F.translate(F.coalesce(docs["text"], F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary"), 256)
    # joined by a hash of id and text, so that rows that share an id, or have none, don't all meet; the few that meet
    # are compared by instr, not "=": as an equality the digest would be a join key, and made of every row
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]) & (F.instr(own, gone["_sha"]) == 1)
    return docs.join(gone, (_row_hash(docs["doc_id"], docs["text"]) == gone["_at"]) & same, "left_anti")
