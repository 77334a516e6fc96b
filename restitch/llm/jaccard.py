"""N-gram Jaccard join and the components of its links.

Texts become sets of word shingles; equal sets become one node.  Two sets can link only if few shingles tell
them apart, so when shingles are hashed into more groups than that, at least one group is the same in both: the
contents of a group are a key of an equi-join.  Sets that meet under a key are points of an R-tree: shingles are
hashed into groups and counted, a pair's overlap is at most the sum of its coordinate minima, a box's at most the
sum of minima with its upper corner.  The number of groups grows with the set (unrelated sets of n shingles in g
groups look about sqrt(n * g) apart, and a link may be n / 5 apart), and vectors are folded to a common number.  Pairs whose bound suffices are joined into candidate clusters, and in each
cluster an R-tree over its points finds the pairs to verify on the shingles themselves.

Nothing emits all pairs of a group: trees search only for partners in other components, so a family of n near
copies takes about n verifications.  Keys are made of the shingles that a sample does not find common, so that a
passage of very many texts makes no key; only sets with too few others are keyed by all of theirs as well.  Sets that
link share more keys than they must, so a key that still has very many sets is left out for a set with few of that
kind; sets that have only such keys (those of one large family) are joined into one cluster.  A cluster too large for a task is cut into
blocks of bounded size, and its sets that are still apart are then searched for in all blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restitch.llm.graph import components
from restitch.llm.sample import least_hashes
from restitch.llm.session import Scratch
from restitch.llm.textscan import Scan, U, chunks, mix, settle, texts_of, values, windows

#: Shingles to a group of a vector that is shuffled, at most; and of one in a block, at the median size.
PER_GROUP, PER_BLOCK_GROUP = 8, 2
LEAF = 32
#: Sets of a key that a tree searches at once; a key with more is large.
KEY_SETS = 1000
#: Shingles count as common that at least COMMON_IN of SAMPLE sampled texts have, the MOST_COMMON most frequent of
#: them.  The choice sets the cost alone: whichever shingles are common, all links are found.
SAMPLE, COMMON_IN, MOST_COMMON = 4000, 8, 100_000
#: Sets, and shingles, of a block of a cluster.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 22
#: Keys and sets that a task gathers before it ships them; more than LOCAL_HOT sets under a key are joined there.
SHIP_KEYS, SHIP_SETS, LOCAL_HOT = 1_000_000, 15_000, 512
#: Numbers of so many candidates (16 MB) are broadcast to find their texts again; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Keys that are met at once, about: the key space is cut into as many parts as that takes.
PART_KEYS = 4_000_000


# ---------------------------------------------------------------- sets


def shingle_sets(texts: Iterable[bytes], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles (of all its words, if it has fewer)."""
    for run in chunks(texts):
        s = Scan(run, lower=True)
        words = s.word_hash()
        grams = windows(words, k)
        for a, b in zip(s.first[:-1].tolist(), s.first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            else:
                yield windows(words[a:b], b - a) if b > a else np.empty(0, U)


def set_id(s: np.ndarray) -> int:
    """64 bits that stand for a set where candidates are searched; ``set_check`` tells sets with the same apart."""
    return _told(s, 0xC2B2AE3D27D4EB4F, 0x9E3779B97F4A7C15)


def set_check(s: np.ndarray) -> int:
    """64 further bits: two of n sets agree in both with a chance of n * n / 2 ** 129, if their shingles' own 64 bits differ."""
    return _told(s, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)


def _told(s: np.ndarray, a: int, b: int) -> int:
    if not len(s):
        return 0
    with np.errstate(over="ignore"):  # arithmetic is modulo 2 ** 64
        h = mix(np.array([mix(s ^ U(b)).sum(dtype=U) ^ mix(s * U(a)).sum(dtype=U) * U(b), len(s)], U))
        return int((h[0] ^ h[1] * U(3)).view(np.int64))


def counts(s: np.ndarray, groups: int) -> np.ndarray:
    """How many shingles each group has; ``groups`` is a power of two."""
    return np.bincount(((s >> U(24)) & U(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)


def point(s: np.ndarray) -> bytes:
    """The counts of a set, a byte each, over the least power of two of groups that is fine enough."""
    groups = 8
    while groups * PER_GROUP < len(s):
        groups *= 2
    while (c := counts(s, groups)).max() > 255:
        groups *= 2
    return c.astype(np.uint8).tobytes()


def folded(points: list[bytes]) -> np.ndarray:
    """Points over the least number of groups that any of them has."""
    groups = min(map(len, points))
    return np.stack([np.frombuffer(p, np.uint8).reshape(-1, groups).sum(0, dtype=np.int32) for p in points])


def block_points(sets: list[np.ndarray]) -> np.ndarray:
    groups = 64
    while groups < 1024 and groups * PER_BLOCK_GROUP < np.median([len(s) for s in sets]):
        groups *= 2
    return np.stack([counts(s, groups) for s in sets])


def bands(percent: int) -> Callable[[int], list[tuple[int, int, int]]]:
    """Of a set size: (band, groups, room) of its bands: of the groups, two sets that link have more than room equal.

    Bands of sizes grow by a half.  A set is keyed in its own band and in any above that a partner can be in.
    """
    table: dict[int, list[tuple[int, int, int]]] = {}
    edges = [1]
    differ = lambda a, b: (a + b) * (100 - percent) // (100 + percent)  # noqa: E731  shingles that are in one of two sets only

    def of(n: int) -> list[tuple[int, int, int]]:
        if n not in table:
            most = 100 * n // percent
            while edges[-1] <= most + 1:
                edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
            out = []
            for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
                if high > n and low <= most:
                    widest = differ(high - 1, high - 1)
                    groups = widest + 1 + (3 + widest // 20 if widest else 0)
                    out.append((i, groups, groups - differ(n, min(most, high - 1)) - 1))
            table[n] = out
        return table[n]

    return of


def _group_keys(s: np.ndarray, groups: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for the content of each group that isn't empty, and one for each that is."""
    g = ((s >> U(8)) % U(groups)).astype(np.int64)
    order = np.argsort(g, kind="stable")
    g = g[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))[: len(g)])
    content = np.add.reduceat(mix(s[order] ^ U(0xA0761D6478BD642F)), first) if len(g) else np.empty(0, U)
    empty = np.ones(groups, bool)
    empty[g[first]] = False
    return mix(content ^ mix(g[first].astype(U) + U(tag << 40))), mix(mix(np.flatnonzero(empty).astype(U) + U(tag << 40)) + U(1))


def keys(s: np.ndarray, of: Callable, common: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
    """For each band of a set (keys, how many of them it can do without, which kind of keys: 0 to 3).

    Of a band's groups more than ``room`` are equal in two sets that link, with or without the common shingles.
    Kinds 0 and 1 (the band above) leave common shingles out.  A set whose empty groups then fill the room is
    keyed by all its shingles as well, kinds 2 and 3; if only one of two sets is, the other has a group that
    isn't empty to share.  The same holds for empty groups among all shingles, which are keys for such a set.
    Of the room that empty groups leave, a set can do without as many keys, whichever they are.
    """
    at = np.searchsorted(common, s)
    rare = s[(at == len(common)) | (common[np.minimum(at, len(common) - 1)] != s)] if len(common) else s
    out = []
    for upper, (band, groups, room) in enumerate(of(len(s))):
        full, empty = _group_keys(rare, groups, 2 * band + 2)
        spare = room - len(empty)
        out.append((full, spare, upper))
        if spare < 0:
            full, empty = _group_keys(s, groups, 2 * band + 3)
            spare = room - len(empty)
            out.append((full if spare >= 0 else np.concatenate((full, empty)), spare, 2 + upper))
    return out


def _common(rows: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of the shingles that many texts of a bounded sample have: the rows with the least hash of their id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(shingle_sets(texts_of(b.column(0)), k))
            s, n = np.unique(np.concatenate(found) if found else np.empty(0, U), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n, pa.int64())], names=["s", "n"])
        settle()

    sample = rows.join(F.broadcast(least_hashes(rows, SAMPLE)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    sample = sample.select("text").mapInArrow(count, "s long, n long")
    often = sample.groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_IN).orderBy(F.desc("n"), "s").limit(MOST_COMMON)
    return np.sort(often.toPandas()["s"].to_numpy(np.int64).view(U))


# ---------------------------------------------------------------- the tree


class Tree:
    """A packed R-tree over count vectors, in the order of set sizes; boxes hold LEAF points."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        self.sizes, self.points = sizes[self.order], points[self.order]
        self.edges = np.arange(0, len(sizes), LEAF)
        self.upper = np.maximum.reduceat(self.points, self.edges, axis=0) if len(sizes) else self.points
        self.least = self.sizes[self.edges]

    def search(self, size: int, point: np.ndarray, percent: int, low: int, high: int) -> np.ndarray:
        """Places low to high whose bound allows a link."""
        if high - low > 2 * LEAF:
            a, b = low // LEAF, -(-high // LEAF)
            fits = (100 + percent) * np.minimum(self.upper[a:b], point).sum(1) >= percent * (size + self.least[a:b])
            at = ((np.flatnonzero(fits) + a)[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[(at >= low) & (at < high)]
        else:
            at = np.arange(low, high)
        return at[(100 + percent) * np.minimum(self.points[at], point).sum(1) >= percent * (size + self.sizes[at])]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def links(sizes: np.ndarray, points: np.ndarray, percent: int, sets: list[np.ndarray] | None = None, labels: np.ndarray | None = None, queries: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among points (of the pairs whose bound allows one, without ``sets``).

    ``labels`` are components known before; ``queries`` marks points to search for among the others only.
    """
    tree = Tree(sizes, points)
    order, n = tree.order, len(sizes)
    label = (np.arange(n) if labels is None else labels)[order].copy()
    asked = range(n) if queries is None else np.flatnonzero(queries[order]).tolist()
    apart = len(np.unique(label))
    out = []
    for i in asked:
        if apart == 1:
            break
        size = int(tree.sizes[i])
        high = int(np.searchsorted(tree.sizes, 100 * size // percent, "right"))
        low = i + 1 if queries is None else int(np.searchsorted(tree.sizes, -(-percent * size // 100), "left"))
        if high <= low:
            continue
        at = tree.search(size, tree.points[i], percent, low, high)
        at = at[label[at] != label[i]]
        for j in at.tolist():
            if label[j] == label[i]:
                continue
            a, b = int(order[i]), int(order[j])
            if sets is None or (100 + percent) * overlap(sets[a], sets[b]) >= percent * (size + int(tree.sizes[j])):
                out.append((a, b))
                label[label == label[j]] = label[i]
                apart -= 1
    return out


# ---------------------------------------------------------------- tasks


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sid, chk, vec = [], [], [], []
            for s in shingle_sets(texts_of(b.column(2)), k):
                n.append(len(s))
                sid.append(set_id(s))
                chk.append(set_check(s))
                vec.append(point(s))
            columns = [b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in (n, sid, chk)], pa.array(vec, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "n", "sid", "chk", "counts"])
        settle()

    return run


_SHIP = "part int, kind int, sids binary, spare binary, at binary, low binary, high binary"
#: Keys that a set can do without, counted up to this, go with their kind in 16 bits.
_SPARE = 100


def _ship(k: int, percent: int, parts: int, common: np.ndarray):
    """Keys by part, as packed arrays.  kind 0: keys; 1: keys that are hot here, with one set; 2: the sets of a hot key."""
    of = bands(percent)

    def flush(found: list[np.ndarray], sids: list[int], spare: list[int]) -> Iterator[tuple]:
        table, spares = np.array(sids, np.int64), np.array(spare, "<u2")
        at = np.repeat(np.arange(len(sids), dtype="<u2"), [len(x) for x in found])
        key = np.concatenate(found)
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        kind = np.zeros(len(key), np.int8)
        gone, seen = np.zeros(len(key), bool), set()
        for g in np.flatnonzero(size > LOCAL_HOT).tolist():
            a, b = first[g], first[g] + size[g]
            members = table[at[a:b]]
            if (h := hash(members.tobytes())) not in seen:
                seen.add(h)
                yield int(key[a] % U(parts)), 2, members.tobytes(), b"", b"", b"", b""
            kind[a], gone[a + 1 : b] = 1, True
        key, at, kind = key[~gone], at[~gone], kind[~gone]
        part, rest = (key % U(parts)).astype(np.int32), key // U(parts)
        for hot in (0, 1):
            rows = np.flatnonzero(kind == hot)
            rows = rows[np.argsort(part[rows], kind="stable")]
            for own in np.split(rows, np.flatnonzero(np.diff(part[rows])) + 1) if len(rows) else []:
                used, where = np.unique(at[own], return_inverse=True)
                low, high = (rest[own] & U(0xFFFFFFFF)).astype("<u4"), ((rest[own] >> U(32)) & U(0xFFFF)).astype("<u2")
                yield int(part[own[0]]), hot, table[used].tobytes(), spares[used].tobytes(), where.astype("<u2").tobytes(), low.tobytes(), high.tobytes()

    def shipped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        found, sids, spare, seen, n = [], [], [], set(), 0
        for b in batches:
            for s in shingle_sets(texts_of(b.column(0)), k):
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                for own, free, kind in keys(s, of, common):
                    sids.append(sid)
                    spare.append(4 * (max(min(free, _SPARE), -1) + 1) + kind)
                    found.append(own)
                    n += len(own)
                if n > SHIP_KEYS or len(seen) == SHIP_SETS:
                    yield from flush(found, sids, spare)
                    found, sids, spare, seen, n = [], [], [], set(), 0
        if sids:
            yield from flush(found, sids, spare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        names = [c.split()[0] for c in _SHIP.split(", ")]
        held: list[tuple] = []
        size = 0
        for r in shipped(batches):
            held.append(r)
            size += sum(map(len, r[2:]))
            if size > 8 << 20 or len(held) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
        settle()

    return run


_MEET = "bucket long, kind int, members array<long>, spare array<int>"


def _meet(parts: int):
    """Of each key with two sets or more the sets.

    kind 0: sets to search, under a number that keys with the same sets share; 1: sets to join; 2: sets of a
    large key, under its own number, with what they can spare.
    """
    return lambda batches: _met(batches, parts)


def _met(batches: Iterator[pa.RecordBatch], n_parts: int) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        b, k, m, s = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(k, pa.int32()), pa.array(m, pa.list_(pa.int64())), pa.array(s, pa.list_(pa.int32()))], names=["bucket", "kind", "members", "spare"])

    def star(members: np.ndarray) -> Iterator[tuple]:
        for a in range(1, len(members), 4096):
            m = np.concatenate((members[:1], members[a : a + 4096]))
            yield int(mix(m.view(U)).sum(dtype=U).view(np.int64)), 1, m, None

    def merged(columns: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """(key, set, what it can spare) in order, each key's sets once."""
        key, sid, spare = map(np.concatenate, zip(*columns, strict=True))
        order = np.lexsort((sid, key))
        key, sid, spare = key[order], sid[order], spare[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])))[: len(key)]
        return key[fresh], sid[fresh], spare[fresh]

    def part(p: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        """Rows come with kind 2 first, then 1, then 0; the sets of a key are held only until it proves large or hot."""
        columns: list[tuple[np.ndarray, ...]] = []
        hot = large = np.empty(0, U)
        n = floor = 0
        for _, kind, sids, spares, at, low, high in rows:
            sids = np.frombuffer(sids, np.int64)
            if kind == 2:
                yield from star(sids)
                continue
            at = np.frombuffer(at, "<u2")
            key = np.frombuffer(low, "<u4").astype(U) | np.frombuffer(high, "<u2").astype(U) << U(32)
            if kind == 1:
                hot = np.union1d(hot, key)
            columns.append((key, sids[at], np.frombuffer(spares, "<u2")[at]))
            n += len(at)
            if n - floor > max(PART_KEYS // 4, floor):
                kept = merged(columns)
                large = yield from shed(p, kept, hot, large, columns)
                n = floor = len(columns[0][0])
        if not columns:
            return
        yield from shed(p, merged(columns), hot, large, columns)
        key, sid, _ = columns[0]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
        size = np.diff(np.append(first, len(key)))
        many = np.flatnonzero(size > 1)
        bucket = np.add.reduceat(mix(sid.view(U)), first).view(np.int64) if len(first) else first
        _, pick = np.unique(bucket[many], return_index=True)
        for g in many[pick].tolist():
            yield int(bucket[g]), 0, sid[first[g] : first[g] + size[g]], None

    def shed(p: int, kept: tuple[np.ndarray, ...], hot: np.ndarray, large: np.ndarray, columns: list) -> Iterator[tuple]:
        """Give out the sets of hot keys (but one) and of large ones; ``columns`` are then what is left."""
        key, sid, spare = kept
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
        size = np.diff(np.append(first, len(key)))
        is_hot = np.isin(key[first], hot)
        is_large = ~is_hot & ((size > KEY_SETS) | np.isin(key[first], large))
        gone = np.zeros(len(key), bool)
        for g in np.flatnonzero(is_hot).tolist():
            a, b = first[g], first[g] + size[g]
            yield from star(sid[a:b])
            gone[a + 1 : b] = True
        for g in np.flatnonzero(is_large).tolist():
            own = int(mix(key[first[g] : first[g] + 1] * U(n_parts) + U(p)).view(np.int64)[0])
            for a in range(first[g], first[g] + size[g], 4096):
                b = min(a + 4096, first[g] + size[g])
                yield own, 2, sid[a:b], spare[a:b].astype(np.int32)
            gone[first[g] : first[g] + size[g]] = True
        columns[:] = [(key[~gone], sid[~gone], spare[~gone])]
        return np.union1d(large, key[first[is_large]])

    def parts() -> Iterator[tuple]:
        for p, rows in groupby((r for b in batches for r in values(*b.columns)), key=lambda r: r[0]):
            yield from part(p, rows)

    held: list[tuple] = []
    size = 0
    for r in parts():
        held.append(r)
        size += len(r[2])
        if size > 100_000:
            yield out(held)
            held, size = [], 0
    if held:
        yield out(held)
    settle()


def _grouped(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[tuple]]:
    """Rows of each run of equal first ``by`` columns."""
    at, rows = None, []
    for b in batches:
        for r in values(*b.columns):
            if r[:by] != at and rows:
                yield rows
                rows = []
            at = r[:by]
            rows.append(r)
    if rows:
        yield rows


def _edges(pairs: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []
    out = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=["u", "v"])
    for p in pairs:
        held.append(p)
        if len(held) == 8192:
            yield out()
            held = []
    if held:
        yield out()
    settle()


def _candidates(percent: int):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        seen: set[tuple[int, int]] = set()
        for rows in _grouped(batches, 1):
            _, sid, n, vec = zip(*rows, strict=True)
            points = folded(vec)
            if len(seen) > 200_000:
                seen.clear()
            for i, j in links(np.array(n, np.int64), points, percent):
                p = (min(sid[i], sid[j]), max(sid[i], sid[j]))
                if p not in seen:
                    seen.add(p)
                    yield p

    return lambda batches: _edges(pairs(batches))


def _verify(k: int, percent: int, searched: bool):
    """Links inside each block; with ``searched``, of its queries to its other rows."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        for rows in _grouped(batches, 3):
            *_, sid, chk, text, label, query = zip(*rows, strict=True)
            sets, keep, seen = [], [], set()
            for i, s in enumerate(shingle_sets(list(text), k)):
                if sid[i] in seen or set_check(s) != chk[i]:
                    continue  # of another row, whose id and text have the same hash
                seen.add(sid[i])
                sets.append(s)
                keep.append(i)
            if len(seen) != len(set(sid)):
                raise RuntimeError("the text of a set was not found again")
            if len(sets) < 2:
                continue
            sizes = np.array([len(s) for s in sets], np.int64)
            points = block_points(sets)
            if searched:
                label = np.unique(np.array([label[i] for i in keep]), return_inverse=True)[1]
                found = links(sizes, points, percent, sets, label, np.array([query[i] for i in keep]))
            else:
                found = links(sizes, points, percent, sets)
            for i, j in found:
                yield sid[keep[i]], sid[keep[j]]

    return lambda batches: _edges(pairs(batches))


# ---------------------------------------------------------------- the operator


def near_groups(docs: DataFrame, words: int = 4, percent: int = 85, block_sets: int = BLOCK_SETS) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id.

    Two rows link when their sets of ``words``-word shingles (A-Z lower-cased) have a Jaccard similarity of
    ``percent`` / 100 or more; component_id is the smallest doc_id reachable by links.  A row without words (an
    empty or null text) is linked with nothing and is its own component; a very long text is taken whole.  Rows that
    repeat a text, an id or both are rows of their own; null ids are never the smallest unless a component has no
    other.  An empty table gives no rows; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    rows = rows.select("doc_id", _row_number().alias("at"), "text")
    features, seen = scratch.counted(rows.mapInArrow(_features(words), "doc_id long, at long, n long, sid long, chk long, counts binary"), n="sum(n)")
    nodes, clash = _nodes(features, scratch)

    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = shuffled * -(-(seen["n"] + 20 * seen["rows"]) // (shuffled * PART_KEYS) or -1)  # a set of n shingles has about n keys
    shipped = rows.select("text").mapInArrow(_ship(words, percent, parts, _common(rows, words)), _SHIP)
    met = shipped.repartitionById(shuffled, F.col("part") % shuffled).sortWithinPartitions("part", F.desc("kind")).mapInArrow(_meet(parts), _MEET)
    met, seen = scratch.counted(met, large="count_if(kind = 2)")
    stars = met.where("kind = 1").select(F.col("members")[0].alias("u"), F.explode(F.expr("slice(members, 2, size(members))")).alias("v"))
    if seen["large"]:
        stars = stars.union(_of_large_keys(met))
    if clash:
        stars = stars.union(nodes.where("node <> sid").select("sid", "node"))
    near = met.where("kind = 0").groupBy("bucket").agg(F.first("members").alias("members"))
    near = near.select("bucket", F.explode("members").alias("sid")).join(nodes.select("sid", "node", "n", "counts"), "sid")
    near = near.select("bucket", "node", "n", "counts").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_candidates(percent), "u long, v long")
    clusters = components(stars.union(near), scratch).toDF("node", "cluster")
    scratch.drop(met)

    members = scratch.table(clusters.join(nodes.select("node", "chk", "at", "n"), "node"))
    blocks = members.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("node").alias("pivot"))
    blocks = blocks.select("cluster", "pivot", F.expr(f"cast(ceil(greatest(size / {block_sets}, shingles / {BLOCK_SHINGLES})) as int)").alias("blocks"))
    members, seen = scratch.counted(members.join(blocks, "cluster"), cut="count_if(blocks > 1)")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    placed = members.select("*", F.explode(F.when(F.col("node") == F.col("pivot"), every).otherwise(F.array(own))).alias("block"))
    first = placed.select("cluster", "block", F.lit(0).alias("turn"), "node", "chk", "at", F.lit(0).cast("long").alias("label"), F.lit(True).alias("query"))
    few = seen["rows"] <= BROADCAST_ROWS
    found = scratch.table(_search(first, rows, words, percent, False, few))

    if seen["cut"]:
        found = found.union(scratch.table(_apart(members, found, rows, words, percent, block_sets, scratch, few)))
    joined = components(found, scratch).toDF("node", "component")
    joined = joined.join(nodes.select("node", "doc_id"), "node")
    least = joined.groupBy("component").agg(F.min("doc_id").alias("least"))
    joined = scratch.table(joined.join(least, "component").select("node", "least"))
    # written, so that the last join has a plain exchange on either side and a hot set can be split
    names = nodes.join(joined, "node", "left").select("sid", "chk", F.coalesce("least", "doc_id").alias("least"))
    names = scratch.table(names)
    scratch.drop_others(features, names)
    return features.select("doc_id", "n", "sid", "chk").join(names, ["sid", "chk"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    )


def _row_number() -> Column:
    """By which a row's text is found again: rows with the same are the same but by chance, whatever their ids."""
    return F.xxhash64("doc_id", "text")


def _nodes(features: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """A row per set: sid, chk, node (its number), doc_id (the least), at (of one row that has it), n, counts.

    ``node`` is ``sid`` but where different sets have that in common (then, but for one of them, a hash of both).
    The second result says whether there are such sets.
    """
    told = [F.min("doc_id").alias("doc_id"), F.min("at").alias("at"), F.max("n").alias("n"), F.max("counts").alias("counts")]
    full = features.where("n > 0")
    nodes, seen = scratch.counted(full.groupBy("sid").agg(*told, F.min("chk").alias("chk"), F.max("chk").alias("other")), clash="count_if(chk <> other)")
    names = ["sid", "chk", "node", "doc_id", "at", "n", "counts"]
    if not seen["clash"]:
        return nodes.withColumn("node", F.col("sid")).select(names), False
    mixed = nodes.where("chk <> other").select("sid", F.col("chk").alias("_first"))
    apart = full.join(mixed, "sid").groupBy("sid", "chk", "_first").agg(*told)
    apart = apart.withColumn("node", F.when(F.col("chk") == F.col("_first"), F.col("sid")).otherwise(F.xxhash64("sid", "chk")))
    return scratch.table(nodes.where("chk = other").withColumn("node", F.col("sid")).select(names).union(apart.select(names))), True


def _of_large_keys(met: DataFrame) -> DataFrame:
    """Edges that join the sets of a large key which have more such keys than they can spare.

    Of two sets that link, if either can spare its large keys, they share another key.
    """
    large = met.where("kind = 2").select("bucket", F.inline(F.arrays_zip(F.col("members").alias("sid"), F.col("spare"))))
    large = large.select("bucket", "sid", (F.col("spare") % 4).alias("kind"), (F.floor(F.col("spare") / 4) - 1).alias("free"))
    bound = large.groupBy("sid", "kind").agg(F.count("*").alias("n"), F.max("free").alias("free")).where("n > free").select("sid", "kind")
    large = large.join(bound, ["sid", "kind"]).select("bucket", "sid")
    least = large.groupBy("bucket").agg(F.min("sid").alias("u"))
    return large.join(least, "bucket").where("u <> sid").select("u", F.col("sid").alias("v"))


def _search(placed: DataFrame, rows: DataFrame, words: int, percent: int, searched: bool, few: bool) -> DataFrame:
    """Links among the sets of each (cluster, block, turn); texts are read again, each once however often it repeats.

    Only the texts of candidates are shuffled, if these are few enough for their numbers to be broadcast.  Where rows
    with different texts have the same ``at``, all of them come, and the set's own check tells which is meant.
    """
    asked = placed.select("at").distinct()
    near = rows.join(F.broadcast(asked) if few else asked, "at", "left_semi")
    texts = near.groupBy("at", F.xxhash64(F.lit(1), "text").alias("_other")).agg(F.first("text").alias("text")).select("at", "text")
    # by merge at any size: the sets in clusters grow with the corpus, and a broadcast of them has no bound
    held = placed.hint("merge").join(texts, "at").select("cluster", "block", "turn", "node", "chk", "text", "label", "query")
    dealt = held.repartition("cluster", "block", "turn").sortWithinPartitions("cluster", "block", "turn")
    return dealt.mapInArrow(_verify(words, percent, searched), "u long, v long")


def _apart(members: DataFrame, found: DataFrame, rows: DataFrame, words: int, percent: int, block_sets: int, scratch: Scratch, few: bool) -> DataFrame:
    """Links between blocks: sets outside their cluster's largest component, searched for in all its blocks."""
    label = components(found, scratch).toDF("node", "label")
    cutup = scratch.table(members.where("blocks > 1").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    sizes = cutup.groupBy("cluster", "label").count().groupBy("cluster")
    major = sizes.agg(F.max_by("label", F.struct("count", "label")).alias("major"), F.sum("count").alias("total"), F.max("count").alias("most"))
    major = major.where("total > most").select("cluster", "major", F.expr(f"cast(ceil((total - most) / {block_sets}) as int)").alias("turns"))
    cutup = cutup.join(major, "cluster")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    shared = lambda at, turn, query: [F.col("cluster"), at.alias("block"), turn.alias("turn"), "node", "chk", "at", "label", F.lit(query).alias("query")]
    turns = cutup.select("*", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("t"))
    index = turns.select(*shared(block, F.col("t"), False))
    asked = cutup.where("label <> major").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    asked = asked.select(*shared(F.col("b"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns")).cast("int"), True))
    both = asked.unionByName(index).groupBy("cluster", "block", "turn", "node").agg(*[F.first(c).alias(c) for c in ("chk", "at", "label")], F.max("query").alias("query"))
    return _search(both, rows, words, percent, True, few)


def drop_near(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, with their columns, whatever their names.

    Rows without an id stay; rows that repeat an id go only if all of them do.  A null or empty text is like no other
    and stays; a very long one is compared whole; an empty table gives no rows.
    """
    groups = near_groups(docs, words, percent)
    gone = groups.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone")).where("gone").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
