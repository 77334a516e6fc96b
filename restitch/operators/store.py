"""Content-addressed storage: insert if absent, parent-checked upsert, cache with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: how long a cached image lives.
TTL_SECONDS = 1800


def content_key(content: Column) -> Column:
    return F.md5(content.cast("binary"))


def insert_if_absent(rows: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """The rows to insert: of each key that isn't there yet, the one with the least ``order``."""
    fresh = rows.join(existing.select(key).distinct(), key, "left_anti")
    return fresh.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in fresh.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def with_parent(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_semi")


def without_parent(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Both tables' rows, of each key the last version."""
    both = current.unionByName(changes)
    return both.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in both.columns if c != key]), version).alias("_r")).select(key, "_r.*").select(*current.columns)


def cache_status(events: DataFrame, key: str, ts: str, order: list[str], ttl: int = TTL_SECONDS) -> DataFrame:
    """``events`` with ``status``: first, hit or expired, by the time since the key's last event."""
    w = Window.partitionBy(key).orderBy(ts, *order)
    age = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    return events.withColumn("status", F.when(age.isNull(), "first").when(age <= ttl * 1_000_000, "hit").otherwise("expired"))


def read_through(requests: DataFrame, cache: DataFrame, blobs: DataFrame, key: str, value: str) -> DataFrame:
    """``requests`` with the value of the cache, or else of the blobs, and which of them had it; of a key's values the greatest."""
    once = lambda held, name: held.groupBy(key).agg(F.max(value).alias(name))
    out = requests.join(once(cache, "_c"), key, "left").join(once(blobs, "_b"), key, "left")
    told = F.when(F.col("_c").isNotNull(), "cache").when(F.col("_b").isNotNull(), "blob")
    return out.withColumns({value: F.coalesce("_c", "_b"), "found_in": told}).drop("_c", "_b")
