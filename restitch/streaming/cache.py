"""The image cache as a stream: status of each event, first uploads, and the store as a sink."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from restitch.operators.store import TTL_SECONDS


def work_dir(spark: SparkSession) -> str:
    """A new folder under the shared one that the session names; on a single machine a temporary one where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{named.rstrip('/')}/stream-{uuid.uuid4().hex}" if named else tempfile.mkdtemp(prefix="restitch-stream-")


def cache_status(events: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", ttl: int = TTL_SECONDS) -> DataFrame:
    """key, order, ts and status (first, hit or expired) of each event of a stream.

    The state of a key is the time of its last event.  Events of a key are taken in order of time within a
    batch; one that comes in a later batch than a newer one is measured from that.
    """

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([ts, order], kind="stable")
        last = state.get[0] if state.exists else None
        out = []
        for at in (rows[ts].astype("datetime64[us]").astype("int64")):
            out.append("first" if last is None else "hit" if at - last <= ttl * 1_000_000 else "expired")
            last = at if last is None else max(last, at)
        state.update((int(last),))
        yield pd.DataFrame({key: rows[key], order: rows[order], ts: rows[ts], "status": out})

    schema = f"{key} {dict(events.dtypes)[key]}, {order} {dict(events.dtypes)[order]}, {ts} timestamp_ntz, status string"
    rows = events.select(key, order, F.col(ts).cast("timestamp_ntz").alias(ts))
    return rows.groupBy(key).applyInPandasWithState(run, schema, "last long", "append", "NoTimeout")


class Expiring(StatefulProcessor):
    """One key's state: the time of its last event, kept until a timer says that no later event can hit it."""

    def __init__(self, key: str, ts: str, order: str, ttl: int):
        self.names, self.ttl = (key, ts, order), ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        name, ts, order = self.names
        told = pd.concat(list(rows)).sort_values([ts, order], kind="stable")
        at = told[ts].astype("datetime64[us, UTC]" if told[ts].dt.tz is not None else "datetime64[us]").astype("int64").tolist()
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for t in at:
            out.append("hit" if last is not None and t - last <= self.ttl * 1_000_000 else "miss")
            last = t if last is None else max(last, t)
        self.last.update((last,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(last // 1000 + self.ttl * 1000 + 1)
        yield pd.DataFrame({name: told[name], order: told[order], ts: told[ts], "status": out})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def expiring_status(events: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", ttl: int = TTL_SECONDS, delay: str = "1 hour") -> DataFrame:
    """key, order, ts and status (hit or miss) of each event of a stream; a key that has expired leaves no state.

    An event hits if its key's last one is at most ``ttl`` seconds older; each sets it anew.  Once the watermark, ``delay``
    behind the newest event, has passed that time the key's state is removed by a timer: no event that still counts could
    hit it.  Events of a batch are taken in order of time; one that is older than its key's last is a hit; one that is older
    than the watermark of an earlier batch comes too late and is left out.  Needs the state store that keeps timers (``timers``).
    """
    fields = dict(events.dtypes)
    rows = events.select(key, order, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, delay)
    schema = f"{key} {fields[key]}, {order} {fields[order]}, {ts} timestamp, status string"
    return rows.groupBy(key).transformWithStateInPandas(Expiring(key, ts, order, ttl), schema, "Append", "EventTime")


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """The session with a state store that keeps timers."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def first_uploads(uploads: DataFrame, key: str = "key", ts: str = "ts", ttl: int = TTL_SECONDS) -> DataFrame:
    """Of the uploads of a key within the time to live the first that comes."""
    return uploads.withWatermark(ts, f"{ttl} seconds").dropDuplicatesWithinWatermark([key])


def replay(spark: SparkSession, stream: DataFrame, schema: str) -> DataFrame:
    """All that a bounded stream yields, as a table: each batch is written once, under its number."""
    folder = work_dir(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out").drop("batch")


def save_stream(uploads: DataFrame, path: str, checkpoint: str):
    """Start a query that stores each batch's images that aren't there yet; uploads have content and ts."""
    from restitch.sources.files import save_images

    return uploads.writeStream.foreachBatch(lambda batch, _: save_images(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
