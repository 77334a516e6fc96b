"""Containers of blobs that are written: tables in hash buckets, of which a write rewrites no more than it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restitch.operators.store import with_parent

SCHEMA = "key string, content binary, ts timestamp, container string, bucket int"
#: Buckets of a container; all writes and reads of a store use the same number.
BUCKETS = 64
#: Files of a bucket: so many tasks write it.
FILES = 4


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def read(spark: SparkSession, path: str, containers: list[str], keys: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """key, content, ts, container and bucket of the blobs of some containers; of the given keys, only their buckets are read.

    Buckets are partitions, so what isn't asked for isn't opened.  A container that was never written is empty.
    """
    if not _there(spark, path):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(path).where(F.col("container").isin(containers))
    if keys is None:
        return rows
    keys = keys.select("key").distinct()
    return rows.where(F.col("bucket").isin(_touched(in_buckets(keys, buckets)))).join(keys, "key", "left_semi")


def in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))


def _touched(rows: DataFrame) -> list[int]:
    return sorted(r[0] for r in rows.select("bucket").distinct().collect())  # as many as there are buckets at most


def upsert(rows: DataFrame, path: str, container: str, buckets: int = BUCKETS) -> None:
    """Write ``rows`` (key, content, ts): of each key the version with the latest ts stays, of equal ones the greater content.

    The buckets that hold a key of ``rows`` are read, merged and put in the place of the old ones once all are written; other
    buckets aren't touched.  What is left depends on the versions alone, so a batch that is written again, or after a later
    one, changes nothing.  Rows without a key are left out.
    """
    spark = rows.sparkSession
    rows = in_buckets(rows.where(F.col("key").isNotNull()).select("key", "content", F.col("ts").cast("timestamp").alias("ts"), F.lit(container).alias("container")), buckets)
    touched = _touched(rows)
    if not touched:
        return
    held = read(spark, path, [container], buckets=buckets).where(F.col("bucket").isin(touched))
    version = F.max(F.struct("ts", "content")).alias("v")
    both = held.unionByName(rows).withColumn("_file", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(FILES)))
    merged = both.repartition("bucket", "_file").groupBy("container", "bucket", "_file", "key").agg(version).select("key", "v.content", "v.ts", "container", "bucket")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("container", "bucket").parquet(path)


def insert_absent(rows: DataFrame, path: str, container: str, buckets: int = BUCKETS) -> None:
    """Append ``rows`` (key, content, ts) of keys that aren't stored, of each the earliest; only keys of touched buckets are read."""
    spark = rows.sparkSession
    rows = in_buckets(rows.where(F.col("key").isNotNull()).select("key", "content", F.col("ts").cast("timestamp").alias("ts"), F.lit(container).alias("container")), buckets)
    there = read(spark, path, [container], buckets=buckets).where(F.col("bucket").isin(_touched(rows))).select("key").distinct()
    fresh = rows.join(there, "key", "left_anti").groupBy("container", "bucket", "key").agg(F.min(F.struct("ts", "content")).alias("v"))
    fresh.select("key", "v.content", "v.ts", "container", "bucket").write.mode("append").partitionBy("container", "bucket").parquet(path)


def save_code(rows: DataFrame, path: str, parents: str = "images", container: str = "code", buckets: int = BUCKETS) -> None:
    """Write the code (key, content, ts) of images that are stored; other code is refused."""
    spark = rows.sparkSession
    upsert(with_parent(rows, read(spark, path, [parents], rows, buckets), "key"), path, container, buckets)


def save_code_stream(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that writes each batch's code; a batch that is tried again leaves the same rows."""
    return stream.writeStream.foreachBatch(lambda batch, _: save_code(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
