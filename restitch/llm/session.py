"""Where lineage is cut: tables in the shared folder that the session names, or a local one where none is named."""

from __future__ import annotations

import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset on a single machine (tests) a new one is set; on a cluster that would be a folder which nobody
    else can read, so it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="restitch-checkpoint-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def quoted(column: str) -> str:
    """A column's name as an expression takes it, whatever dots or quotes it has."""
    return "`" + column.replace("`", "``") + "`"


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


class Scratch:
    """Tables of one operator call under the shared folder.

    A table is written once, as Parquet, so a lost executor costs no more than the stage at hand, and it is
    counted while it is written.  ``drop`` removes one that no later step reads, ``drop_others`` all but those that
    the operator's result reads; these stay until ``release`` is called, once the result has been written.
    """

    _left: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark).rstrip('/')}/restitch-{uuid.uuid4().hex}"
        self._of: dict[int, tuple[DataFrame, str]] = {}
        self._no = 0
        Scratch._left.append(self)

    def table(self, df: DataFrame, **sums: str) -> DataFrame:
        """``df``, written and read again."""
        return self.counted(df, **sums)[0]

    def counted(self, df: DataFrame, **sums: str) -> tuple[DataFrame, dict[str, int]]:
        """The same, and with it ``rows`` and the given SQL aggregates over the rows written."""
        self._no += 1
        path, seen = f"{self.folder}/{self._no}", Observation()
        asked = [F.count(F.lit(1)).alias("rows"), *[F.expr(e).alias(k) for k, e in sums.items()]]
        df.observe(seen, *asked).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._of[id(out)] = (out, path)
        return out, {k: v or 0 for k, v in seen.get.items()}

    def drop(self, df: DataFrame) -> None:
        _, path = self._of.pop(id(df), (None, None))
        if path:
            remove(self.spark, path)

    def drop_others(self, *kept: DataFrame) -> None:
        for df, _ in list(self._of.values()):
            if not any(df is k for k in kept):
                self.drop(df)

    @staticmethod
    def mark() -> int:
        return len(Scratch._left)

    @staticmethod
    def release(since: int) -> None:
        """Remove all tables of operator calls since a mark: their results have been written or aren't needed."""
        for s in Scratch._left[since:]:
            remove(s.spark, s.folder)
        del Scratch._left[since:]
