"""Files as tables: images, golden annotations, templates with test cases; and the blob sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from restitch.operators.evaluate import test_cases
from restitch.operators.store import content_key, insert_if_absent, upsert, with_parent


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def stem_of(path: Column) -> Column:
    """A file's name up to its first dot."""
    return F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, stem, key (md5 of the bytes) and content of every file that isn't empty or a dotfile."""
    rows = spark.read.format("binaryFile").load(path).where(~name_of(F.col("path")).startswith("."))
    return rows.select("path", stem_of(F.col("path")).alias("stem"), F.md5("content").alias("key"), F.col("length").alias("size"), "content")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """stem and expected code, lower-cased, of every annotation file that isn't a dotfile."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.where(~name_of(F.col("path")).startswith(".")).select("path", stem_of(F.col("path")).alias("stem"), F.lower("value").alias("expected"))


def with_annotation(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Images with the code that their annotation of the same stem expects."""
    return files.join(expected.select("stem", "expected"), "stem", "left")


def templates(spark: SparkSession, template_path: str, cases_path: str) -> DataFrame:
    """key (md5 of the template), template and its cases' JSON, for files of the same stem."""
    code = spark.read.text(template_path, wholetext=True).select(stem_of(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("template"))
    cases = spark.read.text(cases_path, wholetext=True).select(stem_of(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("cases"))
    return code.join(cases, "stem").select(content_key(F.col("template")).alias("key"), "stem", "template", "cases")


def template_cases(rows: DataFrame) -> DataFrame:
    return test_cases(rows, "cases").select("key", "case_no", "input", "expected", "hint")


def predicted_scores(tensors: DataFrame, model, batch_size: int = 1024) -> DataFrame:
    """``tensors`` (with ``pixels``, 784 numbers of 0 to 1) with the class scores of a model.

    ``model`` is called without arguments in each Python worker and returns a function from an array of rows to
    an array of scores, so that a model is loaded once a worker and applied in batches.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    score = predict_batch_udf(model, return_type=ArrayType(FloatType()), batch_size=batch_size, input_tensor_shapes=[[784]])
    return tensors.withColumn("scores", score("pixels"))


def named_rows(files: DataFrame) -> DataFrame:
    """Rows with a ``path`` whose name isn't a dotfile's, with their ``stem``."""
    return files.where(~name_of(F.col("path")).startswith(".")).withColumn("stem", stem_of(F.col("path")))


def blobs_of(rows: DataFrame, containers: list[str], keys: DataFrame) -> DataFrame:
    """The blobs of the given keys in any of the containers."""
    return rows.where(F.col("container").isin(containers)).join(keys.select("key").distinct(), "key", "left_semi")


def blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("container string, key string, content binary, ts timestamp").parquet(path)


def save_images(rows: DataFrame, path: str, container: str = "images") -> None:
    """Append the images whose content isn't stored yet."""
    spark = rows.sparkSession
    fresh = rows.select(F.lit(container).alias("container"), content_key(F.col("content")).alias("key"), "content", "ts")
    fresh = insert_if_absent(fresh, _stored(spark, path, container), "key", "ts")
    fresh.select("container", "key", "content", "ts").write.mode("append").parquet(path)


def save_code(rows: DataFrame, path: str, parents: str = "images", container: str = "code") -> DataFrame:
    """The code table with the last version of each key whose image is stored: what is to be written."""
    spark = rows.sparkSession
    fresh = with_parent(rows.select(F.lit(container).alias("container"), "key", "content", "ts"), _stored(spark, path, parents), "key")
    return upsert(_stored(spark, path, container), fresh, "key", "ts")


def _stored(spark: SparkSession, path: str, container: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    rows = blobs(spark, path) if there else spark.createDataFrame([], "container string, key string, content binary, ts timestamp")
    return rows.where(F.col("container") == container)
