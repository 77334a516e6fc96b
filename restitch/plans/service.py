"""The three requests of the service as table transformations: submit, submit again, and store a template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from restitch.functions.text import fill_template
from restitch.operators import evaluate, repair
from restitch.operators.diagnostics import diagnostics
from restitch.operators.store import content_key

REQUEST = "key string, code string, template string"
ERRORS = "array<struct<type:string,module:string,obj:string,line:int,column:int,path:string,symbol:string,message:string,message_id:string>>"


def requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Requests from files of JSON lines, as a table or a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(REQUEST).json(path)


def responses(rows: DataFrame, *fields: str) -> DataFrame:
    """One JSON text a row, of the given columns."""
    return rows.select(F.to_json(F.struct(*fields)).alias("response"))


def collected_errors(code: DataFrame, key: str) -> DataFrame:
    """``code`` with its diagnostics as an array in the order of lines; always an array, empty where there is none."""
    fields = [f.split(":")[0] for f in ERRORS[len("array<struct<") : -2].split(",")]
    found = diagnostics(code, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "column", F.struct(*fields).alias("e")))).alias("_e"))
    found = found.select(key, F.transform("_e", lambda s: s["e"]).alias("errors"))
    return code.join(found.hint("merge"), key, "left").withColumn("errors", F.coalesce("errors", F.array().cast(ERRORS)))


def tests_due(errors: Column, template: Column) -> Column:
    """Tests run where a template is given and the code has no errors."""
    return (F.size(errors) == 0) & template.isNotNull()


def submit(lines: DataFrame, boxes: DataFrame, chars: DataFrame | None = None, language: str = "python3") -> DataFrame:
    """What a submitted picture gives: doc_id, unfixed, fixed, errors and overlay.

    ``lines`` has the lattices of lines (doc_id, line_no, indent, cand), ``boxes`` the places of lines (doc_id,
    line_no, x, y, width, height), ``chars`` those of characters (as boxes, with char_no from 0).  Errors are those of the
    repaired code; each is given the place of its line and of the character before its column, where there are such.  The
    tables grow with the documents, which the size of the files they come from doesn't tell, so none is broadcast.
    """
    code = repair.repaired_code(lines, language).select("doc_id", F.col("code").alias("unfixed"), F.col("fixed_code").alias("code"))
    code = collected_errors(code, "doc_id").withColumnRenamed("code", "fixed")
    box = evaluate.bounding_box(boxes, ["doc_id"], F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    place = F.struct("x", "y", "width", "height")
    each = code.select("doc_id", F.posexplode("errors").alias("pos", "e")).select("doc_id", "pos", "e.line", "e.column")
    each = each.join(boxes.select("doc_id", (F.col("line_no") + 1).alias("line"), place.alias("_line")).hint("merge"), ["doc_id", "line"], "left")
    if chars is not None:
        each = each.join(chars.select("doc_id", (F.col("line_no") + 1).alias("line"), (F.col("char_no") + 1).alias("column"), place.alias("_char")).hint("merge"), ["doc_id", "line", "column"], "left")
    else:
        each = each.withColumn("_char", F.lit(None).cast("struct<x:double,y:double,width:double,height:double>"))
    at = F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("_line").alias("line"), F.col("_char").alias("character")).alias("at"))))
    at = each.groupBy("doc_id").agg(F.transform(at, lambda s: s["at"]).alias("_at"))
    told = code.join(box.hint("merge"), "doc_id", "left").join(at.hint("merge"), "doc_id", "left")
    places = F.coalesce("_at", F.array().cast(at.schema["_at"].dataType))
    return evaluate.overlay_json(told, F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), places).select("doc_id", "unfixed", "fixed", "errors", "overlay")


def resubmit(rows: DataFrame, cache: DataFrame, blobs: DataFrame) -> DataFrame:
    """Requests (key, code, template) with errors, the image's content from the cache or else the store, and the test program.

    ``program`` is the template with the code in its hole, null where tests are not due.  A request that comes again is
    answered again; each different code is looked at once.
    """
    from restitch.operators.store import read_through

    rows = rows.withColumn("_id", F.md5(F.coalesce("code", F.lit(""))))
    errors = collected_errors(rows.select("_id", "code").dropDuplicates(["_id"]), "_id").select("_id", "errors")
    told = read_through(rows.join(errors, "_id", "left").drop("_id"), cache, blobs, "key", "content")
    return told.withColumn("program", F.when(tests_due(F.col("errors"), F.col("template")), fill_template(F.col("template"), F.col("code"))))


#: What a template upload answers.
MISSING, FAILED = "Files Missing", "File Upload Failed"


def store_template(rows: DataFrame, template: str = "template", cases: str = "cases") -> DataFrame:
    """``rows`` with key (md5 of the template) and response: id, error and success.

    Both files are needed; cases that are no JSON array fail.
    """
    read = F.from_json(cases, evaluate.TEST_CASES)
    error = F.when(F.col(template).isNull() | F.col(cases).isNull(), MISSING).when(read.isNull(), FAILED).otherwise("")
    key = F.when(error == "", content_key(F.col(template))).otherwise("")
    return rows.withColumns({"key": key, "response": F.to_json(F.struct(key.alias("id"), error.alias("error"), (error == "").alias("success")))})
