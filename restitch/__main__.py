"""python -m restitch QUERY [--data DIR] [--out DIR], or python -m restitch --repair FILE [--language NAME]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from restitch.functions.lattice import spell
from restitch.operators.repair import repaired_code
from restitch.operators.rules import CATALOGUE
from restitch.plans.registry import QUERIES


def main() -> None:
    said = argparse.ArgumentParser(prog="restitch", description=__doc__)
    said.add_argument("query", nargs="?", choices=sorted(QUERIES))
    said.add_argument("--data", default="/root/testdata/sf0.001", help="folder of Parquet tables")
    said.add_argument("--out", help="write the rows there as Parquet instead of showing some")
    said.add_argument("--repair", metavar="FILE", help="text file of code to repair")
    said.add_argument("--language", default="python3", choices=sorted({language for language, _ in CATALOGUE}))
    asked = said.parse_args()
    spark = SparkSession.builder.appName("restitch").getOrCreate()
    if asked.repair:
        text = spark.read.text(asked.repair, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
        depth = F.floor((F.length("line") - F.length(F.ltrim("line"))) / 2).cast("int")
        lines = text.select(F.lit(0).cast("long").alias("doc_id"), "line_no", depth.alias("indent"), spell(F.trim("line"), {" ": [" "]}).alias("cand"))
        print(repaired_code(lines, asked.language).first()["fixed_code"])
    elif asked.query:
        rows = QUERIES[asked.query](spark, asked.data)
        if asked.out:
            rows.write.mode("overwrite").parquet(asked.out)
        else:
            rows.show(20, truncate=80)
    else:
        said.print_help()


if __name__ == "__main__":
    main()
