"""Bounded samples: the ids with the least hashes, without a shuffle of all ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How many times the ids asked for come through the first, approximate, cut.
_MARGIN = 1.25


def least_hashes(rows: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """(``by``,) doc_id: of the ids in ``rows`` (of each value of ``by``) the ``k`` with the least hash.

    The number of different ids is estimated in one pass over the id column, which tells how small a hash must be;
    only ids below that, about k a group, are shuffled, each once however often it repeats.  Nulls are left out.
    There are fewer than k of a group if its number was overestimated by more than a fifth.
    """
    keys = [by] if by else []
    rows = rows.select(*keys, "doc_id").where("doc_id is not null")
    if by:
        rows = rows.where(F.col(by).isNotNull())
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    found = rows.groupBy(*keys).agg(F.approx_count_distinct("doc_id", 0.02).alias("n"))  # a row a group
    share = F.lit(_MARGIN * (k + 20)) / F.greatest(F.col("n"), F.lit(1))
    if by:
        bounds = found.select(F.col(by).alias("_by"), share.alias("_share"))
        near = rows.join(F.broadcast(bounds), F.col(by) == F.col("_by")).where(draw < F.col("_share"))
    else:
        near = rows.where(draw < found.select(share).first()[0])
    near = near.select(*keys, "doc_id", draw.alias("_draw")).distinct()
    if not by:
        return near.orderBy("_draw", "doc_id").limit(k).select("doc_id")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_draw", "doc_id"))
    return near.withColumn("_place", place).where(F.col("_place") <= k).select(*keys, "doc_id")
