"""Connected components over an edge table, by contraction, without gathering the graph anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restitch.llm.session import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (u long, v long); component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour (itself included), follows these pointers until they
    rest, and contracts the edges to the roots.  The number of nodes falls by half a round at least, a star or a
    clique is gone after one.  Minima are combined map-side, so a hub with a third of all edges costs no more
    than its share of each task.  Nulls and loops are ignored; an empty edge table gives an empty result.
    """
    edges = edges.select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v"))
    edges, n = scratch.counted(edges.where("u is not null and v is not null and u <> v").distinct())
    labels = None
    while n["rows"]:
        ends = edges.select(F.inline(F.expr("array(struct(u as node, v as near), struct(v as node, u as near))")))
        parent = scratch.table(ends.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("root")))
        moved = 1
        while moved:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped, seen = scratch.counted(
                parent.join(up, "root").select("node", F.col("higher").alias("root"), (F.col("higher") < F.col("root")).alias("moved")), moved="count_if(moved)"
            )
            scratch.drop(parent)
            parent, moved = jumped, seen["moved"]
        roots = parent.select("node", "root")
        if labels is None:
            labels = roots
        else:
            labels = scratch.table(labels.join(roots.toDF("root", "higher"), "root", "left").select("node", F.coalesce("higher", "root").alias("root")))
        at = lambda name: roots.toDF(name, f"{name}_root")
        left = edges.join(at("u"), "u").join(at("v"), "v").select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v"))
        left, n = scratch.counted(left.where("u <> v").distinct())
        scratch.drop(edges)
        edges = left
    if labels is None:
        return scratch.spark.createDataFrame([], "node long, component long")
    return labels.select("node", F.col("root").alias("component"))
