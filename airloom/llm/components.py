"""Connected components of a link table by alternating large-star and small-star steps, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common as C


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node of the links (a, b) that isn't the smallest of its component, with that smallest.

    Null ends and self links count as no link; repeated links count once; without links there are no rows.
    Each step keeps a bounded state per node (its smallest neighbour), so a hub of any degree is combined
    before the shuffle; the edges of a step are written to the shared folder, which cuts the lineage. The steps end by
themselves, after about the square of the logarithm of the nodes."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = C.written(links.where("a is not null and b is not null and a <> b").select(high.alias("u"), low.alias("v")).distinct(), "links")
    while not _is_stars(edges):
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        root = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(root, "u").where("v > u").selectExpr("v as u", "m as v").where("u <> v")
        large = C.written(large.distinct(), "links")
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").selectExpr("v as u", "m as v").where("u <> v").unionByName(root.selectExpr("u", "m as v"))
        step = C.written(small.distinct(), "links")
        C.forget(edges, large)
        edges = step
    return C.belongs(edges.selectExpr("u as node", "v as root"), edges)


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node has one link down, to a node that has none."""
    several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    chained = edges.select("v").distinct().join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
    return several.isEmpty() and chained.isEmpty()
