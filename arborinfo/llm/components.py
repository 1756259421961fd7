"""Connected components of link tables by star contraction, with joins and aggregates only.

Nodes are of any orderable type. Every round turns each node's neighbours to the smallest node
around it (first the larger neighbours, then the smaller ones), until all edges point to the
smallest node of their component. The edges are written to the shared folder after each round, so
lineage stays short and a lost executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborinfo.lineage import materialize


def turned(edges: DataFrame, larger: bool) -> DataFrame:
    """One star operation over (u, v) with v < u."""
    if larger:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    lowest = materialize(around.groupBy("u").agg(F.min("v").alias("m")), "star")
    lowest = lowest.select("u", F.least("u", "m").alias("m"))
    joined = around.join(lowest, "u")
    if larger:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        out = out.select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    return materialize(out.filter(F.col("u") != F.col("v")).distinct(), "star")


def summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``links`` (a, b) but the roots, the smallest of their component.

    Links with a null, and of a node to itself, are left out.
    """
    pairs = links.filter(F.col("a") != F.col("b"))
    edges = materialize(
        pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star"
    )
    before = None
    while (now := summary(edges)) != before:
        before = now
        edges = turned(turned(edges, larger=True), larger=False)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
