"""Maximum spanning trees over edge tables (u, v, w).

Edges are ranked by weight, then by (u, v), so the tree is unique. The graph has one node per
variable: its edge table grows with the square of the number of variables, never with the
data. Up to ``DRIVER_EDGES`` edges are ranked on the driver; beyond, the tree is grown by
component-wise best edges (Boruvka) with joins and aggregates only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborinfo.lineage import local_table, settle

DRIVER_EDGES = 200_000
EDGE_SCHEMA = pa.schema([("u", pa.string()), ("v", pa.string())])


class Components:
    """Union-find over hashable items."""

    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[x] = y
        return x != y


def heaviest_forest(edges):
    """Kruskal over (weight, u, v) triples; yields the kept (u, v)."""
    groups = Components()
    for _, u, v in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if groups.join(u, v):
            yield u, v


def maximum_spanning_tree(
    edges: DataFrame, weight: str = "i", driver_edges: int = DRIVER_EDGES
) -> DataFrame:
    """(u, v) of the maximum spanning forest of ``edges``."""
    edges = edges.select("u", "v", F.col(weight).alias("w"))
    rows = edges.limit(driver_edges + 1).collect()
    if len(rows) <= driver_edges:
        kept = heaviest_forest((r["w"], r["u"], r["v"]) for r in rows)
        return local_table(
            edges.sparkSession, [{"u": u, "v": v} for u, v in kept], EDGE_SCHEMA
        )
    return spanning_tree_by_components(edges)


def spanning_tree_by_components(edges: DataFrame) -> DataFrame:
    """The same forest by rounds of best outgoing edge per component.

    Each round at least halves the number of components, so there are log2(nodes) rounds.
    """
    edges = settle(edges.select("u", "v", "w"), "edges")
    ends = edges.select(F.col("u").alias("x")).union(edges.select(F.col("v").alias("x")))
    labels = settle(ends.distinct().withColumn("c", F.col("x")), "labels")
    kept = None
    while True:
        lu = labels.select(F.col("x").alias("u"), F.col("c").alias("cu"))
        lv = labels.select(F.col("x").alias("v"), F.col("c").alias("cv"))
        crossing = edges.join(lu, "u").join(lv, "v").filter("cu <> cv")
        both = crossing.select("u", "v", "w", F.col("cu").alias("c")).union(
            crossing.select("u", "v", "w", F.col("cv").alias("c"))
        )
        # Smallest (-w, u, v) per component; NaN-free weights are assumed.
        best = both.groupBy("c").agg(F.min(F.struct((-F.col("w")).alias("k"), "u", "v")).alias("b"))
        best = settle(best.select("b.u", "b.v").distinct(), "best")
        if best.isEmpty():
            break
        kept = best if kept is None else kept.union(best).distinct()
        links = best.join(lu, "u").join(lv, "v").select(
            F.col("cu").alias("a"), F.col("cv").alias("b")
        )
        merged = connected_components(links)
        labels = settle(
            labels.join(merged, labels["c"] == merged["node"], "left").select(
                "x", F.coalesce("component", "c").alias("c")
            ),
            "labels",
        )
    if kept is None:
        return edges.select("u", "v").limit(0)
    return settle(kept, "tree")


def connected_components(links: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., node, component) of the undirected ``links`` (by..., a, b).

    Component ids are the smallest node id. Every round takes the smallest label among the
    neighbours and then jumps to the label of that label, so long chains shrink fast.
    """
    by = by or []
    twoway = links.select(*by, "a", "b").union(
        links.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))
    )
    loops = twoway.select(*by, "a", F.col("a").alias("b"))
    graph = settle(twoway.union(loops).distinct(), "links")
    labels = settle(
        graph.groupBy(*by, "a").agg(F.min("b").alias("c")), "components"
    )
    while True:
        near = labels.withColumnsRenamed({"a": "b"})
        low = graph.join(near, [*by, "b"]).groupBy(*by, "a").agg(F.min("c").alias("m"))
        jump = labels.select(*by, F.col("a").alias("m"), F.col("c").alias("j"))
        new = (
            low.join(jump, [*by, "m"])
            .join(labels, [*by, "a"])
            .select(*by, "a", F.least("j", "m").alias("c"), (F.col("c") > F.least("j", "m")).alias("moved"))
        )
        new = settle(new, "components")
        labels = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    return labels.select(*by, F.col("a").alias("node"), F.col("c").alias("component"))
