"""Paths of a tree given as undirected edges (u, v).

``tree_paths`` lists all pairs for those who want the table. Nothing else needs it: questions about
some nodes are answered by a ``TreeIndex``, in rows as many as the answer has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborinfo.lineage import SMALL_ROWS, broadcast, local_table, settle
from arborinfo.operators.tree_index import TreeIndex


def directed(edges: DataFrame, *columns: str) -> DataFrame:
    """Both orientations of each edge."""
    return edges.select("u", "v", *columns).union(
        edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *columns)
    )


PATH_SCHEMA = pa.schema(
    [("u", pa.string()), ("v", pa.string()), ("d", pa.int32())]
    + [(c, pa.string()) for c in ("first", "last", "mid")]
)


def tree_paths(edges: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """(u, v, d, first, last, mid) for every ordered pair of distinct nodes.

    ``d`` is the number of edges between them, ``first`` the neighbour of u towards v,
    ``last`` the neighbour of v towards u, and ``mid`` the node on the path whose distance
    from u is the largest power of two below d; NULL for neighbours. A tree whose pairs fit
    ``rows`` is walked on the driver, a larger one by joins.
    """
    few = [(r["u"], r["v"]) for r in edges.select("u", "v").limit(math.isqrt(rows)).collect()]
    if (len(few) + 1) ** 2 <= rows:
        return local_table(edges.sparkSession, list(walked_paths(few)), PATH_SCHEMA)
    return paths_by_doubling(edges)


def walked_paths(edges: list[tuple[str, str]]):
    """The rows of ``tree_paths``, by walking away from every node."""
    near: dict[str, list[str]] = {}
    for u, v in edges:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    for u in near:
        todo = [[u, v] for v in near[u]]
        while todo:
            path = todo.pop()
            d = len(path) - 1
            yield {
                "u": u, "v": path[-1], "d": d, "first": path[1], "last": path[-2],
                "mid": path[1 << (d - 1).bit_length() - 1] if d > 1 else None,
            }
            todo += [path + [v] for v in near[path[-1]] if v != path[-2]]


def paths_by_doubling(edges: DataFrame) -> DataFrame:
    """The rows of ``tree_paths``, by joins.

    Path lengths double each round, so the loop runs log2(diameter) times. Two pieces u..m and
    m..v join to a path exactly if they leave m through different neighbours.
    """
    known = directed(edges).select(
        "u", "v", F.lit(1).alias("d"), F.col("v").alias("first"), F.col("u").alias("last"),
        F.lit(None).cast("string").alias("mid"),
    )
    known, reach = settle(known, "paths"), 1
    while True:
        head = known.filter(F.col("d") == reach).select(
            "u", F.col("v").alias("m"), "first", F.col("last").alias("m_in")
        )
        tail = known.select(
            F.col("u").alias("m"), "v", F.col("d").alias("d2"), F.col("first").alias("m_out"), "last"
        )
        longer = head.join(tail, "m").filter("m_in <> m_out").select(
            "u", "v", (F.col("d2") + reach).cast("int").alias("d"), "first", "last",
            F.col("m").alias("mid"),
        )
        longer = settle(longer, "paths")
        if longer.isEmpty():
            return known
        known, reach = known.union(longer), reach * 2


EDGES = pa.schema([("u", pa.string()), ("v", pa.string())])


def subtree(edges: DataFrame, index: TreeIndex, nodes: list[str]) -> DataFrame:
    """Tree edges on the paths between any two of ``nodes``."""
    used = [{"u": u, "v": v} for u, v in index.spanned(nodes)]
    return edges.join(local_table(edges.sparkSession, used, EDGES), ["u", "v"], "left_semi")


def leaf_paths(spark: SparkSession, index: TreeIndex, root: str) -> DataFrame:
    """(leaf, step, parent, child): the directed edges from ``root`` to each leaf.

    The leaves are dealt to tasks, which walk their paths; the rows are as many as the paths are long.
    """
    ends = [{"leaf": x} for x in index.leaves() if x != root]
    shared = broadcast(spark, index)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leaf in batch.column(0).to_pylist():
                path = shared.value.path(root, leaf)
                yield pa.RecordBatch.from_arrays([
                    pa.array([leaf] * (len(path) - 1), pa.string()), pa.array(range(1, len(path)), pa.int32()),
                    pa.array(path[:-1], pa.string()), pa.array(path[1:], pa.string()),
                ], names=["leaf", "step", "parent", "child"])

    leaves = local_table(spark, ends, pa.schema([("leaf", pa.string())]))
    return leaves.mapInArrow(walk, "leaf string, step int, parent string, child string")
