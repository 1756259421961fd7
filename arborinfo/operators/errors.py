"""Uncertainty of a tree: leaving variables out, knocking edges out, error terms.

Removing a variable or an edge from the graph keeps every other edge of the maximum spanning
tree. Only the pieces that fall apart must be joined again, by the heaviest graph edges that
cross between them, so no tree is fitted from scratch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborinfo.lineage import broadcast, ship_package
from arborinfo.operators.paths import directed
from arborinfo.operators.spanning import Components
from arborinfo.operators.tree_index import TreeIndex


def off_tree(edges: DataFrame, tree: DataFrame) -> DataFrame:
    return edges.join(tree.select("u", "v"), ["u", "v"], "left_anti").select("u", "v", "i")


class Coverings:
    """Which tree edges and which pieces around a node graph edges are the first to cover.

    Graph edges come by falling weight. A tree edge needs the first one whose path holds it, and a node
    those that join pieces of the tree around it which were not joined before. Both kinds of climbing
    skip what is covered already by compressed links, so all edges together take about as
    many steps as there are edges and nodes.
    """

    def __init__(self, index: TreeIndex):
        self.index = index
        self.parent, self.depth = index.parent.tolist(), index.depth.tolist()
        # The first node at or above each whose edge upwards is open, and the same for pairs of edges.
        self.open_edge, self.open_pair = list(range(len(index))), list(range(len(index)))
        self.pieces: dict[int, Components] = {}

    @staticmethod
    def _find(links: list[int], x: int) -> int:
        top = x
        while links[top] != top:
            top = links[top]
        while links[x] != top:
            links[x], x = top, links[x]
        return top

    def _joins(self, node: int, a: int, b: int) -> bool:
        return self.pieces.setdefault(node, Components()).join(a, b)

    def take(self, ends: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, node, a, b, side) of what each edge of ``ends`` (two rows of numbers) covers first.

        ``node`` is -1 for a tree edge from a to its parent b; ``side`` is then the end of the graph edge
        that lies below a. Else a and b are the neighbours of ``node`` in the pieces that are joined.
        """
        top = self.index.meet(ends[0], ends[1])
        inner = (top >= 0) & (ends[0] != top) & (ends[1] != top)
        branches = np.full_like(ends, -1)
        for side in (0, 1):
            branches[side, inner] = self.index.branch(top[inner], ends[side, inner])
        parent, depth = self.parent, self.depth
        for row, (u, v, z, bu, bv) in enumerate(zip(*ends.tolist(), top.tolist(), *branches.tolist())):
            if z < 0:
                continue
            for side, x in ((0, u), (1, v)):
                y = self._find(self.open_edge, x)
                while depth[y] > depth[z]:
                    yield row, -1, y, parent[y], side
                    self.open_edge[y] = parent[y]
                    y = self._find(self.open_edge, y)
                y = self._find(self.open_pair, x)
                while depth[y] > depth[z] + 1:
                    if self._joins(parent[y], y, parent[parent[y]]):
                        yield row, parent[y], y, parent[parent[y]], side
                    self.open_pair[y] = parent[y]
                    y = self._find(self.open_pair, y)
            if bu >= 0 and self._joins(z, bu, bv):
                yield row, z, bu, bv, 0


COVER = "node string, a string, b string, u string, v string, i double, turned boolean"


def coverings(edges: DataFrame, tree: DataFrame, index: TreeIndex) -> DataFrame:
    """The heaviest graph edges off the tree over tree edges and around nodes.

    Rows (node, a, b, u, v, i, turned). With a null ``node``: u-v is the heaviest one over the tree edge
    a-b, a < b, and ``turned`` tells that v lies on the side of a. Else u-v joins the pieces around
    ``node`` that begin with its neighbours a and b. Each task ranks its own edges and emits at most
    three rows for each variable; an aggregate takes the best of all tasks.
    """
    shared = broadcast(edges.sparkSession, index)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        state = Coverings(index)
        for batch in batches:
            us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ends = np.array([[index.number.get(x, -1) for x in xs] for xs in (us, vs)], np.int64).reshape(2, -1)
            known = np.flatnonzero((ends >= 0).all(axis=0))
            rows = []
            for k, node, a, b, side in state.take(ends[:, known]):
                at = int(known[k])
                names = index.name[a], index.name[b]
                # The end below a is on a's side.
                turned = (side == 1) != (names[0] > names[1])
                rows.append((index.name[node] if node >= 0 else None, min(names), max(names), us[at], vs[at], at, turned))
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [pa.string()] * 5 + [pa.int64(), pa.bool_()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            arrays[5] = batch.column(2).take(arrays[5])
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "a", "b", "u", "v", "i", "turned"])

    ranked = off_tree(edges, tree).sortWithinPartitions(F.desc("i"), "u", "v")
    found = ranked.mapInArrow(cover, COVER)
    best = F.min(F.struct((-F.col("i")).alias("k"), "u", "v", "i", "turned")).alias("e")
    return found.groupBy("node", "a", "b").agg(best).select("node", "a", "b", "e.u", "e.v", "e.i", "e.turned")


def _reconnect(pieces: pd.DataFrame) -> pd.DataFrame:
    groups = Components()
    ranked = pieces.sort_values(["i", "u", "v"], ascending=[False, True, True])
    used = [groups.join(a, b) for a, b in zip(ranked["a"], ranked["b"])]
    return ranked.loc[used, ["node", "u", "v", "i"]]


def replacement_edges(covered: DataFrame) -> DataFrame:
    """(node, u, v, i): the edges that reconnect the tree once ``node`` is left out.

    A graph edge can help only where ``node`` lies inside the tree path between its ends. What
    ``coverings`` lists around a node is a graph of its tree neighbours.
    """
    ship_package(covered.sparkSession)
    around = covered.filter(F.col("node").isNotNull()).select("node", "a", "b", "u", "v", "i")
    return around.groupBy("node").applyInPandas(_reconnect, "node string, u string, v string, i double")


def own_contributions(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """(var, c): plug-in entropy minus half the information of the tree edges at ``var``."""
    ends = directed(tree, "i")
    return (
        nodes.select("var", "s")
        .join(ends.groupBy(F.col("u").alias("var")).agg(F.sum("i").alias("si")), "var", "left")
        .select("var", (F.col("s") - F.coalesce("si", F.lit(0.0)) / 2.0).alias("c"))
    )


def leave_out_changes(tree: DataFrame, covered: DataFrame) -> DataFrame:
    """(node, var, x): how the contribution of ``var`` changes when ``node`` goes.

    Only tree neighbours and ends of reconnecting edges are listed: half of the own edge to the node
    is gained, halves of reconnecting edges are lost.
    """
    ends = directed(tree, "i").select(F.col("u").alias("node"), F.col("v").alias("var"), (F.col("i") / 2.0).alias("x"))
    added = replacement_edges(covered)
    for end in ("u", "v"):
        ends = ends.union(added.select("node", F.col(end).alias("var"), (-F.col("i") / 2.0).alias("x")))
    return ends.groupBy("node", "var").agg(F.sum("x").alias("x"))


def leave_out_entropies(own: DataFrame, changes: DataFrame) -> DataFrame:
    """(node, entropy): plug-in entropy of the tree without each variable, as the sum of contributions."""
    one = F.lit(1).alias("_one")
    total = own.agg(F.sum("c").alias("_t")).select(one, "_t")
    moved = changes.groupBy(F.col("node").alias("var")).agg(F.sum("x").alias("_x"))
    return own.select(one, "*").join(total, "_one").join(moved, "var", "left").select(
        F.col("var").alias("node"), (F.col("_t") - F.col("c") + F.coalesce("_x", F.lit(0.0))).alias("entropy")
    )


def leave_out_contributions(edges: DataFrame, own: DataFrame, changes: DataFrame) -> DataFrame:
    """(node, var, contribution) of every variable in the tree without ``node``.

    ``edges`` lists all pairs of variables.
    """
    pairs = directed(edges).select(F.col("u").alias("node"), F.col("v").alias("var"))
    return pairs.join(own, "var").join(changes, ["node", "var"], "left").select(
        "node", "var", (F.col("c") + F.coalesce("x", F.lit(0.0))).alias("contribution")
    )


def contribution_spread(contributions: DataFrame) -> DataFrame:
    """(var, s_contribution_se): sample standard deviation over the left-out variables."""
    return contributions.groupBy("var").agg(
        F.stddev_samp("contribution").alias("s_contribution_se")
    )


def tree_errors(nodes: DataFrame, tree: DataFrame, leave_out: DataFrame) -> DataFrame:
    """One row: mle_bias, counts_variance, structural_variance, rmse.

    ``nodes`` holds (s, s_pm, s_se), ``tree`` (i, i_pm, i_se), ``leave_out`` (entropy).
    """
    one = F.lit(1).alias("_one")
    n = nodes.agg(
        F.sum(F.col("s") - F.col("s_pm")).alias("nb"), F.sum(F.col("s_se") * F.col("s_se")).alias("nv")
    ).select(one, "nb", "nv")
    e = tree.agg(
        F.sum(F.col("i") - F.col("i_pm")).alias("eb"), F.sum(F.col("i_se") * F.col("i_se")).alias("ev")
    ).select(one, "eb", "ev")
    j = leave_out.agg(F.var_pop("entropy").alias("structural_variance")).select(
        one, "structural_variance"
    )
    out = n.join(e, "_one").join(j, "_one").select(
        (F.col("nb") - F.col("eb")).alias("mle_bias"),
        (F.col("nv") + F.col("ev")).alias("counts_variance"),
        "structural_variance",
    )
    bias = F.col("mle_bias")
    return out.withColumn(
        "rmse", F.sqrt(F.col("structural_variance") + F.col("counts_variance") + bias * bias)
    )


def knockout_bridges(covered: DataFrame) -> DataFrame:
    """(a, b, u, v): for each tree edge a-b the graph edge u-v that replaces it.

    u lies on the side of a. An edge without any other crossing edge is not listed: it stays
    its own replacement.
    """
    return covered.filter(F.col("node").isNull()).select(
        "a", "b", F.when(F.col("turned"), F.col("v")).otherwise(F.col("u")).alias("u"),
        F.when(F.col("turned"), F.col("u")).otherwise(F.col("v")).alias("v"),
    )


def knockout_bridge(edges: DataFrame, index: TreeIndex, a: str, b: str) -> tuple[str, str] | None:
    """The replacement of one tree edge, found among the graph edges alone; its first end is on a's side."""
    below = a if index.parent[index.number[a]] == index.number[b] else b
    k = index.number[below]
    cut = edges.sparkSession.createDataFrame(
        pa.table({"x": index.name[k : index.last[k]]}), schema="x string"
    )
    sides = edges.select("u", "v", "i")
    for end in ("u", "v"):
        inside = cut.select(F.col("x").alias(end), F.lit(True).alias(f"in_{end}"))
        sides = sides.join(inside, end, "left")
    in_u, in_v = (F.col(f"in_{end}").isNotNull() for end in ("u", "v"))
    lo, hi = sorted((a, b))
    crossing = sides.filter((in_u != in_v) & ~((F.col("u") == lo) & (F.col("v") == hi)))
    best = crossing.agg(F.min(F.struct((-F.col("i")).alias("k"), "u", "v", in_u.alias("in_u"))).alias("e")).first()["e"]
    if best is None:
        return None
    return (best["u"], best["v"]) if best["in_u"] == (below == a) else (best["v"], best["u"])


def knockout_joints(
    bridges: DataFrame, conditionals: DataFrame, transfers: DataFrame, node_probabilities: DataFrame
) -> DataFrame:
    """(u, v, xu, xv, p) for tree edges u-v: their joint law in the tree without that edge.

    The path runs u .. bridge start, bridge end .. v; its outer pieces are tree paths that do
    not use u-v, so the implied conditionals of the whole tree serve for them.
    """
    state = ["p"]
    start = node_probabilities.select(
        F.col("var").alias("a"), F.col("state").alias("xa"), *state
    )
    rows = bridges.join(start, "a")
    stay = rows.filter("a = u").withColumn("xu", F.col("xa"))
    move = conditionals.select(
        F.col("u").alias("a"), F.col("v").alias("u"), F.col("xu").alias("xa"), F.col("xv").alias("xu"),
        F.col("p").alias("q"),
    )
    moved = rows.filter("a <> u").join(move, ["a", "u", "xa"]).withColumn("p", F.col("p") * F.col("q"))
    rows = stay.unionByName(moved.drop("q"))
    cross = transfers.withColumnRenamed("p", "q")
    rows = (
        rows.join(cross, ["u", "v", "xu"])
        .groupBy("a", "b", "v", "xa", "xv").agg(F.sum(F.col("p") * F.col("q")).alias("p"))
    )
    stay = rows.filter("v = b").select("a", "b", "xa", F.col("xv").alias("xb"), "p")
    back = conditionals.select(
        F.col("u").alias("v"), F.col("v").alias("b"), F.col("xu").alias("xv"), F.col("xv").alias("xb"),
        F.col("p").alias("q"),
    )
    moved = rows.filter("v <> b").join(back, ["v", "b", "xv"]).select(
        "a", "b", "xa", "xb", (F.col("p") * F.col("q")).alias("p")
    )
    return (
        stay.unionByName(moved).groupBy("a", "b", "xa", "xb").agg(F.sum("p").alias("p"))
        .withColumnsRenamed({"a": "u", "b": "v", "xa": "xu", "xb": "xv"})
    )
