"""Saving results as Parquet, one dataset per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborinfo.operators import em
from arborinfo.plans.fit import AngleFit
from arborinfo.plans.tree import InformationTree


def vertex_table(tree: InformationTree) -> DataFrame:
    """(var, n_obs, k, s, s_pm, s_se, s_bias_mle, s_contribution_se)."""
    nodes = tree.nodes.withColumn("s_bias_mle", F.col("s") - F.col("s_pm"))
    return nodes.join(tree.contribution_spread(), "var", "left")


def tree_edge_table(tree: InformationTree) -> DataFrame:
    """(u, v, i, i_pm, i_se, i_bias_mle)."""
    return tree.tree_edges.withColumn("i_bias_mle", F.col("i") - F.col("i_pm"))


def meta_table(tree: InformationTree, attributes: dict[str, str] | None = None) -> DataFrame:
    """One row: the scalars of the tree and how it was made."""
    one = F.lit(1).alias("_one")
    row = tree.summary().select(one, "*").join(tree.errors.select(one, "*"), "_one").drop("_one")
    # An empty map still needs its type.
    pairs = [F.lit(x) for kv in (attributes or {}).items() for x in map(str, kv)]
    extra = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    n_obs = tree.nodes.agg(F.max("n_obs").alias("n_obs")).select(one, "n_obs")
    return row.select(one, "*").join(n_obs, "_one").drop("_one").withColumns(
        {"prior": F.lit(tree.prior), "estimator": F.lit(tree.estimator), "attributes": extra}
    )


def save_tree(
    tree: InformationTree, path: str, mode: str = "errorifexists",
    attributes: dict[str, str] | None = None,
) -> None:
    """Write vertices, node and pair counts, edges of tree and graph, and the scalars."""
    for name, table in {
        "meta": meta_table(tree, attributes),
        "vertices": vertex_table(tree),
        "node_counts": tree.node_counts,
        "tree_edges": tree_edge_table(tree),
        "graph_edges": tree.edges,
        "pair_counts": tree.pair_counts,
    }.items():
        table.write.mode(mode).parquet(f"{path}/{name}")


def save_clustering(run: AngleFit, path: str, mode: str = "errorifexists") -> None:
    """Write component memberships, distances, eps and assigned states."""
    for name in ("membership", "distances", "eps", "states"):
        getattr(run, name).write.mode(mode).parquet(f"{path}/clustering/{name}")


def save_mixtures(fit: em.Fit, path: str, mode: str = "errorifexists") -> None:
    """Write mixture parameters and the trace of their fit; responsibilities follow from them."""
    em.parameter_table(fit.table.state).write.mode(mode).parquet(f"{path}/mixtures/params")
    fit.table.trace.write.mode(mode).parquet(f"{path}/mixtures/trace")
