"""Node entropies and pair information from pair counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborinfo.functions.entropy import (
    check_prior,
    entropy_table,
    plugin_entropy,
    posterior_moments,
    posterior_sums,
    pseudocount,
)


def node_table(node_counts: DataFrame, prior: str = "haldane") -> DataFrame:
    """(var, n_obs, k, s, s_pm, s_se)."""
    return entropy_table(node_counts, ["var"], prior)


def with_ends(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Edges joined with node columns of both ends, suffixed _u and _v."""
    for end in ("u", "v"):
        side = nodes.select(F.col("var").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        edges = edges.join(side, end)
    return edges


def plugin_information(pair_counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, n_obs, s_u, s_v, s_uv, i) for every pair."""
    joint = pair_counts.groupBy("u", "v").agg(
        F.sum("n").alias("n_obs"), plugin_entropy("n").alias("s_uv")
    )
    joined = with_ends(joint, nodes, ["s"])
    return joined.select(
        "u", "v", "n_obs", "s_u", "s_v", "s_uv",
        (F.col("s_u") + F.col("s_v") - F.col("s_uv")).alias("i"),
    )


def posterior_information(
    pair_counts: DataFrame, nodes: DataFrame, prior: str = "haldane"
) -> DataFrame:
    """(u, v, s_uv_pm, s_uv_se, i_pm, i_se) for the pairs present in ``pair_counts``.

    The prior lives on occupied(u) x occupied(v). Cells of that product without a count all
    share one parameter, so their number is enough: no product of states is built. ``nodes``
    must be the node table of the same prior.
    """
    check_prior(prior)
    sized = with_ends(pair_counts, nodes, ["k"]).withColumn(
        "_pc", F.expr(pseudocount(prior, "k_u * k_v"))
    )
    sized = sized.withColumn("_n", F.expr("n + _pc"))
    sums = sized.groupBy("u", "v").agg(
        *posterior_sums("_n"),
        F.max("_pc").alias("_pc"),
        F.expr("max(k_u * k_v) - count(1)").alias("_empty"),
    )
    joint = posterior_moments(sums, "s_uv_pm", "s_uv_se", "_pc", "_empty")
    joined = with_ends(joint, nodes, ["s_pm", "s_se"])
    return joined.select(
        "u", "v", "s_uv_pm", "s_uv_se",
        (F.col("s_pm_u") + F.col("s_pm_v") - F.col("s_uv_pm")).alias("i_pm"),
        F.sqrt(
            F.col("s_se_u") * F.col("s_se_u")
            + F.col("s_se_v") * F.col("s_se_v")
            + F.col("s_uv_se") * F.col("s_uv_se")
        ).alias("i_se"),
    )
