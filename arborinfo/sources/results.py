"""Reading saved results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborinfo.operators.mixture import Mixture, mixtures_of_table
from arborinfo.plans.tree import InformationTree


def short_name(name: str):
    return F.regexp_replace(name, "_A$", "")


def turned(pairs: DataFrame, *states: str) -> DataFrame:
    """Rows of pairs (u, v) under short names with u < v; ``states`` change places with them."""
    u, v = short_name("u"), short_name("v")
    out = {"u": F.least(u, v), "v": F.greatest(u, v)}
    if states:
        a, b = states
        out |= {a: F.when(u < v, F.col(a)).otherwise(F.col(b)), b: F.when(u < v, F.col(b)).otherwise(F.col(a))}
    return pairs.withColumns(out)


def load_tree(spark: SparkSession, path: str, prior: str | None = None) -> InformationTree:
    """The tree saved under ``path``; names lose the suffix of a first chain, ``_A``.

    Names without the suffix may sort otherwise, so pairs are turned until u < v again. Names that
    would become equal are refused. Under the saved prior the error terms are the saved ones, not
    computed anew.
    """
    pairs = spark.read.parquet(f"{path}/pair_counts")
    names = pairs.select(F.explode(F.array("u", "v")).alias("name")).distinct()
    old, new = names.agg(F.count("*"), F.count_distinct(short_name("name"))).first()
    if old != new:
        raise ValueError("names of the saved variables become equal without the suffix _A")
    pairs = turned(pairs, "xu", "xv").select("u", "v", "xu", "xv", "n")
    edges = turned(spark.read.parquet(f"{path}/tree_edges")).select("u", "v", "i", "i_pm", "i_se")
    meta = spark.read.parquet(f"{path}/meta")
    saved = meta.select("prior", "estimator").first()
    tree = InformationTree(
        pairs, saved["estimator"], prior or saved["prior"], tree=edges.select("u", "v")
    )
    if tree.prior == saved["prior"]:
        tree.__dict__["tree_edges"] = edges
        tree.__dict__["errors"] = meta.select(
            "mle_bias", "counts_variance", "structural_variance", "rmse"
        )
    return tree


def load_mixtures(spark: SparkSession, path: str) -> dict[int, Mixture]:
    """Parameters saved by ``save_mixtures``."""
    return mixtures_of_table(spark.read.parquet(f"{path}/mixtures/params"))
