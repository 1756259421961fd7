"""The given tables as inputs of the operators.

Rows of lineitem with their order are joint observations of categorical variables, embeddings
supply angles, points and score arrays, events are state sequences.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborinfo.functions.circular import mean_angle
from arborinfo.operators.mixture import Mixture
from arborinfo.plans.tree import InformationTree

VARIABLES = [
    "l_discount", "l_linenumber", "l_linestatus", "l_returnflag", "l_tax", "o_orderpriority",
    "o_orderstatus",
]
# Names that sort otherwise without their suffix.
RESIDUE_NAMES = ["ALA10_A", "ALA1_A", "GLY3_A", "GLY30_A", "LEU12_A", "LEU1_A", "VAL2_A"]
MANY = [f"{c}{k:02d}" for k, c in enumerate("abcdefghijklmno")]
RESIDUES = 4
FEATURES = 8
COMPONENTS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with the variables of the item and of its order."""
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    joined = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    return joined.select(*VARIABLES)


def many_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen columns of line items and their orders."""
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    joined = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    values = [
        "l_linestatus", "l_returnflag", "l_linenumber", "nullif(l_linenumber, 3)", "-l_linenumber",
        "cast(l_quantity as int)", "o_orderstatus", "o_orderpriority", "nullif(o_orderstatus, 'F')",
        "month(l_shipdate)", "month(o_orderdate)", "cast(year(o_orderdate) as bigint) * 31536000",
        "cast(year(l_shipdate) as bigint) * -4000000000", "cast(l_suppkey % 9 as bigint) - 4", "l_linenumber % 2 = 0",
    ]
    return joined.selectExpr(*[f"{value} AS {name}" for value, name in zip(values, MANY)])


def item_tree(spark: SparkSession, sf_dir: str, **options) -> InformationTree:
    return InformationTree.from_columns(wide_rows(spark, sf_dir), VARIABLES, **options)


def order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, var, state) of three order variables, states being ranks of the first letters."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    code = lambda c, letters: (F.instr(F.lit(letters), F.substring(c, 1, 1)) - 1).cast("int")
    cells = F.array(
        F.struct(F.lit("nation").alias("var"), F.col("c_nationkey").cast("int").alias("state")),
        F.struct(F.lit("priority").alias("var"), code("o_orderpriority", "12345").alias("state")),
        F.struct(F.lit("segment").alias("var"), code("c_mktsegment", "ABFHM").alias("state")),
        F.struct(F.lit("status").alias("var"), code("o_orderstatus", "FOP").alias("state")),
    )
    return rows.select(F.col("o_orderkey").alias("frame"), F.explode(cells).alias("c")).select("frame", "c.*")


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(residue, frame, theta): angles of consecutive component pairs, eight per residue."""
    at = lambda i: F.element_at("embedding", i).cast("double")
    pairs = F.transform(
        F.sequence(F.lit(0), F.lit(RESIDUES * FEATURES - 1)), lambda i: F.atan2(at(2 * i + 2), at(2 * i + 1))
    )
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "label", pairs.alias("t"))
    parts = F.array(
        *[
            F.struct(F.lit(r).alias("residue"), F.slice("t", r * FEATURES + 1, FEATURES).alias("theta"))
            for r in range(RESIDUES)
        ]
    )
    return rows.select("frame", "label", F.explode(parts).alias("p")).select("p.residue", "frame", "p.theta", "label")


def label_means(angle_rows: DataFrame) -> DataFrame:
    """(residue, label, feature, n, mu): mean direction of each feature by label."""
    rows = angle_rows.select("residue", "label", F.posexplode("theta").alias("feature", "x"))
    return rows.groupBy("residue", "label", "feature").agg(
        F.count(F.lit(1)).alias("n"), mean_angle(F.sum(F.cos("x")), F.sum(F.sin("x"))).alias("mu")
    )


def label_mixtures(spark: SparkSession, sf_dir: str) -> dict[int, Mixture]:
    """A fixed starting point: one component per label, at its mean direction."""
    means = label_means(angles(spark, sf_dir)).toPandas().sort_values(["residue", "label", "feature"])
    out = {}
    for residue, part in means.groupby("residue"):
        mu = part["mu"].to_numpy().reshape(-1, FEATURES)
        n = part["n"].to_numpy().reshape(-1, FEATURES)[:, 0]
        kappa = 12.0 + np.arange(len(mu))[:, None] + 0.5 * np.arange(FEATURES)[None, :]
        out[int(residue)] = Mixture(mu, kappa, np.log(n / n.sum()), np.ones(FEATURES, bool))
    return out


ATOMS = ("N", "CA", "C", "O", "CB")
#: Whole residues of points, as many as hold all components of a vector of 64; the first ones come again.
PEPTIDE_RESIDUES = 5
POINTS = PEPTIDE_RESIDUES * len(ATOMS)
LETTERS, SCORED = 11, 6


def component(k):
    """The ``k``-th component of an embedding, counted round."""
    return F.get("embedding", (k % F.size("embedding")).cast("int")).cast("double")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, pos, x, y, z): chains of points from consecutive component triples."""
    triples = F.transform(
        F.sequence(F.lit(0), F.lit(POINTS - 1)),
        lambda i: F.struct(*[component(3 * i + k).alias(n) for k, n in enumerate("xyz")]),
    )
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("frame"), F.posexplode(triples).alias("pos", "p")
    )
    return rows.select("frame", "pos", "p.*")


def peptide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of alanines, from all points of a frame."""
    names = F.array(*[F.lit(a) for a in ATOMS])
    residue = F.floor(F.col("pos") / 5).cast("int")
    return points(spark, sf_dir).select(
        "frame", (F.col("pos") + 1).alias("serial"),
        F.element_at(names, F.col("pos") % 5 + 1).alias("name"), F.lit("ALA").alias("resname"),
        (residue + 1).alias("resseq"), F.lit("A").alias("chain"), residue.alias("residue"),
        "x", "y", "z",
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, residue, s): score arrays of some letters each, from all components of an embedding."""
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(SCORED - 1)),
        lambda r: F.struct(
            r.alias("residue"),
            F.transform(F.sequence(F.lit(0), F.lit(LETTERS - 1)), lambda j: component(LETTERS * r + j)).alias("s"),
        ),
    )
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("frame"), F.explode(parts).alias("p")
    ).select("frame", "p.residue", "p.s")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ts, state): the event types of each user in time."""
    return table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_type").alias("state"))
