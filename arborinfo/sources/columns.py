"""Turning table columns into states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_states(df: DataFrame, frame: str, variables: list[str]) -> DataFrame:
    """(frame, var, state) rows of integer columns; ``frame`` must be a key of ``df``."""
    cells = F.array(
        *[
            F.struct(F.lit(v).alias("var"), F.col(v).cast("int").alias("state"))
            for v in variables
        ]
    )
    return df.select(F.col(frame).alias("frame"), F.explode(cells).alias("c")).select("frame", "c.*")


def state_dictionary(df: DataFrame, variables: list[str]) -> DataFrame:
    """(var, value, n, state): values of each column, numbered from most to least frequent."""
    cells = F.array(
        *[F.struct(F.lit(v).alias("var"), F.col(v).cast("string").alias("value")) for v in variables]
    )
    counts = (
        df.select(F.explode(cells).alias("c")).groupBy("c.var", "c.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rank = Window.partitionBy("var").orderBy(F.desc("n"), "value")
    return counts.withColumn("state", F.row_number().over(rank) - 1)


def encode_states(df: DataFrame, variables: list[str], dictionary: DataFrame) -> DataFrame:
    """Replace the columns ``variables`` by their integer states.

    Each column is an equi-join against its own values, which Spark broadcasts or shuffles by
    their measured size.
    """
    for v in variables:
        values = dictionary.filter(F.col("var") == v).select(
            F.col("value").alias("_value"), F.col("state").alias("_state")
        )
        df = (
            df.join(values, F.col(v).cast("string").eqNullSafe(F.col("_value")))
            .withColumn(v, F.col("_state")).drop("_value", "_state")
        )
    return df
