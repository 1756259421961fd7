"""States from score arrays of an external sampler."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def argmax(scores: Column) -> Column:
    """Zero-based position of the largest entry, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def logits_to_states(logits: DataFrame) -> DataFrame:
    """(frame, var, state) of (frame, residue, s array<double>)."""
    return logits.select("frame", F.col("residue").cast("string").alias("var"), argmax(F.col("s")).alias("state"))
