"""Pair counts kept up to date by a stream of joint observations.

Counts are sums, so the batch tree works on them unchanged. The state of the stream has one
row per distinct joint state, or per occupied cell, and does not grow with the rows seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborinfo.operators.pairs import pair_cells


def streaming_pair_counts(rows: DataFrame, variables: list[str]) -> DataFrame:
    """(u, v, xu, xv, n) over all rows so far, for ``update`` or ``complete`` output."""
    return rows.select(F.explode(pair_cells(variables)).alias("p")).groupBy(
        "p.u", "p.v", "p.xu", "p.xv"
    ).agg(F.count(F.lit(1)).alias("n"))
