"""Dwell times of a state sequence and the block jackknife built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborinfo.functions.entropy import (
    posterior_mean_square,
    posterior_moments,
    posterior_sums,
    posterior_terms,
)

# Pieces that a long sequence is cut into, and the rows from which one counts as long.
CHUNKS = 200
WHOLE_ROWS = 100_000


def with_previous(sequence: DataFrame, by: list[str], order: str, chunks: int = CHUNKS) -> DataFrame:
    """(by..., state, previous, pos): each row with the state before it and its position.

    ``order`` is unique within a sequence. A sequence of any length is cut at its own quantiles into
    up to ``chunks`` pieces of about equal size, wherever its rows lie; lags and positions are
    taken within pieces, and a table with one row per piece carries the last state and the
    running count from one to the next, so no sequence has to fit one task.
    """
    kind = dict(sequence.dtypes)[order]
    at = F.col(order)
    if kind == "timestamp":
        at = F.unix_micros(at)
    elif kind == "timestamp_ntz":
        at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at)
    rows = sequence.select(*by, "state", at.alias("_at"))
    cuts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.percentile_approx("_at", [k / chunks for k in range(1, chunks)] or [0.5], 20 * chunks).alias("_q"),
    )
    # Sequences that fit a task stay whole.
    cuts = cuts.select(*by, F.when(F.col("_rows") > WHOLE_ROWS, F.col("_q")).otherwise(F.array()).alias("_cuts"))
    lower = F.size(F.filter("_cuts", lambda c: c < F.col("_at")))
    rows = rows.join(cuts, by).select(*by, "state", "_at", lower.alias("_piece"))
    piece = [*by, "_piece"]
    ends = rows.groupBy(*piece).agg(
        F.count(F.lit(1)).alias("_n"), F.max_by("state", "_at").alias("_last")
    )
    along = Window.partitionBy(*by).orderBy("_piece")
    carried = ends.select(
        *piece, F.lag("_last").over(along).alias("_carry"),
        (F.sum("_n").over(along) - F.col("_n")).alias("_offset"),
    )
    within = Window.partitionBy(*piece).orderBy("_at")
    local = rows.select(
        *piece, "state", F.lag("state").over(within).alias("_lag"), F.row_number().over(within).alias("_row")
    )
    return local.join(carried, piece).select(
        *by, "state",
        F.when(F.col("_row") == 1, F.col("_carry")).otherwise(F.col("_lag")).alias("previous"),
        (F.col("_offset") + F.col("_row")).alias("pos"),
    )


def indicator_changes(sequence: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by..., state, pos): positions at which the indicator of ``state`` has flipped.

    Going from one state to another flips the indicators of both, so one lag over the sequence
    serves all states.
    """
    steps = with_previous(sequence, by, order).filter("previous is not null and previous <> state")
    return steps.select(*by, "pos", F.explode(F.array("previous", "state")).alias("state"))


def mean_gaps(sequence: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by..., state, gap): mean distance between successive flips of each state's indicator.

    The gaps between flips add up to the distance from the first to the last one. NULL with
    fewer than two flips.
    """
    flips = indicator_changes(sequence, by, order)
    return flips.groupBy(*by, "state").agg(
        F.try_divide(F.max("pos") - F.min("pos"), F.count(F.lit(1)) - 1).alias("gap")
    )


def block_jackknife(sequence: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by..., s_se): per state, the posterior entropy with that state's count reduced by its
    mean gap; the spread of these replicates' moments.

    A count that has nothing left, or a state without a gap, is set to 1. Posterior sums are
    additive over states, so a replicate is the whole sum with one term exchanged.
    """
    counts = sequence.groupBy(*by, "state").agg(F.count(F.lit(1)).cast("double").alias("n"))
    reduced = F.col("n") - F.col("gap")
    cells = counts.join(mean_gaps(sequence, by, order), [*by, "state"], "left").withColumn(
        "m", F.when(reduced > 0, reduced).otherwise(1.0)
    )
    totals = counts.groupBy(*by).agg(*posterior_sums("n"))
    old, new = posterior_terms("n"), posterior_terms("m")
    swapped = cells.join(totals, by).select(
        *by, "state", *[F.expr(f"{k} - {old[k]} + {new[k]}").alias(k) for k in old]
    )
    moments = posterior_moments(swapped, "mean", "sd")
    out = moments.groupBy(*by).agg(
        F.avg("mean").alias("mean"),
        F.avg(posterior_mean_square(F.col("mean"), F.col("sd"))).alias("sq"),
    )
    spread = F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(0.0))
    return out.select(*by, F.sqrt(spread).alias("s_se"))
