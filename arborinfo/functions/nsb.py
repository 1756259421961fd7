"""The entropy under a mixture of Dirichlet priors that is flat in the expected entropy.

For counts n_i of K states with the sum N, a symmetric Dirichlet prior of concentration b has the evidence

    G(K b) / G(N + K b) * prod G(n_i + b) / G(b)        (G: gamma function)

and the density K psi1(K b + 1) - psi1(b + 1) of b makes the prior of the expected entropy flat. The
estimate is the mean of the posterior entropy over b. States of equal counts add equal terms, so
everything is a sum over a table of counts of counts, times the points of a grid in t = ln b. A coarse grid
finds the peak and its width in each group; the integral is then a trapezoid sum in u with t = c + s sinh(u),
whose points are dense at the peak and reach far into both tails, whatever the number of states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborinfo.functions.entropy import posterior_moments, posterior_terms
from arborinfo.functions.special import lgamma, trigamma
from arborinfo.lineage import settle

#: Range and step of ln b on the coarse grid; reach and points of the fine one.
LOWEST, HIGHEST, STEP = -25.0, 25.0, 0.5
REACH, POINTS = 40.0, 256


def counts_of_counts(counts: DataFrame, by: list[str], cells: str | None = None) -> DataFrame:
    """(by..., n, m, total, k): how many of the ``k`` states of a group have the count n.

    ``cells`` names a column with the number of possible states; without it the listed states are all.
    """
    plain = counts.select(*by, F.col("n").cast("double").alias("n"), *([F.col(cells).alias("_k")] if cells else []))
    table = plain.groupBy(*by, "n").agg(F.count(F.lit(1)).cast("double").alias("m"), *([F.max("_k").alias("_k")] if cells else []))
    listed = F.sum("m")
    sums = table.groupBy(*by).agg(
        F.sum(F.col("n") * F.col("m")).alias("total"), listed.alias("_listed"),
        (F.greatest(listed, F.max("_k").cast("double")) if cells else listed).alias("k"),
    )
    unseen = sums.filter("k > _listed").select(*by, F.lit(0.0).alias("n"), (F.col("k") - F.col("_listed")).alias("m"))
    return table.select(*by, "n", "m").unionByName(unseen).join(sums.drop("_listed"), by)


def log_evidence(points: DataFrame, by: list[str]) -> DataFrame:
    """One row for each (by..., place) of ``points``, rows of counts of counts at ln b = t.

    Adds ``l``, the log of evidence times density of t, and the sums behind the posterior moments at b.
    """
    rows = points.withColumn("_b", F.exp("t")).withColumn("_x", F.col("n") + F.col("_b"))
    terms = {k: F.expr(f"sum(m * ({x}))") for k, x in posterior_terms("_x").items()}
    likely = F.expr(f"sum(m * ({lgamma('_x')} - {lgamma('_b')}))")
    summed = rows.groupBy(*by, "place", "t", "total", "k").agg(likely.alias("_l"), *[v.alias(k) for k, v in terms.items()])
    b = summed.withColumn("_b", F.exp("t")).withColumn("_kb", F.col("k") * F.col("_b"))
    density = F.expr(f"k * {trigamma('_kb + 1D')} - {trigamma('_b + 1D')}")
    total = F.expr(f"_l + {lgamma('_kb')} - {lgamma('total + _kb')} + t")
    return b.withColumn("l", F.when(density > 0, total + F.log(density))).drop("_l", "_b", "_kb")


def nsb_entropy(counts: DataFrame, by: list[str], cells: str | None = None) -> DataFrame:
    """(by..., s_nsb, s_nsb_se) of a count table with column ``n``, in nats.

    Mean and standard deviation of the entropy under the mixture. A group of one possible state has
    the entropy 0.
    """
    table = settle(counts_of_counts(counts, by, cells), "counts")
    varied = table.filter("k > 1")
    steps = round((HIGHEST - LOWEST) / STEP)
    coarse = varied.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn(
        "t", LOWEST + STEP * F.col("place")
    )
    along = Window.partitionBy(*by).orderBy("place")
    known = log_evidence(coarse, by).select(
        *by, "t", "l", F.lag("l").over(along).alias("_low"), F.lead("l").over(along).alias("_high")
    )
    best = known.groupBy(*by).agg(F.max_by(F.struct("t", "l", "_low", "_high"), "l").alias("p"))
    bend = 2.0 * F.col("p.l") - F.col("p._low") - F.col("p._high")
    bent = bend > STEP * STEP / 9.0
    width = F.coalesce(F.when(bent, STEP / F.sqrt(bend)), F.lit(3.0))
    shift = F.coalesce(F.when(bent, (F.col("p._high") - F.col("p._low")) * (STEP / 2.0) / bend), F.lit(0.0))
    peaks = settle(best.select(*by, (F.col("p.t") + F.greatest(F.least(shift, F.lit(STEP)), F.lit(-STEP))).alias("c"), width.alias("s")), "peaks")

    u = F.asinh(REACH / F.col("s")) * (F.col("place") * (2.0 / POINTS) - 1.0)
    fine = peaks.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(POINTS)))).select(
        *by, "place", (F.col("c") + F.col("s") * F.sinh(u)).alias("t"), (F.col("s") * F.cosh(u)).alias("_dt")
    ).filter(F.col("t").between(LOWEST - 5.0, HIGHEST + 5.0))
    at = posterior_moments(log_evidence(varied.join(fine, by), by), "mean", "sd").join(
        fine.select(*by, "place", "_dt"), [*by, "place"]
    )
    top = F.max("l").over(Window.partitionBy(*by))
    weighed = at.withColumn("_w", F.coalesce(F.exp(F.col("l") - top) * F.col("_dt"), F.lit(0.0)))
    w, mean, sd = F.col("_w"), F.col("mean"), F.col("sd")
    done = weighed.groupBy(*by).agg(
        (F.sum(w * mean) / F.sum(w)).alias("s_nsb"), (F.sum(w * (sd * sd + mean * mean)) / F.sum(w)).alias("_sq")
    ).select(*by, "s_nsb", F.sqrt(F.greatest(F.col("_sq") - F.col("s_nsb") * F.col("s_nsb"), F.lit(0.0))).alias("s_nsb_se"))
    single = table.filter("k <= 1").select(*by, F.lit(0.0).alias("s_nsb"), F.lit(0.0).alias("s_nsb_se")).distinct()
    return done.unionByName(single)
