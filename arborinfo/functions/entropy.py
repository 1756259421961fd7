"""Entropy estimators as aggregate expressions (nats).

Every estimator reduces to plain sums over count rows, so Spark combines them map-side and
one shuffle of partial sums is all that moves. With a_i the Dirichlet parameters and A their
sum, the posterior of the entropy has

    mean = psi(A+1) - sum a psi(a+1) / A
    var  = V / (A+1) + sum a (a+1) psi1(a+1) / (A (A+1)) - psi1(A+1)

where V is the a-weighted variance of psi(a+1). This is the K x K double sum of the usual
second moment in linear form; unlike ``E[S^2] - E[S]^2`` it does not lose all its digits when
A is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborinfo.functions.special import digamma, lgamma, trigamma, xlogx

ESTIMATORS = ("bayes", "mle")
PRIORS = ("haldane", "laplace", "jeffreys", "percs")


def check_estimator(estimator: str) -> str:
    if estimator not in ESTIMATORS:
        raise ValueError(f"estimator must be one of {ESTIMATORS}, got {estimator!r}")
    return estimator


def check_prior(prior: str) -> str:
    if prior not in PRIORS:
        raise ValueError(f"prior must be one of {PRIORS}, got {prior!r}")
    return prior


def pseudocount(prior: str, cells: str) -> str:
    """SQL for the count added to each of ``cells`` possible cells."""
    check_prior(prior)
    if prior == "percs":
        return f"(1D / ({cells}))"
    return {"haldane": "0D", "jeffreys": "0.5D", "laplace": "1D"}[prior]


def plugin_entropy(n: str) -> Column:
    """Aggregate: plug-in entropy of the counts (or weights) ``n`` of a group."""
    n = f"CAST({n} AS DOUBLE)"
    return F.expr(f"ln(sum({n})) - sum({xlogx(n)}) / sum({n})")


def posterior_terms(a: str) -> dict[str, str]:
    """SQL for what one cell of parameter ``a`` adds to the sums behind the posterior moments."""
    psi = digamma(f"{a} + 1D")
    return {
        "_a": a,
        "_ap": f"{a} * {psi}",
        "_app": f"{a} * {psi} * {psi}",
        "_at": f"{a} * ({a} + 1D) * {trigamma(f'{a} + 1D')}",
    }


def posterior_sums(a: str) -> list[Column]:
    """Aggregates that determine the posterior moments for Dirichlet parameters ``a``.

    ``a`` is the name of a double column.
    """
    return [F.expr(f"sum({x})").alias(k) for k, x in posterior_terms(a).items()]


def posterior_moments(
    df: DataFrame, mean: str, sd: str, a: str | None = None, copies: str | None = None
) -> DataFrame:
    """Replace the columns of ``posterior_sums`` by posterior mean and standard deviation.

    ``copies`` further cells of parameter ``a`` each (column names) are added in closed form;
    this is how unoccupied cells enter without being written out.
    """
    if a is not None:
        df = df.withColumns({k: F.expr(f"{k} + {copies} * {x}") for k, x in posterior_terms(a).items()})
    spread = "greatest(_app / _a - (_ap / _a) * (_ap / _a), 0D)"
    variance = f"{spread} / (_a + 1D) + _at / (_a * (_a + 1D)) - {trigamma('_a + 1D')}"
    return df.withColumns(
        {
            mean: F.expr(f"{digamma('_a + 1D')} - _ap / _a"),
            sd: F.expr(f"sqrt(greatest({variance}, 0D))"),
        }
    ).drop("_a", "_ap", "_app", "_at")


def entropy_table(counts: DataFrame, by: list[str], prior: str = "haldane") -> DataFrame:
    """(by..., n_obs, k, s, s_pm, s_se) of a count table with column ``n``.

    ``prior`` adds its pseudocount to the occupied cells of each group.
    """
    check_prior(prior)
    if prior == "percs":
        sizes = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_k"))
        counts = counts.join(sizes, by)
    counts = counts.withColumn("_n", F.expr(f"CAST(n AS DOUBLE) + {pseudocount(prior, '_k')}"))
    sums = counts.groupBy(*by).agg(
        F.sum("n").alias("n_obs"), F.count(F.lit(1)).alias("k"), plugin_entropy("n").alias("s"),
        *posterior_sums("_n"),
    )
    return posterior_moments(sums, "s_pm", "s_se")


def posterior_mean_square(mean: Column, sd: Column) -> Column:
    """Posterior mean of the squared entropy."""
    return mean * mean + sd * sd


def cells_with_margins(pair_counts: DataFrame) -> DataFrame:
    """Pair counts plus the margins n_u, n_v and the total of each pair, as doubles."""
    key = ["u", "v"]
    left = pair_counts.groupBy(*key, "xu").agg(F.sum("n").cast("double").alias("n_u"))
    right = pair_counts.groupBy(*key, "xv").agg(F.sum("n").cast("double").alias("n_v"))
    total = left.groupBy(*key).agg(F.sum("n_u").alias("total"))
    return pair_counts.join(left, [*key, "xu"]).join(right, [*key, "xv"]).join(total, key)


def fixed_beta_information(pair_counts: DataFrame, beta: float) -> DataFrame:
    """Mutual information with Dirichlet(beta p(v)) rows of v given u, at a fixed ``beta``.

    For each pair, H(v) minus the posterior mean of H(v | u). A cell of zero count still has
    parameter beta p(v); its term is the one every row shares, so occupied cells carry only
    the difference from it and no zero cell is written out.
    """
    b = f"{float(beta)!r}D"
    cells = cells_with_margins(pair_counts).withColumn("_q", F.expr(f"{b} * n_v / total"))
    cells = cells.withColumn("_g", F.expr("_q + n"))
    cells = cells.withColumn("_b", F.expr(f"_q * {digamma('_q + 1D')}"))
    cells = cells.withColumn("_d", F.expr(f"_g * {digamma('_g + 1D')} - _b"))
    shared = (
        cells.select("u", "v", "xv", "n_v", "_b").distinct().groupBy("u", "v")
        .agg(F.sum("_b").alias("_base"), plugin_entropy("n_v").alias("s_v"))
    )
    rows = cells.groupBy("u", "v", "xu", "n_u", "total").agg(F.sum("_d").alias("_d"))
    rows = rows.join(shared, ["u", "v"])
    conditional = F.expr(
        f"n_u / total * ({digamma(f'n_u + {b} + 1D')} - (_base + _d) / (n_u + {b}))"
    )
    return rows.groupBy("u", "v", "s_v").agg(F.sum(conditional).alias("_h")).select(
        "u", "v", F.expr("s_v - _h").alias("i_beta")
    )


def fixed_beta_log_likelihood(
    pair_counts: DataFrame, beta: float, log_prior: float = 0.0
) -> DataFrame:
    """Marginal log-likelihood of the rows of v given u under Dirichlet(beta p(v))."""
    b = f"{float(beta)!r}D"
    cells = cells_with_margins(pair_counts).withColumn("_q", F.expr(f"{b} * n_v / total"))
    cells = cells.withColumn("_g", F.expr("_q + n"))
    rows = cells.groupBy("u", "v", "xu", "n_u").agg(
        F.expr(f"sum({lgamma('_g')} - {lgamma('_q')})").alias("_c")
    )
    rows = rows.withColumn("_f", F.expr(f"n_u + {b}"))
    return rows.groupBy("u", "v").agg(
        F.expr(f"sum({lgamma(b)} - {lgamma('_f')} + _c) + {float(log_prior)!r}D").alias("log_likelihood")
    )
