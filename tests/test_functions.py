import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborinfo.functions import special
from arborinfo.functions.circular import clamp_kappa, kappa_of_resultant, wrap_angle
from arborinfo.functions.entropy import check_estimator, check_prior, entropy_table
from arborinfo.functions.rng import normal, uniform, uniform_array


def bessel(kappa):
    """(A, ln I0) by quadrature."""
    t = (np.arange(200_000) + 0.5) / 200_000 * math.pi
    w = np.exp(kappa * (np.cos(t) - 1))
    return (w * np.cos(t)).sum() / w.sum(), math.log(w.mean()) + kappa


def test_gamma_family(spark):
    x = [0.5, 1.0, 2.5, 10.0, 1e6, 1e12]
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = df.select(
        *[F.expr(getattr(special, n)("x")).alias(n) for n in ("digamma", "trigamma", "lgamma")]
    ).toPandas()
    gamma = 0.5772156649015329
    assert got["digamma"][0] == pytest.approx(-gamma - 2 * math.log(2), abs=1e-12)
    assert got["digamma"][1] == pytest.approx(-gamma, abs=1e-12)
    assert got["digamma"][5] == pytest.approx(math.log(1e12), rel=1e-12)
    assert got["trigamma"][0] == pytest.approx(math.pi**2 / 2, abs=1e-11)
    assert got["trigamma"][1] == pytest.approx(math.pi**2 / 6, abs=1e-12)
    assert list(got["lgamma"]) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)


def test_bessel_family(spark):
    k = [0.5, 3.0, 9.9, 11.9, 12.1, 20.0, 50.0, 599.0]
    truth = [bessel(v) for v in k]
    df = spark.createDataFrame(pd.DataFrame({"k": k}))
    got = df.select(
        F.expr(special.bessel_ratio("k")).alias("a"), F.expr(special.log_i0("k")).alias("l")
    ).toPandas()
    assert list(got["a"]) == pytest.approx([t[0] for t in truth], abs=1e-9)
    assert list(got["l"]) == pytest.approx([t[1] for t in truth], abs=1e-9)


def test_concentration_of_resultant(spark):
    k = [10.0, 11.0, 20.0, 75.0, 300.0, 599.0]
    df = spark.createDataFrame(pd.DataFrame({"r": [bessel(v)[0] for v in k] + [0.0, 0.5, 1.0]}))
    got = kappa_of_resultant(df, "r", "k").toPandas()["k"]
    assert list(got) == pytest.approx(k + [10.0, 10.0, 600.0], rel=1e-6)


def test_wrap_and_clamp(spark):
    x = [-7.0, -math.pi, 0.0, 3.0, math.pi, 4.0, 100.0]
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = df.select(wrap_angle(F.col("x")).alias("w"), clamp_kappa(F.col("x")).alias("k")).toPandas()
    assert np.allclose(np.exp(1j * got["w"]), np.exp(1j * np.array(x)))
    assert ((got["w"] > -math.pi) & (got["w"] <= math.pi + 1e-12)).all()
    assert list(got["k"]) == [10.0] * 6 + [100.0]


def test_posterior_against_sampling(spark):
    alpha = np.array([12, 3, 7, 40, 1])
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "n": alpha}))
    row = entropy_table(df, ["g"]).first()
    p = np.random.default_rng(1).dirichlet(alpha, 400_000)
    s = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
    assert row["s_pm"] == pytest.approx(s.mean(), abs=5e-4)
    assert row["s_se"] == pytest.approx(s.std(), abs=5e-4)


def test_posterior_of_huge_counts(spark):
    n = [3 * 10**11, 7 * 10**11]
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "n": n}))
    row = entropy_table(df, ["g"]).first()
    p = np.array([0.3, 0.7])
    spread = (p * np.log(p) ** 2).sum() - (p * np.log(p)).sum() ** 2
    assert row["s_pm"] == pytest.approx(row["s"], abs=1e-11)
    assert row["s_se"] == pytest.approx(math.sqrt(spread / 1e12), rel=1e-3)


def test_posterior_tends_to_plugin(spark):
    gaps = []
    for scale in (1, 100, 10_000):
        df = spark.createDataFrame(pd.DataFrame({"g": 0, "n": [5 * scale, 3 * scale, 2 * scale]}))
        row = entropy_table(df, ["g"]).first()
        gaps.append(abs(row["s"] - row["s_pm"]))
    assert gaps[0] > gaps[1] > gaps[2] and gaps[2] < 1e-4


def test_validators():
    with pytest.raises(ValueError):
        check_prior("flat")
    with pytest.raises(ValueError):
        check_estimator("nsb")


def test_random_numbers_depend_on_keys_only(spark):
    ids = spark.range(20_000)
    a = ids.repartition(7).select("id", uniform(3, F.col("id"), "x").alias("u")).toPandas()
    b = ids.repartition(2).select("id", uniform(3, F.col("id"), "x").alias("u")).toPandas()
    a, b = a.sort_values("id"), b.sort_values("id")
    assert list(a["u"]) == list(b["u"])
    assert abs(a["u"].mean() - 0.5) < 0.01 and a["u"].between(0, 1).all()
    z = ids.select(normal(3, F.col("id")).alias("z")).toPandas()["z"]
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03
    u = uniform_array(1, 2, np.arange(20_000))
    assert (u > 0).all() and (u <= 1).all() and abs(u.mean() - 0.5) < 0.01


def psi(x, order=0):
    """Digamma (or trigamma) by recurrence and series, for arrays."""
    x, out = np.asarray(x, float), 0.0
    for _ in range(12):
        out = out + (-1 / x if order == 0 else 1 / x**2)
        x = x + 1
    if order == 0:
        return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return out + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7)


def nsb_by_sums(n, k):
    """Mean and deviation of the entropy on a very fine grid of concentrations."""
    from math import lgamma

    n = np.concatenate([n, np.zeros(k - len(n))])
    value, times = np.unique(n, return_counts=True)
    t = np.arange(-25, 25, 0.02)
    log = np.empty(len(t))
    mean, square = np.empty(len(t)), np.empty(len(t))
    for j, b in enumerate(np.exp(t)):
        a = value + b
        total = n.sum() + k * b
        log[j] = lgamma(k * b) - lgamma(total) + sum(m * (lgamma(x) - lgamma(b)) for x, m in zip(a, times)) + t[j]
        log[j] += np.log(max(k * psi(k * b + 1, 1) - psi(b + 1, 1), 1e-300))
        p = psi(a + 1)
        mean[j] = psi(total + 1) - (times * a * p).sum() / total
        spread = (times * a * p * p).sum() / total - ((times * a * p).sum() / total) ** 2
        var = spread / (total + 1) + (times * a * (a + 1) * psi(a + 1, 1)).sum() / (total * (total + 1)) - psi(total + 1, 1)
        square[j] = var + mean[j] ** 2
    w = np.exp(log - log.max())
    s = (w * mean).sum() / w.sum()
    return s, np.sqrt((w * square).sum() / w.sum() - s**2)


def test_nsb_entropy(spark):
    from arborinfo.functions.nsb import nsb_entropy

    rng = np.random.default_rng(5)
    cases = {
        "few": ([3, 1, 1], 3), "unseen": ([5, 2, 1], 40), "once": ([1, 1, 1, 1], 100), "even": ([10**6] * 4, 4),
        "one": ([7], 1), "sure": ([50], 5), "wide": (rng.multinomial(3000, rng.dirichlet(np.ones(800))), 800),
        "large": ([10**9, 2 * 10**9, 10**7], 3),
    }
    rows = [(g, f"s{i}", int(n), k) for g, (ns, k) in cases.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "g string, state string, n long, k int")
    got = {r["g"]: (r["s_nsb"], r["s_nsb_se"]) for r in nsb_entropy(df, ["g"], "k").collect()}
    assert got.pop("one") == (0.0, 0.0) and len(got) == len(cases) - 1
    for g, (s, se) in got.items():
        mean, sd = nsb_by_sums(np.array(cases[g][0], float), cases[g][1])
        # Posterior deviations of 1e-5 are differences of nearly equal squares in the sums here.
        assert s == pytest.approx(mean, abs=2e-6), g
        assert se == pytest.approx(sd, abs=2e-5), g
    plain = nsb_entropy(df.filter("g = 'few'"), ["g"]).head()
    assert plain["s_nsb"] == pytest.approx(got["few"][0], abs=1e-9)
    assert nsb_entropy(df.limit(0), ["g"]).count() == 0
