import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborinfo.operators import cluster, em, mixture
from arborinfo.plans.fit import fit_angles
from tests import brute

CENTRES = np.array([[0.0, 2.0], [2.5, -1.0], [-2.0, 0.5]])
KAPPA = 60.0


def angles_of(hidden, seed):
    rng = np.random.default_rng(seed)
    return rng.vonmises(CENTRES[hidden], KAPPA)


@pytest.fixture(scope="module")
def hidden():
    rng = np.random.default_rng(3)
    first = rng.choice(3, 1500, p=[0.5, 0.3, 0.2])
    copy = np.where(rng.random(1500) < 0.9, first, rng.integers(0, 3, 1500))
    return np.stack([first, copy, rng.integers(0, 3, 1500)])


@pytest.fixture(scope="module")
def theta(hidden):
    return np.stack([angles_of(h, i) for i, h in enumerate(hidden)])


@pytest.fixture(scope="module")
def angles(spark, theta):
    rows = [
        (r, f, [float(x) for x in theta[r, f]]) for r in range(3) for f in range(theta.shape[1])
    ]
    return spark.createDataFrame(rows, "residue int, frame long, theta array<double>").repartition(6)


@pytest.fixture(scope="module")
def start(angles):
    return mixture.initial_mixtures(angles, mixture.mask_table(angles), 6, seed=1, tight=0)


@pytest.fixture(scope="module")
def fit(angles, start):
    return em.fit_mixtures(angles, start, atol=1e-3)


def log_density(theta, m):
    out = np.zeros((len(theta), len(m.mu)))
    for k in range(len(m.mu)):
        for j in range(theta.shape[1]):
            if m.mask[j]:
                out[:, k] += m.kappa[k, j] * np.cos(theta[:, j] - m.mu[k, j])
                out[:, k] -= np.log(2 * math.pi * np.i0(m.kappa[k, j]))
    return out


def softmax(x):
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_seeds_are_data_rows_and_repeatable(angles, start, theta):
    again = mixture.initial_mixtures(angles.repartition(2), mixture.mask_table(angles), 6, seed=1, tight=0)
    for r, m in start.items():
        assert np.array_equal(m.mu, again[r].mu) and np.array_equal(m.kappa, again[r].kappa)
        for centre in m.mu:
            assert (np.abs(theta[r] - centre).max(axis=1) < 1e-12).any()
        assert len({tuple(c) for c in m.mu}) == 6
        assert ((m.kappa >= 25) & (m.kappa <= 50)).all()


def test_seeding_with_fewer_points_than_centres(spark):
    df = spark.createDataFrame([(0, i, [1.0 + i % 2, 2.0]) for i in range(6)], "residue int, frame long, theta array<double>")
    centres = mixture.seed_centres(df, [0], 4, seed=2)[0]
    assert centres.shape == (4, 2)


def test_responsibilities(angles, start, theta):
    m = start[1]
    m.mask = np.array([True, True])
    got = mixture.responsibilities(angles, start).filter("residue = 1").toPandas().sort_values("frame")
    want = softmax(log_density(theta[1], m) + m.logw)
    assert np.allclose(np.stack(got["r"]), want, atol=1e-10)


def test_masked_features_do_not_count(angles, start, theta):
    m = {0: mixture.Mixture(start[0].mu, start[0].kappa, start[0].logw, np.array([True, False]))}
    got = mixture.responsibilities(angles, m).toPandas().sort_values("frame")
    assert np.allclose(np.stack(got["r"]), softmax(log_density(theta[0], m[0]) + m[0].logw), atol=1e-10)


def test_one_step_of_expectation_maximization(angles, start, theta):
    masks = mixture.mask_table(angles)
    rows = mixture.maximization(mixture.expectation_sums(angles, start))
    new, likelihood = mixture.collect_mixtures(rows, masks)
    m = start[2]
    log = log_density(theta[2], m) + m.logw
    r = softmax(log)
    top = log.max(axis=1)
    assert likelihood[2] == pytest.approx((top + np.log(np.exp(log - top[:, None]).sum(axis=1))).mean())
    z = r.T @ np.exp(1j * theta[2])
    assert np.allclose(np.exp(1j * new[2].mu), np.exp(1j * np.angle(z)), atol=1e-9)
    w = r.sum(axis=0)
    assert np.allclose(new[2].logw, np.log(w / w.max()), atol=1e-9)
    # No concentration in range explains the angles better.
    for k in range(6):
        length = np.abs(z[k]) / w[k]
        grid = np.linspace(10, 600, 20_000)
        best = [grid[np.argmax(x * grid - np.log(np.i0(grid)))] for x in length]
        assert np.allclose(new[2].kappa[k], best, atol=0.05)


def test_likelihood_never_falls(fit):
    trace = pd.DataFrame(fit.trace)
    for _, part in trace.groupby("residue"):
        ll = part.sort_values("iter")["ll"].to_numpy()
        assert (np.diff(ll) > -1e-9).all()
        assert part["converged"].iloc[-1] and not part["converged"].iloc[:-1].any()


def test_warm_start_is_already_there(angles, fit):
    again = em.fit_mixtures(angles, fit.mixtures, atol=1e-2)
    assert max(r["iter"] for r in again.trace) == 1


def test_parameter_groups_hold_everything(start, monkeypatch):
    monkeypatch.setattr(mixture, "PARAMETER_BUDGET", start[0].nbytes + 1)
    assert mixture.parameter_groups(start) == [[0], [1], [2]]


def test_fit_in_groups_is_the_same(angles, start, monkeypatch):
    whole = em.fit_mixtures(angles, start, max_iter=2)
    monkeypatch.setattr(mixture, "PARAMETER_BUDGET", 1)
    parts = em.fit_mixtures(angles, start, max_iter=2)
    for r in start:
        assert np.allclose(whole.mixtures[r].mu, parts.mixtures[r].mu, atol=1e-9)


def test_passes_in_groups_and_small_memory(angles, fit, monkeypatch):
    key = lambda df: {(r["residue"], r["i"], r["j"]): r["c"] for r in df.collect()}
    whole = key(cluster.component_overlap(angles, fit.mixtures))
    members = angles.sparkSession.createDataFrame(
        [(r, c, c // 2) for r in range(3) for c in range(6)], "residue int, comp int, state int"
    )
    states = lambda: sorted(map(tuple, cluster.assign_states(angles, fit.mixtures, members).collect()))
    before = states()
    monkeypatch.setattr(mixture, "PARAMETER_BUDGET", 1)
    assert key(cluster.component_overlap(angles, fit.mixtures)) == pytest.approx(whole, abs=1e-9)
    assert states() == before
    assert mixture.responsibilities(angles, fit.mixtures).count() == 4500
    again = mixture.initial_mixtures(angles, mixture.mask_table(angles), 3, seed=1, tight=0)
    monkeypatch.undo()
    first = mixture.initial_mixtures(angles, mixture.mask_table(angles), 3, seed=1, tight=0)
    assert all(np.array_equal(first[r].mu, again[r].mu) for r in range(3))


def test_tables_of_parameters(spark, fit):
    table = mixture.mixtures_table(spark, fit.mixtures)
    back = mixture.mixtures_of_table(table)
    assert np.array_equal(back[0].kappa, fit.mixtures[0].kappa)
    assert mixture.held_params(mixture.feature_rows(table)).count() == 3 * 6 * 2
    flipped = table.withColumn("comp", 5 - F.col("comp"))
    order = mixture.sort_by_weight(flipped).orderBy("residue", "comp").toPandas()
    for _, part in order.groupby("residue"):
        assert (np.diff(part["logw"]) <= 1e-12).all()


def test_overlap_and_distances(angles, fit, theta):
    overlap = cluster.component_overlap(angles, fit.mixtures)
    got = cluster.component_distances(overlap).filter("residue = 0").toPandas()
    r = softmax(log_density(theta[0], fit.mixtures[0]) + fit.mixtures[0].logw)
    c = np.sqrt(r).T @ np.sqrt(r)
    want = 1 - c / np.sqrt(np.outer(np.diag(c), np.diag(c)))
    d = np.zeros((6, 6))
    d[got["i"], got["j"]] = got["d"]
    np.fill_diagonal(want, 0.0)
    assert np.allclose(d, want, atol=1e-10)
    eps = {x["residue"]: x["eps"] for x in cluster.eps_of_spread(cluster.component_distances(overlap)).collect()}
    assert eps[0] == pytest.approx(1 - want[np.triu_indices(6)].std())


def test_clustering_against_brute_force(spark):
    rng = np.random.default_rng(8)
    distances, weights, want = [], [], {}
    for key in range(12):
        x = rng.random((14, 2))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        w = rng.dirichlet(np.ones(14))
        eps, mass = 0.12 + 0.02 * key, 0.12
        want[key] = brute.dbscan(d, w, eps, mass)
        distances += [(key, i, j, float(d[i, j]), eps) for i in range(14) for j in range(14)]
        weights += [(key, i, float(w[i])) for i in range(14)]
    d = spark.createDataFrame(distances, "residue int, i int, j int, d double, eps double")
    w = spark.createDataFrame(weights, "residue int, i int, w double")
    near = cluster.neighbourhood(d, F.col("eps"))
    got = cluster.density_states(near, w, ["residue"], 0.12).toPandas()
    for key, part in got.groupby("residue"):
        assert list(part.sort_values("comp")["state"]) == want[key]
    assert got["is_noise"].any() and not got["is_noise"].all()


def test_von_neumann_entropy(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for key in range(3):
        a = np.abs(rng.random((5, 4)))
        m = a.T @ a
        m /= np.trace(m)
        values = np.linalg.eigvalsh(m)
        want[key] = -(values[values > 0] * np.log(values[values > 0])).sum()
        rows += [(key, i, j, float(m[i, j])) for i in range(4) for j in range(4)]
    df = spark.createDataFrame(rows, "residue int, i int, j int, x double")
    for r in cluster.von_neumann_entropy(df, ["residue"]).collect():
        assert r["s_vn"] == pytest.approx(want[r["residue"]], abs=1e-12)


def entropy_of_states(weights, states):
    p = np.bincount(states, weights=weights)
    return brute.entropy(p)


def test_sweep_and_jackknife(angles, fit, theta):
    overlap = cluster.component_overlap(angles, fit.mixtures)
    r = softmax(log_density(theta[0], fit.mixtures[0]) + fit.mixtures[0].logw)
    c = np.sqrt(r).T @ np.sqrt(r)
    d = 1 - c / np.sqrt(np.outer(np.diag(c), np.diag(c)))
    np.fill_diagonal(d, 0.0)
    grid = [0.3, 0.7, 0.95]
    got = cluster.eps_sweep(overlap, angles, fit.mixtures, grid).filter("residue = 0").toPandas()
    for _, row in got.iterrows():
        states = np.array(brute.dbscan(d, r.mean(axis=0), row["eps"], 0.01))
        assert row["s"] == pytest.approx(entropy_of_states(r.mean(axis=0), states), abs=1e-8)
        summed = np.stack([r[:, states == s].sum(axis=1) for s in np.unique(states)], axis=1)
        rho = np.sqrt(summed).T @ np.sqrt(summed)
        values = np.linalg.eigvalsh(rho / np.trace(rho))
        values = values[values > 1e-15]
        assert row["s_vn"] == pytest.approx(-(values * np.log(values)).sum(), abs=1e-7)
    left = cluster.left_out_weights(angles, fit.mixtures).filter("residue = 0 and key = 2").toPandas()
    rest = r.copy()
    rest[:, 2] = 0
    total = rest.sum(axis=1, keepdims=True)
    rest = np.where(total > 0, rest / np.where(total > 0, total, 1.0), 0.0)
    w = np.zeros(6)
    w[left["i"]] = left["w"]
    assert np.allclose(w, rest.sum(axis=0), rtol=1e-9)
    eps = cluster.eps_of_spread(cluster.component_distances(overlap))
    out = cluster.component_jackknife(angles, fit.mixtures, overlap, eps).toPandas()
    assert len(out) == 3 and (out["s_se"] >= 0).all()
    noisy = cluster.eps_resampling(overlap, eps, seed=4, replicates=10).toPandas()
    assert len(noisy) == 3 and (noisy["s_mean"] > 0).all()


def test_whole_way_finds_hidden_states_and_tree(angles, hidden):
    run = fit_angles(angles, components=6, seed=1, labels={0: "x", 1: "y", 2: "z"})
    got = run.states.toPandas().sort_values("frame")
    for r in range(3):
        found = got[got["residue"] == r]["state"].to_numpy()
        table = brute.joint(hidden[r], found)
        assert table.max(axis=1).sum() / len(found) > 0.97
    edges = run.tree.edges.orderBy(F.desc("i")).first()
    assert (edges["u"], edges["v"]) == ("x", "y")


def test_cases_cluster_as_single_clusterings_do(spark):
    rng = np.random.default_rng(8)
    k = 7
    d = np.round(rng.random((k, k)), 2)
    d = np.minimum(d, d.T)
    np.fill_diagonal(d, 0.0)
    w = rng.dirichlet(np.ones(k))
    distances = spark.createDataFrame(
        [(0, i, j, float(d[i, j])) for i in range(k) for j in range(k)], "residue int, i int, j int, d double"
    )
    weights = spark.createDataFrame([(0, i, float(w[i])) for i in range(k)], "residue int, i int, w double")
    for eps, mass in ((0.05, 0.1), (0.2, 0.3), (0.35, 0.5), (0.9, 0.2)):
        one = cluster.density_states(cluster.neighbourhood(distances, F.lit(eps)), weights, ["residue"], mass)
        cases = weights.withColumns({"key": F.lit(3), "eps": F.lit(eps)})
        many = cluster.states_of_cases(distances, cases, mass).filter("key = 3")
        rows = lambda df: {tuple(r) for r in df.select("comp", "state", "is_noise").collect()}
        assert rows(one) == rows(many)


def test_fit_on_tables_is_plain_em(angles, start, theta, monkeypatch):
    """Three iterations over slots of few frames, against the same by hand."""
    monkeypatch.setattr(em, "SLOT_FRAMES", 400)
    monkeypatch.setattr(em, "BLOCK_FRAMES", 64)
    fit = em.fit_mixtures(angles, start, atol=0.0, max_iter=3)
    assert fit.table.unconverged == 3 and len(fit.trace) == 9
    for r, m in start.items():
        for k in range(3):
            log = log_density(theta[r], m) + m.logw
            top = log.max(axis=1)
            norm = m.logw.max() + np.log(np.exp(m.logw - m.logw.max()).sum())
            ll = (top + np.log(np.exp(log - top[:, None]).sum(axis=1))).mean() - norm
            assert fit.trace[3 * r + k]["ll"] == pytest.approx(ll, abs=1e-9)
            p = softmax(log)
            z, w = p.T @ np.exp(1j * theta[r]), p.sum(axis=0)
            m = mixture.Mixture(np.angle(z), em.concentrations(np.abs(z) / w[:, None]), np.log(w / w.max()), m.mask)
        m = mixture.sort_mixture(m)
        assert np.allclose(np.exp(1j * fit.mixtures[r].mu), np.exp(1j * m.mu), atol=1e-9)
        assert np.allclose(fit.mixtures[r].kappa, m.kappa, rtol=1e-9)
    table = em.parameter_table(fit.table.state)
    back = mixture.mixtures_of_table(table)
    assert all(np.array_equal(back[r].mu, fit.mixtures[r].mu) and np.array_equal(back[r].logw, fit.mixtures[r].logw) for r in start)


def test_concentrations_are_those_of_the_expression(spark):
    from arborinfo.functions.circular import kappa_of_resultant

    length = np.concatenate([np.linspace(0, 1, 301), [0.99999]])
    rows = kappa_of_resultant(spark.createDataFrame([(float(x),) for x in length], "r double"), "r", "kappa").toPandas()
    assert np.allclose(rows["kappa"], em.concentrations(length), rtol=1e-12)


def test_fit_of_many_residues_and_of_none(spark, caplog):
    """2,000 residues, two of them without frames: nothing but counts comes back during the fit."""
    n = 2000
    rows = spark.range(n * 6).select(
        (F.col("id") % n).cast("int").alias("residue"), F.floor(F.col("id") / n).alias("frame"),
        F.array(F.sin(F.col("id") * 1.7) * 3, F.cos(F.col("id") * 0.9) * 3).alias("theta"),
    )
    one = mixture.Mixture(np.array([[0.0, 1.0], [2.0, -1.0]]), np.full((2, 2), 20.0), np.log([0.5, 0.5]), np.array([True, True]))
    state = em.state_of(spark, {0: one}).drop("residue").crossJoin(spark.range(n + 2).select(F.col("id").cast("int").alias("residue")))
    calls = []
    fit = em.fit_state(rows, state.select(em.STATE.names), atol=0.0, max_iter=2, on_iteration=lambda *x: calls.append(x))
    assert fit.state.count() == n + 2 and calls[-1] == (1, 2, n + 2) and fit.unconverged == n
    assert fit.trace.groupBy("iter").count().count() == 2 + 1  # rows without frames keep -1
    again = em.fit_state(rows.filter("residue = 3"), state.filter("residue = 3").select(em.STATE.names), atol=0.0, max_iter=2)
    pick = lambda f: f.state.filter("residue = 3").head()
    assert pick(again)["ll"] == pytest.approx(pick(fit)["ll"], abs=1e-12)
    assert "have not converged" in caplog.text
    none = em.fit_state(rows.limit(0), state.limit(0).select(em.STATE.names))
    assert none.state.count() == 0 and none.trace.count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_cuts_of_one_linkage_are_all_clusterings(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 30))
    d = np.round(rng.random((k, k)), 1 + seed % 2)  # many ties
    d = np.minimum(d, d.T)
    np.fill_diagonal(d, 0.0)
    w = rng.dirichlet(np.ones(k) * 0.5)
    for mass in (0.01, 0.1, 0.3, 2.0):
        linkage = cluster.Linkage(d, w, mass)
        for eps in (-0.1, 0.0, *np.linspace(0.03, 1.1, 40)):
            state, noise = linkage.cut(eps)
            assert list(state) == brute.dbscan(d, w, eps, mass), (mass, eps)
            near = d <= eps
            core = near @ w >= mass
            assert (noise == ~(core | (near & core).any(axis=1))).all()
