import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborinfo import InformationTree
from arborinfo.lineage import local_table
from arborinfo.operators import pairs, paths, spanning
from arborinfo.operators.tree_index import TreeIndex
from arborinfo.sinks.results import save_tree
from arborinfo.sources.results import load_tree
from tests import brute

NAMES = list("abcde")


@pytest.fixture(scope="module")
def states():
    return brute.chain_states(4000)


@pytest.fixture(scope="module")
def frame(spark, states):
    return spark.createDataFrame(pd.DataFrame(states, columns=NAMES).assign(frame=range(len(states))))


@pytest.fixture(scope="module")
def tree(frame):
    return InformationTree.from_columns(frame, NAMES)


def edge_set(df):
    return {(r["u"], r["v"]) for r in df.collect()}


def counts(df):
    return {(r["u"], r["v"], int(r["xu"]), int(r["xv"])): r["n"] for r in df.collect()}


def test_ways_to_count_agree(frame, monkeypatch):
    by_joint = counts(pairs.pair_counts(frame, NAMES))
    by_array = counts(pairs.pairs_of_arrays(frame, F.array(*NAMES), NAMES))
    cells = F.array(*[F.struct(F.lit(v).alias("var"), F.col(v).alias("state")) for v in NAMES])
    long = frame.select("frame", F.explode(cells).alias("c")).select("frame", "c.*")
    assert by_joint == by_array == counts(pairs.pair_counts_long(long))
    monkeypatch.setattr(pairs, "PIVOT_VARIABLES", 0)
    assert by_joint == counts(pairs.pair_counts_long(long))
    assert sum(by_joint.values()) == 10 * 4000


@pytest.mark.parametrize("budget", [1, 20, 60, 10**6])
def test_counting_within_any_memory(frame, budget, monkeypatch):
    want = counts(pairs.pairs_of_joint(pairs.joint_counts(frame, NAMES), NAMES))
    rows = frame.select(F.array(*NAMES).alias("x")).toArrow()
    monkeypatch.setattr(pairs, "CHUNK_CODES", 500)
    found = {}
    for batch in pairs._count_batches(rows.to_batches(max_chunksize=700), budget):
        for r in batch.to_pylist():
            key = (NAMES[r["u"]], NAMES[r["v"]], int(r["xu"]), int(r["xv"]))
            found[key] = found.get(key, 0) + r["n"]
    assert found == want


@pytest.mark.parametrize("columns", [12, 13, 64, 65])
def test_any_number_of_columns_and_any_values(spark, columns):
    """Nulls, negative and very large integers, text and dates count alike at every width."""
    rng = np.random.default_rng(columns)
    kinds = [
        lambda: None if rng.random() < 0.3 else int(rng.integers(-2, 2)), lambda: int(1.7e9 + rng.integers(3) * 86_400),
        lambda: rng.choice(["a", "b c", ""]), lambda: bool(rng.integers(2)),
    ]
    rows = [tuple(kinds[k % 4]() for k in range(columns)) for _ in range(60)]
    rows = [tuple(str(x) if k % 4 == 2 else x for k, x in enumerate(row)) for row in rows]
    names = [f"v{k:02d}" for k in range(columns)]
    schema = ", ".join(f"{n} {['long', 'long', 'string', 'boolean'][k % 4]}" for k, n in enumerate(names))
    got = {
        (r["u"], r["v"], r["xu"], r["xv"]): r["n"]
        for r in pairs.pair_counts(spark.createDataFrame(rows, schema).repartition(3), names).collect()
    }
    text = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x)
    want = {}
    for row in rows:
        for i in range(columns):
            for j in range(i + 1, columns):
                key = (names[i], names[j], text(row[i]), text(row[j]))
                want[key] = want.get(key, 0) + 1
    assert got == want


def test_batches_of_a_task_are_combined():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    states = rng.integers(0, 12, (4000, 30))
    states[rng.random(states.shape) < 0.01] = 99  # a noise state with a high number
    column = pa.FixedSizeListArray.from_arrays(pa.array(states.ravel()), 30).cast(pa.list_(pa.int64()))
    rows = {
        size: sum(b.num_rows for b in pairs._count_batches(pa.table({"x": column}).to_batches(max_chunksize=size)))
        for size in (4000, 1000)
    }
    assert rows[1000] == rows[4000]


@pytest.mark.parametrize("pivot", [0, 64])
@pytest.mark.parametrize("odd", [[(1, "a", 1)], [(1, "a", 1), (1, "a", 0)], [(1, "a", 1), (1, "c", 0)]])
def test_frames_must_be_whole(spark, odd, pivot, monkeypatch):
    monkeypatch.setattr(pairs, "PIVOT_VARIABLES", pivot)
    rows = [(0, "a", 1), (0, "b", 0)] + odd
    df = spark.createDataFrame(rows, "frame long, var string, state int")
    with pytest.raises(Exception, match="exactly one state"):
        pairs.pair_counts_long(df, ["a", "b"]).collect()


def test_null_is_a_state(spark):
    df = spark.createDataFrame([("x", None), ("x", "y"), (None, "y")], "a string, b string")
    got = {(r["xu"], r["xv"]): r["n"] for r in pairs.pair_counts(df, ["a", "b"]).collect()}
    assert got == {("x", "null"): 1, ("x", "y"): 1, ("null", "y"): 1}


def test_information_and_tree(tree, states):
    want = brute.information(states)
    got = {(r["u"], r["v"]): r["i"] for r in tree.edges.collect()}
    for (i, j), value in want.items():
        assert got[NAMES[i], NAMES[j]] == pytest.approx(value, abs=1e-12)
    best = {(NAMES[i], NAMES[j]) for i, j in brute.spanning_tree(want, range(5))}
    assert edge_set(tree.tree) == best == {("a", "b"), ("b", "c"), ("c", "d"), ("b", "e")}
    total = sum(brute.entropy(np.bincount(states[:, i])) for i in range(5))
    assert tree.summary().first()["entropy"] < total


def test_information_of_a_copy(spark, states):
    df = spark.createDataFrame(pd.DataFrame({"a": states[:, 0], "b": states[:, 0] + 5}))
    row = InformationTree.from_columns(df, ["a", "b"]).edges.first()
    assert row["i"] == pytest.approx(row["s_u"], abs=1e-12)
    assert row["s_u"] <= np.log(3) + 1e-12


def random_edges(spark, n, seed, ties=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        for j in range(i + 1, n):
            w = float(rng.integers(0, 3)) if ties else float(rng.random())
            rows.append({"u": f"n{i:02d}", "v": f"n{j:02d}", "i": w})
    schema = pa.schema([("u", pa.string()), ("v", pa.string()), ("i", pa.float64())])
    return local_table(spark, rows, schema)


@pytest.mark.parametrize("ties", [False, True])
def test_spanning_tree_by_joins(spark, ties):
    edges = random_edges(spark, 14, 3, ties)
    small = edge_set(spanning.maximum_spanning_tree(edges))
    assert small == edge_set(spanning.maximum_spanning_tree(edges, driver_edges=0))
    assert len(small) == 13


def test_components_of_keyed_graphs(spark):
    rows = [(0, "a", "b"), (0, "b", "c"), (0, "x", "y"), (1, "a", "x"), (1, "c", "c")]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    got = {(r["k"], r["node"]): r["component"] for r in spanning.connected_components(df, ["k"]).collect()}
    assert got == {
        (0, "a"): "a", (0, "b"): "a", (0, "c"): "a", (0, "x"): "x", (0, "y"): "x",
        (1, "a"): "a", (1, "x"): "a", (1, "c"): "c",
    }


def test_long_chain_is_one_component(spark):
    df = spark.range(60).selectExpr("id as a", "id + 1 as b")
    got = spanning.connected_components(df)
    assert {r["component"] for r in got.collect()} == {0} and got.count() == 61


def test_paths_walked_and_joined_agree(spark):
    rng = np.random.default_rng(5)
    rows = [(f"n{rng.integers(0, i):02d}", f"n{i:02d}") for i in range(1, 18)]
    edges = spark.createDataFrame(rows, "u string, v string")
    key = lambda df: sorted(map(tuple, df.select("u", "v", "d", "first", "last", "mid").collect()), key=str)
    walked = key(paths.tree_paths(edges))
    assert walked == key(paths.tree_paths(edges, rows=4))
    assert len(walked) == 18 * 17


def transfer(states, i, j):
    c = brute.joint(states[:, i], states[:, j])
    return c / c.sum(1, keepdims=True)


def test_path_joint_and_implied(tree, states):
    p = np.bincount(states[:, 0]) / len(states)
    want = np.diag(p) @ transfer(states, 0, 1) @ transfer(states, 1, 2) @ transfer(states, 2, 3)
    got = np.zeros((3, 3))
    for r in tree.joint_distribution("a", "d").collect():
        got[int(r["xu"]), int(r["xv"])] = r["p"]
    assert np.allclose(got, want, atol=1e-12)
    both = {}
    for r in tree.implied_joints().collect():
        both.setdefault((r["u"], r["v"]), np.zeros((3, 3)))[int(r["xu"]), int(r["xv"])] = r["p"]
    assert np.allclose(both["a", "d"], want, atol=1e-12)
    assert np.allclose(both["a", "b"] * len(states), brute.joint(states[:, 0], states[:, 1]))
    assert all(m.sum() == pytest.approx(1.0) for m in both.values()) and len(both) == 10


def test_log_probability(tree, frame, states):
    p = np.bincount(states[:, 0]) / len(states)
    want = np.log(p[states[:, 0]])
    for i, j in ((0, 1), (1, 2), (2, 3), (1, 4)):
        want = want + np.log(transfer(states, i, j)[states[:, i], states[:, j]])
    got = tree.log_probability(frame).toPandas().sort_values("frame")["log_p"]
    assert np.allclose(got, want, atol=1e-10)
    plugin = InformationTree(tree.pair_counts, estimator="mle").summary().first()["entropy"]
    assert -got.mean() == pytest.approx(plugin, abs=1e-9)


def test_unseen_states_have_no_probability(tree, spark):
    row = spark.createDataFrame([(9, 0, 0, 0, 0), (0, 0, 0, 0, 9)], "a int, b int, c int, d int, e int")
    assert [r["log_p"] for r in tree.log_probability(row).collect()] == [float("-inf")] * 2


def test_sampled_marginals(tree):
    drawn = tree.sample(20_000, seed=11).toPandas()
    again = tree.sample(20_000, seed=11).toPandas()
    assert drawn.sort_values("id").equals(again.sort_values("id")[drawn.columns])
    p = {(r["var"], r["state"]): r["p"] for r in tree.node_probabilities.collect()}
    for (var, state), value in p.items():
        assert (drawn[var] == state).mean() == pytest.approx(value, abs=0.015)
    joint = {(r["xu"], r["xv"]): r["p"] for r in tree.joint_distribution("b", "c").collect()}
    assert ((drawn["b"] == "1") & (drawn["c"] == "1")).mean() == pytest.approx(joint["1", "1"], abs=0.015)


def test_samples_by_passing_and_by_joining_agree(tree, spark):
    from arborinfo.operators import model

    ids = spark.createDataFrame([(5, "x"), (-3, "y"), (None, "z"), (5, "w"), (10**12, "x")], "id long, a string")
    root = tree.root()
    args = (tree.transfers, tree.node_probabilities, tree.ordered_edges(root), root, 7)
    key = lambda df: sorted(map(str, df.select("id", *NAMES).collect()))
    passed = key(model.sample(ids, *args))
    assert passed == key(model.sample(ids.repartition(3), *args, table_rows=1)) and len(passed) == 5
    words = model.sample(ids.select(F.col("a").alias("id")), *args).orderBy("id").collect()
    assert words[1] == words[2] and words[0].id == "w"
    assert model.sample(ids.limit(0), *args).count() == 0


def test_leave_one_out(tree, states):
    weights = brute.information(states)
    s = [brute.entropy(np.bincount(states[:, i])) for i in range(5)]
    got = {r["node"]: r["entropy"] for r in tree.leave_one_out_entropies().collect()}
    for out in range(5):
        kept = {e: w for e, w in weights.items() if out not in e}
        edges = brute.spanning_tree(kept, [i for i in range(5) if i != out])
        want = sum(s[i] for i in range(5) if i != out) - sum(weights[e] for e in edges)
        assert got[NAMES[out]] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replacement_edges_on_random_graphs(spark, seed):
    from arborinfo.operators import errors

    edges = random_edges(spark, 9, seed)
    w = {(r["u"], r["v"]): r["i"] for r in edges.collect()}
    nodes = sorted({x for e in w for x in e})
    tree = edges.join(spanning.maximum_spanning_tree(edges), ["u", "v"])
    covered = errors.coverings(edges.repartition(3), tree, TreeIndex.of(tree))
    kept = edge_set(tree)
    added = {}
    for r in errors.replacement_edges(covered).collect():
        added.setdefault(r["node"], set()).add((r["u"], r["v"]))
    for out in nodes:
        best = brute.spanning_tree({e: x for e, x in w.items() if out not in e}, [n for n in nodes if n != out])
        assert {e for e in kept if out not in e} | added.get(out, set()) == best
    bridges = {(r["a"], r["b"]): (r["u"], r["v"]) for r in errors.knockout_bridges(covered).collect()}
    for e in kept:
        best = brute.spanning_tree({**w, e: -1.0}, nodes)
        assert {tuple(sorted(bridges[e]))} == best - kept


def test_knockout_and_trim(tree, states):
    got = np.zeros((3, 3))
    for r in tree.edge_knockout("c", "d").collect():
        got[int(r["xu"]), int(r["xv"])] = r["p"]
    w = brute.information(states)
    best = brute.spanning_tree({**w, (2, 3): 0.0}, range(5))
    (bridge,) = [e for e in best if 3 in e]
    p = np.bincount(states[:, 2]) / len(states)
    first = np.eye(3) if bridge[0] == 2 else transfer(states, 2, bridge[0])
    if bridge[0] == 0:
        first = transfer(states, 2, 1) @ transfer(states, 1, 0)
    assert np.allclose(got, np.diag(p) @ first @ transfer(states, bridge[0], 3), atol=1e-12)
    assert edge_set(tree.trim(["a", "c"])) == {("a", "b"), ("b", "c")}
    assert edge_set(tree.trim(["a", "d", "e"])) == edge_set(tree.tree)


def test_information_matrix_kinds(tree):
    value = lambda kind: {(r["u"], r["v"]): r["value"] for r in tree.information_matrix(kind).collect()}
    seen, implied, mixed = value("empirical"), value("chow_liu"), value("hybrid")
    assert mixed["a", "d"] == seen["a", "d"] and mixed["d", "a"] == implied["d", "a"]
    assert implied["a", "b"] == pytest.approx(seen["a", "b"], abs=1e-12)
    with pytest.raises(ValueError):
        tree.information_matrix("none")


def test_priors_order_and_reload(tree, spark, tmp_path):
    means = {p: tree.with_prior(p).nodes.agg(F.sum("s_pm")).first()[0] for p in ("haldane", "percs", "jeffreys", "laplace")}
    assert means["haldane"] < means["percs"] < means["jeffreys"] < means["laplace"]
    save_tree(tree, str(tmp_path / "saved"))
    back = load_tree(spark, str(tmp_path / "saved"))
    assert back.summary().first() == tree.summary().first()
    assert back.entropy_interval().first() == tree.entropy_interval().first()
    other = load_tree(spark, str(tmp_path / "saved"), prior="laplace")
    assert other.entropy() == pytest.approx(tree.with_prior("laplace").entropy())
    assert edge_set(back.refit_to_subset(["a", "b", "c"]).tree) == {("a", "b"), ("b", "c")}


def test_interval_covers_point(tree):
    row = tree.entropy_interval(0.9).first()
    assert row["lo"] < row["entropy"] < row["hi"]
    assert row["hi"] - row["entropy"] == pytest.approx(1.6448536 * row["entropy_se"], rel=1e-6)


def test_saved_names_of_a_first_chain(spark, tmp_path):
    """Without the suffix these names sort otherwise than with it."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (500, 3))
    x[:, 1] = np.where(rng.random(500) < 0.8, x[:, 0], x[:, 1])
    x[:, 2] = np.where(rng.random(500) < 0.6, x[:, 1], x[:, 2])
    names = ["ALA1_A", "ALA10_A", "ALA2_A"]
    df = spark.createDataFrame([tuple(map(int, row)) for row in x], ", ".join(f"{n} int" for n in names))
    tree = InformationTree.from_columns(df, names)
    save_tree(tree, str(tmp_path / "saved"))
    back = load_tree(spark, str(tmp_path / "saved"))
    entropy = lambda t: t.summary().first()["entropy"]
    assert entropy(back) == pytest.approx(entropy(tree), abs=1e-12)
    assert {r["var"] for r in back.nodes.collect()} == {"ALA1", "ALA10", "ALA2"}
    assert back.pair_counts.filter("u >= v").isEmpty() and back.tree.filter("u >= v").isEmpty()
    plain = df.withColumnsRenamed({n: n[:-2] for n in names})
    direct = InformationTree.from_columns(plain, [n[:-2] for n in names])
    rows = lambda t: {tuple(r) for r in t.edges.select("u", "v", F.round("i", 9)).collect()}
    assert rows(back) == rows(direct)
    clash = df.withColumnRenamed("ALA2_A", "ALA1")
    save_tree(InformationTree.from_columns(clash, ["ALA1_A", "ALA10_A", "ALA1"]), str(tmp_path / "clash"))
    with pytest.raises(ValueError, match="become equal"):
        load_tree(spark, str(tmp_path / "clash"))


def test_scoring_rows_with_nulls(spark):
    rows = [(1, "a"), (None, "a"), (None, None), (2, "b"), (2, None), (1, "a")]
    df = spark.createDataFrame(rows, "x int, y string")
    tree = InformationTree.from_columns(df, ["x", "y"])
    got = tree.log_probability(df).collect()
    want = [np.log(rows.count(r) / len(rows)) for r in rows]
    assert [r["log_p"] for r in got] == pytest.approx(want)


def test_scoring_many_columns_writes_nothing(spark):
    rng = np.random.default_rng(1)
    names = [f"v{k:02d}" for k in range(40)]
    values = rng.integers(0, 2, (40, 40))
    df = spark.createDataFrame([tuple(map(int, row)) for row in values], ", ".join(f"{n} int" for n in names))
    tree = InformationTree.from_columns(df, names)
    scored = tree.log_probability(df)
    plan = scored._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "parquet" not in plan.lower() and "Join" not in plan
    from arborinfo.operators import model

    root = tree.root()
    order = tree.ordered_edges(root)
    joined = model.log_probability(df, tree.transfers, tree.node_probabilities, order, root, table_rows=0)
    key = lambda r: tuple(r[n] for n in names)
    a, b = ({key(r): r["log_p"] for r in d.collect()} for d in (scored, joined))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def random_tree(rng, n, chain=False):
    return [(f"n{(i - 1) if chain else rng.integers(0, i):05d}", f"n{i:05d}") for i in range(1, n)]


def walk(near, u, v):
    todo = [[u]]
    while todo:
        path = todo.pop()
        if path[-1] == v:
            return path
        todo += [path + [x] for x in near[path[-1]] if x not in path[-2:-1]]
    return []


@pytest.mark.parametrize("seed", range(4))
def test_index_of_random_forests(seed):
    rng = np.random.default_rng(seed)
    edges = random_tree(rng, 40)
    if seed == 3:
        edges.pop(17)  # two parts
    index = TreeIndex(edges)
    near = index.near
    ends = rng.integers(0, len(index), (2, 400))
    top = index.meet(*ends)
    for a, b, z in zip(*ends.tolist(), top.tolist()):
        path = walk(near, index.name[a], index.name[b])
        assert index.path(index.name[a], index.name[b]) == path
        if path:
            assert index.name[z] == min(path, key=lambda x: index.depth[index.number[x]])
            if z != a:
                assert index.name[index.branch(np.array([z]), np.array([a]))[0]] == path[-1 - path[::-1].index(index.name[z]) - 1]
    chain = index.centroids()
    assert max(map(len, chain.values())) <= np.log2(len(index)) + 1
    for a, b, z in zip(*ends.tolist(), top.tolist()):
        if z >= 0:
            shared = [x for x, y in zip(chain[index.name[a]], chain[index.name[b]]) if x == y]
            assert shared[-1] in index.path(index.name[a], index.name[b])
    some = [index.name[k] for k in rng.integers(0, len(index), 5)]
    want = {tuple(sorted(e)) for a in some for b in some for w in [walk(near, a, b)] for e in zip(w, w[1:])}
    assert set(index.spanned(some)) == want


def test_coverings_of_many_variables_stay_small(spark):
    """300 variables, 44,850 graph edges: no more rows than tasks times edges, and the right ones."""
    from arborinfo.operators import errors

    rng, n = np.random.default_rng(7), 300
    names = [f"n{i:05d}" for i in range(n)]
    weight = rng.random((n, n))
    rows = [(names[i], names[j], float(weight[i, j])) for i in range(n) for j in range(i + 1, n)]
    edges = spark.createDataFrame(pd.DataFrame(rows, columns=["u", "v", "i"])).repartition(4)
    tree = edges.join(spanning.maximum_spanning_tree(edges), ["u", "v"])
    covered = errors.coverings(edges, tree, TreeIndex.of(tree)).toPandas()
    assert len(covered) <= 4 * 3 * n
    best_of = lambda ok: set(spanning.heaviest_forest((i, u, v) for u, v, i in rows if ok(u, v)))
    kept = edge_set(tree)
    bridges = covered[covered.node.isna()]
    assert len(bridges) == n - 1
    for r in bridges.head(20).itertuples():
        assert {(r.u, r.v)} == best_of(lambda u, v: (u, v) != (r.a, r.b)) - kept
    added = errors.replacement_edges(spark.createDataFrame(covered)).toPandas()
    hub = added.node.value_counts().index[0]
    for out in (hub, names[0], names[150]):
        mine = added[added.node == out]
        assert {e for e in kept if out not in e} | set(zip(mine.u, mine.v)) == best_of(lambda u, v: out not in (u, v))


def test_long_chain_of_variables(spark):
    """10,000 variables in a row: questions about two of them read the way between them."""
    from arborinfo.operators import errors, model

    n = 10_000
    edges = random_tree(None, n, chain=True)
    index = TreeIndex(edges)
    assert len(index.path("n00000", f"n{n - 1:05d}")) == n
    flip = 0.001
    step = [("0", "0", 1 - flip), ("0", "1", flip), ("1", "0", flip), ("1", "1", 1 - flip)]
    states = spark.createDataFrame(step, "xu string, xv string, p double")
    near = spark.createDataFrame(pd.DataFrame(edges + [(v, u) for u, v in edges], columns=["u", "v"]))
    transfers = near.crossJoin(states)
    halves = spark.createDataFrame(pd.DataFrame([(x, s, 0.5) for x in index.name for s in "01"], columns=["var", "state", "p"]))
    for k in (1, 8, 9, 64, 700, n - 1):
        law = {(r["xu"], r["xv"]): r["p"] for r in model.path_joint(transfers, halves, index.path("n00000", f"n{k:05d}")).collect()}
        same = (1 + (1 - 2 * flip) ** k) / 4
        assert law["0", "0"] == pytest.approx(same, abs=1e-12) and law["0", "1"] == pytest.approx(0.5 - same, abs=1e-12)
    assert errors.knockout_bridge(near.select("u", "v", F.lit(1.0).alias("i")).limit(1), index, "n00000", "n00001") is None


def test_implied_laws_of_blocks(spark, monkeypatch):
    """Pieces dealt out as pairs of blocks give the laws of the products along paths."""
    from arborinfo.operators import model

    monkeypatch.setattr(model, "BLOCK_STATES", 12)
    rng = np.random.default_rng(9)
    edges = random_tree(rng, 23)
    index = TreeIndex(edges)
    k = {x: int(rng.integers(2, 5)) for x in index.name}
    law = {index.name[0]: rng.dirichlet(np.ones(k[index.name[0]]))}
    rows = []
    for u, v, _ in index.away_from(index.name[0]):
        t = rng.dirichlet(np.ones(k[v]), k[u])
        law[v] = law[u] @ t
        back = (law[u][:, None] * t / law[v]).T
        for a, b, m in ((u, v, t), (v, u, back)):
            rows += [(a, b, f"s{x}", f"s{y}", float(m[x, y])) for x in range(k[a]) for y in range(k[b])]
    step = {(a, b): np.zeros((k[a], k[b])) for a, b, *_ in rows}
    for a, b, x, y, p in rows:
        step[a, b][int(x[1:]), int(y[1:])] = p
    transfers = spark.createDataFrame(rows, "u string, v string, xu string, xv string, p double")
    nodes = spark.createDataFrame([(x, f"s{j}", float(p)) for x, ps in law.items() for j, p in enumerate(ps)], "var string, state string, p double")
    tables = model.centre_tables(transfers, nodes, index)
    got = {}
    for r in model.implied_joints(tables).collect():
        assert (r["u"], r["v"], r["xu"], r["xv"]) not in got
        got[r["u"], r["v"], r["xu"], r["xv"]] = r["p"]
    sums = {(r["u"], r["v"]): r["s_uv"] for r in model.implied_entropies(tables).collect()}
    assert len(sums) == 23 * 22 // 2
    wanted = [(a, b) for a in index.name[::3] for b in index.name if a != b]
    given_u = {(r["u"], r["v"], r["xu"], r["xv"]): r["p"] for r in model.implied_conditionals(tables, index, wanted).collect()}
    for u in index.name:
        for v in index.name:
            if u < v:
                m = np.diag(law[u])
                path = index.path(u, v)
                for a, b in zip(path, path[1:]):
                    m = m @ step[a, b]
                assert sums[u, v] == pytest.approx(-(m * np.log(m)).sum(), abs=1e-10)
                for x, y in np.ndindex(*m.shape):
                    assert got[u, v, f"s{x}", f"s{y}"] == pytest.approx(m[x, y], abs=1e-12)
                    if (u, v) in wanted:
                        assert given_u[u, v, f"s{x}", f"s{y}"] == pytest.approx(m[x, y] / law[u][x], abs=1e-10)
