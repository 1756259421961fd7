import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborinfo import InformationTree
from arborinfo.operators import dwell
from arborinfo.operators.logits import argmax
from arborinfo.plans import cli
from arborinfo.sinks.drawing import draw_tree, drawn_edges, drawn_nodes
from arborinfo.sources.columns import encode_states, long_states, state_dictionary
from arborinfo.sources.results import load_mixtures, load_tree
from arborinfo.streaming.pair_counts import streaming_pair_counts
from tests import brute


def gaps(seq):
    out = {}
    for s in set(seq):
        ind = [int(x == s) for x in seq]
        flips = [i for i in range(1, len(seq)) if ind[i] != ind[i - 1]]
        if len(flips) > 1:
            out[s] = float(np.mean(np.diff(flips)))
    return out


@pytest.mark.parametrize("chunks", [1, 3, 50])
def test_positions_across_pieces(spark, chunks, monkeypatch):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for user, n in (("hot", 300), ("cold", 7), ("one", 1)):
        seq = [str(x) for x in rng.integers(0, 3, n)]
        # Times far from evenly spread.
        ts = np.cumsum(rng.pareto(1.0, n) + 0.01)
        rows += [(user, float(t), s) for t, s in zip(ts, seq)]
        want[user] = gaps(seq)
    df = spark.createDataFrame(rows, "user string, t double, state string").repartition(5)
    monkeypatch.setattr(dwell.with_previous, "__defaults__", (chunks,))
    monkeypatch.setattr(dwell, "WHOLE_ROWS", 5)
    got = {(r["user"], r["state"]): r["gap"] for r in dwell.mean_gaps(df, ["user"], "t").collect() if r["gap"] is not None}
    assert got == pytest.approx({(u, s): g for u, m in want.items() for s, g in m.items()})
    pos = dwell.with_previous(df, ["user"], "t", chunks).toPandas()
    assert sorted(pos[pos["user"] == "hot"]["pos"]) == list(range(1, 301))
    assert pos["previous"].isna().sum() == 3
    se = {r["user"]: r["s_se"] for r in dwell.block_jackknife(df, ["user"], "t").collect()}
    assert se["hot"] > 0 and set(se) == {"hot", "cold", "one"}


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([1.0, 5.0, 5.0],), ([-3.0, -4.0],)], "s array<double>")
    assert [r[0] for r in df.select(argmax(F.col("s"))).collect()] == [1, 0]


def test_encoding_orders_by_frequency(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), (None,), ("c",), ("b",)], "x string")
    table = state_dictionary(df, ["x"])
    got = [r["x"] for r in encode_states(df, ["x"], table).collect()]
    assert sorted(got) == [0, 0, 0, 1, 2, 3]


def test_columns_as_long_states(spark):
    df = spark.createDataFrame([(7, 1, 2), (8, 0, 1)], "k long, a int, b int")
    got = sorted(map(tuple, long_states(df, "k", ["a", "b"]).collect()))
    assert got == [(7, "a", 1), (7, "b", 2), (8, "a", 0), (8, "b", 1)]


def test_stream_counts_like_a_batch(spark, tmp_path):
    states = pd.DataFrame(brute.chain_states(600), columns=list("abcde"))
    for i in range(3):
        spark.createDataFrame(states[i * 200:(i + 1) * 200]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = spark.read.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = (
        streaming_pair_counts(rows, list("abcde")).writeStream.outputMode("complete").format("memory")
        .queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    tree = InformationTree(spark.table("counts"))
    batch = InformationTree.from_columns(whole, list("abcde"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(tree.pair_counts) == key(batch.pair_counts)
    assert key(tree.tree) == key(batch.tree)


def test_drawing(spark, tmp_path):
    states = pd.DataFrame(brute.chain_states(3000), columns=list("abcde"))
    tree = InformationTree.from_columns(spark.createDataFrame(states), list("abcde"))
    rows = [(v, i + 1, "CA", "ALA", i, "A", 3.8 * i, 0.0, 0.0, 0.0) for i, v in enumerate("abcde")]
    structure = spark.createDataFrame(
        rows, "label string, serial int, name string, resname string, resseq int, chain string, x double, y double, z double, bfactor double"
    )
    points = structure.withColumnRenamed("label", "var")
    nodes = drawn_nodes(tree, points)
    got = {r["var"]: r for r in nodes.collect()}
    s = {r["var"]: r["entropy"] for r in tree.node_entropies().collect()}
    assert all(got[v]["bfactor"] == pytest.approx(math.exp(-s[v])) for v in s)
    assert all(got[v]["vdw"] == pytest.approx(s[v] ** (1 / 3)) for v in s)
    for r in drawn_edges(tree, nodes, min_mi=0.2).collect():
        length = 0.38 * (r["v_id"] - r["u_id"])
        want = math.sqrt(r["mi"] / (math.pi * length)) if r["mi"] > 0.2 else 0.0
        assert r["radius"] == pytest.approx(max(want, 0.1))
    draw_tree(tree, structure, str(tmp_path / "drawing"))
    script = (tmp_path / "drawing" / "draw_tree.pml").read_text()
    assert script.count("cmd.bond(") == 4 and "cmd.bond('tree and id 1', 'tree and id 2')" in script
    pdb = (tmp_path / "drawing" / "tree.pdb").read_text().splitlines()
    assert pdb[1][:6] == "ATOM  " and float(pdb[2][30:38]) == 3.8 and len(pdb) == 8


def test_published_radii_and_spheres(spark):
    """Alpha carbons, information and entropy of a nine-residue run, and how they were drawn."""
    from arborinfo.sinks.drawing import NANOMETRES
    from arborinfo.functions.vec3 import distance, vec

    points = [
        ((2.056, -8.269, -3.433), (2.284, -8.132, 0.350), 0.26850, 0.4747240887935291),
        ((0.344, 0.371, -1.614), (0.639, 3.490, 0.661), 0.27609, 0.47642319998502686),
    ]
    df = spark.createDataFrame(
        points, "a struct<x:double,y:double,z:double>, b struct<x:double,y:double,z:double>, i double, want double"
    )
    wide = F.sqrt(F.col("i") / (math.pi * NANOMETRES * distance(vec("a"), vec("b"))))
    for row in df.select(wide.alias("r"), "want").collect():
        assert row["r"] == pytest.approx(row["want"], abs=2e-5)
    assert 2.972865901976011 ** (1 / 3) == pytest.approx(1.4378881566201054, abs=1e-12)
    assert round(math.exp(-2.972865901976011), 2) == 0.05


def test_command_line_from_scores(spark, tmp_path):
    rng = np.random.default_rng(0)
    hidden = rng.integers(0, 4, 800)
    rows = []
    for f, h in enumerate(hidden):
        for r in range(3):
            s = rng.random(5)
            s[h if rng.random() < 0.9 - 0.2 * r else rng.integers(0, 5)] += 2
            rows.append((f, r, [float(x) for x in s]))
    spark.createDataFrame(rows, "frame long, residue int, s array<double>").write.parquet(str(tmp_path / "scores"))
    cli.main(["logits", "-t", str(tmp_path / "scores"), "-o", str(tmp_path / "run"), "--prior", "percs", "--master", "local[4]"])
    tree = load_tree(spark, str(tmp_path / "run_seed_0"))
    assert tree.prior == "percs" and tree.tree.count() == 2


def test_command_line_from_a_trajectory(spark, tmp_path):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(3, 5, 3)).cumsum(axis=1) * 1.5 + np.arange(3)[:, None, None] * 4
    lines = []
    for m in range(60):
        lines.append(f"MODEL     {m:4d}\n")
        for r in range(3):
            for a, name in enumerate(("N", "CA", "C", "O", "CB")):
                x, y, z = base[r, a] + rng.normal(size=3) * 0.05 + (0.8 if m % 2 and a == 4 else 0.0)
                lines.append(f"ATOM  {r * 5 + a + 1:5d}  {name:<3s} ALA A{r:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00           {name[0]}\n")
        lines.append("ENDMDL\n")
    (tmp_path / "run.pdb").write_text("".join(lines))
    cli.main([
        "angles", "-t", str(tmp_path / "run.pdb"), "-o", str(tmp_path / "out"), "--components", "4",
        "--seed", "2", "--draw", "--master", "local[4]",
    ])
    tree = load_tree(spark, str(tmp_path / "out_seed_2"))
    assert {r["var"] for r in tree.variables().collect()} == {"ALA0", "ALA1", "ALA2"}
    assert set(load_mixtures(spark, str(tmp_path / "out_seed_2"))) == {0, 1, 2}
    assert (tmp_path / "out_seed_2" / "drawing" / "draw_tree.pml").exists()


def test_trajectory_argument(spark, tmp_path):
    from arborinfo.plans.cli import holds_text

    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "a.pdb").write_text("END\n")
    spark.range(3).write.parquet(str(tmp_path / "table"))
    assert holds_text(spark, str(tmp_path / "run")) and holds_text(spark, str(tmp_path / "run") + "/")
    assert not holds_text(spark, str(tmp_path / "table")) and holds_text(spark, "x/y.pdb")
