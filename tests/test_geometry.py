import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborinfo.operators import geometry, topology
from arborinfo.sources.trajectory import read_atoms, read_pdb

SEQUENCE = ["ALA", "GLY", "TRP", "ILE", "SER"]


def peptide(frames=4, seed=0):
    """Random positions for every slot atom and a hydrogen per residue."""
    rng = np.random.default_rng(seed)
    names = {aa: [r for r in topology.layout_rows() if r["aa"] == aa] for aa in topology.SIDE_CHAINS}
    rows = []
    for f in range(frames):
        serial = 0
        for i, resname in enumerate(SEQUENCE):
            for atom in [r["atom"] for r in names[topology.ONE_LETTER[resname]]] + ["H"]:
                serial += 1
                x, y, z = (float(v) for v in rng.normal(size=3) * 3)
                rows.append((f, serial, atom, resname, i + 5, "B", i, x, y, z))
    return rows


SCHEMA = "frame long, serial int, name string, resname string, resseq int, chain string, residue int, x double, y double, z double"


@pytest.fixture(scope="module")
def atoms(spark):
    return spark.createDataFrame(peptide(), SCHEMA)


@pytest.fixture(scope="module")
def internal(atoms):
    return geometry.internal_coordinates(geometry.slot_coordinates(atoms)).cache()


def pairwise(df):
    out = {}
    for f, part in df.toPandas().sort_values(["frame", "residue", "slot"]).groupby("frame"):
        p = part[["x", "y", "z"]].to_numpy()
        out[f] = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    return out


def test_layout():
    rows = topology.layout_rows()
    assert len(rows) == 167
    assert max(r["slot"] for r in rows) == 13 and sum(r["slot"] == 13 for r in rows) == 1
    ile = {r["atom"]: r for r in rows if r["aa"] == "I"}
    assert [ile["CG2"][k] for k in "abc"] == [0, 1, 4] and [ile["CD1"][k] for k in "abc"] == [1, 4, 5]
    assert [ile["CB"][k] for k in "abc"] == [2, 0, 1]


def test_slots_drop_unknown_atoms(atoms):
    rows = geometry.slot_list(geometry.slot_coordinates(atoms))
    assert rows.count() == atoms.filter("name <> 'H'").count()


def test_fold_restores_all_distances(atoms, internal):
    want = pairwise(geometry.slot_list(geometry.slot_coordinates(atoms)))
    got = pairwise(geometry.fold(internal))
    for f in want:
        assert np.allclose(got[f], want[f], atol=1e-8)


def test_hand_dihedral(spark):
    rows = [(0, 0, 1.0, 0.0, 0.0), (0, 1, 0.0, 0.0, 0.0), (0, 2, 0.0, 1.0, 0.0), (0, 3, 0.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "frame long, pos int, x double, y double, z double")
    row = geometry.backbone_internal(df).first()
    assert row["length"] == 2.0 and row["angle"] == pytest.approx(math.pi / 2)
    assert abs(row["dihedral"]) == pytest.approx(math.pi / 2)


def test_features_shift_and_mask(internal, spark):
    features = geometry.angle_features(internal).filter("frame = 0").toPandas().set_index("residue")["theta"]
    natural = internal.filter("frame = 0").toPandas().set_index(["residue", "slot"])
    for i in range(5):
        after = (i + 1) % 5
        assert features[i][0] == natural.loc[(after, 0), "angle"]
        assert features[i][14] == natural.loc[(after, 0), "dihedral"]
        assert features[i][2] == natural.loc[(i, 2), "angle"]
    assert features[1][4] == 0.0
    residues = spark.createDataFrame(list(enumerate(SEQUENCE)), "residue int, resname string")
    masks = {r["residue"]: r["m"] for r in geometry.feature_masks(residues).collect()}
    assert [sum(masks[i]) for i in range(5)] == [10, 8, 28, 16, 12]
    arrays = geometry.slot_arrays(internal, ("angle", "dihedral"))
    there = geometry.shift_first_slot(geometry.shift_first_slot(arrays, -1), 1)
    key = lambda df: sorted((r["frame"], r["residue"], tuple(r["angle"])) for r in df.collect())
    assert key(there) == key(arrays)


def test_mean_lengths(internal):
    out = geometry.mean_lengths(internal).groupBy("residue", "slot").agg(
        F.count_distinct("length").alias("k"), F.count(F.lit(1)).alias("n")
    ).toPandas()
    assert (out["k"] == 1).all() and (out["n"] == 4).all()


def test_superpose_undoes_a_rigid_motion(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(size=(12, 3))
    a, b = 0.7, -1.2
    turn = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]]) @ np.array(
        [[1, 0, 0], [0, math.cos(b), -math.sin(b)], [0, math.sin(b), math.cos(b)]]
    )
    q = p @ turn.T + np.array([3.0, -2.0, 5.0])
    rows = [(f, i, *map(float, v)) for f, xs in enumerate((p, q)) for i, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "frame long, serial int, x double, y double, z double")
    moved = geometry.superpose(df).filter("frame = 1").toPandas().sort_values("serial")
    assert np.allclose(moved[["x", "y", "z"]].to_numpy(), p, atol=1e-10)


def test_rebuilt_frames_lie_on_the_structure(atoms, internal):
    want = geometry.slot_list(geometry.slot_coordinates(atoms)).filter("frame = 2")
    got = geometry.rebuilt_frames(internal, mean_length=False, onto=want).filter("frame = 2")
    order = lambda df: df.toPandas().sort_values(["residue", "slot"])[["x", "y", "z"]].to_numpy()
    assert np.allclose(order(got), order(want), atol=1e-7)
    assert geometry.rebuilt_frames(internal).count() == want.count() * 4


PDB = """MODEL        {m}
ATOM      1  N   THR A   0    {x:8.3f}  -7.195  -4.392  1.00  0.00           N
ATOM      2  CA  THR A   0       2.056  -8.269  -3.433  1.00  0.05           C
TER       3      THR A   0
ATOM      4  CA  LYS B   3       2.284  -8.132   0.350  1.00  0.06           C
HETATM    5  O   HOH C   9       0.000   0.000   0.000  1.00  0.00           O
ENDMDL
"""


def test_pdb_files_are_read_in_order(spark, tmp_path):
    (tmp_path / "b.pdb").write_text(PDB.format(m=1, x=30.0) + PDB.format(m=2, x=40.0) + "END\n")
    (tmp_path / "a.pdb").write_text(PDB.format(m=0, x=10.0) + PDB.format(m=1, x=20.0) + "END\n")
    df = read_pdb(spark, str(tmp_path))
    got = df.filter("name = 'N'").orderBy("frame").collect()
    assert [(r["frame"], r["x"]) for r in got] == [(0, 10.0), (1, 20.0), (2, 30.0), (3, 40.0)]
    assert df.filter("resname = 'HOH'").count() == 0
    assert [r["frame"] for r in read_pdb(spark, str(tmp_path), stride=3).select("frame").distinct().orderBy("frame").collect()] == [0, 3]
    residues = topology.residue_numbers(df.filter("frame = 0")).orderBy("residue").collect()
    assert [r["label"] for r in residues] == ["THR0_A", "LYS3_B"]
    df.write.parquet(str(tmp_path / "atoms"))
    again = read_atoms(spark, str(tmp_path / "atoms"), stride=2, superpose=False)
    assert again.count() == 6


def test_missing_trajectory(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_pdb(spark, str(tmp_path / "none.pdb")).count()


def test_forms_of_residues_count_as_the_residue(spark, atoms):
    renamed = atoms.withColumn("resname", F.when(F.col("residue") == 2, "XXX").otherwise(F.col("resname")))
    with pytest.raises(Exception, match="unknown residue name XXX"):
        geometry.slot_atoms(renamed).collect()
    forms = {"HSD": "H", "HIP": "H", "CYX": "C", "ASH": "D", "GLH": "E", "LYN": "K", "ALA": "A"}
    rows = spark.createDataFrame([(f,) for f in forms], "resname string")
    assert {r[0]: r[1] for r in rows.select("resname", topology.one_letter(F.col("resname"))).collect()} == forms


def test_alternate_locations_and_insertions(spark, tmp_path):
    line = "ATOM  {:5d}  {:<3s}{:1s}{:3s} A{:4d}{:1s}   {:8.3f}{:8.3f}{:8.3f}  1.00  0.00"
    rows = [
        ("CA", " ", "ALA", 5, " ", 1.0), ("CB", "B", "ALA", 5, " ", 3.0), ("CB", "A", "ALA", 5, " ", 2.0),
        ("CA", " ", "ALA", 5, "A", 4.0), ("CB", "B", "HSD", 6, " ", 6.0), ("CA", " ", "HSD", 6, " ", 5.0),
    ]
    lines = [line.format(k + 1, n, alt, res, seq, ins, x, 0.0, 0.0) for k, (n, alt, res, seq, ins, x) in enumerate(rows)]
    path = tmp_path / "x.pdb"
    path.write_text("\n".join(lines) + "\nEND\n")
    read = read_pdb(spark, str(path))
    assert sorted(r["x"] for r in read.collect()) == [1.0, 2.0, 4.0, 5.0, 6.0]
    numbers = topology.residue_numbers(read).orderBy("residue").collect()
    assert [r["label"] for r in numbers] == ["ALA5_A", "ALA5A_A", "HSD6_A"]
    one = topology.to_single_chain(read, topology.residue_numbers(read))
    slots = geometry.slot_coordinates(one).orderBy("residue").collect()
    assert [r["aa"] for r in slots] == ["A", "A", "H"] and slots[0]["c"][4]["x"] == 2.0


def test_a_chain_in_pieces_is_the_whole_chain(spark):
    """Seven pieces, the last one of a single point, against the fold in one go."""
    rng = np.random.default_rng(12)
    frames, n = 5, 6 * 11 + 1
    values = np.stack([rng.uniform(1, 2, (frames, n)), rng.uniform(1, 2.5, (frames, n)), rng.uniform(-3, 3, (frames, n))], axis=-1)
    rows = [(f, k, *map(float, values[f, k])) for f in range(frames) for k in range(n)]
    chain = spark.createDataFrame(rows, "frame long, pos int, length double, angle double, dihedral double").repartition(4)
    want = geometry.fold_backbone(values)
    for piece in (11, 1, 2, 4096):
        got = geometry.rebuild_backbone(chain, piece).orderBy("frame", "pos").toPandas()
        assert got["pos"].tolist() == list(range(n)) * frames
        assert np.allclose(got[["x", "y", "z"]].to_numpy().reshape(frames, n, 3), want, atol=1e-9), piece
    assert geometry.rebuild_backbone(chain.limit(0)).count() == 0


def test_a_fold_in_pieces_is_the_whole_fold(spark):
    from arborinfo.operators.topology import layout_rows

    rng = np.random.default_rng(13)
    sequence = "AWKGRYHTCDEFILMNPQSVA"
    slots = {}
    for row in layout_rows():
        slots.setdefault(row["aa"], []).append(row["slot"])
    rows = [
        (f, r, aa, slot, float(rng.uniform(1, 2)), float(rng.uniform(1, 2.5)), float(rng.uniform(-3, 3)))
        for f in range(3) for r, aa in enumerate(sequence) for slot in slots[aa]
    ]
    internal = spark.createDataFrame(rows, "frame long, residue int, aa string, slot int, length double, angle double, dihedral double")
    key = ["frame", "residue", "slot"]
    whole = geometry.fold(internal).orderBy(*key).toPandas()
    for piece in (3, 7, 20):
        got = geometry.fold(internal, piece).orderBy(*key).toPandas()
        assert got[[*key, "aa"]].equals(whole[[*key, "aa"]]) and len(got) == len(rows)
        assert np.allclose(got[["x", "y", "z"]], whole[["x", "y", "z"]], atol=1e-9)
