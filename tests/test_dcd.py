import struct

import numpy as np
import pytest

from arborinfo.sources import dcd
from arborinfo.sources.dcd import DcdSource, layout_of, places_of, ranges_of, read_dcd

ATOMS = 7


def block(order, raw):
    size = struct.pack(f"{order}i", len(raw))
    return size + raw + size


def write_dcd(path, xyz, order="<", cell=True, fourth=False, fixed=0, version=24):
    """A file as molecular dynamics programs write it."""
    numbers = [len(xyz), 1, 1, len(xyz), 0, 0, 0, 0, fixed, 0, int(cell), int(fourth), 0, 0, 0, 0, 0, 0, 0, version]
    out = block(order, b"CORD" + struct.pack(f"{order}20i", *numbers))
    out += block(order, struct.pack(f"{order}i", 2) + b"a title".ljust(80) + b"another".ljust(80))
    out += block(order, struct.pack(f"{order}i", xyz.shape[1]))
    for k, frame in enumerate(xyz):
        if cell:
            out += block(order, struct.pack(f"{order}6d", 10, 90, 10, 90, 90, 10))
        for axis in frame.T:
            out += block(order, axis.astype(f"{order}f4").tobytes())
        if fourth:
            out += block(order, np.full(xyz.shape[1], k, f"{order}f4").tobytes())
    path.write_bytes(out)


def frames(n, seed=0):
    return np.random.default_rng(seed).normal(size=(n, ATOMS, 3)).astype(np.float32) * 10


@pytest.mark.parametrize("order,cell,fourth", [("<", True, False), (">", False, False), ("<", True, True), (">", True, False)])
def test_frames_come_back(spark, tmp_path, order, cell, fourth):
    xyz = frames(53)
    write_dcd(tmp_path / "x.dcd", xyz, order, cell, fourth)
    spark.dataSource.register(DcdSource)
    df = spark.read.format("dcd").option("partitionBytes", 1500).load(str(tmp_path / "x.dcd"))
    rows = df.orderBy("frame").collect()
    assert df.rdd.getNumPartitions() >= 5 and [r["frame"] for r in rows] == list(range(53))
    assert np.array_equal(np.array([r["xyz"] for r in rows], np.float32).reshape(xyz.shape), xyz)


def test_stride_and_atoms_over_a_folder(spark, tmp_path):
    a, b = frames(10, 1), frames(13, 2)
    write_dcd(tmp_path / "2.dcd", b)
    write_dcd(tmp_path / "1.dcd", a)
    (tmp_path / "notes.txt").write_text("x")
    spark.dataSource.register(DcdSource)
    read = spark.read.format("dcd").option("stride", 4).option("atoms", "1-2,5-5").option("partitionBytes", 700)
    rows = read.load(f"file://{tmp_path}").orderBy("frame").collect()
    both = np.concatenate([a, b])
    assert [r["frame"] for r in rows] == list(range(0, 23, 4))
    got = np.array([r["xyz"] for r in rows], np.float32).reshape(-1, 3, 3)
    assert np.array_equal(got, both[::4][:, [1, 2, 5]])


class Watched:
    """A file that notes which bytes are read."""

    def __init__(self, file, seen):
        self.file, self.seen = file, seen

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def read_at(self, size, at):
        self.seen.append((at, size))
        return self.file.read_at(size, at)


def test_a_stride_reads_its_own_bytes_only(tmp_path, monkeypatch):
    write_dcd(tmp_path / "x.dcd", frames(1000))
    path = str(tmp_path / "x.dcd")
    reader = dcd.DcdReader({"path": path, "stride": "100"})
    parts, seen = reader.partitions(), []

    class System:
        def open_input_file(self, inner):
            return Watched(dcd.fs.LocalFileSystem().open_input_file(inner), seen)

    monkeypatch.setattr(dcd, "opened", lambda p: (System(), p))
    got = [k for p in parts for batch in reader.read(p) for k in batch.column(0).to_pylist()]
    size = parts[0].layout.size
    assert got == list(range(0, 1000, 100))
    assert sum(n for _, n in seen) == 10 * size and {(at - parts[0].layout.first) % (100 * size) for at, _ in seen} == {0}


def test_layout_is_checked(tmp_path, spark):
    write_dcd(tmp_path / "fixed.dcd", frames(2), fixed=3)
    (tmp_path / "no.dcd").write_bytes(b"nothing of the kind" * 10)
    for name, message in (("fixed", "do not move"), ("no", "not a DCD")):
        path = tmp_path / f"{name}.dcd"
        with path.open("rb") as file, pytest.raises(ValueError, match=message):
            layout_of(file, str(path), path.stat().st_size)
    with pytest.raises(FileNotFoundError):
        dcd.files_of(str(tmp_path / "none.dcd"))
    write_dcd(tmp_path / "cut.dcd", frames(5))
    whole = (tmp_path / "cut.dcd").read_bytes()
    (tmp_path / "cut.dcd").write_bytes(whole[:-10])  # a run that was ended while writing
    with (tmp_path / "cut.dcd").open("rb") as file:
        assert layout_of(file, "cut", len(whole) - 10).frames == 4
    assert ranges_of([0, 1, 2, 5, 7, 8]) == "0-2,5-5,7-8" and places_of("0-2,5-5").tolist() == [0, 1, 2, 5]


def test_atoms_by_topology(spark, tmp_path):
    names = ["N", "CA", "C", "O", "CB", "OW", "HW"]
    rows = [(10 + k, n, "ALA" if k < 5 else "HOH", 1 if k < 5 else 2, "A") for k, n in enumerate(names)]
    top = spark.createDataFrame(rows[::-1], "serial int, name string, resname string, resseq int, chain string")
    xyz = frames(6, 3)
    write_dcd(tmp_path / "x.dcd", xyz)
    got = read_dcd(spark, str(tmp_path / "x.dcd"), top, stride=2).toPandas().sort_values(["frame", "serial"])
    assert got["frame"].unique().tolist() == [0, 2, 4] and got["name"].tolist() == names[:5] * 3
    assert np.array_equal(got[["x", "y", "z"]].to_numpy().reshape(3, 5, 3), xyz[::2, :5].astype(float))
    whole = read_dcd(spark, str(tmp_path / "x.dcd"), top, protein_only=False)
    assert whole.count() == 6 * 7
    with pytest.raises(ValueError, match="7 atoms, the topology 6"):
        read_dcd(spark, str(tmp_path / "x.dcd"), top.filter("serial > 10"))


def test_residues_without_a_letter_are_refused(spark):
    from arborinfo.operators.topology import select_protein

    rows = [("CA", "ALA"), ("OW", "HOH"), ("CA", "CA"), ("C1", "LIG"), (None, None)]
    df = spark.createDataFrame(rows, "name string, resname string")
    assert [tuple(r) for r in select_protein(df).collect()] == [("CA", "ALA")]
    with pytest.raises(Exception, match="without a letter: MSE"):
        select_protein(df.union(spark.createDataFrame([("CA", "MSE")], df.schema))).collect()
