"""Binary trajectories in DCD format, as a data source of their own.

A DCD file is a header and then frames of one fixed size, so any frame can be sought. The frames of all
files are dealt to partitions as ranges of bytes; a stride reads the bytes of its own frames only, and
of these the chosen atoms are kept. Nothing but the headers is read while planning.

    spark.dataSource.register(DcdSource)
    spark.read.format("dcd").option("stride", 10).load("runs/")      # frame, xyz

``read_dcd`` gives the same rows as the text sources, with names from a topology.
"""

from __future__ import annotations

import posixpath
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arborinfo.lineage import ship_package
from arborinfo.operators.geometry import superpose as superpose_frames
from arborinfo.operators.topology import PROTEIN_NAMES

#: Bytes of frames that one partition reads, and that a task holds at a time.
PARTITION_BYTES, CHUNK_BYTES = 64 << 20, 8 << 20
# Fixed values of the format: the header block's size, its mark, and the places of its numbers.
HEADER_BYTES, MARK = 84, b"CORD"
FIXED_ATOMS, UNIT_CELL, FOURTH_DIMENSION, VERSION = 8, 10, 11, 19
CELL_BYTES = 48


@dataclass(frozen=True)
class Layout:
    """Where the frames of a file lie."""

    order: str  # byte order, as in struct
    atoms: int
    first: int  # byte of the first frame
    cell: bool
    fourth: bool
    frames: int

    @property
    def size(self) -> int:
        """Bytes of a frame: blocks of coordinates with a length before and behind each."""
        blocks = 3 + self.fourth
        return blocks * (4 * self.atoms + 8) + (CELL_BYTES + 8 if self.cell else 0)

    def coordinates(self, raw: bytes) -> np.ndarray:
        """(frames, atoms, 3) of the bytes of whole frames."""
        words = np.frombuffer(raw, f"{self.order}f4").reshape(-1, self.size // 4)
        begin = (CELL_BYTES + 8) // 4 if self.cell else 0
        step = self.atoms + 2
        axes = [words[:, begin + k * step + 1 : begin + k * step + 1 + self.atoms] for k in range(3)]
        return np.stack(axes, axis=2).astype(np.float32)


def layout_of(file, path: str, total: int) -> Layout:
    """The layout of an open file of ``total`` bytes; the frames are counted by its size."""
    head = file.read(4)
    order = next((o for o in "<>" if len(head) == 4 and struct.unpack(f"{o}i", head)[0] == HEADER_BYTES), None)
    block = file.read(HEADER_BYTES + 4) if order else b""
    if block[:4] != MARK:
        raise ValueError(f"{path} is not a DCD file")
    numbers = struct.unpack(f"{order}20i", block[4:HEADER_BYTES])
    if numbers[FIXED_ATOMS]:
        raise ValueError(f"{path} leaves out atoms that do not move; write it with all atoms")
    (titles,) = struct.unpack(f"{order}i", file.read(4))
    file.seek(HEADER_BYTES + 8 + titles + 8)
    size, atoms, _ = struct.unpack(f"{order}3i", file.read(12))
    if size != 4 or atoms < 1:
        raise ValueError(f"{path} has no number of atoms")
    first = HEADER_BYTES + 8 + titles + 8 + 12
    modern = numbers[VERSION] != 0  # older files have neither cells nor a fourth dimension
    layout = Layout(order, atoms, first, modern and bool(numbers[UNIT_CELL]), modern and bool(numbers[FOURTH_DIMENSION]), 0)
    return Layout(*[getattr(layout, f) for f in ("order", "atoms", "first", "cell", "fourth")], (total - first) // layout.size)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all DCD files of a folder by name."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted(
        (posixpath.join(path, f.base_name), f.size)
        for f in found if f.type == fs.FileType.File and f.base_name.endswith(".dcd")
    )


def ranges_of(places: list[int]) -> str:
    """Sorted numbers as ``0-3,7-7``."""
    out: list[list[int]] = []
    for k in places:
        if out and out[-1][1] == k - 1:
            out[-1][1] = k
        else:
            out.append([k, k])
    return ",".join(f"{a}-{b}" for a, b in out)


def places_of(ranges: str) -> np.ndarray:
    pairs = [tuple(map(int, part.split("-"))) for part in ranges.split(",")]
    return np.concatenate([np.arange(a, b + 1) for a, b in pairs])


@dataclass
class FrameRange(InputPartition):
    """Every ``stride``-th frame of a file from its frame ``begin`` to ``end``; ``number`` is that of ``begin``."""

    path: str
    layout: Layout
    begin: int
    end: int
    number: int
    stride: int


class DcdReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.stride = int(options.get("stride", 1))
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.atoms = options.get("atoms")
        if self.stride < 1:
            raise ValueError("stride must be 1 or more")

    def partitions(self) -> list[FrameRange]:
        out, before, atoms = [], 0, None
        for path, size in files_of(self.path):
            system, inner = opened(path)
            with system.open_input_file(inner) as file:
                layout = layout_of(file, path, size)
            if atoms not in (None, layout.atoms):
                raise ValueError(f"{path} has {layout.atoms} atoms, the files before it {atoms}")
            atoms = layout.atoms
            # Frames are numbered over all files.
            first = -before % self.stride
            step = self.stride * max(1, self.bytes // layout.size)
            for begin in range(first, layout.frames, step):
                end = min(begin + step, layout.frames)
                out.append(FrameRange(path, layout, begin, end, before + begin, self.stride))
            before += layout.frames
        return out

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        layout, stride = partition.layout, partition.stride
        keep = places_of(self.atoms) if self.atoms else slice(None)
        system, inner = opened(partition.path)
        frames = range(partition.begin, partition.end, stride)
        step = max(1, CHUNK_BYTES // layout.size)
        with system.open_input_file(inner) as file:
            for low in range(0, len(frames), step):
                part = frames[low : low + step]
                if stride == 1:
                    raw = file.read_at(len(part) * layout.size, layout.first + part[0] * layout.size)
                else:
                    raw = b"".join(file.read_at(layout.size, layout.first + k * layout.size) for k in part)
                xyz = layout.coordinates(raw)[:, keep].reshape(len(part), -1)
                numbers = partition.number + np.arange(low, low + len(part)) * stride
                offsets = np.arange(len(part) + 1, dtype=np.int32) * xyz.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(xyz.ravel()))],
                    names=["frame", "xyz"],
                )


class DcdSource(DataSource):
    """Rows (frame, xyz) of DCD files; xyz has x, y and z of each atom in turn, in Angstrom.

    Options: ``path`` (a file, or a folder whose files are one trajectory in the order of their names),
    ``stride``, ``atoms`` (places of the atoms to keep, as ``0-3,7-7``), ``partitionBytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "dcd"

    def schema(self) -> str:
        return "frame bigint, xyz array<float>"

    def reader(self, schema) -> DcdReader:
        return DcdReader(self.options)


def read_dcd(
    spark: SparkSession, path: str, topology: DataFrame, stride: int = 1, protein_only: bool = True,
    superpose: bool = False,
) -> DataFrame:
    """Atoms (frame, serial, name, resname, resseq, chain[, icode], x, y, z) of a DCD file or folder.

    ``topology`` has the atoms of one frame, in the order of ``serial``; coordinates come in that order.
    The atoms of a molecule are few, so their places go to the reader as an option: what is not
    wanted (solvent) does not leave it.
    """
    ship_package(spark)
    spark.dataSource.register(DcdSource)
    names = [c for c in ("serial", "name", "resname", "resseq", "chain", "icode") if c in topology.columns]
    table = topology.select(*names).toArrow().sort_by("serial").to_pylist()
    places = [k for k, atom in enumerate(table) if not protein_only or atom["resname"] in PROTEIN_NAMES]
    files = files_of(path)
    if files:
        system, inner = opened(files[0][0])
        with system.open_input_file(inner) as file:
            atoms = layout_of(file, *files[0]).atoms
        if atoms != len(table):
            raise ValueError(f"{path} has {atoms} atoms, the topology {len(table)}")
    kept = spark.createDataFrame(
        pa.Table.from_pylist([{"place": k, **table[at]} for k, at in enumerate(places)], schema=pa.schema(
            [("place", pa.int32())] + [(c, pa.int32() if c in ("serial", "resseq") else pa.string()) for c in names]
        ))
    )
    frames = spark.read.format("dcd").option("stride", stride).option("atoms", ranges_of(places)).load(path)
    if not places:
        frames = frames.limit(0)
    each = frames.select("frame", "xyz", F.explode(F.sequence(F.lit(0), F.lit(max(len(places), 1) - 1))).alias("place"))
    axis = lambda k: F.get("xyz", F.col("place") * 3 + k).cast("double")
    rows = each.select("frame", "place", *[axis(k).alias(c) for k, c in enumerate("xyz")])
    atoms = rows.join(kept, "place").select("frame", *names, "x", "y", "z")
    return superpose_frames(atoms) if superpose else atoms
