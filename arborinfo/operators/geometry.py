"""Cartesian and internal coordinates of trajectories.

Atoms (frame, residue, resname, name, x, y, z) become one row per frame and residue with the
coordinates in their slots, then one row per frame, residue and slot with the internal
coordinates. Everything about a frame happens in the partition the frame was hashed to: one
shuffle, by frame.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborinfo.functions.vec3 import decompose, vec
from arborinfo.lineage import materialize, ship_package
from arborinfo.operators.topology import SLOTS, layout, layout_rows, one_letter



def slot_atoms(atoms: DataFrame) -> DataFrame:
    """Atoms that have a slot, with ``aa`` and ``slot``; others (hydrogens, ...) are dropped."""
    slots = layout(atoms.sparkSession).select("aa", F.col("atom").alias("name"), "slot")
    return atoms.withColumn("aa", one_letter(F.col("resname"))).join(
        F.broadcast(slots), ["aa", "name"]  # fixed table, under 200 rows
    )


def slot_coordinates(atoms: DataFrame) -> DataFrame:
    """(frame, residue, aa, c): coordinates by slot, 14 of them, NULL where there is no atom."""
    rows = slot_atoms(atoms).select(
        "frame", "residue", "aa", "slot",
        F.struct(*[F.col(k).cast("double").alias(k) for k in "xyz"]).alias("p"),
    )
    gathered = rows.repartition("frame").groupBy("frame", "residue", "aa").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "p"))).alias("m")
    )
    return gathered.select(
        "frame", "residue", "aa",
        F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.col("m")[i]).alias("c"),
    )


def slot_list(coordinates: DataFrame) -> DataFrame:
    """(frame, residue, aa, slot, x, y, z): the inverse of ``slot_coordinates``."""
    return coordinates.select("frame", "residue", "aa", F.posexplode("c").alias("slot", "p")).filter(
        "p is not null"
    ).select("frame", "residue", "aa", "slot", "p.*")


def residue_layout(spark) -> DataFrame:
    """(aa, refs, m): the reference slots of slots 3..13 and the mask of the 14 slots."""
    table = layout(spark)
    return table.groupBy("aa").agg(
        F.sort_array(
            F.collect_list(F.when(F.col("slot") >= 3, F.struct("slot", "a", "b", "c")))
        ).alias("refs"),
        F.collect_list("slot").alias("_slots"),
    ).select(
        "aa", "refs",
        F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.array_contains("_slots", i)).alias("m"),
    )


def internal_coordinates(coordinates: DataFrame) -> DataFrame:
    """(frame, residue, aa, slot, length, angle, dihedral) of every occupied slot.

    Backbone atoms follow the three atoms before them, a residue of zeros standing before the
    first. The beta carbon hangs on the previous residue's C, or in the first residue on the
    next one's N. The first angle has no meaning and is 1.
    """
    along = Window.partitionBy("frame").orderBy("residue")
    zero = F.struct(*[F.lit(0.0).alias(k) for k in "xyz"])
    at = lambda i: F.col("c")[i]
    before = lambda i: F.coalesce(F.lag(at(i)).over(along), zero)
    rows = coordinates.select(
        "frame", "residue", "aa", "c",
        before(0).alias("n0"), before(1).alias("a0"), before(2).alias("c0"),
        F.lag(at(2)).over(along).alias("prev_c"), F.lead(at(0)).over(along).alias("next_n"),
        (F.row_number().over(along) == 1).alias("first"),
    ).join(F.broadcast(residue_layout(coordinates.sparkSession)), "aa")  # 20 rows
    quad = lambda slot, a, b, c, d: F.struct(
        slot.alias("slot"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")
    )
    backbone = F.array(
        quad(F.lit(0), F.col("n0"), F.col("a0"), F.col("c0"), at(0)),
        quad(F.lit(1), F.col("a0"), F.col("c0"), at(0), at(1)),
        quad(F.lit(2), F.col("c0"), at(0), at(1), at(2)),
    )

    def hanging(r):
        beta = r["slot"] == 4
        get = lambda i: F.get("c", r[i])
        start = beta & F.col("first")
        # First residue: next N, C, CA, CB; else previous C, N, CA, CB.
        a = F.when(start, F.col("next_n")).when(beta, F.col("prev_c")).otherwise(get("a"))
        b = F.when(start, at(2)).otherwise(get("b"))
        return quad(r["slot"], a, b, get("c"), F.get("c", r["slot"]))

    quads = F.concat(backbone, F.transform("refs", hanging))
    points = rows.select("frame", "residue", "aa", "first", F.explode(quads).alias("q")).select(
        "frame", "residue", "aa", "first", "q.*"
    ).filter("d is not null")
    out = points.select(
        "frame", "residue", "aa", "first", "slot", decompose(*[vec(k) for k in "abcd"]).alias("i")
    )
    return out.select(
        "frame", "residue", "aa", "slot", "i.length",
        F.when(F.col("first") & (F.col("slot") == 0), F.lit(1.0)).otherwise(F.col("i.angle")).alias("angle"),
        "i.dihedral",
    )


def shift_first_slot(
    features: DataFrame, towards: int, columns=("angle", "dihedral"), supplement: bool = False
) -> DataFrame:
    """Move entry 0 of the array columns by one residue, around the ends.

    ``towards`` = -1 gives every residue the entry of the next one, +1 that of the one before.
    ``supplement`` also turns the column ``angle`` into pi minus itself, the angle at the
    middle atom.
    """
    if supplement:
        features = features.withColumn("angle", F.transform("angle", lambda x: F.pi() - x))
    along = Window.partitionBy("frame").orderBy("residue")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for name in columns:
        head = F.col(name)[0]
        if towards < 0:
            moved = F.coalesce(F.lead(head).over(along), F.first(head).over(whole))
        else:
            moved = F.coalesce(F.lag(head).over(along), F.last(head).over(whole))
        features = features.withColumn(
            name, F.concat(F.array(moved), F.slice(name, 2, SLOTS - 1))
        )
    return features


def slot_arrays(internal: DataFrame, columns=("length", "angle", "dihedral")) -> DataFrame:
    """(frame, residue, aa, arrays...) of 14 entries, 0 where a slot is empty."""
    entries = F.map_from_entries(F.collect_list(F.struct("slot", F.struct(*columns)))).alias("m")
    gathered = internal.groupBy("frame", "residue", "aa").agg(entries)
    index = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    filled = lambda name: F.transform(index, lambda i: F.coalesce(F.col("m")[i][name], F.lit(0.0)))
    return gathered.select("frame", "residue", "aa", *[filled(c).alias(c) for c in columns])


def angle_features(internal: DataFrame) -> DataFrame:
    """(residue, frame, theta): 14 bond angles, then 14 dihedrals, entry 0 moved back by one
    residue."""
    rows = shift_first_slot(slot_arrays(internal, ("angle", "dihedral")), -1)
    return rows.select(
        F.col("residue").cast("int").alias("residue"), F.col("frame").cast("long").alias("frame"),
        F.concat("angle", "dihedral").alias("theta"),
    )


def feature_masks(residues: DataFrame) -> DataFrame:
    """(residue, m): which of the 28 features exist, from (residue, resname)."""
    table = residue_layout(residues.sparkSession).select("aa", "m")
    return residues.select("residue", one_letter(F.col("resname")).alias("aa")).join(
        F.broadcast(table), "aa"  # 20 rows
    ).select(F.col("residue").cast("int").alias("residue"), F.concat("m", "m").alias("m"))


def mean_lengths(internal: DataFrame) -> DataFrame:
    """The same coordinates with every bond length replaced by its mean over the frames.

    Means are one row per residue and slot; the frames keep their partitioning.
    """
    means = internal.groupBy("residue", "slot").agg(F.avg("length").alias("length"))
    return internal.drop("length").join(means, ["residue", "slot"]).select(*internal.columns)


def backbone_internal(points: DataFrame) -> DataFrame:
    """(frame, pos, length, angle, dihedral) of chains of points (frame, pos, x, y, z)."""
    along = Window.partitionBy("frame").orderBy("pos")
    p = F.struct("x", "y", "z")
    rows = points.select("frame", "pos", p.alias("d"), *[
        F.lag(p, k).over(along).alias(n) for k, n in ((1, "c"), (2, "b"), (3, "a"))
    ]).filter("a is not null")
    return rows.select("frame", "pos", decompose(*[vec(k) for k in "abcd"]).alias("i")).select(
        "frame", "pos", "i.*"
    )


def _place(a, b, c, length, angle, torsion):
    """numpy twin of ``functions.vec3.place`` for arrays of points (frames, 3)."""
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    along = unit(c - b)
    normal = unit(np.cross(b - a, c - b))
    side = np.cross(normal, along)
    length, angle, torsion = (x[:, None] for x in (length, angle, torsion))
    return c + length * (
        np.cos(angle) * along
        + np.sin(angle) * (np.cos(torsion) * side + np.sin(torsion) * normal)
    )


START = ((-1.0, -1.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 0.0, 0.0))
#: Residues, or points, of a chain that are folded in one piece.
PIECE_RESIDUES, PIECE_POINTS = 1000, 4096


def chained(values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(frames, atoms, 3) positions of a chain from its (frames, atoms, 3) internal coordinates, and
    its last three points.

    The chain starts after three points at (-1,-1,0), (-1,0,0) and the origin. Work is
    vectorized over the frames of a batch.
    """
    frames = len(values)
    last = [np.tile(np.array(p), (frames, 1)) for p in START]
    out = np.empty((frames, values.shape[1], 3))
    for i in range(values.shape[1]):
        out[:, i] = _place(*last, values[:, i, 0], values[:, i, 1], values[:, i, 2])
        last = [last[1], last[2], out[:, i]]
    return out, last


def fold_backbone(values: np.ndarray) -> np.ndarray:
    """The positions alone."""
    return chained(values)[0]


def axes_of(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(n, 3, 3) with the axes as columns that the next point after a, b, c is placed by."""
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    along, normal = unit(c - b), unit(np.cross(b - a, c - b))
    return np.stack([along, np.cross(normal, along), normal], axis=-1)


def turn_of(last: list[np.ndarray]) -> np.ndarray:
    """(n, 12): the rotation and shift that carry the starting points' axes to those of ``last``."""
    start = axes_of(*[np.array([p]) for p in START])[0]
    return np.concatenate([(axes_of(*last) @ start.T).reshape(-1, 9), last[2]], axis=1)


def composed(turns: np.ndarray) -> np.ndarray:
    """(pieces, 12): what carries each piece to its place, from the turns over the pieces themselves."""
    out = np.empty_like(turns)
    rotation, shift = np.eye(3), np.zeros(3)
    for k, turn in enumerate(turns):
        out[k, :9], out[k, 9:] = rotation.ravel(), shift
        rotation, shift = rotation @ turn[:9].reshape(3, 3), rotation @ turn[9:] + shift
    return out


def carried(pieces: DataFrame) -> DataFrame:
    """(frame, block, m): where each piece of a chain belongs, from (frame, block, turn).

    A frame is a list of its pieces' turns here, twelve numbers each.
    """
    turns = pieces.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("block", "turn"))).alias("g"))

    def scan(batches):
        for batch in batches:
            blocks, flat = batch.column(1), np.asarray(batch.column(2).flatten().flatten()).reshape(-1, 12)
            offsets = np.asarray(blocks.offsets) - np.asarray(blocks.offsets)[0]
            moves = [composed(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            m = np.concatenate(moves) if moves else np.zeros((0, 12))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * 12), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.asarray(batch.column(0)), np.diff(offsets)), pa.int64()), blocks.flatten(), lists],
                names=["frame", "block", "m"],
            )

    return turns.select("frame", "g.block", "g.turn").mapInArrow(scan, "frame long, block int, m array<double>")


def in_place(pieces: DataFrame, name: str) -> DataFrame:
    """(frame, at, x, y, z) of pieces (frame, block, at, xyz, turn) that were folded apart."""
    pieces = materialize(pieces, name)
    moves = carried(pieces.select("frame", "block", "turn"))
    local = pieces.join(moves, ["frame", "block"]).select("frame", "at", "xyz", "m", F.posexplode("at").alias("k", "place"))
    axis = lambda j: F.get("xyz", 3 * F.col("k") + j)
    moved = lambda i: sum((F.get("m", F.lit(3 * i + j)) * axis(j) for j in range(3)), F.get("m", F.lit(9 + i)))
    return local.select("frame", F.col("place").alias("at"), *[moved(i).alias(c) for i, c in enumerate("xyz")])


def fold_frames(values: np.ndarray, sequence: str, first: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(frames, residues, 14, 3) from (frames, residues, 14, 3) internal coordinates, and their turns.

    A piece that is not the ``first`` of a chain follows a carbon at the origin.
    """
    frames, residues = values.shape[:2]
    out = np.full((frames, residues, SLOTS, 3), np.nan)
    chain, last = chained(values[:, :, :3].reshape(frames, -1, 3))
    out[:, :, :3] = chain.reshape(frames, residues, 3, 3)
    hanging = {}
    for row in layout_rows():
        if row["slot"] >= 3:
            hanging.setdefault(row["aa"], []).append((row["slot"], row["a"], row["b"], row["c"]))
    for r, aa in enumerate(sequence):
        for slot, a, b, c in sorted(hanging[aa]):
            before, second = out[:, r, a], out[:, r, b]
            if slot == 4 and r:
                before = out[:, r - 1, 2]
            elif slot == 4 and not first:
                before = np.zeros_like(second)
            elif slot == 4:
                before, second = out[:, 1, 0], out[:, 0, 2]
            out[:, r, slot] = _place(before, second, out[:, r, c], *values[:, r, slot].T)
    return out, turn_of(last)


PIECE_SQL = "frame long, block int, at array<int>, xyz array<double>, turn array<double>"


def piece_batch(frame: np.ndarray, block: np.ndarray, at: np.ndarray, xyz: np.ndarray, turn: np.ndarray) -> pa.RecordBatch:
    """Pieces with the same places ``at``; xyz is (pieces, places, 3)."""
    def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel(), kind))

    n = len(frame)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(frame, pa.int64()), pa.array(block, pa.int32()), lists(np.tile(at, (n, 1)), pa.int32()),
            lists(xyz.reshape(n, -1), pa.float64()), lists(turn, pa.float64()),
        ],
        names=["frame", "block", "at", "xyz", "turn"],
    )


def fold(internal: DataFrame, piece: int = PIECE_RESIDUES) -> DataFrame:
    """(frame, residue, aa, slot, x, y, z) from internal coordinates in natural order.

    Up to ``piece`` residues (two or more) of a frame are one row of residues x 14 entries; batches of such
    rows are folded together. A longer chain is folded in pieces, each from the starting points;
    a scan over their turns then carries every piece to its place.
    """
    ship_package(internal.sparkSession)
    sequence = "".join(
        r["aa"] for r in internal.select("residue", "aa").distinct().orderBy("residue").collect()
    )
    whole = len(sequence) <= piece
    block = F.lit(0) if whole else F.floor(F.col("residue") / piece).cast("int")
    frames = internal.withColumn("block", block).groupBy("frame", "block").agg(
        F.collect_list(
            F.struct(
                ((F.col("residue") - F.col("block") * (0 if whole else piece)) * SLOTS + F.col("slot")).cast("int").alias("at"),
                "length", "angle", "dihedral",
            )
        ).alias("g")
    ).select("frame", "block", "g.at", "g.length", "g.angle", "g.dihedral")
    schema = pa.schema(
        [("frame", pa.int64()), ("residue", pa.int32()), ("slot", pa.int32())]
        + [(k, pa.float64()) for k in "xyz"]
    )

    def folded(batches):
        """(frames, number of their block, positions, turns) of rows with the same block."""
        for batch in batches:
            frame, blocks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for number in np.unique(blocks).tolist():
                part = batch.filter(pa.array(blocks == number))
                n, letters = part.num_rows, sequence if whole else sequence[number * piece : (number + 1) * piece]
                values = np.zeros((n, len(letters) * SLOTS, 3))
                at = part.column(2)
                row = np.repeat(np.arange(n), np.diff(np.asarray(at.offsets)))
                for k in range(3):
                    values[row, np.asarray(at.flatten()), k] = np.asarray(part.column(3 + k).flatten())
                xyz, turn = fold_frames(values.reshape(n, len(letters), SLOTS, 3), letters, number == 0)
                yield frame[blocks == number], number, xyz, turn

    def rows(batches):
        for frame, _, xyz, _ in folded(batches):
            f, r, s = np.nonzero(~np.isnan(xyz[..., 0]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(frame[f], pa.int64()), pa.array(r, pa.int32()),
                    pa.array(s, pa.int32()), *[pa.array(xyz[f, r, s, k], pa.float64()) for k in range(3)],
                ],
                schema=schema,
            )

    def pieces(batches):
        for frame, number, xyz, turn in folded(batches):
            flat = xyz.reshape(len(frame), -1, 3)
            there = np.flatnonzero(~np.isnan(flat[0, :, 0]))
            at = (there + number * piece * SLOTS).astype(np.int32)
            yield piece_batch(frame, np.full(len(frame), number), at, flat[:, there], turn)

    if whole:
        placed = frames.mapInArrow(rows, "frame long, residue int, slot int, x double, y double, z double")
    else:
        placed = in_place(frames.mapInArrow(pieces, PIECE_SQL), "folded_pieces").select(
            "frame", F.floor(F.col("at") / SLOTS).cast("int").alias("residue"),
            (F.col("at") % SLOTS).alias("slot"), "x", "y", "z",
        )
    letters = F.lit(sequence)
    return placed.select(
        "frame", "residue", F.substring(letters, F.col("residue") + 1, F.lit(1)).alias("aa"), "slot", "x", "y", "z"
    )


def rebuild_backbone(chain: DataFrame, piece: int = PIECE_POINTS) -> DataFrame:
    """(frame, pos, x, y, z) from chains (frame, pos, length, angle, dihedral), pos from 0.

    Chains are cut into pieces of up to ``piece`` points, which are folded apart and then carried to their
    places; a chain of one piece stays where it is.
    """
    ship_package(chain.sparkSession)
    block = F.floor(F.col("pos") / piece).cast("int")
    frames = chain.groupBy("frame", block.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "length", "angle", "dihedral"))).alias("g")
    ).select("frame", "block", F.expr("flatten(transform(g, e -> array(e.length, e.angle, e.dihedral)))").alias("v"))

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(np.asarray(batch.column(2).offsets))
            flat, frame = np.asarray(batch.column(2).flatten()), np.asarray(batch.column(0))
            number = np.asarray(batch.column(1))
            start = np.concatenate([[0], np.cumsum(sizes)])
            for size, block in sorted(set(zip(sizes.tolist(), number.tolist()))):
                hit = np.flatnonzero((sizes == size) & (number == block))
                values = np.stack([flat[start[i]:start[i + 1]] for i in hit]).reshape(len(hit), -1, 3)
                xyz, last = chained(values)
                at = np.arange(xyz.shape[1], dtype=np.int32) + block * piece
                yield piece_batch(frame[hit], number[hit], at, xyz, turn_of(last))

    pieces = frames.mapInArrow(rows, PIECE_SQL)
    return in_place(pieces, "chain_pieces").select("frame", F.col("at").alias("pos"), "x", "y", "z")


def rebuilt_frames(
    internal: DataFrame, mean_length: bool = True, onto: DataFrame | None = None
) -> DataFrame:
    """Atoms (frame, residue, aa, slot, x, y, z) of internal coordinates.

    ``mean_length`` holds every bond at its mean over the frames; ``onto`` (residue, slot, x, y,
    z) is a structure all frames are superposed on.
    """
    placed = fold(mean_lengths(internal) if mean_length else internal)
    if onto is None:
        return placed
    # Superposing reads the frames twice; they are folded once.
    placed = materialize(placed, "folded")
    at = (F.col("residue") * SLOTS + F.col("slot")).alias("serial")
    moved = superpose(placed.select("*", at), fixed=onto.select(at, "x", "y", "z"))
    return moved.drop("serial")


def superpose(
    atoms: DataFrame, reference: int | None = None, key: str = "serial",
    fixed: DataFrame | None = None,
) -> DataFrame:
    """Move every frame onto the reference frame (the first), or onto the structure ``fixed``,
    by least squares.

    Per frame, the sums behind the covariance with the reference are one aggregate; the
    rotations come from batched 3 x 3 singular value decompositions.
    """
    ship_package(atoms.sparkSession)
    if fixed is None:
        if reference is None:
            reference = atoms.agg(F.min("frame")).first()[0]
        fixed = atoms.filter(F.col("frame") == reference)
    fixed = fixed.select(key, *[F.col(k).cast("double").alias(f"r{k}") for k in "xyz"])
    paired = atoms.join(fixed, key)
    moments = paired.groupBy("frame").agg(
        *[F.avg(k).alias(f"m{k}") for k in "xyz"],
        *[F.avg(f"r{k}").alias(f"n{k}") for k in "xyz"],
        *[F.covar_pop(a, f"r{b}").alias(f"h{a}{b}") for a in "xyz" for b in "xyz"],
    )
    names = [f"h{a}{b}" for a in "xyz" for b in "xyz"]

    @F.pandas_udf("array<double>")
    def rotation(*h):
        import pandas as pd

        m = np.stack([np.asarray(x, float) for x in h], axis=1).reshape(-1, 3, 3)
        u, _, vt = np.linalg.svd(m)
        flip = np.sign(np.linalg.det(u @ vt))
        u[:, :, 2] *= flip[:, None]
        return pd.Series(list((u @ vt).reshape(-1, 9)))

    turns = moments.select(
        "frame", *[f"m{k}" for k in "xyz"], *[f"n{k}" for k in "xyz"], rotation(*names).alias("q")
    )
    centred = [F.col(k) - F.col(f"m{k}") for k in "xyz"]
    moved = {
        k: F.col(f"n{k}") + sum((centred[i] * F.col("q")[3 * i + j] for i in range(3)), F.lit(0.0))
        for j, k in enumerate("xyz")
    }
    return atoms.join(turns, "frame").select(
        *[moved[c].alias(c) if c in moved else F.col(c) for c in atoms.columns]
    )
