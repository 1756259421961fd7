"""Reading trajectories: atoms (frame, serial, name, resname, resseq, chain, icode, x, y, z, bfactor)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborinfo.operators.geometry import superpose as superpose_frames
from arborinfo.operators.topology import select_protein

ATOMS = ("ATOM  ", "HETATM")


def read_pdb(
    spark: SparkSession, path: str, stride: int = 1, protein_only: bool = True,
    superpose: bool = False,
) -> DataFrame:
    """Atoms of a PDB file or of all PDB files of a folder, in the order of their names.

    A record of the text source is one MODEL, so files with many frames are split between
    tasks. Coordinates are in Angstrom. Of alternate locations of an atom the first named one is
    kept; insertion codes are in ``icode``.
    """
    models = spark.read.option("lineSep", "ENDMDL").text(path).select(
        F.col("_metadata.file_path").alias("file"), "value",
        F.coalesce(
            F.regexp_extract("value", r"(?m)^MODEL\s+(\d+)", 1).try_cast("long"), F.lit(0)
        ).alias("model"),
    ).filter(F.col("value").rlike(r"(?m)^ATOM"))
    # One row per file: where its frames start.
    files = models.groupBy("file").agg(F.min("model").alias("low"), F.max("model").alias("high"))
    span = F.col("high") - F.col("low") + 1
    files = files.select(
        "file", "low", (F.sum(span).over(Window.orderBy("file")) - span).alias("offset")
    )
    lines = models.join(files, "file").select(
        (F.col("offset") + F.col("model") - F.col("low")).alias("frame"), "value"
    ).filter(F.col("frame") % stride == 0)
    lines = lines.select("frame", F.split("value", r"\r?\n").alias("lines"))
    named = F.filter("lines", lambda x: F.substring(x, 1, 6).isin(*ATOMS) & (F.substring(x, 17, 1) != " "))
    # Atom name, and chain with number and insertion code.
    atom = lambda x: F.concat(F.substring(x, 13, 4), F.substring(x, 22, 6))
    earlier = lambda x: F.exists("named", lambda y: (atom(y) == atom(x)) & (F.substring(y, 17, 1) < F.substring(x, 17, 1)))
    lines = lines.withColumn("named", named).select(
        "frame", F.explode(F.filter("lines", lambda x: (F.substring(x, 17, 1) == " ") | ~earlier(x))).alias("line")
    )
    cut = lambda start, length: F.trim(F.substring("line", start, length))
    atoms = lines.filter(F.substring("line", 1, 6).isin(*ATOMS)).select(
        "frame",
        cut(7, 5).cast("int").alias("serial"), cut(13, 4).alias("name"), cut(18, 3).alias("resname"),
        cut(23, 4).cast("int").alias("resseq"), cut(22, 1).alias("chain"),
        cut(27, 1).alias("icode"),
        cut(31, 8).cast("double").alias("x"), cut(39, 8).cast("double").alias("y"),
        cut(47, 8).cast("double").alias("z"), cut(61, 6).try_cast("double").alias("bfactor"),
    )
    if protein_only:
        atoms = select_protein(atoms)
    return superpose_frames(atoms) if superpose else atoms


def read_atoms(
    spark: SparkSession, path: str, stride: int = 1, protein_only: bool = True,
    superpose: bool = True,
) -> DataFrame:
    """Atoms from Parquet; filters reach the scan."""
    atoms = spark.read.parquet(path)
    if stride > 1:
        atoms = atoms.filter(F.col("frame") % stride == 0)
    if protein_only:
        atoms = select_protein(atoms)
    return superpose_frames(atoms) if superpose else atoms
