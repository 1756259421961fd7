"""A tree drawn on a structure: tables of radii and colours, and the viewer's files.

All tables have one row per variable, tree edge or atom of one structure.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborinfo.functions.vec3 import distance, vec
from arborinfo.plans.tree import InformationTree

# Fixed value: sticks are sized with distances in nanometres, coordinates are in Angstrom.
NANOMETRES = 0.1
# Colour anchors from light to dark; a map of any length may be given instead.
EDGE_COLOURS = ((0.96, 0.94, 0.78), (0.82, 0.70, 0.40), (0.55, 0.38, 0.24), (0.20, 0.12, 0.10))


def colour(value: Column, low: float, high: float, anchors=EDGE_COLOURS) -> Column:
    """struct<r, g, b> by linear interpolation between ``anchors`` over [low, high]."""
    last = len(anchors) - 1
    t = F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * last
    i = F.least(F.floor(t), F.lit(last - 1)).cast("int")
    channel = lambda k: F.array(*[F.lit(float(a[k])) for a in anchors])
    mix = lambda c: c[i] + (c[i + 1] - c[i]) * (t - i)
    return F.struct(*[mix(channel(k)).alias(n) for k, n in enumerate("rgb")])


def drawn_nodes(
    tree: InformationTree, points: DataFrame, sphere: float = 1.0, decay: float = 1.0
) -> DataFrame:
    """(id, var, resseq, entropy, bfactor, vdw, p) in the order of ``points``.

    ``points`` is (var, serial, resseq, x, y, z): one alpha carbon per variable.
    """
    rows = tree.node_entropies().join(points, "var")
    entropy = F.col("entropy")
    return rows.select(
        F.row_number().over(Window.orderBy("serial")).alias("id"), "var", "resseq", "entropy",
        F.exp(-decay * entropy).alias("bfactor"),
        (sphere * F.pow(entropy, F.lit(1.0 / 3.0))).alias("vdw"),
        F.struct("x", "y", "z").alias("p"),
    )


def drawn_edges(
    tree: InformationTree, nodes: DataFrame, min_mi: float = 0.0, base: float = 1.0,
    min_radius: float = 0.1, low: float = 0.0, high: float = 1.0, anchors=EDGE_COLOURS,
) -> DataFrame:
    """(u_id, v_id, mi, radius, colour): a stick's volume is proportional to its information."""
    edges = tree.edge_information()
    for end in ("u", "v"):
        edges = edges.join(
            nodes.select(F.col("var").alias(end), F.col("id").alias(f"{end}_id"), F.col("p").alias(f"{end}_p")),
            end,
        )
    wide = base * F.sqrt(F.col("mi") / (math.pi * NANOMETRES * distance(vec("u_p"), vec("v_p"))))
    radius = F.when(F.col("mi") > min_mi, wide).otherwise(0.0)
    return edges.select(
        F.least("u_id", "v_id").alias("u_id"), F.greatest("u_id", "v_id").alias("v_id"), "mi",
        F.greatest(radius, F.lit(min_radius)).alias("radius"),
        colour(F.col("mi"), low, high, anchors).alias("colour"),
    )


def script_lines(nodes: DataFrame, edges: DataFrame, node_map: str, low: float, high: float) -> list[str]:
    """The viewer script."""
    # Fixed text: commands of the viewer's language.
    bond = edges.select(
        "u_id", "v_id",
        F.format_string("cmd.bond('tree and id %d', 'tree and id %d')", "u_id", "v_id").alias("bond"),
        F.format_string(
            "cmd.set_color('I_%d_%d', ('%s', '%s', '%s'))", "u_id", "v_id",
            *[F.col(f"colour.{c}").cast("string") for c in "rgb"],
        ).alias("colour"),
        F.format_string(
            "cmd.set_bond('stick_color', 'I_%d_%d', 'tree and id %d', 'tree and id %d')",
            "u_id", "v_id", "u_id", "v_id",
        ).alias("bond_colour"),
        F.format_string(
            "cmd.set_bond('stick_radius', %s, 'tree and id %d', 'tree and id %d')",
            F.col("radius").cast("string"), "u_id", "v_id",
        ).alias("radius"),
    ).orderBy("u_id", "v_id").collect()
    label = nodes.select(
        "id",
        F.format_string(
            "cmd.alter('resi %d and name CA', 'q=%s')", "resseq", F.col("entropy").cast("string")
        ).alias("q"),
        F.format_string(
            "cmd.alter('resi %d and name CA and tree', 'vdw=%s')", "resseq", F.col("vdw").cast("string")
        ).alias("vdw"),
    ).orderBy("id").collect()
    lines = ["load structure.pdb", "load tree.pdb", "hide cartoon, tree"]
    for part in ("bond", "colour", "bond_colour", "radius"):
        lines += [r[part] for r in bond]
    for r in label:
        lines += [r["q"], r["vdw"]]
    return lines + [
        "set cartoon_cylindrical_helices, 1",
        f"spectrum q, {node_map}, name CA, {low}, {high}",
        "show sticks, tree",
        "show spheres, tree",
        "set cartoon_transparency, 0.6",
        "set sphere_transparency, 0.3, all",
        "orient",
        "zoom visible, complete=1",
    ]


def pdb_lines(atoms: DataFrame) -> list[str]:
    """PDB records of one structure (serial, name, resname, resseq, chain, x, y, z, bfactor)."""
    padded = F.when(F.length("name") < 4, F.concat(F.lit(" "), F.rpad("name", 3, " "))).otherwise(F.col("name"))
    line = F.format_string(
        "ATOM  %5d %s %3s %1s%4d    %8.3f%8.3f%8.3f  1.00%6.2f          %2s",
        "serial", padded, "resname", F.coalesce(F.substring("chain", 1, 1), F.lit("A")), "resseq",
        "x", "y", "z", F.coalesce("bfactor", F.lit(0.0)),
        F.regexp_extract("name", r"([A-Z])", 1),
    )
    rows = atoms.select("serial", line.alias("line")).orderBy("serial").collect()
    return ["MODEL        0"] + [r["line"] for r in rows] + ["ENDMDL", "END"]


def write_lines(spark: SparkSession, path: str, lines: list[str]) -> None:
    """Write a small text file through the cluster's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = system.create(target, True)
    stream.write(bytearray("".join(line + "\n" for line in lines), "utf-8"))
    stream.close()


def draw_tree(
    tree: InformationTree, structure: DataFrame, folder: str, *, min_mi: float = 0.0,
    stick: float = 1.0, sphere: float = 1.0, decay: float = 1.0, min_radius: float = 0.1,
    edge_range: tuple[float, float] = (0.0, 1.0), node_range: tuple[float, float] = (0.0, 3.5),
    anchors=EDGE_COLOURS, node_map: str = "algae",
) -> None:
    """Write structure.pdb, tree.pdb and draw_tree.pml.

    ``structure`` holds the atoms of one frame with ``label``, the variable each belongs to.
    """
    spark = structure.sparkSession
    carbons = structure.filter("name = 'CA'").withColumnRenamed("label", "var")
    nodes = drawn_nodes(tree, carbons.select("var", "serial", "resseq", "x", "y", "z"), sphere, decay)
    edges = drawn_edges(tree, nodes, min_mi, stick, min_radius, *edge_range, anchors)
    b = nodes.select("var", "bfactor")
    with_b = carbons.drop("bfactor").join(b, "var")
    whole = structure.drop("bfactor").withColumn("bfactor", F.lit(0.0)).filter("name <> 'CA'")
    atoms = ["serial", "name", "resname", "resseq", "chain", "x", "y", "z", "bfactor"]
    write_lines(spark, f"{folder}/structure.pdb", pdb_lines(whole.select(atoms).union(with_b.select(atoms))))
    numbered = with_b.withColumn("serial", F.row_number().over(Window.orderBy("serial")))
    write_lines(spark, f"{folder}/tree.pdb", pdb_lines(numbered.select(atoms)))
    write_lines(spark, f"{folder}/draw_tree.pml", script_lines(nodes, edges, node_map, *node_range))
