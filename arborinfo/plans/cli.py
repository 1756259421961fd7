"""Command line: ``python -m arborinfo.plans.cli angles|logits ...``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import functions as F

from arborinfo.functions.entropy import PRIORS
from arborinfo.lineage import materialize
from arborinfo.operators import geometry, topology
from arborinfo.plans.fit import fit_angles, fit_logits, log, timed
from arborinfo.session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Infer an information tree.")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("angles", "from a trajectory"), ("logits", "from sampler scores")):
        s = sub.add_parser(name, help=text)
        s.add_argument("-t", "--trajectory", required=True, help="Parquet atoms, PDB or DCD file or folder; Parquet scores for logits")
        s.add_argument("-o", "--output_prefix", required=True)
        s.add_argument("--seed", type=int, default=0)
        s.add_argument("--prior", choices=PRIORS, default="haldane")
        s.add_argument("--master", default=None, help="Spark master; spark-submit decides by default")
        if name == "angles":
            s.add_argument("-p", "--topology", help="PDB file with the atoms of a DCD trajectory")
            s.add_argument("--stride", type=int, default=1)
            s.add_argument("--min_mass", type=float, default=0.01)
            s.add_argument("--components", type=int, default=100)
            s.add_argument("--draw", action="store_true", help="write files for the viewer")
    return p


def holds(spark, path: str, kind: str) -> bool:
    """Whether ``path`` is a file of this kind (its ending) or a folder with such files."""
    if path.endswith((".pdb", ".dcd", ".parquet")):
        return path.endswith(kind)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{kind}").load(path)
    return not files.select("path").isEmpty()


def holds_text(spark, path: str) -> bool:
    """Whether ``path`` is a PDB file or a folder of them; what is neither text nor binary is read as Parquet."""
    return holds(spark, path, ".pdb")


def read_trajectory(spark, path: str, topology_path: str | None, stride: int):
    """Atoms of a trajectory of any known format."""
    from arborinfo.sources.dcd import read_dcd
    from arborinfo.sources.trajectory import read_atoms, read_pdb

    if holds(spark, path, ".dcd"):
        if not topology_path:
            raise ValueError("a DCD trajectory needs the PDB file of its atoms")
        first = read_pdb(spark, topology_path, protein_only=False).filter("frame = 0")
        return read_dcd(spark, path, first, stride=stride)
    return (read_pdb if holds_text(spark, path) else read_atoms)(spark, path, stride=stride, superpose=False)


def run_angles(spark, args, out: str) -> None:
    from arborinfo.sinks.drawing import draw_tree
    from arborinfo.sinks.results import save_clustering, save_mixtures, save_tree

    atoms = read_trajectory(spark, args.trajectory, args.topology, args.stride)
    first = atoms.agg(F.min("frame")).first()[0]
    frame0 = materialize(atoms.filter(F.col("frame") == first), "topology")
    residues = materialize(topology.residue_numbers(frame0), "residues")
    chain = topology.to_single_chain(atoms, residues)
    internal = geometry.internal_coordinates(geometry.slot_coordinates(chain))
    angles = geometry.angle_features(internal)
    labels = {r["residue"]: r["label"] for r in residues.collect()}
    run = fit_angles(
        angles, geometry.feature_masks(residues), labels, args.components, args.seed,
        min_mass=args.min_mass, prior=args.prior,
    )
    timed("Saved results", save_tree)(run.tree, out)
    save_clustering(run, out)
    save_mixtures(run.fit, out)
    if args.draw:
        draw_tree(run.tree, topology.to_single_chain(frame0, residues), f"{out}/drawing")


def run_logits(spark, args, out: str) -> None:
    from arborinfo.sinks.results import save_tree

    tree = timed("Inferred tree", fit_logits)(spark.read.parquet(args.trajectory), prior=args.prior)
    timed("Saved results", save_tree)(tree, out)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.WARNING)
    log.setLevel(logging.INFO)
    spark = build_session(args.master)
    out = f"{args.output_prefix}_seed_{args.seed}"
    (run_angles if args.command == "angles" else run_logits)(spark, args, out)


if __name__ == "__main__":
    main()
