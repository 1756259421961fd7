"""Residue numbering and the fixed atom layout of the amino acids."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborinfo.lineage import local_table

# One-letter codes of the residue names.
ONE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E",
    "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F",
    "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
# Names of protonation and disulphide forms and the residue they are.
FORMS = {
    "HSD": "HIS", "HSE": "HIS", "HSP": "HIS", "HID": "HIS", "HIE": "HIS", "HIP": "HIS",
    "CYX": "CYS", "CYM": "CYS", "ASH": "ASP", "GLH": "GLU", "LYN": "LYS",
}

# Side chain atoms in slot order from 4 on. Each atom is bonded to the one
# before it unless another is named after the colon.
SIDE_CHAINS = {
    "A": "CB",
    "R": "CB CG CD NE CZ NH1 NH2:CZ",
    "N": "CB CG OD1 ND2:CG",
    "D": "CB CG OD1 OD2:CG",
    "C": "CB SG",
    "Q": "CB CG CD OE1 NE2:CD",
    "E": "CB CG CD OE1 OE2:CD",
    "G": "",
    "H": "CB CG ND1 CE1 NE2 CD2",
    "I": "CB CG1 CD1 CG2:CB",
    "L": "CB CG CD1 CD2:CG",
    "K": "CB CG CD CE NZ",
    "M": "CB CG SD CE",
    "F": "CB CG CD1 CE1 CZ CE2 CD2",
    "P": "CB CG CD",
    "S": "CB OG",
    "T": "CB OG1 CG2:CB",
    "W": "CB CG CD1 NE1 CE2 CZ2 CH2 CZ3 CE3 CD2",
    "Y": "CB CG CD1 CE1 CZ OH CE2:CZ CD2",
    "V": "CB CG1 CG2:CB",
}
BACKBONE = ("N", "CA", "C", "O")
SLOTS = 14
PROTEIN_NAMES = (*ONE_LETTER, *FORMS)


def side_chain(aa: str) -> list[tuple[str, str]]:
    """(atom, bonded atom) of a residue in slot order."""
    out, before = [], "CA"
    for entry in SIDE_CHAINS[aa].split():
        atom, _, parent = entry.partition(":")
        out.append((atom, parent or before))
        before = atom
    return out


def layout_rows() -> list[dict]:
    """(aa, atom, slot, a, b, c): slots and, from slot 3 on, the three slots an atom hangs on.

    The references follow the bonds back: c is the bonded atom, b the one before, a the one
    before that. The oxygen hangs on N, CA, C and a beta carbon on C, N, CA.
    """
    rows = []
    for aa in sorted(SIDE_CHAINS):
        slot = {name: i for i, name in enumerate(BACKBONE)}
        parent = {"CA": "N", "N": "C"}
        chain = side_chain(aa)
        for i, (atom, bonded) in enumerate(chain):
            slot[atom], parent[atom] = i + 4, bonded
        for atom, at in slot.items():
            row = {"aa": aa, "atom": atom, "slot": at, "a": None, "b": None, "c": None}
            if atom == "O":
                row.update(a=0, b=1, c=2)
            elif at > 3:
                c = parent[atom]
                row.update(a=slot[parent[parent[c]]], b=slot[parent[c]], c=slot[c])
            rows.append(row)
    return rows


def layout(spark) -> DataFrame:
    """The layout of all amino acids, a table of fixed size."""
    schema = pa.schema(
        [("aa", pa.string()), ("atom", pa.string())] + [(c, pa.int32()) for c in ("slot", "a", "b", "c")]
    )
    return local_table(spark, layout_rows(), schema)


def one_letter(resname):
    """One-letter code of a residue name column; any name but those of ``PROTEIN_NAMES`` is refused."""
    letters = ONE_LETTER | {form: ONE_LETTER[name] for form, name in FORMS.items()}
    table = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair])
    refuse = F.raise_error(F.concat(F.lit("unknown residue name "), F.coalesce(resname, F.lit("NULL"))))
    return F.coalesce(table[resname], refuse)


# Residues of a chain that have no letter here: end groups and modified residues.
WITHOUT_LETTER = (
    "ACE", "AIB", "CME", "CSO", "FOR", "HYP", "KCX", "MLY", "MSE", "NH2", "NMA", "NME", "ORN", "PCA", "PTR", "PYL",
    "SEC", "SEP", "TPO",
)


def select_protein(atoms: DataFrame) -> DataFrame:
    """Atoms of amino acids; solvent, ions and ligands go.

    Residues that are part of a chain but have no letter are refused: without them, residues
    on either side would count as neighbours.
    """
    name = F.col("resname")
    refuse = F.raise_error(F.concat(F.lit("residue without a letter: "), name)).cast("boolean")
    return atoms.filter(F.when(name.isin(*PROTEIN_NAMES), True).when(name.isin(*WITHOUT_LETTER), refuse).otherwise(False))


def select_alpha_carbons(atoms: DataFrame) -> DataFrame:
    return atoms.filter(F.col("name") == "CA")


def residue_key(atoms: DataFrame) -> list[str]:
    """The columns that tell residues apart; tables without insertion codes do without."""
    return ["resseq", "resname", "chain", *(["icode"] if "icode" in atoms.columns else [])]


def residue_numbers(topology: DataFrame) -> DataFrame:
    """(resseq, resname, chain[, icode], residue, label) of one frame's atoms.

    Residues of all chains are numbered from 0 by the order of their alpha carbons and labelled
    by name, number, insertion code and the letter of the chain's place. The window runs over one
    row per residue.
    """
    key = residue_key(topology)
    first = select_alpha_carbons(topology).groupBy(*key).agg(F.min("serial").alias("serial"))
    chains = topology.groupBy("chain").agg(F.min("serial").alias("s")).select(
        "chain", (F.row_number().over(Window.orderBy("s")) - 1).alias("_c")
    )
    order = Window.orderBy("serial")
    number = [F.col("resseq").cast("string"), *[F.col(c) for c in key[3:]], F.lit("_"), F.char(65 + F.col("_c"))]
    return first.join(chains, "chain").select(
        *key, (F.row_number().over(order) - 1).alias("residue"), F.concat("resname", *number).alias("label"),
    )


def to_single_chain(atoms: DataFrame, residues: DataFrame) -> DataFrame:
    """Atoms with their ``residue`` number and ``label`` over all chains."""
    key = residue_key(residues)
    table = residues.select(*key, "residue", "label")
    return atoms.join(F.broadcast(table) if _small(table) else table, key)


def _small(residues: DataFrame, rows: int = 100_000) -> bool:
    # A row per residue of the molecule; checked before it is shipped to every executor.
    return residues.limit(rows + 1).count() <= rows
