"""The tree as a probability model: conditionals, joints, scoring and sampling."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from arborinfo.functions.entropy import plugin_entropy
from arborinfo.functions.rng import uniform_array
from arborinfo.lineage import broadcast, local_table, materialize, settle, ship_package
from arborinfo.operators.pairs import text
from arborinfo.operators.tree_index import TreeIndex

# Matrices that are multiplied by joins, and matrices of a longer chain that one task multiplies.
SHORT_CHAIN, CHAIN = 8, 64
# States of the nodes in one block of a piece: a pair of blocks has the square of it in cells.
BLOCK_STATES = 1024
# Edges per block when a wide table is extended column by column.
EDGE_BLOCK = 32
# Pairs of states of the tree's edges that are shipped to every task for scoring.
TABLE_ROWS = 500_000


def both_ways(pair_counts: DataFrame) -> DataFrame:
    """Pair counts in both orientations."""
    return pair_counts.select("u", "v", "xu", "xv", "n").union(
        pair_counts.select("v", "u", "xv", "xu", "n")
    )


def transfer_matrix(pair_counts: DataFrame, fix: dict[str, str] | None = None) -> DataFrame:
    """(u, v, xu, xv, p) with p = P(v = xv | u = xu), both orientations of each pair.

    Unseen xu have no rows (all their transfer probabilities are zero). ``fix`` maps variables
    to a state that every transfer into them takes with probability one.
    """
    counts = both_ways(pair_counts)
    rows = counts.groupBy("u", "v", "xu").agg(F.sum("n").alias("_t"))
    out = counts.join(rows, ["u", "v", "xu"]).select(
        "u", "v", "xu", "xv", (F.col("n") / F.col("_t")).alias("p")
    )
    for var, state in (fix or {}).items():
        pinned = out.filter(F.col("v") == var).select("u", "v", "xu").distinct()
        pinned = pinned.select("u", "v", "xu", F.lit(state).alias("xv"), F.lit(1.0).alias("p"))
        out = out.filter(F.col("v") != var).union(pinned)
    return out


def chain_product(matrices: DataFrame, length: int) -> DataFrame:
    """(x, y, p): the product of ``length`` matrices given as (pos, x, y, p), pos from 0.

    Long chains are first cut into blocks of ``CHAIN`` matrices, each multiplied in a task. Neighbours
    are then multiplied pairwise.
    """
    while length > SHORT_CHAIN:
        matrices = settle(
            matrices.withColumn("block", F.expr(f"pos div {CHAIN}").cast("int"))
            .groupBy("block").applyInArrow(_block_product, "pos int, x string, y string, p double"),
            "chain",
        )
        length = -(-length // CHAIN)
    while length > 1:
        left = matrices.filter("pos % 2 = 0").select(
            F.expr("pos div 2").cast("int").alias("pos"), "x", F.col("y").alias("m"), F.col("p").alias("p1")
        )
        right = matrices.filter("pos % 2 = 1").select(
            F.expr("pos div 2").cast("int").alias("pos"), F.col("x").alias("m"), "y", F.col("p").alias("p2")
        )
        product = (
            left.join(right, ["pos", "m"]).groupBy("pos", "x", "y")
            .agg(F.sum(F.col("p1") * F.col("p2")).alias("p"))
        )
        if length % 2:
            odd = matrices.filter(F.col("pos") == length - 1).select(
                F.expr("pos div 2").cast("int").alias("pos"), "x", "y", "p"
            )
            product = product.unionByName(odd)
        matrices, length = product, (length + 1) // 2
    return matrices.select("x", "y", "p")


def codes(values: pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
    """Distinct strings, and the number of each row's."""
    coded = values.combine_chunks().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def parts_of(order: np.ndarray) -> list[np.ndarray]:
    """Row numbers of each run of equal values, by value."""
    rows = np.argsort(order, kind="stable")
    return np.split(rows, np.flatnonzero(np.diff(order[rows])) + 1) if len(rows) else []


def matrix_of(xs: list[str], x: np.ndarray, y: np.ndarray, p: np.ndarray, before: dict[str, int] | None):
    """(states of x, states of y, matrix); rows in the order of ``before`` where it is given."""
    used, row = np.unique(x, return_inverse=True)
    names = [xs[k] for k in used.tolist()]
    if before is not None:
        row = np.array([before.get(name, -1) for name in names], np.int64)[row]
    to, column = np.unique(y, return_inverse=True)
    out = np.zeros((len(before) if before is not None else len(names), len(to)))
    known = row >= 0
    out[row[known], column[known]] = p[known]
    return names, to, out


def _block_product(key: tuple, table: pa.Table) -> pa.Table:
    (xs, x), (ys, y) = codes(table.column("x")), codes(table.column("y"))
    p, pos = table.column("p").to_numpy(), table.column("pos").to_numpy()
    first, states, product = None, None, None
    for rows in parts_of(pos):
        before = None if states is None else {name: k for k, name in enumerate(states)}
        names, to, step = matrix_of(xs, x[rows], y[rows], p[rows], before)
        first, product = (names, step) if product is None else (first, product @ step)
        states = [ys[k] for k in to.tolist()]
    row, column = np.nonzero(product)
    return pa.table({
        "pos": pa.array(np.full(len(row), key[0].as_py()), pa.int32()), "x": [first[k] for k in row.tolist()],
        "y": [states[k] for k in column.tolist()], "p": product[row, column],
    })


STEPS = pa.schema([("a", pa.string()), ("b", pa.string()), ("pos", pa.int32())])


def path_joint(transfers: DataFrame, node_probabilities: DataFrame, path: list[str]) -> DataFrame:
    """(xu, xv, p): the joint law of the ends of ``path``, a list of neighbours.

    Only the transfers along the path are read; two nodes without a path have no rows.
    """
    spark = transfers.sparkSession
    if len(path) < 2:
        same = node_probabilities.filter(F.col("var") == path[0] if path else F.lit(False))
        return same.select(F.col("state").alias("xu"), F.col("state").alias("xv"), "p")
    steps = local_table(
        spark, [{"a": a, "b": b, "pos": k} for k, (a, b) in enumerate(zip(path, path[1:]))], STEPS
    )
    on_path = transfers.withColumnsRenamed({"u": "a", "v": "b", "xu": "x", "xv": "y"}).join(steps, ["a", "b"])
    product = chain_product(on_path.select("pos", "x", "y", "p"), len(path) - 1)
    start = node_probabilities.filter(F.col("var") == path[0]).select(
        F.col("state").alias("x"), F.col("p").alias("p0")
    )
    return product.join(start, "x").select(
        F.col("x").alias("xu"), F.col("y").alias("xv"), (F.col("p") * F.col("p0")).alias("p")
    )


CENTRE_STEPS = pa.schema(
    [(c, pa.string()) for c in ("centre", "parent", "node", "branch")] + [("depth", pa.int32())]
)
TABLE = (
    "centre string, node string, branch string, block int, blocks int, states array<string>,"
    " start array<double>, cells array<double>"
)


def centre_steps(index: TreeIndex) -> list[dict]:
    """The directed edges of all pieces of a centroid decomposition, away from the piece's centre.

    There are at most L log2(L) of them. ``branch`` is the neighbour of the centre on the way.
    """
    chain, out = index.centroids(), []
    for centre in index.name:
        level = len(chain[centre]) - 1
        inside = lambda x: len(chain[x]) > level and chain[x][level] == centre  # noqa: B023, E731
        todo = [(centre, y, y, 1) for y in index.near[centre] if inside(y)]
        while todo:
            parent, node, branch, depth = todo.pop()
            out.append({"centre": centre, "parent": parent, "node": node, "branch": branch, "depth": depth})
            todo += [(node, y, branch, depth + 1) for y in index.near[node] if y != parent and inside(y)]
    return out


def _away_from_centre(key: tuple, table: pa.Table) -> pa.Table:
    centre = key[0].as_py()
    (xs, x), (ys, y) = codes(table.column("xu")), codes(table.column("xv"))
    p, first = table.column("p").to_numpy(), table.column("start").to_numpy()
    nodes, node = codes(table.column("node"))
    parents, branches = table.column("parent").combine_chunks(), table.column("branch").combine_chunks()
    depth = table.column("depth").to_numpy()
    # States and matrix of each node; a matrix has the centre's states as rows.
    known: dict[str, tuple[list[str], np.ndarray]] = {}
    start = np.zeros(0)
    rows: list[tuple] = []
    steps = parts_of(node)
    steps.sort(key=lambda at: int(depth[at[0]]))
    for at in steps:
        parent, name = parents[int(at[0])].as_py(), nodes[node[at[0]]]
        before = {s: k for k, s in enumerate(known[parent][0])} if parent in known else None
        names, to, step = matrix_of(xs, x[at], y[at], p[at], before)
        if parent not in known:  # the centre itself, met first
            known[parent] = (names, np.eye(len(names)))
            of_state = dict(zip((xs[k] for k in x[at].tolist()), first[at].tolist()))
            start = np.array([of_state[s] for s in names])
            rows.append((centre, centre, names, known[parent][1]))
        states = [ys[k] for k in to.tolist()]
        known[name] = (states, known[parent][1] @ step)
        rows.append((name, branches[int(at[0])].as_py(), *known[name]))
    per = max(1, BLOCK_STATES // max(max(len(r[2]) for r in rows), 1))
    return pa.table({
        "centre": [centre] * len(rows), "node": [r[0] for r in rows], "branch": [r[1] for r in rows],
        "block": pa.array([k // per for k in range(len(rows))], pa.int32()),
        "blocks": pa.array([(len(rows) - 1) // per + 1] * len(rows), pa.int32()),
        "states": [r[2] for r in rows], "start": [start] * len(rows), "cells": [r[3].ravel() for r in rows],
    })


def centre_tables(transfers: DataFrame, node_probabilities: DataFrame, index: TreeIndex) -> DataFrame:
    """What the nodes of each piece say about its centre: P(node | centre), as matrices.

    A row (centre, node, branch, block, blocks, states, start, cells) has the probabilities of the
    centre's states and one row of ``cells`` for each of them. A task has the tables of one piece. Pieces
    are of all sizes down to neighbours, so all tables are L log2(L) and any pair is in one piece
    in which its nodes lie on different branches.
    """
    ship_package(transfers.sparkSession)
    steps = local_table(transfers.sparkSession, centre_steps(index), CENTRE_STEPS)
    known = steps.join(transfers.withColumnsRenamed({"u": "parent", "v": "node"}), ["parent", "node"])
    start = node_probabilities.select(
        F.col("var").alias("parent"), F.col("state").alias("xu"), F.col("p").alias("start")
    )
    return known.join(start, ["parent", "xu"]).groupBy("centre").applyInArrow(_away_from_centre, TABLE)


def _pair_law(a: tuple, b: tuple) -> np.ndarray:
    """The joint law of two nodes from their (start, cells) under one centre."""
    start = a[0]
    return (a[1].reshape(len(start), -1) * start[:, None]).T @ b[1].reshape(len(start), -1)


def _tables(table: pa.Table, prefix: str = "") -> list[tuple[np.ndarray, np.ndarray]]:
    of = lambda name: table.column(prefix + name).combine_chunks()
    return [(s.values.to_numpy(), c.values.to_numpy()) for s, c in zip(of("start"), of("cells"))]


def _meeting_pairs(key: tuple, table: pa.Table) -> Iterator[tuple[str, str, list, list, np.ndarray]]:
    """(u, v, states of u, states of v, joint law), u < v, of the pairs of two blocks that part at the centre."""
    low, high = key[1].as_py(), key[2].as_py()
    names, branches = table.column("node").to_pylist(), table.column("branch").to_pylist()
    block, states = table.column("block").to_pylist(), table.column("states").to_pylist()
    start, width = table.column("start")[0].values.to_numpy(), [len(s) for s in states]
    cells = [c.values.to_numpy().reshape(len(start), -1) for c in table.column("cells").combine_chunks()]
    left = [k for k, b in enumerate(block) if b == low]
    right = [k for k, b in enumerate(block) if b == high]
    law = (np.hstack([cells[k] for k in left]) * start[:, None]).T @ np.hstack([cells[k] for k in right])
    rows = np.concatenate([[0], np.cumsum([width[k] for k in left])])
    columns = np.concatenate([[0], np.cumsum([width[k] for k in right])])
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            if branches[a] != branches[b] and (low != high or i < j):
                joint = law[rows[i] : rows[i + 1], columns[j] : columns[j + 1]]
                if names[a] < names[b]:
                    yield names[a], names[b], states[a], states[b], joint
                else:
                    yield names[b], names[a], states[b], states[a], joint.T


def _pair_entropies(key: tuple, table: pa.Table) -> pa.Table:
    us, vs, sums = [], [], []
    for u, v, _, _, joint in _meeting_pairs(key, table):
        seen = joint[joint > 0]
        us.append(u)
        vs.append(v)
        sums.append(float(-(seen * np.log(seen)).sum()))
    return pa.table({"u": pa.array(us, pa.string()), "v": pa.array(vs, pa.string()), "s_uv": pa.array(sums, pa.float64())})


JOINT = "u string, v string, xu string, xv string, p double"


def law_rows(laws) -> pa.Table:
    """Rows (u, v, xu, xv, p) of laws given as (u, v, states of u, states of v, matrix)."""
    parts = []
    for u, v, us, vs, law in laws:
        row, column = np.nonzero(law)
        parts.append(pa.table({
            "u": pa.array([u] * len(row), pa.string()), "v": pa.array([v] * len(row), pa.string()),
            "xu": pa.array(us, pa.string()).take(pa.array(row)), "xv": pa.array(vs, pa.string()).take(pa.array(column)),
            "p": law[row, column],
        }))
    empty = pa.table({c: pa.array([], pa.string()) for c in ("u", "v", "xu", "xv")} | {"p": pa.array([], pa.float64())})
    return pa.concat_tables([empty, *parts])


def _pair_joints(key: tuple, table: pa.Table) -> pa.Table:
    return law_rows(_meeting_pairs(key, table))


def _by_block_pair(tables: DataFrame):
    """Each block of a piece's tables, beside each other block of that piece."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other")
    beside = tables.select("*", other)
    return beside.groupBy(
        "centre", F.least("block", "_other").alias("_low"), F.greatest("block", "_other").alias("_high")
    )


def implied_joints(tables: DataFrame) -> DataFrame:
    """(u, v, xu, xv, p), u < v: the joint law of every pair implied by the tree."""
    return _by_block_pair(tables).applyInArrow(_pair_joints, JOINT)


def implied_entropies(tables: DataFrame) -> DataFrame:
    """(u, v, s_uv), u < v: the entropy of every pair implied by the tree; laws stay in the tasks."""
    return _by_block_pair(tables).applyInArrow(_pair_entropies, "u string, v string, s_uv double")


PAIRS = pa.schema([(c, pa.string()) for c in ("u", "v", "centre")])


def implied_conditionals(tables: DataFrame, index: TreeIndex, pairs: list[tuple[str, str]]) -> DataFrame:
    """(u, v, xu, xv, p): P(v | u) along the tree for the ordered ``pairs`` of different nodes.

    The tables of both ends meet at the last centre that they share.
    """
    chain = index.centroids()
    meeting = [
        {"u": u, "v": v, "centre": [a for a, b in zip(chain[u], chain[v]) if a == b][-1]} for u, v in sorted(set(pairs))
    ]
    wanted = local_table(tables.sparkSession, meeting, PAIRS)
    for end in ("u", "v"):
        side = tables.select(
            "centre", F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("states", "start", "cells")]
        )
        wanted = wanted.join(side, ["centre", end])

    def laws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ends = [table.column(c).to_pylist() for c in ("u", "v", "u_states", "v_states")]
            found = []
            for u, v, us, vs, a, b in zip(*ends, _tables(table, "u_"), _tables(table, "v_")):
                law = _pair_law(a, b)
                found.append((u, v, us, vs, law / law.sum(axis=1, keepdims=True)))
            yield from law_rows(found).to_batches()

    return wanted.mapInArrow(laws, JOINT)


def joint_entropies(joints: DataFrame) -> DataFrame:
    """(u, v, s_uv) of the laws (u, v, xu, xv, p)."""
    return joints.groupBy("u", "v").agg(plugin_entropy("p").alias("s_uv"))


def information_of_entropies(s: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, i): s(u) + s(v) - s(joint), with plug-in node entropies."""
    for end in ("u", "v"):
        s = s.join(nodes.select(F.col("var").alias(end), F.col("s").alias(f"s_{end}")), end)
    return s.select("u", "v", (F.col("s_u") + F.col("s_v") - F.col("s_uv")).alias("i"))


def reweighted_joints(
    transfers: DataFrame, order: list[tuple[str, str]], marginals: DataFrame
) -> DataFrame:
    """(u, v, xu, xv, p): joints of the directed edges ``order`` under new node marginals.

    ``marginals`` is (var, state, p); the conditionals stay as they are.
    """
    keys = [f"{u}\x00{v}" for u, v in order]
    edge = F.concat_ws("\x00", "u", "v")
    start = marginals.select(F.col("var").alias("u"), F.col("state").alias("xu"), F.col("p").alias("p0"))
    return transfers.filter(edge.isin(keys)).join(start, ["u", "xu"]).select(
        "u", "v", "xu", "xv", (F.col("p") * F.col("p0")).alias("p")
    )


def log_probability(
    rows: DataFrame,
    transfers: DataFrame,
    node_probabilities: DataFrame,
    order: list[tuple[str, str]],
    root: str,
    name: str = "log_p",
    table_rows: int = TABLE_ROWS,
) -> DataFrame:
    """Add the log-probability of each wide row (one column per variable) under the tree.

    States are read as in counting (a missing value is the state ``null``); states unseen in the
    data get minus infinity. The conditionals of the tree's edges, one row per pair of states,
    are shipped whole up to ``table_rows`` rows, and the rows pass once, in Arrow batches, without
    a shuffle. Larger tables are joined edge by edge.
    """
    keys = [f"{u}\x00{v}" for u, v in order]
    steps = transfers.filter(F.concat_ws("\x00", "u", "v").isin(keys)).select("u", "v", "xu", "xv", F.log("p").alias("l"))
    start = node_probabilities.filter(F.col("var") == root).select("state", F.log("p").alias("l"))
    head = steps.limit(table_rows + 1).toArrow()
    first = start.limit(table_rows + 1).toArrow()
    if head.num_rows + first.num_rows > table_rows:
        return joined_log_probability(rows, steps, start, order, root, name)
    tables: dict[tuple[str, str], dict] = {edge: {} for edge in order}
    for u, v, xu, xv, l in zip(*(head.column(c).to_pylist() for c in ("u", "v", "xu", "xv", "l"))):
        tables[u, v][xu, xv] = l
    begin = dict(zip(first.column("state").to_pylist(), first.column("l").to_pylist()))
    shared = broadcast(rows.sparkSession, (begin, tables))
    variables = [root, *[v for _, v in order]]
    out = rows.select("*", *[F.expr(text(v)).alias(f"_s{k}") for k, v in enumerate(variables)])
    kept = rows.columns
    schema = StructType([*rows.schema.fields, StructField(name, DoubleType())])

    def score(batches):
        begin, tables = shared.value
        low = float("-inf")
        for batch in batches:
            coded = {}
            for k, v in enumerate(variables):
                column = batch.column(len(kept) + k).dictionary_encode()
                coded[v] = (column.dictionary.to_pylist(), column.indices.to_numpy(zero_copy_only=False))
            values, at = coded[root]
            total = np.array([begin.get(x, low) for x in values])[at] if values else np.zeros(0)
            for u, v in order:
                (xs, i), (ys, j) = coded[u], coded[v]
                found, place = np.unique(i.astype(np.int64) * len(ys) + j, return_inverse=True)
                step = tables[u, v]
                gained = [step.get((xs[c // len(ys)], ys[c % len(ys)]), low) for c in found.tolist()]
                total = total + np.array(gained, np.float64)[place]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(total, pa.float64())], names=[*kept, name]
            )

    return out.mapInArrow(score, schema)


def joined_log_probability(rows, steps, start, order, root, name) -> DataFrame:
    """The same by one equi-join per edge, against tables that Spark ships or shuffles by size."""
    kept = rows.columns
    states = {v: f"_s{i}" for i, v in enumerate([root, *[v for _, v in order]])}
    out = rows.select("*", *[F.expr(text(v)).alias(s) for v, s in states.items()])
    low = F.lit(float("-inf"))
    out = out.join(start.withColumnsRenamed({"state": "_x", "l": "_l"}), F.col(states[root]) == F.col("_x"), "left")
    out = out.withColumn(name, F.coalesce("_l", low)).drop("_x", "_l")
    for u, v in order:
        step = steps.filter((F.col("u") == u) & (F.col("v") == v)).select(
            F.col("xu").alias("_x"), F.col("xv").alias("_y"), F.col("l").alias("_l")
        )
        same = (F.col(states[u]) == F.col("_x")) & (F.col(states[v]) == F.col("_y"))
        out = out.join(step, same, "left")
        out = out.withColumn(name, F.col(name) + F.coalesce("_l", low)).drop("_x", "_y", "_l")
    return out.select(*kept, name)


def state_intervals(table: DataFrame, by: list[str], state: str) -> DataFrame:
    """(by..., state, lo, hi): the states of each group laid out over [0, 1) by probability.

    The last interval is open upwards, so rounding leaves no gap at the end.
    """
    along = Window.partitionBy(*by).orderBy(state)
    back = Window.partitionBy(*by).orderBy(F.desc(state))
    hi = F.sum("p").over(along.rowsBetween(Window.unboundedPreceding, 0))
    laid = table.select(*by, state, hi.alias("_hi"), (F.row_number().over(back) == 1).alias("_last"))
    return laid.select(
        *by, state, F.coalesce(F.lag("_hi").over(along), F.lit(0.0)).alias("lo"),
        F.when(F.col("_last"), 2.0).otherwise(F.col("_hi")).alias("hi"),
    )


def sample(
    ids: DataFrame,
    transfers: DataFrame,
    node_probabilities: DataFrame,
    order: list[tuple[str, str]],
    root: str,
    seed: int,
    table_rows: int = TABLE_ROWS,
) -> DataFrame:
    """Ancestral samples: one column per variable for each ``id`` of ``ids``.

    Draws depend on (seed, id, variable) only, never on partitioning or order. The cumulated
    conditionals of all edges are shipped, up to ``table_rows`` rows, and the ids pass once, in Arrow
    batches: a uniform number is looked up among the states that follow the parent's. Larger tables
    are joined edge by edge. Ids of other types than whole numbers are hashed; a null one draws as 0.
    """
    kind = ids.schema["id"].dataType
    whole = kind.typeName() in ("byte", "short", "integer", "long")
    keyed = ids.select("id", (F.col("id").cast("long") if whole else F.xxhash64("id")).alias("_k"))
    keys = [f"{u}\x00{v}" for u, v in order]
    steps = transfers.filter(F.concat_ws("\x00", "u", "v").isin(keys)).select("u", "v", "xu", "xv", "p")
    start = node_probabilities.filter(F.col("var") == root).select("state", "p")
    head, first = steps.limit(table_rows + 1).toArrow(), start.limit(table_rows + 1).toArrow()
    if head.num_rows + first.num_rows > table_rows:
        return joined_sample(keyed, steps, start, order, root, seed)
    rows: dict[tuple[str, str], dict[str, list]] = {edge: {} for edge in order}
    for u, v, xu, xv, p in zip(*(head.column(c).to_pylist() for c in ("u", "v", "xu", "xv", "p"))):
        rows[u, v].setdefault(xu, []).append((xv, p))
    begin = cumulated(list(zip(first.column("state").to_pylist(), first.column("p").to_pylist())))
    shared = broadcast(
        ids.sparkSession, (begin, {edge: {x: cumulated(ys) for x, ys in of.items()} for edge, of in rows.items()})
    )
    variables = [root, *[v for _, v in order]]
    schema = StructType([ids.schema["id"], *[StructField(v, StringType()) for v in variables]])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, tables = shared.value
        for batch in batches:
            numbers = batch.column(1).fill_null(0).to_numpy()
            states = {root: drawn(begin, uniform_array(seed, salt_of(root), numbers))}
            for u, v in order:
                z = uniform_array(seed, salt_of(v), numbers)
                out = np.empty(len(z), object)
                for x in set(states[u]):
                    at = states[u] == x
                    out[at] = drawn(tables[u, v][x], z[at])
                states[v] = out
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(states[v], pa.string()) for v in variables]], names=["id", *variables]
            )

    return keyed.mapInArrow(draw, schema)


def salt_of(variable: str) -> int:
    return zlib.crc32(variable.encode())


def cumulated(law: list[tuple[str, float]]) -> tuple[np.ndarray, np.ndarray]:
    """States in order and where the interval of each ends; the last one is open."""
    law = sorted(law)
    ends = np.cumsum([p for _, p in law])
    ends[-1:] = 2.0
    return np.array([x for x, _ in law], object), ends


def drawn(law: tuple[np.ndarray, np.ndarray], z: np.ndarray) -> np.ndarray:
    return law[0][np.searchsorted(law[1], z, "right")]


def joined_sample(keyed: DataFrame, steps: DataFrame, start: DataFrame, order, root: str, seed: int) -> DataFrame:
    """The same by one equi-join per edge, against tables that Spark ships or shuffles by size."""
    steps = settle(state_intervals(steps, ["u", "v", "xu"], "xv"), "intervals").withColumnsRenamed({"xu": "_x", "xv": "_y"})
    start = state_intervals(start.withColumn("var", F.lit(root)), ["var"], "state")
    names = ["id", "_k"]

    def numbered(rows: DataFrame, variables: list[str]) -> DataFrame:
        """``rows`` with the uniform numbers of ``variables``."""
        columns = rows.columns

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(columns.index("_k")).fill_null(0).to_numpy()
                z = [pa.array(uniform_array(seed, salt_of(v), ids)) for v in variables]
                yield pa.RecordBatch.from_arrays([*batch.columns, *z], names=[*columns, *[f"_z{v}" for v in variables]])

        more = [StructField(f"_z{v}", DoubleType()) for v in variables]
        return rows.mapInArrow(add, StructType([*rows.schema.fields, *more]))

    within = lambda v: (F.col(f"`_z{v}`") >= F.col("lo")) & (F.col(f"`_z{v}`") < F.col("hi"))
    ship_package(keyed.sparkSession)
    first = start.select(F.lit(0).alias("_one"), F.col("state").alias(root), "lo", "hi")
    out = numbered(keyed, [root]).withColumn("_one", F.lit(0)).join(F.broadcast(first), "_one")
    out = out.filter(within(root)).select(*names, F.col(f"`{root}`"))
    names.append(f"`{root}`")
    for low in range(0, len(order), EDGE_BLOCK):
        block = order[low : low + EDGE_BLOCK]
        out = numbered(out, [v for _, v in block])
        for u, v in block:
            step = steps.filter((F.col("u") == u) & (F.col("v") == v)).select("_x", "_y", "lo", "hi")
            out = out.join(step, (F.col(f"`{u}`") == F.col("_x")) & within(v))
            out = out.withColumnRenamed("_y", v).drop("_x", "lo", "hi")
            names.append(f"`{v}`")
        out = materialize(out.select(*names), "samples")
    return out.drop("_k")
