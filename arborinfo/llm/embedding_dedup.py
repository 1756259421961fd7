"""Near-duplicate vectors: cross-polytope hashing after fast rotations, multiprobe, verified pairs.

Vectors are compared within equal labels (and equal dimension) and link when their cosine, in
double precision, is 0.93 or more.

Equal vectors are one class from the start. Each class is hashed in ``tables`` tables: three rounds
of random signs and a fast Hadamard transform turn it, and the largest coordinates with their
signs name its buckets; ``hashes`` such names make one key. A class is at home in its best key and
a guest in the next ``probes`` - 1 of each table (those that lose least), and two classes are
compared where one is at home. At a cosine of exactly 0.93 in 64 dimensions a table misses a pair
with a probability of about 0.2, six tables with 7e-5, and it falls quickly above; the tests hold
this against brute force.

Rows of a key with more than ``BLOCK`` classes are dealt out as pairs of blocks, so no group of
copies meets in one task, and cosines of a block pair are one matrix product. A pair counts only
at the first of its common keys, which both hash codes tell, so links are counted without listing
pairs; what leaves a task is a count for each class and the edges of a forest.

Defined cases: a null label or vector, a zero vector, or one with null or non-finite components
links with nothing and is a component of its own; repeated rows link with each other; rows with a
null id take part, but a component's id is its smallest id that is not null; dimensions that are
no power of two are padded with zeros. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborinfo.functions.rng import mix64, uniform_array
from arborinfo.lineage import materialize, ship_package
from arborinfo.llm import text as tx
from arborinfo.llm.components import components

COSINE = 0.93
TABLES, HASHES, PROBES = 6, 2, 6
BLOCK = 1024
#: Coordinates of each rotation that are considered for probing.
NEAR = 4
#: Rows of a shard of buckets, about.
SHARD_ROWS = 40_000
#: Hot keys up to this number (16 bytes each) are broadcast, more are joined.
BROADCAST_KEYS = 100_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; additions only, the same in any batch."""
    rows, width = x.shape
    h = 1
    while h < width:
        pairs = x.reshape(rows, width // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, width)
        h *= 2
    return x / np.sqrt(width)


def bucket_codes(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 0) -> np.ndarray:
    """(rows, tables, probes) keys of unit vectors, the home key first."""
    rows, dim = x.shape
    width = max(2, 1 << (dim - 1).bit_length())
    x = np.concatenate([x, np.zeros((rows, width - dim))], axis=1)
    near = min(NEAR, width)
    out = np.empty((rows, tables, probes), np.int64)
    for t in range(tables):
        loss, code = np.zeros((rows, 1)), np.zeros((rows, 1), np.int64)
        for k in range(hashes):
            turned = x
            for r in range(3):
                salt = 1000 * (t * hashes + k) + r
                turned = hadamard(turned * np.where(uniform_array(seed, salt, np.arange(width)) < 0.5, -1.0, 1.0))
            size = np.abs(turned)
            order = np.argsort(-size, axis=1, kind="stable")[:, :near]
            value = np.take_along_axis(size, order, 1)
            name = 2 * order + (np.take_along_axis(turned, order, 1) < 0)
            loss = (loss[:, :, None] + (value[:, None, :1] - value[:, None, :]) ** 2).reshape(rows, -1)
            code = (code[:, :, None] * (2 * width) + name[:, None, :]).reshape(rows, -1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        chosen = np.take_along_axis(code, best, 1)
        out[:, t] = -1
        out[:, t, : chosen.shape[1]] = chosen
    return out


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def described(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(vec_id, node, grp, vec): the class of each row, null where it cannot link."""
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vec")
    )
    ship_package(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    double = vectors.schema[vector_col].dataType.elementType.simpleString() != "float"
    dtype = np.float64 if double else np.float32

    def describe(batches):
        for batch in batches:
            lists = tx.column(batch, "vec")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            cut = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            nodes, groups, blobs = [], [], []
            for k, label in enumerate(tx.column(batch, "label").to_pylist()):
                v = flat[cut[k] : cut[k + 1]] + dtype(0)  # minus zero becomes zero
                if label is None or not np.isfinite(v).all() or not v.any():
                    nodes.append(None), groups.append(None), blobs.append(None)
                    continue
                group = hashlib.blake2b(f"{len(v)}:{label}".encode(), digest_size=8).digest()
                blob = v.tobytes()
                nodes.append(hashlib.blake2b(group + blob, digest_size=16).digest())
                groups.append(int.from_bytes(group, "little", signed=True))
                blobs.append(blob)
            yield pa.RecordBatch.from_arrays([
                tx.column(batch, "vec_id"), pa.array(nodes, pa.binary()), pa.array(groups, pa.int64()),
                pa.array(blobs, pa.binary()),
            ], names=["vec_id", "node", "grp", "vec"])

    return rows.mapInArrow(describe, f"vec_id {kind}, node binary, grp long, vec binary"), dtype


def parsed(blobs: list[bytes], dtype) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Unit vectors by dimension: (places, rows)."""
    by_size: dict[int, list[int]] = {}
    for k, blob in enumerate(blobs):
        by_size.setdefault(len(blob), []).append(k)
    return {
        size // np.dtype(dtype).itemsize: (
            np.array(at), unit(np.frombuffer(b"".join(blobs[k] for k in at), dtype).reshape(len(at), -1))
        )
        for size, at in by_size.items()
    }


def bucket_rows(classes: DataFrame, dtype, shape: tuple[int, int, int], vectors: bool) -> DataFrame:
    """(key, node, size, grp, vec, tab, code) of every class in every key; or the keys alone."""

    def spread(batches):
        for batch in batches:
            nodes, sizes, groups, blobs = (batch.column(k).to_pylist() for k in range(4))
            for at, x in parsed(blobs, dtype).values():
                for low in range(0, len(at), 2000):
                    part, codes = at[low : low + 2000], bucket_codes(x[low : low + 2000], *shape)
                    row, tab, probe = np.nonzero(codes >= 0)
                    code = codes[row, tab, probe]
                    group = np.array([groups[k] for k in part], np.int64)[row]
                    key = mix64(group.view(np.uint64) ^ mix64((code * 64 + tab).astype(np.uint64))).view(np.int64)
                    columns = [pa.array(key)]
                    if vectors:
                        take = pa.array(part[row])
                        columns += [
                            pa.array(nodes, pa.binary()).take(take), pa.array(sizes, pa.int64()).take(take),
                            pa.array(group), pa.array(blobs, pa.binary()).take(take),
                            pa.array(tab.astype(np.int32)), pa.array(code),
                        ]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "size", "grp", "vec", "tab", "code"][: len(columns)])

    rows = classes.select("node", "size", "grp", "vec")
    return rows.mapInArrow(
        spread, "key long" + (", node binary, size long, grp long, vec binary, tab int, code long" if vectors else "")
    )


def near_pairs(x: np.ndarray, group: np.ndarray, side: np.ndarray, cosine: float):
    """Pairs (i < j) of rows of one group with that cosine, of unequal sides where sides differ.

    ``group`` is sorted; ``side`` is 0, or 1 and 2 in groups that compare two blocks.
    """
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(first, len(group)))
    left, right = [], []
    small = np.repeat(sizes <= 32, sizes)
    for d in range(1, int(sizes[sizes <= 32].max(initial=1))):
        i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d])
        if len(i):
            hit = i[np.einsum("ij,ij->i", x[i], x[i + d]) >= cosine]
            left.append(hit), right.append(hit + d)
    for k in np.flatnonzero(sizes > 32):
        begin, end = first[k], first[k] + sizes[k]
        for low in range(begin, end, BLOCK):
            rows = x[low : min(low + BLOCK, end)]
            i, j = np.nonzero(rows @ x[low:end].T >= cosine)
            later = j > i
            left.append(low + i[later]), right.append(low + j[later])
    none = np.zeros(0, np.int64)
    left, right = np.concatenate([none, *left]), np.concatenate([none, *right])
    good = (side[left] != side[right]) | (side[left] == 0)
    return left[good], right[good]


def link_buckets(table: pa.Table, dtype, shape: tuple[int, int, int], cosine: float) -> pa.Table:
    """Link counts (a, n) of classes and forest edges (a, b) of one shard of buckets."""
    nodes, blobs = table.column("node").to_pylist(), table.column("vec").to_pylist()
    key, block, size, tab, code, grp, side = (
        table.column(c).to_numpy() for c in ("key", "blocks", "size", "tab", "code", "grp", "side")
    )
    counts: dict[bytes, int] = {}
    edges: set[tuple[bytes, bytes]] = set()
    for at, x in parsed(blobs, dtype).values():
        order = np.lexsort((block[at], code[at], tab[at], grp[at], key[at]))
        at, x = at[order], x[order]
        fields = np.stack([key[at], grp[at], tab[at], code[at], block[at]])
        group = np.append(0, np.cumsum((fields[:, 1:] != fields[:, :-1]).any(axis=0)))
        left, right = near_pairs(x, group, side[at], cosine)
        if not len(left):
            continue
        used, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
        codes = np.concatenate([bucket_codes(x[used[k : k + 2000]], *shape) for k in range(0, len(used), 2000)])
        i, j = inverse[: len(left)], inverse[len(left) :]
        for low in range(0, len(left), 50_000):
            part = slice(low, low + 50_000)
            a, b = codes[i[part]], codes[j[part]]
            ab, ba = (a[:, :, :1] == b).any(axis=2), (b[:, :, :1] == a).any(axis=2)
            shared = ab | ba
            here, bucket = tab[at[left[part]]], code[at[left[part]]]
            pick = np.arange(len(here))
            far = np.int64(1) << 60
            lowest = np.minimum(
                np.where(ab[pick, here], a[pick, here, 0], far), np.where(ba[pick, here], b[pick, here, 0], far)
            )
            mine = (shared.argmax(axis=1) == here) & (lowest == bucket)
            u, v = at[left[part][mine]], at[right[part][mine]]
            for x_, n in zip(np.concatenate([u, v]).tolist(), np.concatenate([size[v], size[u]]).tolist()):
                counts[nodes[x_]] = counts.get(nodes[x_], 0) + n
            edges |= forest(u.tolist(), v.tolist(), nodes)
    a, b = zip(*edges) if edges else ((), ())
    return pa.table({
        "a": pa.array([*counts, *a], pa.binary()), "b": pa.array([None] * len(counts) + list(b), pa.binary()),
        "n": pa.array([*counts.values(), *[None] * len(a)], pa.int64()),
    })


def forest(u: list[int], v: list[int], nodes: list[bytes]) -> set[tuple[bytes, bytes]]:
    """Of the pairs, those that join two trees so far."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = set()
    for i, j in zip(u, v):
        a, b = root(nodes[i]), root(nodes[j])
        if a != b:
            parent[a] = b
            out.add((nodes[i], nodes[j]))
    return out


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    cosine: float = COSINE, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    shape = (tables, hashes, probes)
    facts, dtype = described(vectors, id_col, label_col, vector_col)
    facts = materialize(facts, "vectors")
    classes = materialize(
        facts.filter("node is not null").groupBy("node")
        .agg(F.min("vec_id").alias("low"), F.count("*").alias("size"), F.first(F.struct("grp", "vec")).alias("v"))
        .select("node", "low", "size", "v.*"), "classes",
    )
    keys = bucket_rows(classes, dtype, shape, vectors=False)
    hot = materialize(
        keys.groupBy("key").count().filter(F.col("count") > BLOCK)
        .select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("pieces")), "hot",
    )
    few = hot.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    rows = bucket_rows(classes, dtype, shape, vectors=True).join(F.broadcast(hot) if few else hot, "key", "left")
    piece = F.coalesce(F.pmod(F.xxhash64("node"), F.col("pieces")), F.lit(0)).cast("int")
    # Block p meets itself and every other block q; a pair of blocks is numbered by (lower, upper).
    other = F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))
    dealt = rows.withColumn("piece", piece).withColumn("other", other)
    low, high = F.least("piece", "other").cast("long"), F.greatest("piece", "other").cast("long")
    dealt = dealt.withColumns({
        "blocks": low * 1_000_000 + high,
        "side": F.when(low == high, 0).when(F.col("piece") == low, 1).otherwise(2),
    })
    total = classes.count() * tables * probes
    shards = int(max(32, -(-total // SHARD_ROWS)))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("key", "blocks"), F.lit(shards)).cast("int"))
    made = dealt.select("shard", "key", "blocks", "side", "node", "size", "grp", "vec", "tab", "code").groupBy(
        "shard"
    ).applyInArrow(lambda t: link_buckets(t, dtype, shape, cosine), "a binary, b binary, n long")
    made = materialize(made, "links")
    roots = materialize(components(made.filter("b is not null").select("a", "b")), "roots")
    links = made.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    placed = classes.select("node", "low", "size").join(links, "node", "left").join(roots, "node", "left")
    placed = materialize(
        placed.filter("size > 1 or n is not null")
        .select("node", "low", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("root", "node").alias("root")),
        "placed",
    )
    lowest = materialize(placed.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    named = materialize(placed.join(lowest, "root").select("node", "n", "component_id"), "named")
    out = facts.join(named, "node", "left").select(
        F.col("vec_id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
