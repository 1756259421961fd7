"""Token ids packed into rows of fixed width, best fit first, as binary columns.

Tasks tokenise their texts as they stream and pack them in blocks of about ``BLOCK_TOKENS`` tokens,
so memory is bounded and nothing is shuffled; a block leaves at most a few rows partly empty. A
document longer than a row is split into full rows and a rest, without loss. Pieces are placed in
order of falling size, each into the row with the least room that still holds it; that row is
found by descending a segment tree over the amounts of room.

A packed row has the ids (little endian, 16 or 32 bits by vocabulary), the lengths of its segments
added up, the position of each token in its segment (restarting with each), and the pieces it
holds: document, and which of its tokens. ``unpack`` puts the documents' ids together again.

Defined cases: null and empty texts take no place; every other text is followed by one end token;
rows with one id are packed apart, in the order of the input; unused places hold ``pad_id``. The
rows depend on how the input is split into partitions, the documents' ids do not.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborinfo.lineage import ship_package
from arborinfo.llm import text as tx

WIDTH = 2048
BLOCK_TOKENS = 2_000_000


class RoomTree:
    """Which amounts of room are on offer; finds the smallest that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the least room of at least ``need``, no longer on offer."""
        at = need + self.leaves
        if not self.count[at]:
            # Up to the first right neighbour with an offer, then down to its smallest.
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers; pieces go by falling size, equal ones in order."""
    tree, rows = RoomTree(width), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.take(sizes[k])
        if found is None:
            rows.append([])
            found = (width, len(rows) - 1)
        room, row = found
        rows[row].append(k)
        if room > sizes[k]:
            tree.add(room - sizes[k], row)
    return rows


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """A tokeniser from a file of byte strings and ranks."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packed", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def packed_rows(ids: list[np.ndarray], owners: pa.Array, width: int, pad_id: int, dtype) -> list[pa.Array]:
    """Columns of the packed rows of one block."""
    pieces = [(d, at, min(at + width, len(x))) for d, x in enumerate(ids) for at in range(0, len(x), width)]
    rows = best_fit([end - begin for _, begin, end in pieces], width)
    matrix = np.full((len(rows), width), pad_id, dtype)
    places = np.zeros((len(rows), width), np.uint16 if width <= 1 << 16 else np.uint32)
    ends, doc, first, last = [], [], [], []
    for r, row in enumerate(rows):
        at, sums = 0, [0]
        for k in row:
            d, begin, end = pieces[k]
            size = end - begin
            matrix[r, at : at + size] = ids[d][begin:end]
            places[r, at : at + size] = np.arange(size)
            at += size
            sums.append(at)
            doc.append(d), first.append(begin), last.append(end)
        ends.append(sums)
    cut = np.append(0, np.cumsum([len(r) for r in rows]))
    held = pa.StructArray.from_arrays(
        [owners.take(pa.array(doc, pa.int64())), pa.array(first, pa.int64()), pa.array(last, pa.int64())],
        names=["doc_id", "begin", "end"],
    )
    return [
        pa.array([x.tobytes() for x in matrix], pa.binary()), pa.array(ends, pa.list_(pa.int32())),
        pa.array([x.tobytes() for x in places], pa.binary()), tx.ragged(cut, held),
    ]


def pack(
    docs: DataFrame, path: str, pattern: str, end_id: int, vocabulary: int, id_col: str = "doc_id",
    width: int = WIDTH, pad_id: int = 0, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """(block, row, ids, cu_seqlens, positions, pieces) of the packed texts of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches):
        encode = encoding(path, pattern).encode_ordinary
        place, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        owners: list[pa.Array] = []
        held = 0

        def flush():
            nonlocal ids, owners, held, number
            columns = packed_rows(ids, pa.concat_arrays(owners), width, pad_id, np.dtype(dtype))
            n = len(columns[0])
            block, number = (place << 32) + number, number + 1
            ids, owners, held = [], [], 0
            for low in range(0, n, 512):
                part = slice(low, min(low + 512, n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * (part.stop - low), pa.int64()), pa.array(range(low, part.stop), pa.int32()),
                     *[c[part] for c in columns]],
                    names=["block", "row", "ids", "cu_seqlens", "positions", "pieces"],
                )

        for batch in batches:
            for part in tx.row_slices(batch):
                texts = tx.column(part, "text")
                mine = [k for k, t in enumerate(texts) if t.is_valid and len(t.as_py())]
                if not mine:
                    continue
                owners.append(tx.column(part, "doc_id").take(pa.array(mine, pa.int64())))
                for k in mine:
                    ids.append(np.array([*encode(texts[k].as_py()), end_id], np.uint32))
                    held += len(ids[-1])
                if held >= block_tokens:
                    yield from flush()
        if ids:
            yield from flush()

    return rows.mapInArrow(
        run, "block long, row int, ids binary, cu_seqlens array<int>, positions binary, "
        f"pieces array<struct<doc_id:{kind},begin:bigint,end:bigint>>",
    )


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet, each block's rows in order within a file."""
    packed.write.mode("error").parquet(path)


def unpack(packed: DataFrame, vocabulary: int) -> DataFrame:
    """(doc_id, begin, ids): every piece's ids; pieces of a document in order of begin join up."""
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    kind = packed.schema["pieces"].dataType.elementType["doc_id"].dataType.simpleString()

    def split(batches):
        for batch in batches:
            out = [[], [], []]
            for raw, ends, pieces in zip(*(tx.column(batch, c).to_pylist() for c in ("ids", "cu_seqlens", "pieces"))):
                ids = np.frombuffer(raw, dtype)
                for a, b, piece in zip(ends, ends[1:], pieces):
                    out[0].append(piece["doc_id"]), out[1].append(piece["begin"]), out[2].append(ids[a:b].astype(np.int32))
            kinds = [batch.schema.field("pieces").type.value_type.field("doc_id").type, pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["doc_id", "begin", "ids"])

    return packed.mapInArrow(split, f"doc_id {kind}, begin long, ids array<int>")
