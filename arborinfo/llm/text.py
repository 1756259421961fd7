"""Array code shared by the text operators: slices of Arrow batches, words, hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from arborinfo.functions.rng import mix64
from arborinfo.lineage import ship_package

#: Text that is turned into arrays at a time, and bytes of words that are hashed at a time; a byte
#: takes some ten and some forty bytes of memory there.
SLICE_BYTES = 1 << 20
HASH_BYTES = 1 << 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: One random 64-bit value per byte, and the odd base of the polynomial over them.
BYTE_VALUE = mix64(np.arange(256, dtype=np.uint64))
BASE = np.uint64(0x9E3779B97F4A7C15)


def map_rows(
    df: DataFrame, fields: list[StructField], fn: Callable[[pa.RecordBatch], list[pa.Array]]
) -> DataFrame:
    """``df`` with the columns that ``fn`` makes of each batch; equal names are replaced."""
    ship_package(df.sparkSession)
    new = {f.name for f in fields}
    keep = [i for i, f in enumerate(df.schema.fields) if f.name not in new]
    schema = StructType([df.schema.fields[i] for i in keep] + fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch):
                made = fn(part)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in keep] + made, names=names)

    return df.mapInArrow(run, schema)


def row_slices(
    batch: pa.RecordBatch, limit: int = SLICE_BYTES, rows: int = 60_000, column: str = "text"
) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text each; a longer text is a slice alone."""
    if not batch.num_rows:
        return
    if column not in batch.schema.names:
        yield batch
        return
    _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1
        end = min(max(end, begin + 1), begin + rows, batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (one more for the end).

    A null is an empty text.
    """
    if pa.types.is_null(texts.type):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    if not len(texts) or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return bytes_, offsets - offsets[0]


def find_words(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes, cut at the ends of texts.

    The third array has the number of the first word of each text, and of all words.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    flags = inside[data]
    first, last = flags.copy(), flags.copy()
    first[1:] &= ~flags[:-1]
    last[:-1] &= ~flags[1:]
    begins = offsets[:-1][offsets[:-1] < n]
    first[begins] = flags[begins]
    stops = offsets[1:][offsets[1:] > 0] - 1
    last[stops] = flags[stops]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 64, 2 * len(_powers)), BASE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


_inverse_powers = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    """Powers of what multiplies with ``BASE`` to one, modulo 2^64."""
    global _inverse_powers
    if len(_inverse_powers) < n:
        grown = np.full(max(n, 64, 2 * len(_inverse_powers)), pow(int(BASE), -1, 1 << 64), np.uint64)
        grown[0] = 1
        _inverse_powers = np.multiply.accumulate(grown)
    return _inverse_powers


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each (not empty) span; spans are taken in blocks."""
    out = np.empty(len(starts), np.uint64)
    sizes = ends - starts
    total = np.concatenate([[0], np.cumsum(sizes)])
    begin = 0
    while begin < len(starts):
        end = int(np.searchsorted(total, total[begin] + HASH_BYTES, "right")) - 1
        end = max(end, begin + 1)
        length = sizes[begin:end]
        at = total[begin:end] - total[begin]
        inner = np.arange(total[end] - total[begin]) - np.repeat(at, length)
        value = BYTE_VALUE[data[inner + np.repeat(starts[begin:end], length)]]
        value *= powers(int(length.max()))[inner]
        out[begin:end] = mix64(np.add.reduceat(value, at) ^ length.astype(np.uint64))
        begin = end
    return out


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``hash_spans`` of spans that rise and do not overlap, by differences of running sums."""
    out = np.empty(len(starts), np.uint64)
    begin = 0
    while begin < len(starts):
        low = starts[begin]
        end = max(int(np.searchsorted(ends, low + HASH_BYTES, "right")), begin + 1)
        first, last = starts[begin:end] - low, ends[begin:end] - low
        value = BYTE_VALUE[data[low : ends[end - 1]]]
        value *= powers(len(value))[: len(value)]
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        value = (total[last] - total[first]) * inverse_powers(int(first[-1]) + 1)[first]
        out[begin:end] = mix64(value ^ (last - first).astype(np.uint64))
        begin = end
    return out


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags; the given inclusive ranges are set."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


def ragged(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
