"""Summaries of a whole table of hashes, sized from the table: a count sketch and a bit sketch.

Each task folds its rows into one numpy array and sends it as compressed blocks; blocks are merged on the
executors, and only the merged summary, of at most ``MOST_COUNT_BITS`` bytes or ``MOST_FILTER_BITS`` bits (as powers
of two), reaches the driver and is broadcast from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treeloom.functions.shingles import mix
from treeloom.session import shuffles_removed

BLOCKS = 64
BLOCK_SCHEMA = "block int, data binary"

#: log2 of the most cells of a count sketch (one byte each once merged: 32 MB) and of the most bits of a bit sketch (64 MB).
MOST_COUNT_BITS = 25
MOST_FILTER_BITS = 29
#: Levels of a count sketch per doubling of the count.
_PER_OCTAVE = 10


def count_bits(total: int) -> int:
    """Cells for so many counted occurrences: two to four of them share one, as far as the bound goes."""
    return min(MOST_COUNT_BITS, max(12, int(total).bit_length() - 2))


def filter_bits(number: int) -> int | None:
    """Bits for so many values, of which at most a tenth is set; None where the bound is too small for that."""
    bits = max(12, int(10 * number).bit_length())
    return bits if bits <= MOST_FILTER_BITS else None


def blocks_of(array: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Non-empty blocks of an array, compressed."""
    numbers, datas = [], []
    for k, part in enumerate(np.split(array, BLOCKS)):
        if part.any():
            numbers.append(k)
            datas.append(pa.compress(np.ascontiguousarray(part).tobytes(), codec="zstd", asbytes=True))
    return numbers, datas


def _merge(blocks: DataFrame, dtype: type, size: int, combine: Callable[[np.ndarray, np.ndarray], np.ndarray], finish: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    per = size // BLOCKS
    nbytes = per * np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(pa.decompress(data.as_buffer(), nbytes, codec="zstd"), dtype)
                held[k] = combine(held[k], part) if k in held else part
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([finish(x).tobytes() for x in held.values()], pa.binary())], ["block", "data"])

    with shuffles_removed(blocks.sparkSession):
        rows = blocks.repartition(BLOCKS, "block").mapInArrow(run, BLOCK_SCHEMA).collect()  # at most BLOCKS rows of bounded size
    merged = {r["block"]: r["data"] for r in rows}
    empty = finish(np.zeros(per, dtype))
    return np.concatenate([np.frombuffer(merged[k], empty.dtype) if k in merged else empty for k in range(BLOCKS)])


class Counter:
    """One task's share of a count sketch."""

    def __init__(self, bits: int):
        self.cells = np.zeros(1 << bits, np.int32)
        self.mask = np.uint64((1 << bits) - 1)

    def add(self, hashes: np.ndarray) -> None:
        cells, counts = np.unique((hashes & self.mask).astype(np.int64), return_counts=True)
        self.cells[cells] += counts.astype(np.int32)


def merge_counts(blocks: DataFrame, bits: int) -> np.ndarray:
    """Merged counts as levels of a tenth of an octave, one byte a cell: level = round(10 * log2(count + 1))."""
    return _merge(blocks, np.int32, 1 << bits, lambda a, b: np.minimum(a.astype(np.int64) + b, 2**31 - 1).astype(np.int32), lambda x: np.minimum(255, np.round(_PER_OCTAVE * np.log2(x.astype(np.float64) + 1))).astype(np.uint8))


def count_level(sketch: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return sketch[(hashes & np.uint64(len(sketch) - 1)).astype(np.int64)]


def count_at(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: never far below the true one, since a cell counts all its hashes."""
    return np.exp2(level.astype(np.float64) / _PER_OCTAVE) - 1


class Bits:
    """One task's share of a bit sketch (a Bloom filter with one hash)."""

    def __init__(self, bits: int):
        self.bits = np.zeros(1 << bits, bool)
        self.mask = np.uint64((1 << bits) - 1)

    def add(self, hashes: np.ndarray) -> None:
        self.bits[(hashes & self.mask).astype(np.int64)] = True

    def packed(self) -> np.ndarray:
        return np.packbits(self.bits, bitorder="little")


def may_contain(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False only for hashes that were never added."""
    at = (hashes & np.uint64(len(packed) * 8 - 1)).astype(np.int64)
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bits_of_column(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bit sketch of a bigint column, hashed by :func:`treeloom.functions.shingles.mix`; nulls are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            values = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            if len(values):
                held = held or Bits(bits)
                held.add(mix(values.astype(np.int64).view(np.uint64)))
        if held:
            numbers, datas = blocks_of(held.packed())
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(datas, pa.binary())], ["block", "data"])

    return _merge(df.select(column).mapInArrow(run, BLOCK_SCHEMA), np.uint8, 1 << (bits - 3), np.bitwise_or, lambda x: x)
