"""A set of 64-bit keys that fits in a bounded number of bytes: no false negatives, some false positives.

Used to keep rows out of a shuffle that cannot matter there. What passes is always judged exactly
later, so a filter that is too small for its keys costs time, never results. Its size follows the
number of keys up to MAX_BITS, which bounds what reaches the driver and is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm import text as tx
from gaugeline.llm.common import ship

SEGMENT_BITS = 17
MAX_BITS = 1 << 28
HASHES = 4


def _bits(keys: np.ndarray) -> np.ndarray:
    """The bits of each key within its segment, one row for each hash."""
    a, b = tx.mix(keys + np.uint64(1)), tx.mix(keys + np.uint64(2))
    step = b | np.uint64(1)
    return np.stack([(a + np.uint64(k) * step) >> np.uint64(64 - SEGMENT_BITS) for k in range(HASHES)]).astype(np.int64)


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    return (tx.mix(keys) % np.uint64(segments)).astype(np.int64)


class Bloom:
    def __init__(self, data: np.ndarray, segments: int):
        self.data, self.segments = data, segments

    def has(self, keys: np.ndarray) -> np.ndarray:
        """For each unsigned key, False if it is surely not in the set."""
        base = _segment(keys, self.segments) << SEGMENT_BITS
        out = np.ones(len(keys), bool)
        for row in _bits(keys):
            at = base + row
            out &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) == 1
        return out


def build(keys: DataFrame, column: str, count: int, max_bits: int = MAX_BITS) -> Bloom:
    """The filter of a bigint column; each segment's bits are made in a group of its own."""
    ship(keys.sparkSession)
    segments = max(1, min(12 * count, max_bits) >> SEGMENT_BITS)

    def tagged(batches):
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_segment(k, segments)), b.column(0)], names=["segment", "k"])

    def fill(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << SEGMENT_BITS, np.uint8)
        bits[_bits(table.column("k").to_numpy().view(np.uint64)).ravel()] = 1
        return pa.table({"segment": table.column("segment")[:1].cast(pa.int64()), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    rows = keys.select(F.col(column).alias("k")).filter("k IS NOT NULL").mapInArrow(tagged, "segment bigint, k bigint")
    data = np.zeros(segments << (SEGMENT_BITS - 3), np.uint8)
    size = 1 << (SEGMENT_BITS - 3)
    for r in rows.groupBy("segment").applyInArrow(fill, "segment bigint, bits binary").collect():
        data[r.segment * size : (r.segment + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return Bloom(data, segments)
