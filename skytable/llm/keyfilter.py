"""A bitmap over keys that lets through all keys it was made from, and few others.

It has at least eight bits for each key, up to ``MOST_BITS``; with eight bits about one other key in eight or nine passes. The bitmap is made in slices, one a
task, each from the keys that fall into it, and is 64 MB at most when it is sent to the tasks. With more keys than ``MOST_BITS / 8`` it lets through ever
more; what follows it is exact in any case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS, BITS_A_KEY = 1 << 21, 1 << 29, 8
_SLICE = 21


def place(key: str, bits: int) -> int:
    """Where a key is in a bitmap, whose size is a power of two."""
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass")) & (bits - 1)


def size_for(keys: int, most: int = MOST_BITS) -> int:
    """Bits for a number of keys."""
    return min(most, max(LEAST_BITS, 1 << (BITS_A_KEY * max(keys, 1) - 1).bit_length()))


def bitmap(keys: DataFrame, most: int = MOST_BITS) -> bytes:
    """Bitmap of the keys in the first column (text). Counts the keys first; what reaches the driver is the bitmap, once."""
    keys = keys.select(F.col(keys.columns[0]).alias("key")).where("key is not null")
    bits = size_for(keys.count(), most)

    def located(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([place(k, bits) for k in batch.column("key").to_pylist()], pa.int64())], ["at"])

    def filled(table: pa.Table) -> pa.Table:
        at = np.asarray(table["at"])
        found = np.zeros(1 << (_SLICE - 3), np.uint8)
        np.bitwise_or.at(found, (at & ((1 << _SLICE) - 1)) >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return pa.table({"slice": pa.array([int(at[0]) >> _SLICE], pa.int64()), "bits": pa.array([found.tobytes()], pa.binary())})

    places = keys.mapInArrow(located, "at bigint").distinct()
    whole = np.zeros(bits // 8, np.uint8)
    for row in places.groupBy(F.shiftright("at", _SLICE)).applyInArrow(filled, "slice bigint, bits binary").toLocalIterator():
        begin = row["slice"] << (_SLICE - 3)
        whole[begin : begin + (1 << (_SLICE - 3))] = np.frombuffer(row["bits"], np.uint8)
    return whole.tobytes()


class Known(dict):
    """Whether a key may be one of the bitmap's; remembers keys met, up to a bound."""

    def __init__(self, bits: bytes, most: int = 300_000) -> None:
        super().__init__()
        self.bits, self.most, self.size = bits, most, 8 * len(bits)

    def __missing__(self, key: str) -> bool:
        if len(self) > self.most:
            self.clear()
        at = place(key, self.size)
        hit = self[key] = bool(self.bits[at >> 3] >> (at & 7) & 1)
        return hit
