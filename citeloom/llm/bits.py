"""A broadcast bitmap of 64-bit keys whose size follows the number of keys, up to a bound.

It lets through every key it was made of, and some others: a filter before an exact step, never instead
of one. Beyond the bound it lets more through and still loses none.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, so that about one in sixteen other keys gets through.
SHARE = 16
FEWEST_BITS = 1 << 16
#: 32 MB.
MOST_BITS = 1 << 28


class Bits:
    """Which slots are taken; a key's slot is its lowest bits."""

    def __init__(self, taken: np.ndarray):
        self.taken = taken
        self.mask = np.uint64(8 * len(taken) - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys & self.mask).astype(np.int64)
        return (self.taken[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def bits_for(count: int) -> int:
    return min(MOST_BITS, max(FEWEST_BITS, 1 << (SHARE * max(1, count) - 1).bit_length()))


def broadcast_bits(keys: DataFrame, count: int) -> Broadcast:
    """The ``key`` values (long, well mixed) of a frame that has about ``count`` of them.

    Spark makes the bitmap in pieces of 4 kB; the driver receives at most MOST_BITS / 8 bytes.
    """
    size = bits_for(count)
    slot = keys.select((F.col("key").bitwiseAND(F.lit(size - 1)) + 1).alias("slot"))
    parts = slot.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    taken = np.zeros(size // 8, np.uint8)
    for row in parts.collect():
        piece = np.frombuffer(row.bits, np.uint8)
        taken[(row.part - 1) * len(piece) : row.part * len(piece)] = piece
    return keys.sparkSession.sparkContext.broadcast(Bits(taken))
