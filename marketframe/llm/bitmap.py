"""A membership filter of fixed size: one bit per hash value, as a table small enough to broadcast.

It says "surely not" or "perhaps". Joins behind it stay exact; it spares rows the shuffle. With far
more keys than bits it lets everything pass, which costs speed and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: 8 MiB, whatever the input.
BITS = 1 << 26
_ROW_BITS = 32_768  # fixed by Spark's bitmap functions


def _slot(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(BITS))


def build(hashes: DataFrame, column: str) -> DataFrame:
    """``(bucket, bits)``: at most ``BITS / 32768`` rows of 4 KiB."""
    slot = _slot(F.col(column))
    return (
        hashes.where(F.col(column).isNotNull())
        .select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("position"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("position").alias("bits"))
    )


def mark(df: DataFrame, hashed: Column, bitmap: DataFrame, name: str) -> DataFrame:
    """``df`` with the boolean ``name``: false where ``hashed`` is surely not among the keys."""
    slot = _slot(hashed)
    position = F.bitmap_bit_position(slot)
    side = bitmap.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.lit(1) + F.shiftright(F.col("_position"), 3).cast("int"), F.lit(1))), 16, 10)
    bit = F.expr("shiftright(cast(_byte as int), cast(_position % 8 as int)) & 1 = 1")
    return (
        df.withColumn("_slot", F.bitmap_bucket_number(slot))
        .withColumn("_position", position)
        .join(F.broadcast(side), F.col("_slot") == F.col("_bucket"), "left")
        .withColumn("_byte", F.coalesce(byte, F.lit("0")))
        .withColumn(name, bit)
        .drop("_slot", "_position", "_bucket", "_bits", "_byte")
    )


def tester(bitmap: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """What ``mark`` does, for arrays of hashes (signed longs) in Python tasks. The filter, 8 MiB at most, goes to
    them over the driver."""
    bits = np.zeros((BITS // _ROW_BITS + 1, _ROW_BITS // 8), np.uint8)
    for row in bitmap.collect():
        bits[row.bucket] = np.frombuffer(row.bits, np.uint8)
    bits = bits.ravel()

    def perhaps(hashes: np.ndarray) -> np.ndarray:
        slot = hashes & (BITS - 1)
        # Spark puts slot 0 into a bucket of its own; the others follow from the next bucket on.
        at = np.where(slot > 0, slot + (_ROW_BITS - 1), 0)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    return perhaps
