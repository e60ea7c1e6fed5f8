"""Sets of numbers as bitmaps of fixed size, tested in the plan itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmap(df: DataFrame, number: Column, bits: int) -> bytes:
    """The bits of the numbers (0 to ``bits`` - 1) that occur: at most ``bits`` / 8 numbers come to the driver."""
    rows = df.select(number.alias("n")).select(F.shiftright("n", 3).cast("int").alias("byte"), F.expr("shiftleft(1, CAST(n & 7 AS INT))").alias("bit"))
    out = bytearray(bits // 8)
    for r in rows.groupBy("byte").agg(F.bit_or("bit").alias("mask")).collect():
        out[r["byte"]] = r["mask"]
    return bytes(out)


def in_bitmap(held: bytes, number: Column) -> Column:
    """Whether the bit of a number is set. The map is one literal of the plan, so it should have some tens of kilobytes."""
    byte = F.substring(F.lit(held), (F.shiftright(number, 3) + 1).cast("int"), F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), number.bitwiseAND(7).cast("int")) == 1
