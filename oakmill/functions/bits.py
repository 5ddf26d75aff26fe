"""Bitmaps of 32,768 bits, built from numbers of 64."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmaps(df: DataFrame, by: Sequence[str], at: Column, bucket: str) -> DataFrame:
    """``by``, ``bucket``, ``bitmap``: the bits of the positions ``at`` (from 0; bucket 1 has the first 32,768), as ``bitmap_construct_agg`` sets them.

    That aggregate sorts all rows of a task.  Here bits meet in numbers first, in a hash table, and a bitmap is put together from the numbers
    that have any, so what a task holds is numbers and no rows.
    """
    low = F.col("__at").bitwiseAND(F.lit(63)).cast("int")
    # byte 0 of eight is a number's highest one
    place = (F.lit(7) - F.shiftright(low, 3)) * 8 + low.bitwiseAND(F.lit(7))
    numbers = df.select(*by, at.cast("long").alias("__at")).groupBy(*by, F.shiftright("__at", 6).alias("__number"))
    bits = numbers.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("__bits"))
    slot = F.coalesce(F.col("__number").bitwiseAND(F.lit(511)).cast("int"), F.lit(0)).alias("slot")  # null: a bitmap without a bit, in a bucket of its own
    slots = bits.select(*by, (F.shiftright("__number", 9) + 1).alias(bucket), F.struct(slot, F.lpad(F.hex(F.coalesce("__bits", F.lit(0))), 16, "0").alias("digits")).alias("__slot"))
    whole = slots.groupBy(*by, bucket).agg(F.array_sort(F.collect_list("__slot")).alias("__slots"))
    digits = F.aggregate("__slots", F.lit(""), lambda done, s: F.concat(F.rpad(done, s["slot"] * 16, "0"), s["digits"]))
    return whole.select(*by, bucket, F.unhex(F.rpad(digits, 8192, "0")).alias("bitmap"))
