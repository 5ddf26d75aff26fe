"""Zone maps, Bloom filters, and what they spare a scan."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import bitmaps
from ..sources.tables import PARTITION_ROWS

#: Bits of a Bloom filter that is broadcast (8 MB).
BROADCAST_BITS = 1 << 26


def with_partitions(df: DataFrame, key: str, rows: int = PARTITION_ROWS) -> DataFrame:
    """``df`` with ``partition_id``: ``rows`` consecutive values of a dense key each."""
    return df.withColumn("partition_id", F.floor(F.col(key) / F.lit(rows)).cast("long"))


def zone_map(df: DataFrame, columns: Sequence[str], partition: str = "partition_id") -> DataFrame:
    """Rows, least and largest value of ``columns`` in each partition."""
    parts = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(partition).agg(F.count("*").alias("n_rows"), *parts)


def may_hold(zones: DataFrame, column: str, value: object) -> DataFrame:
    """Zones whose range holds ``value``; a zone of nulls alone, without a range, is kept."""
    low, high, v = F.col(f"min_{column}"), F.col(f"max_{column}"), value if isinstance(value, Column) else F.lit(value)
    return zones.where(low.isNull() | ((low <= v) & (high >= v)))


def bloom_params(n: int, p: float) -> tuple[int, int]:
    """Bits and hashes for ``n`` keys at a false-positive rate of ``p``."""
    bits = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return bits, max(1, round(bits / n * math.log(2)))


def false_positive_rate(bits: int, hashes: int, count: int) -> float:
    """The rate to expect after ``count`` keys."""
    return (1 - math.exp(-hashes * count / bits)) ** hashes


def bloom_positions(value: Column, bits: int, hashes: int) -> Column:
    """The bits of a value, by double hashing; both hashes are reduced before they are combined, so nothing overflows."""
    a = F.pmod(F.xxhash64(value, F.lit(1)), F.lit(bits))
    b = F.pmod(F.xxhash64(value, F.lit(2)), F.lit(bits))
    return F.array(*[F.pmod(a + F.lit(i) * b, F.lit(bits)) for i in range(hashes)])


def bloom_words(df: DataFrame, column: str, bits: int, hashes: int, by: Sequence[str] = ()) -> DataFrame:
    """A Bloom filter of a column's values for each group of ``by``: a row (``by``, ``word``, ``bitmap``) for each 32,768 bits that are not all unset."""
    known = df.where(F.col(column).isNotNull()).select(*by, F.explode(bloom_positions(F.col(column), bits, hashes)).alias("at"))
    return bitmaps(known, by, F.col("at"), "word")


def bit_is_set(bitmap: Column, bit: Column) -> Column:
    """Whether a bit (from 0) of a bitmap is set; not if there is no bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))


def holding(words: DataFrame, value: Column, bits: int, hashes: int, by: Sequence[str]) -> DataFrame:
    """The groups whose filter (of :func:`bloom_words`) may hold one ``value``; null is never held.

    Only the words that the value's bits are in are read, and a group comes to a count of set bits.
    """
    wanted = words.sparkSession.range(1).select(F.explode(F.array_distinct(bloom_positions(value, bits, hashes))).alias("at"))
    places = [r.at for r in wanted.where(value.isNotNull()).collect()]
    if not places:
        return words.where(F.lit(False)).select(*by).distinct()
    numbers = F.array(*[F.lit(p) for p in places])
    hits = words.where(F.col("word").isin(sorted({p // 32768 + 1 for p in places}))).withColumn(
        "set", F.size(F.filter(numbers, lambda p: (F.bitmap_bucket_number(p + 1) == F.col("word")) & bit_is_set(F.col("bitmap"), F.bitmap_bit_position(p + 1))))
    )
    return hits.groupBy(*by).agg(F.sum("set").alias("set")).where(F.col("set") == len(places)).select(*by)


def bloom_member(df: DataFrame, column: str, words: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``df`` with ``held``: whether one filter (of :func:`bloom_words`, without groups) may hold the column's value; null never.

    A filter of ``BROADCAST_BITS`` or fewer is one map that goes to all executors: its size is known from ``bits``.
    A larger one stays in rows, and bits are joined with words.
    """
    positions = bloom_positions(F.col(column), bits, hashes)
    if bits <= BROADCAST_BITS:
        one = words.agg(F.map_from_entries(F.collect_list(F.struct("word", "bitmap"))).alias("__words"))

        def is_set(p: Column) -> Column:
            word = F.try_element_at("__words", F.bitmap_bucket_number(p + 1))
            return bit_is_set(word, F.bitmap_bit_position(p + 1))

        held = F.col(column).isNotNull() & F.forall(positions, is_set)
        return df.join(F.broadcast(one)).withColumn("held", held).drop("__words")
    keyed = df.select("*", F.monotonically_increasing_id().alias("__row"))
    bits_of = keyed.where(F.col(column).isNotNull()).select("__row", F.explode(positions).alias("__at"))
    met = bits_of.join(words, F.bitmap_bucket_number(F.col("__at") + 1) == F.col("word"), "left")
    whole = met.groupBy("__row").agg(F.every(bit_is_set(F.col("bitmap"), F.bitmap_bit_position(F.col("__at") + 1))).alias("__held"))
    return keyed.join(whole, "__row", "left").withColumn("held", F.coalesce("__held", F.lit(False))).drop("__row", "__held")
