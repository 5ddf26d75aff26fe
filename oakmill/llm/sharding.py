"""Sharding by a Feistel permutation of global row numbers (native).

Every row gets a number in ``[0, n)`` that depends on the data alone, a keyed
permutation of ``[0, n)`` moves it, and the moved number ``p`` gives
``shard = p mod shards`` and ``slot = p div shards``.  Counts of shards differ
by one at most (the law ``rows``), slots have no gaps, and where a row number
goes can be computed without looking at any other row.

Row numbers: id, size and checksum of each row are written once, range-partitioned and sorted by (a hash of
them, id, size, checksum, place), so that ids that a third of all rows repeat are spread like others, and numbered by partition;
each partition is shifted by the rows of those before it, one number a partition.

Permutation: a generalised Feistel network over ``[0, a) x [0, b)`` with
additions mod ``a`` and mod ``b`` (Black and Rogaway), ``a * b >= n``.  Numbers
that leave ``[0, n)`` walk their cycle until they are back.  A walk visits only
the ``a * b - n`` numbers outside, each once at most, so that count bounds the
steps exactly; ``sides`` searches for a pair with few of them.

Defined results: null text has size 1 and checksum 0 (of no bytes); rows with equal id,
size and checksum are interchangeable; an empty table gives no rows; columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, documents, small_side

ROUNDS = 6


def sides(n: int, tries: int = 20_000) -> tuple[int, int]:
    """``a, b`` near the root of ``n`` with ``a * b >= n`` and least excess."""
    if n <= 1:
        return 1, 1
    low = max(1, math.isqrt(n) // 2)
    best = min(
        range(low, min(2 * low + 2, n) if n < 16 else low + min(tries, 3 * low) + 1),
        key=lambda a: ((-n) % a, abs(a * a - n)),
    )
    return best, -(-n // best)


def feistel(number: Column, n: int, seed: int) -> Column:
    """The place in ``[0, n)`` to which the permutation moves ``number``."""
    a, b = sides(n)

    def turn(p: Column) -> Column:
        def one_round(state: Column, k: Column) -> Column:
            left, right = state["l"], state["r"]
            new_left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), k, right), F.lit(a)), F.lit(a))
            new_right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), k, left), F.lit(b)), F.lit(b))
            return F.when(
                k % 2 == 0, F.struct(new_left.alias("l"), right.alias("r"))
            ).otherwise(F.struct(left.alias("l"), new_right.alias("r")))

        start = F.struct(
            F.call_function("div", p, F.lit(b)).alias("l"),
            F.pmod(p, F.lit(b)).alias("r"),
        )
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
            start,
            one_round,
            lambda s: s["l"] * F.lit(b) + s["r"],
        )

    out = turn(number)
    outside = a * b - n
    if outside:
        out = F.aggregate(
            F.sequence(F.lit(1), F.lit(outside)),
            out,
            lambda p, _: F.when(p >= F.lit(n), turn(p)).otherwise(p),
        )
    return out


def row_numbers(rows: DataFrame) -> DataFrame:
    """``rows`` with ``row_number`` in ``[0, n)``, by the data alone (equal rows are interchangeable)."""
    order = ["__hash", *rows.columns, "__place"]
    # written before they are dealt, so that the sample of ranges doesn't read texts again
    placed = cut_lineage(rows.withColumns({"__hash": F.xxhash64(*rows.columns), "__place": F.monotonically_increasing_id()}), "rows")
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*rows.columns, F.monotonically_increasing_id().alias("at"))
    at = F.col("at")
    dealt = cut_lineage(
        dealt.select(*rows.columns, F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("in_part")), "row-numbers"
    )
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    offsets = cut_lineage(counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    return dealt.join(small_side(offsets), "part").withColumn("row_number", F.col("offset") + F.col("in_part")).drop("part", "in_part", "offset")


def shard(
    docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Put every row into one of ``shards`` shards; see the module's text."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    data = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(data).cast("long") + 1).alias("size"),
        F.crc32(F.encode(data, "utf-8")).alias("text_crc32"),
    )
    n = docs.count()
    place = feistel(F.col("row_number"), n, seed) if n else F.col("row_number")
    return (
        row_numbers(rows)
        .withColumn("place", place)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
            F.call_function("div", F.col("place"), F.lit(shards)).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
