"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's target is its weight's share of all words, ``MOST_REPEATS`` times
its own size at most; what is over goes to the other sources by weight.
Tokens are dealt in equal blocks of ``BLOCK`` words, or fewer where a target is small (:func:`block_of`).
Sainte-Lague gives each block to the source with the highest quotient target / (2 blocks + 1), then each source's
blocks to its shards, by quotients of the shards' sizes: integer quotas.

A shard is a hash share of a source's documents, in a seeded order; its words
make one stream, cut into blocks.  The quota takes whole passes over
the stream and then its first blocks, which the seeded order makes a random
choice.  So a document is taken some number of whole times, and one document
of a shard may have a first part taken once more.

``apportion`` finds the quotients' dividing line by bisection and deals only
the remainder one by one, so its cost doesn't depend on the number of blocks.
A shard has :func:`shard_rows` rows on average: what the driver holds (a quota a shard) and what a
task sorts (a shard, without texts) both grow with the root of the table only.
The number of sources is bounded by the weights that the caller configures.

Defined results: null or blank text has size 0 and nothing is taken; a null source is a
source of its own, after all others; rows of one id are ordered by size and text; reruns and other
partitionings give the same rows; an empty table gives none; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, documents, named, numbered, small_batches, small_side, split_words, trim

BLOCK = 32
#: Blocks that the smallest target has at least, where it has as many words.
LEAST_BLOCKS = 64
MOST_REPEATS = 3
SEED = 11


def shard_rows(rows: int) -> int:
    """Rows of a shard on average, in a table of ``rows``."""
    return max(4096, 16 * math.isqrt(rows))


def block_of(targets: Sequence[float], most: int = BLOCK) -> int:
    """Words of a block: ``most``, or fewer so that the smallest target has ``LEAST_BLOCKS``."""
    return max(1, min(most, int(min((t for t in targets if t > 0), default=0)) // LEAST_BLOCKS))


def apportion(weights: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Sainte-Lague: ``seats`` by highest quotients weight / (2 k + 1), no more than ``most`` each.

    Ties go to the earlier entry.  Seats that no entry may take stay empty.
    """
    weights = np.asarray(weights, np.float64)
    most = np.full(len(weights), seats, np.int64) if most is None else np.asarray(most, np.int64)
    most = np.where(weights > 0, most, 0)
    seats = int(min(seats, most.sum()))
    got = np.zeros(len(weights), np.int64)
    if not seats:
        return got

    def above(line: float) -> np.ndarray:
        """Seats whose quotient is over ``line``."""
        return np.minimum(most, np.maximum(0, np.ceil((weights / line - 1) / 2)).astype(np.int64))

    low, high = float(weights[weights > 0].min()) / (2.0 * seats + 3), float(weights.max()) * 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if above(mid).sum() > seats:
            low = mid
        else:
            high = mid
    got = above(high)
    while (left := seats - int(got.sum())) > 0:
        quotients = np.where(got < most, weights / (2 * got + 1), -1.0)
        best = np.lexsort((np.arange(len(weights)), -quotients))[:left]
        got[best[quotients[best] >= 0]] += 1
    return got


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of all sizes by weight, ``most`` times a source's size at most, the excess shared anew by weight."""
    out = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
            free.discard(i)
        left -= sum(out[i] for i in full)
    return out


def words_in(text: Column) -> Column:
    """The number of words of a text."""

    def count(texts: pa.Array) -> pa.Array:
        out = pa.array([len(split_words(t)) for t in texts.to_pylist()], pa.int64())
        trim()
        return out

    return F.arrow_udf(count, "long")(text)


def facts(id_col: str, source_col: str, text_col: str) -> list[Column]:
    """doc_id, source, size in words, tie (of the text), and row (a number by place)."""
    text = F.col(text_col).cast("string")
    return [
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        words_in(text).alias("size"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"),
    ]


Weight = Callable[[int, "str | None"], float]


def by_three(i: int, _: str | None) -> float:
    """Weights 1, 2, 3, repeating."""
    return i % 3 + 1


def mix(
    docs: DataFrame, weight: Weight = by_three, block: int = BLOCK, seed: int = SEED,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words), for every row of ``docs``.

    ``weight(i, source)``: of the i-th source by code point, null last.
    """
    small_batches(docs.sparkSession)
    rows = cut_lineage(docs.select(*facts(id_col, source_col, text_col)), "sizes")
    return dealt(rows, *shares(rows, weight, block, seed), seed).select("doc_id", "source", "size", "source_size", "target", "taken")


def shares(rows: DataFrame, weight: Weight, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (:func:`facts`): the sources (no, source, shards, source_size, target), and the words to take from each shard (no, shard, stream, take)."""
    spark = rows.sparkSession
    by_source = {
        r.source: (int(r.n), int(r.size))
        for r in rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    }
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    sizes = [by_source[s][1] for s in names]
    goal = targets(sizes, [weight(i, s) for i, s in enumerate(names)])
    block = block_of(goal, block)
    cap = [-(-MOST_REPEATS * z // block) for z in sizes]
    quota = apportion(np.array(goal), round(sum(goal) / block), np.array(cap)) if names else []
    most = shard_rows(sum(n for n, _ in by_source.values()))
    plan = [(i, s, -(-by_source[s][0] // most), sizes[i], goal[i]) for i, s in enumerate(names)]
    sources = cut_lineage(spark.createDataFrame(plan, "no int, source string, shards int, source_size long, target double"), "sources")
    streams = sharded(rows, sources, seed).groupBy("no", "shard").agg(F.sum("size").alias("size")).orderBy("no", "shard").collect()
    out = []
    for no, of in itertools.groupby(streams, key=lambda r: r.no):
        own = list(of)
        z = np.array([r["size"] for r in own], np.int64)
        got = apportion(z, int(quota[no]), -(-MOST_REPEATS * z // block))
        out += [
            (no, r.shard, int(r["size"]), int(min(q * block, MOST_REPEATS * r["size"])))
            for r, q in zip(own, got.tolist(), strict=True)
        ]
    return sources, cut_lineage(spark.createDataFrame(out, "no int, shard int, stream long, take long"), "shares")


def sharded(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """``rows`` with no, source_size, target, shard and ``at``, their place in the order of their shard."""
    key = ["doc_id", "size", "tie"]
    return (
        rows.join(small_side(sources), rows["source"].eqNullSafe(sources["source"]))
        .drop(sources["source"])
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), *key), F.col("shards")).cast("int"))
        .withColumn("at", F.struct(F.xxhash64(F.lit(seed + 1), *key).alias("h"), "row"))
        .drop("shards")
    )


def dealt(rows: DataFrame, sources: DataFrame, share: DataFrame, seed: int) -> DataFrame:
    """``rows`` with source_size, target, the words ``taken`` of each, and what their shard takes."""
    before = W.partitionBy("no", "shard").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        sharded(rows, sources, seed)
        .withColumn("start", F.sum("size").over(before) - F.col("size"))
        .join(small_side(share), ["no", "shard"])
        .withColumn("passes", F.when(F.col("stream") > 0, F.call_function("div", F.col("take"), F.col("stream"))).otherwise(F.lit(0)))
        .withColumn("rest", F.when(F.col("stream") > 0, F.pmod("take", "stream")).otherwise(F.lit(0)))
        .withColumn("taken", F.col("size") * F.col("passes") + F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("start"))))
    )


def first_words(text: str, n: int) -> str:
    """The text up to the end of its ``n``-th word."""
    data, at = text.encode("utf-8", "surrogatepass"), 0
    tail = data.split(None, n)
    at = len(data) - len(tail[n]) if len(tail) > n else len(data)
    return data[:at].rstrip().decode("utf-8", "surrogatepass")


def mixed_documents(
    docs: DataFrame, weight: Weight = by_three, block: int = BLOCK, seed: int = SEED,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``docs`` as the mix takes them: a row for each whole time that a document is taken, and one for a first part.

    Columns stay as they are; ``text_col`` of a part is cut after its last word taken.  Ids may be null or repeated.
    Texts are not shuffled: rows without texts are ordered, and each shard names the one row where its last pass ends;
    rows before it, by the order's key, are taken once more than rows after it.
    """
    small_batches(docs.sparkSession)
    plain, names = numbered(docs)
    text = names[text_col]
    # written with sizes and places, so that words are counted once and a row's place stays what it is
    kept = cut_lineage(
        plain.select("*", *facts(names[id_col], names[source_col], text)),
        "sized",
    )
    rows = kept.select("doc_id", "source", "size", "tie", "row")
    sources, share = shares(rows, weight, block, seed)
    end = dealt(rows, sources, share, seed).where("start <= rest and rest < start + size")
    ends = cut_lineage(end.select("no", "shard", F.col("at").alias("end"), (F.col("rest") - F.col("start")).alias("part"), "passes"), "ends")
    once_more = F.when(F.col("at") < F.col("end"), F.col("size")).when(F.col("at") == F.col("end"), F.col("part")).otherwise(F.lit(0))
    take = (
        sharded(kept.where("size > 0"), sources, seed)
        .join(small_side(ends), ["no", "shard"])
        .withColumn("taken", F.col("size") * F.col("passes") + once_more)
        .where("taken > 0")
    )
    # words of each row: the size as often as it goes into what is taken, then the rest
    parts = F.transform(
        F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")),
        lambda k: F.least(F.col("size"), F.col("taken") - (k - 1) * F.col("size")),
    )

    def cut(texts: pa.Array, n: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), n.to_pylist(), strict=True)
        return pa.array([None if t is None else first_words(t, k) for t, k in pairs], pa.string())

    out = take.withColumn("words", F.explode(parts))
    # only texts that are cut go to Python
    first = F.arrow_udf(cut, "string")(F.when(F.col("words") < F.col("size"), F.col(text).cast("string")), F.col("words"))
    out = out.withColumn(text, F.coalesce(first, F.col(text)))
    return out.select(*named(out, names))


def op3_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
