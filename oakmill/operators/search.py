"""Token postings, column postings and bitmaps, as ordinary tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.text import TO_BLANKS, bitmap_value, column_tokens, document_tokens, lowered

#: Bytes of text whose tokens are counted at once.
COUNT_BYTES = 16 << 20


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``token``, ``id``, one row for each time that a token stands in a document."""
    return docs.select(F.explode(document_tokens(F.col(text_col))).alias("token"), F.col(id_col).alias("id"))


def counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``token``, ``id``, ``times``: the tokens of each row of ``docs``, counted in the row; rows that repeat an id have their own counts.  No shuffle."""
    own, kind = _texts(docs, id_col, text_col)
    return own.mapInArrow(_count, f"token string, id {kind}, times long")


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Postings of :func:`counted` in lists: a row (``token``, ``first``, ``documents``, ``total``, ``ids``, ``times``) for a token of some documents."""
    own, kind = _texts(docs, id_col, text_col)
    return own.mapInArrow(_count_packed, PACKED.format(kind=kind))


PACKED = "token string, first {kind}, documents long, total long, ids array<{kind}>, times array<long>"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    own = docs.select(F.col(id_col).alias("id"), lowered(F.col(text_col)).alias("text"))
    return own, own.schema["id"].dataType.simpleString()


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]]:
    """Distinct tokens of some documents, where the postings of each begin (and the last ends), and the postings' ids and times."""
    edge = "".join(map(chr, range(33)))
    for batch in batches:
        text = batch.column("text")
        valid, offsets, data = text.buffers()
        text = pa.Array.from_buffers(text.type, len(text), [valid, offsets, pa.py_buffer(bytes(data or b"").translate(TO_BLANKS))], offset=text.offset)
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(ends):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + COUNT_BYTES, "right")))
            some, own, start = text.slice(start, stop - start), batch.column("id").slice(start, stop - start), stop
            words = pc.split_pattern(some, " ")
            row, token = pc.list_parent_indices(words).to_numpy(), pc.list_flatten(words)
            if pc.any(pc.match_substring_regex(some, r"[\x00-\x1f]")).as_py():
                token = pc.utf8_trim(token, edge)
            there = pc.not_equal(pc.binary_length(token), 0)
            row, found = row[there.to_numpy(zero_copy_only=False)], token.filter(there).dictionary_encode()
            if not len(row):
                continue
            pairs = found.indices.to_numpy().astype(np.int64) * len(some) + row
            pairs.sort()
            at = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            pairs, times = pairs[at], np.diff(at, append=len(pairs))
            begins = np.searchsorted(pairs, np.arange(len(found.dictionary) + 1, dtype=np.int64) * len(some))
            yield found.dictionary, begins, own.take(pa.array(pairs % len(some))), times


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tokens, begins, ids, times in _tallies(batches):
        of = pa.array(np.repeat(np.arange(len(tokens)), np.diff(begins)))
        yield from pa.table({"token": tokens.take(of), "id": ids, "times": times}).to_batches(max_chunksize=1 << 16)


def _in_lists(tokens: pa.Array, begins: np.ndarray, ids: pa.Array, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    lists = [pa.ListArray.from_arrays(pa.array(begins, pa.int32()), x) for x in (ids, pa.array(times, pa.int64()))]
    sums = np.add.reduceat(times, begins[:-1])
    names = {"token": tokens, "first": ids.take(pa.array(begins[:-1])), "documents": np.diff(begins), "total": sums, "ids": lists[0], "times": lists[1]}
    yield from pa.table(names).to_batches(max_chunksize=1 << 14)


def _count_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tally in _tallies(batches):
        yield from _in_lists(*tally)


def pack(sorted_counts: DataFrame) -> DataFrame:
    """Rows of :func:`by_token` in lists, a batch's rows of a token in one."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = _starts(batch.column("token"))
                yield from _in_lists(batch.column("token").take(pa.array(at)), np.append(at, batch.num_rows), batch.column("id"), batch.column("times").to_numpy())

    return sorted_counts.mapInArrow(lists, PACKED.format(kind=sorted_counts.schema["id"].dataType.simpleString()))


def ids_repeat(docs: DataFrame, id_col: str) -> bool:
    """Whether an id stands in several rows; only ids are read."""
    return not docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").limit(1).isEmpty()


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``token``, ``id``, ``times``, one row for each token of an id; shuffled only if ids repeat."""
    own = counted(docs, id_col, text_col)
    return own.groupBy("token", "id").agg(F.sum("times").alias("times")) if ids_repeat(docs, id_col) else own


def by_token(counts: DataFrame) -> DataFrame:
    """Rows (``token``, ``id``, ``times``) in ranges of token and id, so that a token of all documents is many tasks' work, sorted, and one for each pair."""
    dealt = counts.select("token", "id", "times").repartitionByRange("token", "id").sortWithinPartitions("token", "id")
    return dealt.mapInArrow(_add_up, dealt.schema)


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it; nulls are equal."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        a, b = c[1:], c[:-1]
        differs = pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, those of a pair added up; the last pair waits for the next batch."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.concat_batches([last, batch])
        at = _starts(batch.column("token"), batch.column("id"))
        if len(at) < batch.num_rows:
            times = np.add.reduceat(batch.column("times").to_numpy(), at)
            own = batch.take(pa.array(at))
            batch = pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(times)], schema=batch.schema)
        last = batch.slice(batch.num_rows - 1).take(pa.array([0]))  # a copy: a slice would hold the batch
        yield batch.slice(0, batch.num_rows - 1)
    if last is not None:
        yield last


def token_search(docs: DataFrame, id_col: str, text_col: str, token: str, occurrences: bool = False) -> DataFrame:
    """Documents that hold a token, each once or once for each time; no shuffle, no index needed."""
    wanted = F.lit(token.lower())
    tokens = document_tokens(F.col(text_col))
    hits = docs.select(F.col(id_col).alias("id"), tokens.alias("t")).where(F.array_contains("t", wanted))
    if occurrences:
        return hits.select("id", F.explode(F.filter("t", lambda t: t == wanted)).alias("token")).select("id")
    return hits.select("id")


def token_search_all(docs: DataFrame, id_col: str, text_col: str, tokens: Sequence[str]) -> DataFrame:
    """Documents that hold all tokens; none for an empty list."""
    return _search(docs, id_col, text_col, tokens, every=True)


def token_search_any(docs: DataFrame, id_col: str, text_col: str, tokens: Sequence[str]) -> DataFrame:
    """Documents that hold one of the tokens at least."""
    return _search(docs, id_col, text_col, tokens, every=False)


def _search(docs: DataFrame, id_col: str, text_col: str, tokens: Sequence[str], every: bool) -> DataFrame:
    wanted = F.array(*[F.lit(t.lower()) for t in dict.fromkeys(tokens)]).cast("array<string>")
    own = docs.select(F.col(id_col).alias("id"), document_tokens(F.col(text_col)).alias("t"))
    if not tokens:
        return own.where(F.lit(False)).select("id")
    if every:
        return own.where(F.size(F.array_except(wanted, F.col("t"))) == 0).select("id")
    return own.where(F.arrays_overlap(wanted, F.col("t"))).select("id")


def token_count(docs: DataFrame, text_col: str) -> DataFrame:
    """The number of distinct tokens."""
    return docs.select(F.explode(F.array_distinct(document_tokens(F.col(text_col)))).alias("token")).agg(F.countDistinct("token").alias("n"))


def column_postings(df: DataFrame, column: str, partition: str, row: str) -> DataFrame:
    """``token``, ``partition_id``, ``row_index``: where a column's tokens stand."""
    tokens = F.explode(column_tokens(column, F.col(column)))
    return df.select(tokens.alias("token"), F.col(partition).alias("partition_id"), F.col(row).alias("row_index"))


def _of_value(posted: DataFrame, column: str, value: str) -> DataFrame:
    """The postings of any token of ``value``."""
    wanted = column_tokens(column, F.lit(value))
    return posted.where(F.array_contains(wanted, F.col("token")))


def partitions_containing(posted: DataFrame, column: str, value: str) -> DataFrame:
    """Partitions that hold any token of a value."""
    return _of_value(posted, column, value).select("partition_id").distinct()


def row_locations(posted: DataFrame, column: str, value: str) -> DataFrame:
    """Rows that hold a token of a value, once for each token."""
    return _of_value(posted, column, value).select("partition_id", "row_index")


def is_indexed(posted: DataFrame, column: str) -> bool:
    """Whether postings hold tokens of a column."""
    return not posted.where(F.startswith("token", F.lit(f"{column.lower()}:"))).limit(1).isEmpty()


# Bitmaps: a table of (doc_id, value).


def bitmaps(pairs: DataFrame, id_col: str = "doc_id", value_col: str = "value") -> DataFrame:
    """``value``, ``bucket``, ``bitmap``: one bitmap for each value and 32,768 ids."""
    return bits.bitmaps(pairs.select(bitmap_value(F.col(value_col)).alias("value"), F.col(id_col).cast("long").alias("id")), ["value"], F.col("id"), "bucket")


def _normal(values: Sequence[str]) -> list[str]:
    edge = "".join(map(chr, range(33)))
    return list(dict.fromkeys((v or "").strip(edge).lower() for v in values))


def bitmap_all(index: DataFrame, values: Sequence[str]) -> DataFrame:
    """``bucket``, ``bitmap`` of the ids that have all values; none for an empty list."""
    wanted = _normal(values)
    return (
        index.where(F.col("value").isin(wanted) if wanted else F.lit(False))
        .groupBy("bucket")
        .agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("k"))
        .where(F.col("k") == len(wanted))  # a value without a bitmap there empties the bucket
        .select("bucket", "bitmap")
    )


def bitmap_any(index: DataFrame, values: Sequence[str]) -> DataFrame:
    """``bucket``, ``bitmap`` of the ids that have one of the values at least."""
    wanted = _normal(values)
    hits = index.where(F.col("value").isin(wanted) if wanted else F.lit(False))
    return hits.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def expand(bitmaps: DataFrame) -> DataFrame:
    """``doc_id`` of the bits that are set, from (bucket, bitmap): 64 bits are read as one number, and numbers without a bit are left out."""
    digits = F.hex("bitmap")
    word = F.col("word")
    longs = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.conv(F.substring(digits, i * 16 + 1, F.lit(16)), 16, -10).cast("long"))
    words = bitmaps.select("bucket", F.posexplode(longs).alias("at", "word")).where(word != 0)
    # the first byte of eight is a number's highest one
    ones = words.select("bucket", "at", word, F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).where(
        F.getbit(word, ((F.lit(7) - F.shiftright("bit", 3)) * 8 + F.col("bit").bitwiseAND(F.lit(7))).cast("int")) == 1
    )
    return ones.select(((F.col("bucket") - 1) * 32768 + F.col("at") * 64 + F.col("bit")).alias("doc_id"))


def bitmap_search(pairs: DataFrame, values: Sequence[str], every: bool = False, id_col: str = "doc_id", value_col: str = "value") -> DataFrame:
    """Ids of (id, value) rows that have any of the values, or all of them; none for an empty list.  Only the values' own bitmaps are made."""
    wanted = _normal(values)
    hits = pairs.where(bitmap_value(F.col(value_col)).isin(wanted)) if wanted else pairs.where(F.lit(False))
    index = bitmaps(hits, id_col, value_col)
    return expand(bitmap_all(index, values) if every else bitmap_any(index, values))


def bitmap_cardinality(pairs: DataFrame, id_col: str = "doc_id", value_col: str = "value") -> DataFrame:
    """``value`` and the number of ids that have it."""
    return bitmaps(pairs, id_col, value_col).groupBy("value").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))
