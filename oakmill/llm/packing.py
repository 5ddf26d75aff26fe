"""Packing documents into training sequences by first-fit decreasing.

A document is its byte-level BPE ids, then the end id.  It is cut every
``LENGTH`` ids, so all its pieces but the last fill a sequence.  Documents are
dealt into randomised groups of ``GROUP_ROWS`` on average by a hash of the id and the
document's checksum; each group is packed on its own: pieces in decreasing length, each into the
first sequence with room, which a tournament tree over the sequences' free
capacities finds in a logarithmic number of steps.  Only lengths and checksums
are shuffled, never texts or ids; ``sequences`` gives the packed ids.

Tokens: a text is split where a single space stands between two characters that
are no white space; no pre-token of this vocabulary spans such a place, so each distinct part
of some ``SLICE_BYTES`` of text is encoded once, all of them in one call, and
the ids are laid out by array operations.  Texts with other white space around a space, or with
the string of an added token (which is that token's id), are encoded as they are.

Defined results: null text is empty and has the end id alone; rows that repeat an id
are documents of their own; an empty table gives no rows; other columns are ignored.
Rows that repeat both id and text are told apart by their number in a partition, so that
they don't meet in one group.  A group's size follows from
the number of rows, and a document of any length adds one short piece to it.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, parts_for, small_batches, tidy

VOCABULARY = "byte_bpe_50k.json"
LENGTH = 2048
END = 1
GROUP_ROWS = 2048
SEED = 5
#: Text whose distinct parts are encoded together; bounds a worker's memory.
SLICE_BYTES = 4_000_000

#: The vocabulary's split into pre-tokens (fixed value of the byte-level format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_white = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
_uneven = f"^ | $|{_white} | {_white}"
#: Runs of white space (Unicode's property) that the pattern's engine would need too much stack for.
_long_run = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Texts to ids by a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        held = Tokenizer.from_file(path)
        self._added = {t.content: i for i, t in held.get_added_tokens_decoder().items()}
        of = byte_alphabet()
        ranks = {bytes(map(of.__getitem__, t)): i for t, i in held.get_vocab().items() if t not in self._added}
        self._bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self._bytes[list(ranks.values())] = [len(t) for t in ranks]
        longest = sorted(self._added, key=len, reverse=True)
        self._split = re.compile("|".join(map(re.escape, longest)) or r"(?!)")

    def __call__(self, text: str) -> np.ndarray:
        """Ids of one text."""
        out: list[np.ndarray] = []
        at = 0
        for m in self._split.finditer(text):
            out += [*self._plain(text[at : m.start()]), np.array([self._added[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*out, *self._plain(text[at:]), np.empty(0, np.uint32)])

    def _plain(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text without added tokens, by pieces: a very long run of white space, but for its last character, is one pre-token."""
        at = 0
        for m in _long_run.finditer(text):
            yield self._bpe.encode_to_numpy(text[at : m.start()], disallowed_special=())
            at = m.end() if m.end() == len(text) else m.end() - 1
            yield np.array(self._bpe._encode_single_piece(text[m.start() : at]), np.uint32)
        yield self._bpe.encode_to_numpy(text[at:], disallowed_special=())

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each of ``texts`` (strings without null)."""
        odd = pc.or_(pc.match_substring_regex(texts, _uneven), pc.equal(pc.binary_length(texts), 0))
        for t in self._added:
            odd = pc.or_(odd, pc.match_substring(texts, t))
        odd = odd.to_numpy(zero_copy_only=False)
        even = texts.filter(pa.array(~odd))
        done = iter(self._even(even) if len(even) else [])
        return [self(texts[i].as_py()) if x else next(done) for i, x in enumerate(odd.tolist())]

    def _even(self, texts: pa.Array) -> list[np.ndarray]:
        split = pc.split_pattern(texts, " ")
        starts, words = split.offsets.to_numpy(), split.flatten()
        starts = starts - starts[0]
        coded = words.dictionary_encode()
        part, distinct = coded.indices.to_numpy().copy(), coded.dictionary
        # all distinct parts in one call, each after its space; where one ends shows from the lengths of tokens
        whole = pa.ListArray.from_arrays(np.array([0, len(distinct)], np.int32), distinct)
        ids = self._bpe.encode_to_numpy(" " + pc.binary_join(whole, " ")[0].as_py(), disallowed_special=())
        stops = np.cumsum(pc.binary_length(distinct).to_numpy() + 1)
        ends = np.searchsorted(np.cumsum(self._bytes[ids]), stops) + 1
        # a text's first part has no space before it
        firsts = [self._bpe.encode_ordinary(w) for w in words.take(pa.array(starts[:-1])).to_pylist()]
        part[starts[:-1]] = len(distinct) + np.arange(len(firsts))
        size = np.r_[np.diff(ends, prepend=0), [len(f) for f in firsts]].astype(np.int32)
        ids = np.concatenate([ids, np.array([i for f in firsts for i in f], np.uint32)])
        n = size[part]
        before = np.cumsum(n) - n
        shift = (np.cumsum(size) - size)[part] - before
        flat = ids[np.repeat(shift.astype(np.int32), n) + np.arange(int(n.sum()), dtype=np.int32)]
        cuts = [*before[starts[:-1]].tolist(), len(flat)]
        return [flat[a:b] for a, b in pairwise(cuts)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """First and next row of slices of ``texts`` with some ``most`` bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


_PIECES = "doc_id long, start long, length long, {ids}, doc_tokens long, copy long"


def pieces(
    docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, end: int = END,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True,
) -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens for every piece of every document.

    Without ``with_ids`` ids_crc32, their checksum, stands for the ids.  ``copy`` is a hash of
    the document (id, checksum of all its ids, number among equal ones in a partition): its place in the random order.
    """
    small_batches(docs.sparkSession)
    schema = _PIECES.format(ids="ids binary" if with_ids else "ids_crc32 long")
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary() if with_ids else pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in schema.split(", ")]
    keep = (lambda x: x) if with_ids else zlib.crc32

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(public_tokenizers.path(vocabulary)), Counter()
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            for at, to in slices(texts):
                rows = []
                for doc, own in zip(b.column(0)[at:to].to_pylist(), encode.many(texts[at:to]), strict=True):
                    n, ids = len(own) + 1, memoryview(np.append(own, np.uint32(end)).astype("<u4")).cast("B")
                    key = xxhash.xxh64_intdigest(f"{doc} {n} {zlib.crc32(ids)}")
                    copy = xxhash.xxh64_intdigest(b"%d" % seen[key], key) - 2**63
                    seen[key] += 1
                    rows += [
                        (doc, i, min(length, n - i), keep(ids[4 * i : 4 * (i + length)]), n, copy) for i in range(0, n, length)
                    ]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)
        tidy()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, schema)


class Capacities:
    """A tournament tree: each node knows the largest free capacity below it."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> tuple[int, int]:
        """Take ``need`` from the first bin that has it: the bin and its free capacity before."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < need:
                at += 1
        free = most[at]
        bin_ = at - self.leaves
        most[at] = free - need
        while at > 1:
            at //= 2
            best = max(most[2 * at], most[2 * at + 1])
            if most[at] == best:
                break
            most[at] = best
        return bin_, free


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; ``lengths`` must be in decreasing order."""
    tree = Capacities(len(lengths), capacity)
    placed = [tree.place(n) for n in lengths]
    return [b for b, _ in placed], [capacity - free for _, free in placed]


def pack(parts: DataFrame, rows: int, length: int = LENGTH, group_rows: int = GROUP_ROWS, seed: int = SEED) -> DataFrame:
    """``parts`` (of :func:`pieces`) with sequence_id and offset.  ``rows``: documents, for the number of groups."""
    groups = parts_for(rows, group_rows)
    schema = parts.drop("copy").schema
    extra = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, sequence_id long, offset long"
    order = [("length", "descending"), *((c, "ascending") for c in ("__order", "doc_id", "start"))]

    def one(key: tuple, g: pa.Table) -> pa.Table:
        g = g.sort_by(order)
        bins, offsets = first_fit_decreasing(g["length"].to_pylist(), length)
        first = key[0].as_py() * 2**32
        return (
            g.drop_columns(["__group", "__order"])
            .append_column("sequence_id", pa.array([first + b for b in bins], pa.int64()))
            .append_column("offset", pa.array(offsets, pa.int64()))
        )

    return (
        parts.withColumn("__group", F.pmod(F.xxhash64(F.lit(seed), "copy"), F.lit(groups)))
        .withColumn("__order", F.xxhash64(F.lit(seed + 1), "copy"))
        .drop("copy")
        .groupBy("__group")
        .applyInArrow(one, extra)
    )


def sequences(packed: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """sequence_id, used and ids (binary, ``length`` unsigned 32-bit ids, padded unless filled to a power of two), from packed pieces with ids."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def row() -> pa.RecordBatch:
            data = b"".join(held)
            used = len(data) // 4
            data += b"" if used & (used - 1) == 0 else array("I", [pad]).tobytes() * (length - used)
            return pa.RecordBatch.from_pydict({"sequence_id": [now], "used": [used], "ids": [data]}, pa.schema([("sequence_id", pa.int64()), ("used", pa.int64()), ("ids", pa.binary())]))

        for b in batches:
            for no, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if no != now and held:
                    yield row()
                    held = []
                now = no
                held.append(ids)
        if held:
            yield row()

    return (
        packed.select("sequence_id", "offset", "ids")
        .repartition("sequence_id")
        .sortWithinPartitions("sequence_id", "offset")
        .select("sequence_id", "ids")
        .mapInArrow(join, "sequence_id long, used long, ids binary")
    )


def packed_documents(docs: DataFrame) -> DataFrame:
    """The digest of packing all ``docs``: each piece with its checksum and place."""
    return pack(pieces(docs, with_ids=False), docs.count())


def op2_tournament_ffd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))
