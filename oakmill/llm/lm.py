"""Language-model score: marginal probability of a text over all its subword segmentations.

Model: a unigram model over the pieces of an existing vocabulary.  A text is
its words, each after a word mark, then one end.  A word's lattice has an edge
for every piece that stands in it (bytes are pieces too, so there is always a
way through), weighted by the piece's score as a last or as an earlier piece of
a word.  The forward recursion in log space sums all segmentations.  Pieces don't cross words,
so the sum for a text is the product over its words.

Scores are the vocabulary's own (it gives ranks of merges, and rank r weighs 1 / (r + 1)).  What is learned
from the training documents, by options: ``iterations`` of expectation
maximisation refit the scores over the same lattices, each distinct word counting once; with ``known_words`` a word that
training documents hold is one more edge over its whole length, weighted by
its count (Witten and Bell's share of known words); with ``part_col`` each part of the corpus (such
as the language) has scores and counts of its own, and the text's probability is the sum over parts:
the part of the text itself is not looked at.  Every part counts; cost grows with their number.

Layout: documents are read once into blocks of about ``BLOCK_BYTES`` of text,
which hold each document's distinct words and counts with local numbers.  A block is written as many small rows,
so that neither its writer nor a reader, which take rows by number, hold more of a file than a few blocks; and words are
spelled by as many as ``BATCH_WORDS``, ``BATCH_PLACES`` and ``Lattice.BYTES`` allow.  Only
(block, distinct word) is shuffled, by word and by a share of the blocks, so that no task holds a common word's
places in more than ``SHARE_BLOCKS`` blocks or so.  Each distinct word is spelled once a share, whatever its count, and
its count and probabilities go back, packed, to the blocks that hold it.  All words and
documents are used; what the executors exchange grows with the corpus, what the
driver gets is a number for each piece and part.

Defined results: null text is empty and has the end alone; a null id counts as
empty text for the split; rows that repeat an id are documents of their own; a null
part is a part; with no training documents the vocabulary's own scores hold; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, documents, gathered, small_batches, tidy, trim

VOCABULARY = "piece_bpe_32k.model"
ITERATIONS = 3
BLOCK_BYTES = 8_000_000
#: Words and bytes of documents' pairs in a row of a block, and rows that are handed over together.
ROW_WORDS, ROW_BYTES, ROWS = 32, 1 << 20, 256
SMOOTHING = 0.02
#: Blocks whose places of a word meet in one task.
SHARE_BLOCKS = 4096
#: Words that are spelled together, and their places.
BATCH_WORDS, BATCH_PLACES = 8192, 1 << 18
FOLDS, HELD_OUT = 5, 1
MARK = b" "

_upper = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    """A text's words, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_upper).split() if text else []


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, and their weights by the file's scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rank: dict[bytes, float] = {}
    n = model.get_piece_size()
    for i in range(n):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:]:
            rank[piece] = -model.get_score(i)
    for b in range(256):  # bytes come after all other pieces
        rank.setdefault(bytes([b]), float(n))
    pieces = sorted(rank)
    return pieces, np.array([1 / (rank[p] + 1) for p in pieces])


def scores(weights: np.ndarray, pieces: list[bytes]) -> np.ndarray:
    """Log probabilities from weights of (piece, last in its word or not): of a word's first piece, and of the others."""
    first = np.array([p[:1] == MARK for p in pieces])
    out = np.empty(weights.shape)
    for own in (first, ~first):
        out[own] = np.log(weights[own] / weights[own].sum())
    return out


class Lattice:
    """Sums over segmentations, for many words at once.

    Pieces are the paths of a trie.  All positions of all words walk it together;
    where a piece ends there is an edge.  Edges are taken in the order of where they end in their
    word, so each step of the recursion is one step of all words.  Scores are
    (2 * pieces, parts): that of piece k as the last of its word at 2 k + 1, and else at 2 k.
    """

    WORDS, BYTES = 2048, 1 << 16

    def __init__(self, pieces: list[bytes]) -> None:
        number: dict[bytes, int] = {b"": 0}
        for p in pieces:
            for i in range(1, len(p) + 1):
                number.setdefault(p[:i], len(number))
        self.next = np.zeros((len(number), 256), np.uint16 if len(number) < 1 << 16 else np.int32)
        for p, n in number.items():
            if p:
                self.next[number[p[:-1]], p[-1]] = n
        self.piece = np.full(len(number), -1, np.int32)
        self.piece[[number[p] for p in pieces]] = np.arange(len(pieces))

    def edges(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Start, end, score's place of all edges, where in its word each ends, and each word's last node."""
        marked = [MARK + w for w in words]
        sizes = np.array([len(w) for w in marked])
        text = np.frombuffer(b"".join(marked), np.uint8)
        word = np.repeat(np.arange(len(sizes)), sizes)
        stop = np.cumsum(sizes)
        first = stop - sizes
        at = np.arange(len(text))
        state = np.zeros(len(text), self.next.dtype)
        found: list[tuple[np.ndarray, ...]] = []
        length = 0
        while len(at):
            state = self.next[state, text[at + length]]
            length += 1
            k = self.piece[state]
            hit = np.flatnonzero((k >= 0) & (state > 0))
            i, w = at[hit], word[hit]
            found.append((i + w, i + w + length, 2 * k[hit] + (i + length == stop[w]), i + length - first[w]))
            go = (state > 0) & (at + length < stop[word])
            at, state, word = at[go], state[go], word[go]
        start, end, place, depth = (np.concatenate([f[x] for f in found]) for x in range(4))
        order = np.lexsort((end, depth))
        return start[order], end[order], place[order], depth[order], stop + np.arange(len(sizes))

    def forward(self, words: list[bytes], scores: np.ndarray, shares: bool = False) -> tuple:
        """Log of each word's probability by part; with ``shares`` also what the backward steps need."""
        start, end, place, depth, last = self.edges(words)
        alpha = np.zeros((int(last[-1]) + 1, scores.shape[1]))
        cuts = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1], True])
        share = np.empty((len(start), scores.shape[1])) if shares else None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            ways = alpha[start[a:b]] + scores[place[a:b]]
            node = end[a:b]
            new = np.r_[True, node[1:] != node[:-1]]
            seg, of = np.flatnonzero(new), np.cumsum(new) - 1
            top = np.maximum.reduceat(ways, seg)
            np.exp(ways - top[of], out=ways)
            total = np.add.reduceat(ways, seg)
            alpha[node[seg]] = top + np.log(total)
            if shares:
                share[a:b] = ways / total[of]
        return (alpha[last], start, end, place, share, cuts, last) if shares else (alpha[last],)

    def spans(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """From where to where words go together: ``WORDS`` of them and ``BYTES`` at most, or one word."""
        i, size = 0, 0
        for j, w in enumerate(words):
            if j > i and (j - i == self.WORDS or size + len(w) > self.BYTES):
                yield i, j
                i, size = j, 0
            size += len(w)
        if words:
            yield i, len(words)

    def log_probability(self, words: list[bytes], scores: np.ndarray) -> np.ndarray:
        """(words, parts)."""
        own = [self.forward(words[i:j], scores)[0] for i, j in self.spans(words)]
        return np.concatenate(own) if own else np.empty((0, scores.shape[1]))

    def expect(self, words: list[bytes], counts: np.ndarray, scores: np.ndarray, total: np.ndarray) -> None:
        """Add to ``total`` (like ``scores``) the expected uses of each score in ``counts`` (words, parts) of the words."""
        for i, j in self.spans(words):
            _, start, end, place, share, cuts, last = self.forward(words[i:j], scores, shares=True)
            through = np.zeros((int(last[-1]) + 1, scores.shape[1]))
            through[last] = counts[i:j]
            for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
                share[a:b] *= through[end[a:b]]
                through[start[a:b]] += share[a:b]  # a word's edges to one place start at different ones
            for k in range(scores.shape[1]):
                total[:, k] += np.bincount(place, share[:, k], len(total))


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    """This worker's lattice of a vocabulary."""
    return Lattice(vocabulary(path)[0])


#: A row of documents, of which the last one of a block has ``ends``, or one of words, whose numbers go from ``first`` on.
_BLOCK = (
    "block long, doc_ids array<long>, held array<boolean>, tokens array<long>, lengths array<int>, "
    "pairs binary, ends array<long>, first int, words array<binary>, train array<array<int>>"
)
_BLOCK_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]
_BLOCK_TYPES = [
    pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int32()),
    pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.list_(pa.int32())),
]


def _lists(values: pa.Array, size: int) -> pa.Array:
    """``values`` as lists of ``size``; the last one may have less."""
    return pa.ListArray.from_arrays(np.r_[np.arange(0, len(values), size), len(values)].astype(np.int32), values)


class Block:
    """Documents being gathered, and their distinct words' numbers and training counts by part."""

    def __init__(self, no: int, parts: int) -> None:
        self.no, self.size = no, 0
        self.number: defaultdict = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids, self.held, self.tokens, self.lengths, self.pairs = [], [], [], [], []
        self.counts, self.ends = np.zeros((1024, parts), np.int32), [0] * parts

    def add(self, doc: int | None, text: str | None, part: int) -> None:
        words, out = words_of(text), is_held_out(doc)
        local = np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words))
        local, n = np.unique(local, return_counts=True)
        if len(self.number) > len(self.counts):
            more = np.zeros((max(len(self.counts), len(self.number) - len(self.counts)), len(self.ends)), np.int32)
            self.counts = np.concatenate([self.counts, more])
        if not out:
            self.counts[local, part] += n.astype(np.int32)
            self.ends[part] += 1
        self.ids.append(doc)
        self.held.append(out)
        self.tokens.append(len(words) + 1)
        self.lengths.append(len(local))
        self.pairs.append(np.concatenate([local, n.astype(np.uint32)]).tobytes())
        self.size += len(text or "")

    def batch(self, n: int, **columns: object) -> pa.RecordBatch:
        """``n`` rows of the block; columns that aren't given are null."""
        columns["block"] = pa.array([self.no] * n)
        return pa.RecordBatch.from_arrays(
            [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns.get(c, [None] * n), t) for c, t in zip(_BLOCK_NAMES, _BLOCK_TYPES, strict=True)],
            names=_BLOCK_NAMES,
        )

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The block's documents, up to ``ROW_BYTES`` of their pairs a row, and its words, ``ROW_WORDS`` a row."""
        size = np.cumsum([0, *map(len, self.pairs)])
        a = 0
        while a < len(self.ids):
            b = max(a + 1, int(np.searchsorted(size, size[a] + ROW_BYTES, "right")) - 1)
            yield self.batch(
                1, doc_ids=[self.ids[a:b]], held=[self.held[a:b]], tokens=[self.tokens[a:b]], lengths=[self.lengths[a:b]],
                pairs=[b"".join(self.pairs[a:b])], ends=[self.ends if b == len(self.ids) else None],
            )
            a = b
        self.pairs.clear()
        words, most = iter(self.number), ROW_WORDS * ROWS
        for a in range(0, len(self.number), most):
            own = _lists(pa.array(islice(words, most), pa.binary()), ROW_WORDS)
            counts = pa.array(self.counts[a : min(a + most, len(self.number))].reshape(-1))
            first = np.arange(a, min(a + most, len(self.number)), ROW_WORDS, dtype=np.int32)
            yield self.batch(len(own), first=pa.array(first), words=own, train=_lists(_lists(counts, len(self.ends)), ROW_WORDS))


def blocks_of(docs: DataFrame, parts: dict[str | None, int]) -> DataFrame:
    """``docs`` (doc_id, text, part) as blocks."""
    most = max(1, len(parts))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        block = Block(at, most)
        for b in batches:
            for doc, text, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block.add(doc, text, parts[part])
                if block.size >= BLOCK_BYTES:
                    yield from block.rows()
                    at += 1
                    block = Block(at, most)
                    tidy()  # else what small objects leave behind grows with each block
        if block.ids:
            yield from block.rows()
        del block
        tidy()

    return docs.mapInArrow(gather, _BLOCK)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by word (word, train, place) to one row a word (word, counts, places)."""

    def runs(word: pa.Array, train: np.ndarray, place: pa.Array) -> pa.RecordBatch:
        new = np.ones(len(word), bool)
        if len(word) > 1:
            new[1:] = pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(new)
        counts = np.add.reduceat(train, at)
        parts = counts.shape[1]
        return pa.RecordBatch.from_arrays(
            [
                word.take(pa.array(at)),
                pa.ListArray.from_arrays(np.arange(0, counts.size + 1, parts, dtype=np.int32), pa.array(counts.reshape(-1))),
                pa.ListArray.from_arrays(np.r_[at, len(place)].astype(np.int32), place),
            ],
            names=["word", "c", "places"],
        )

    rest: list[tuple] = []  # of one word, which may go on in the next batch
    for b in batches:
        if not b.num_rows:
            continue
        word, place = b.column(0), b.column(2)
        train = b.column(1).flatten().to_numpy().astype(np.int64).reshape(len(word), -1)
        same = pc.equal(word, word[-1]).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(same))  # sorted, so all from the first equal one on
        if rest and (cut or rest[0][0][0] != word[-1]):
            rest.append((word[:cut], train[:cut], place[:cut]))
            yield runs(pa.concat_arrays([r[0] for r in rest]), np.concatenate([r[1] for r in rest]), pa.concat_arrays([r[2] for r in rest]))
            rest = []
        elif cut:
            yield runs(word[:cut], train[:cut], place[:cut])
        rest.append((word[cut:], train[cut:], place[cut:]))
    if rest:
        yield runs(pa.concat_arrays([r[0] for r in rest]), np.concatenate([r[1] for r in rest]), pa.concat_arrays([r[2] for r in rest]))
    tidy()


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles as a 32-bit float and what is left, times 65,536, as a 16-bit one: ten digits in six bytes."""
    high = x.astype(np.float32)
    return high, ((x - high) * 65536).astype(np.float16)


def joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The doubles of :func:`halves`."""
    return high.astype(np.float64) + low.astype(np.float64) / 65536


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Words (with their places) that are spelled together: ``BATCH_WORDS`` or a batch more, ``BATCH_PLACES`` at most, or one word."""

    def cut() -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b["places"].offsets.to_numpy() if b.num_rows else [0]
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + BATCH_PLACES, "right")) - 1)
                yield b.slice(i, j - i)
                i = j

    held: list[pa.RecordBatch] = []
    rows = many = 0
    for b in cut():
        n = len(b["places"].flatten())
        if held and (rows >= BATCH_WORDS or many + n > BATCH_PLACES):
            yield pa.Table.from_batches(held)
            held, rows, many = [], 0, 0
        held.append(b)
        rows, many = rows + b.num_rows, many + n
    if held:
        yield pa.Table.from_batches(held)


def places(scored: np.ndarray) -> np.ndarray:
    """Scores (part, piece, last or not) as a lattice takes them: (2 * pieces, parts)."""
    return np.ascontiguousarray(scored.reshape(len(scored), -1).T)


def fit(words: DataFrame, parts: int, path: str, iterations: int = ITERATIONS) -> np.ndarray:
    """Scores (part, piece, last or not) refitted to ``words`` (word, c by part), one row a word."""
    pieces, weights = vocabulary(path)
    now = np.stack([scores(np.repeat(weights[:, None], 2, 1), pieces)] * parts)
    spark = words.sparkSession
    known = words.where(F.exists("c", lambda c: c > 0)).select("word", "c")
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(now)

        def expected(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            scored = places(shared.value)
            total = np.zeros(scored.shape)
            for t in gathered(batches, BATCH_WORDS):
                t = t.combine_chunks()
                word, c = t["word"].combine_chunks(), t["c"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
                for k in range(c.shape[1]):  # few words are of several parts
                    own = word.filter(pa.array(c[:, k] > 0)).to_pylist()
                    lattice(path).expect(own, np.ones((len(own), 1)), scored[:, k : k + 1], total[:, k : k + 1])
            got = total.T.reshape(-1)
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(got[at])], names=["at", "n"])
            tidy()

        rows = known.mapInArrow(expected, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
        if not rows:
            break
        n = np.full(now.size, SMOOTHING)
        for r in rows:
            n[r["at"]] += r["n"]
        now = np.stack([scores(m, pieces) for m in n.reshape(now.shape)])
    return now


def score(
    docs: DataFrame, vocabulary_file: str = VOCABULARY, iterations: int = 0, known_words: bool = False,
    id_col: str = "doc_id", text_col: str = "text", part_col: str | None = None,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    spark = docs.sparkSession
    path = public_tokenizers.path(vocabulary_file)
    small_batches(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
        (F.col(part_col) if part_col else F.lit(None)).cast("string").alias("part"),
    )
    numbers = {r["part"]: k for k, r in enumerate(rows.select("part").distinct().orderBy("part").collect())}
    parts = max(1, len(numbers))
    blocks = cut_lineage(blocks_of(rows, numbers), "blocks")
    shares = -(-blocks.where("ends is not null").count() // SHARE_BLOCKS)
    words = cut_lineage(
        blocks.select("block", "first", F.posexplode(F.arrays_zip("words", "train")))
        .select("col.words", "col.train", F.struct("block", (F.col("first") + F.col("pos")).alias("local")).alias("place"))
        .toDF("word", "train", "place")
        .repartition("word", F.pmod(F.xxhash64("place.block"), F.lit(max(1, shares))))
        .sortWithinPartitions("word")
        .mapInArrow(_distinct, "word binary, c array<long>, places array<struct<block:long,local:int>>"),
        "words",
    )
    if shares > 1:  # a word's counts are in several rows: a row a share
        sums = words.groupBy("word").agg(F.array(*[F.sum(F.col("c")[k]) for k in range(parts)]).alias("c"))
        whole_words = cut_lineage(sums, "counts")
        words = words.select("word", "places").join(whole_words, "word").select("word", "c", "places")
    else:
        whole_words = words.select("word", "c")
    facts = blocks.agg(*[F.sum(F.col("ends")[k]) for k in range(parts)]).first()
    ends = np.array([int(x or 0) for x in facts[:parts]], np.float64)
    facts = whole_words.agg(
        *[F.sum(F.col("c")[k]) for k in range(parts)],
        *[F.count_if(F.col("c")[k] > 0) for k in range(parts)],
        F.count_if(F.exists("c", lambda c: c > 0)),
    ).first()
    size, kinds = (np.array([float(x or 0) for x in facts[a : a + parts]]) for a in (0, parts))
    n_ends = int(ends.sum())
    total, distinct = int(size.sum()) + n_ends, int(facts[-1]) + (n_ends > 0)
    shared = spark.sparkContext.broadcast(fit(whole_words, parts, path, iterations))
    # of each part: a document's chance to be of it, a token's to be the end, a word's to be a known one
    prior = np.log((ends + 1) / (ends + 1).sum())
    stop = (ends + 0.5) / (size + ends + 1)
    known = size / np.maximum(1, size + kinds) if known_words else np.zeros(parts)
    unseen = np.log((1 - stop) * (1 - known))
    whole = (1 - stop) * known / np.maximum(1, size)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each block needs of a batch of words, packed: local numbers, counts, log probabilities by part."""
        scored = places(shared.value)
        for t in batches_of(batches):
            t = t.combine_chunks()
            spelled = lattice(path).log_probability(t["word"].to_pylist(), scored)
            c = t["c"].combine_chunks().flatten().to_numpy().reshape(-1, parts)
            with np.errstate(divide="ignore"):
                high, low = halves(np.logaddexp(unseen + spelled, np.log(whole * c)))
            lists = t["places"].combine_chunks()
            block, local = (x.to_numpy() for x in lists.flatten().flatten())
            word = np.repeat(np.arange(len(t)), np.diff(lists.offsets.to_numpy()))
            order = np.argsort(block, kind="stable")
            block, local, word = block[order], local[order], word[order]
            at = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)]
            values = (local, c.sum(1)[word], high[word], low[word])
            packed = [pa.array([v[x:y].tobytes() for x, y in pairwise(at)], pa.binary()) for v in values]
            yield pa.RecordBatch.from_arrays([pa.array(block[at[:-1]]), *packed], names=["block", "local", "c", "high", "low"])
        tidy()

    values = words.mapInArrow(spell, "block long, local binary, c binary, high binary, low binary")
    below = math.log10(total + 0.5 * (distinct + 1))
    end_base = math.log10(n_ends + 0.5) - below
    start = prior + np.log(stop)

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        local, counts, high, low = (
            np.frombuffer(b"".join(right[k].to_pylist()), kind) for k, kind in (("local", np.int32), ("c", np.int64), ("high", np.float32), ("low", np.float16))
        )
        c, log_p = np.zeros(len(local), np.int64), np.zeros((len(local), parts))
        c[local], log_p[local] = counts, joined(high, low).reshape(-1, parts)
        base = np.log10(c + 0.5) - below
        out: dict[str, list] = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        for row in left.to_pylist():
            data, at = np.frombuffer(row["pairs"], np.uint32), 0
            out["doc_id"] += row["doc_ids"]
            out["held_out"] += row["held"]
            out["n_tokens"] += row["tokens"]
            for n in row["lengths"]:
                word, times = data[at : at + n], data[at + n : at + 2 * n].astype(np.float64)
                at += 2 * n
                out["n_known"].append(int(times[c[word] > 0].sum()) + (n_ends > 0))
                out["base_score"].append(float(times @ base[word]) + end_base)
                by_part = times @ log_p[word] + start
                out["score"].append(float(np.logaddexp.reduce(by_part)) / math.log(10))
        trim()
        return pa.table({
            "doc_id": pa.array(out["doc_id"], pa.int64()),
            "held_out": pa.array(out["held_out"], pa.bool_()),
            "n_tokens": pa.array(out["n_tokens"], pa.int64()),
            "n_known": pa.array(out["n_known"], pa.int64()),
            "train_tokens": pa.array([total] * len(out["doc_id"]), pa.int64()),
            "base_score": pa.array(out["base_score"], pa.float64()),
            "score": pa.array(out["score"], pa.float64()),
        })

    return (
        blocks.where("doc_ids is not null")
        .select("block", "doc_ids", "held", "tokens", "lengths", "pairs")
        .groupBy("block")
        .cogroup(values.groupBy("block"))
        .applyInArrow(
            add_up,
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )


def op9_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), iterations=ITERATIONS, known_words=True, part_col="lang")
