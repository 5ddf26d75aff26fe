"""SimHash near-dedup with bit-sliced comparison.

1. Fingerprints: 64-bit majority of the xxHash64 of a text's word shingles.
   Rows with equal fingerprints form a class; from here on each class is one row.
2. Candidates: a fingerprint has four 16-bit blocks.  Two that differ in ``RADIUS`` = 2
   bits or fewer agree on two blocks at least, so each class goes to six buckets,
   one for each pair of blocks (no pair of classes is lost).  A bucket of more
   than ``BUCKET_ROWS`` classes is dealt again by the four 8-bit blocks of
   its other 32 bits: two of those agree as well, and as 16 bits are left then,
   no bucket can exceed 65,536 classes.
3. Comparison: the buckets of a batch are stored as vertical bit planes, 64
   classes to a word.  Each class is compared with a word of its bucket at a
   time: planes are XORed in and counted by a carry-save adder that saturates
   over the radius.  A block (class, word) is abandoned once all its lanes exceed the radius.
4. Links inside a batch are merged by union-find, and only a forest of them
   leaves the task, so a group of near copies costs a row a member, not a row a pair.
   The forests are joined by :func:`common.components`.

Defined results: null text equals empty text, has the fingerprint zero, and links
like any other; a text with fewer words than a shingle is one shingle; equal ids are rows of
their own; a component's id is its smallest non-null ``doc_id``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARROW_ROWS, components, cut_lineage, documents, map_batches, named, numbered, small_batches, tidy

SHINGLE = 3
SEED = 42
RADIUS = 2
BUCKET_ROWS = 2048

_words = re.compile(rb"[^\x20\x09-\x0D]+")
_upper = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """xxHash64 of every shingle of a text's words, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(_upper).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    data = b" ".join(words)
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    return np.array([h(data[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :])], np.uint64)  # noqa: B905


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, n, 65_280):
        bits = np.unpackbits(hashes[i : i + 65_280].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            total += bits[k : k + 255].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_hash (of the whole text as it is)."""
    small_batches(docs.sparkSession)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(shingle_hashes(t, size)) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), b.column(2)], names=["doc_id", "fp", "text_hash"]
        )

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), text_hash(text_col))
    return map_batches(rows, f, "doc_id long, fp long, text_hash long")


PAIRS = list(itertools.combinations(range(4), 2))


def near_lanes(fps: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows ``i > j`` of the same bucket within the radius, a block of pairs at a time.

    ``fps`` (uint64, a row or a row of words for each fingerprint) lies bucket
    by bucket; ``starts`` has each bucket's first row, then the number of rows.
    """
    fps = fps.reshape(len(fps), -1)
    bits = 64 * fps.shape[1]
    sizes = np.diff(starts)
    per = (sizes + 63) // 64  # words of each bucket
    first = np.concatenate([[0], np.cumsum(per)])
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(fps)) - np.repeat(starts[:-1], sizes)
    slot = (first[bucket] + inside // 64) * 64 + inside % 64
    planes = np.zeros((bits, int(first[-1])), np.uint64)
    lanes = np.zeros(int(first[-1]) * 64, np.uint8)
    for b in range(bits):
        lanes[slot] = ((fps[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.uint8)
        planes[b] = np.packbits(lanes, bitorder="little").view(np.uint64)
    row_of = np.zeros(len(lanes), np.int64)
    row_of[slot] = np.arange(len(fps))
    none, one, full = np.uint64(0), np.uint64(1), ~np.uint64(0)

    def exceeds(over: np.ndarray, counters: list[np.ndarray]) -> np.ndarray:
        """Lanes whose count is over the radius, from the carry-out and the counters' planes."""
        same = np.full_like(over, full)
        for b in reversed(range(len(counters))):
            if radius >> b & 1:
                same &= counters[b]
            else:
                over = over | (same & counters[b])
                same &= ~counters[b]
        return over

    blocks = inside // 64 + 1  # a row meets the words up to its own
    ends = np.cumsum(blocks)
    step = 1 << 17
    at = 0
    while at < len(fps):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step)))
        n = blocks[at:to]
        i = np.repeat(np.arange(at, to), n)
        w = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        own = w == inside[i] // 64
        w = w + first[bucket[i]]
        at = to
        # lanes that count: those before the row itself
        over = np.where(own, ~((one << (inside[i] % 64).astype(np.uint64)) - one), none)
        counters = [np.zeros_like(over) for _ in range(max(1, radius.bit_length()))]
        mine = fps[i]
        for b in range(bits):
            carry = planes[b][w] ^ (none - ((mine[:, b // 64] >> np.uint64(b % 64)) & one))
            for c in counters:
                both = c & carry
                c ^= carry
                carry = both
            over |= carry
            if b % 8 == 7:
                alive = exceeds(over, counters) != full
                if not alive.all():
                    i, w, over, mine = (v[alive] for v in (i, w, over, mine))
                    counters = [c[alive] for c in counters]
                    if not len(i):
                        break
        if not len(i):
            continue
        near = ~exceeds(over, counters)
        k, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        if len(k):
            yield i[k], row_of[w[k] * 64 + lane]


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Each row's root after all ``links`` are merged."""
    root = np.arange(n)
    for a, b in links:
        while True:
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                break
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _bucketed(classes: DataFrame) -> DataFrame:
    """Classes by bucket: ``t`` (which bits are the key), ``key``, ``fp``."""

    def cut(fp, width, blocks, shift=0):  # noqa: ANN001, ANN202
        mask = (1 << width) - 1
        part = [F.shiftrightunsigned(fp, width * b + shift).bitwiseAND(F.lit(mask)) for b in blocks]
        return F.shiftleft(part[0], width).bitwiseOR(part[1])

    fp = F.col("fp")
    first = classes.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(t).alias("t"), cut(fp, 16, p).alias("key")) for t, p in enumerate(PAIRS)])).alias("b"),
    ).select("b.t", "b.key", "fp")
    counts = first.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    known = first.join(counts, ["t", "key"])
    small = known.where(F.col("n") <= BUCKET_ROWS).select("t", "key", "fp")
    # the 32 bits that the key leaves, packed, and dealt again
    left = F.lit(0).cast("long")
    for t, p in enumerate(PAIRS):
        rest = [b for b in range(4) if b not in p]
        left = F.when(F.col("t") == t, cut(fp, 16, rest)).otherwise(left)
    deep = known.where(F.col("n") > BUCKET_ROWS).withColumn("left", left)
    deep = deep.select(
        "t", "key", "fp",
        F.explode(F.array(*[F.struct(F.lit(u).alias("u"), cut(F.col("left"), 8, p).alias("sub")) for u, p in enumerate(PAIRS)])).alias("b"),
    ).select(
        (F.col("t") * 6 + F.col("b.u") + 6).alias("t"),
        F.shiftleft("key", 16).bitwiseOR(F.col("b.sub")).alias("key"),
        "fp",
    )
    return small.union(deep)


def bucket_starts(key: np.ndarray) -> np.ndarray:
    """Each bucket's first row, then the number of rows, of rows sorted by ``key`` (a row of numbers each)."""
    return np.r_[np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]), len(key)]


def by_bucket(
    f: Callable[[np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], keys: int, rows: int = 100_000
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls ``f`` with the keys and the values of some ``rows`` sorted rows of longs, whole buckets only."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for b in batches:
            held.append(np.stack([c.to_numpy().astype(np.int64) for c in b.columns], 1))
            n += b.num_rows
            if n < rows:
                continue
            data = np.concatenate(held)
            last = int(bucket_starts(data[:, :keys])[-2])  # the last bucket may go on in the next batch
            if last:
                yield from f(data[:last, :keys], np.ascontiguousarray(data[:last, keys:]))
            held, n = [data[last:]], len(data) - last
        if n:
            data = np.concatenate(held)
            yield from f(data[:, :keys], np.ascontiguousarray(data[:, keys:]))
        tidy()

    return over


def link_forest(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a``, ``b``: links that connect all classes within the radius; ``classes`` has distinct longs ``fp``."""
    if radius not in (0, 1, 2):
        raise ValueError("the buckets hold for a radius of 2 or less")

    def links(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        root = forest(len(fp), near_lanes(fp.view(np.uint64), bucket_starts(key), radius))
        off = np.flatnonzero(root != np.arange(len(fp)))
        if len(off):
            yield pa.RecordBatch.from_arrays([pa.array(fp[off, 0]), pa.array(fp[root[off], 0])], names=["a", "b"])

    return (
        _bucketed(classes)
        .repartition("t", "key")
        .sortWithinPartitions("t", "key")
        .mapInArrow(by_bucket(links, 2), "a long, b long")
    )


def near_dedup(
    docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (hex), component_id and text_hash for every row of ``docs``."""
    rows = cut_lineage(fingerprints(docs, size, id_col, text_col), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(link_forest(classes.select("fp"), radius), "simhash")
    joined = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut_lineage(joined.join(least, "root").select("fp", "component_id"), "classes")
    return rows.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash"
    )


# Near duplicates by similarity: a wider fingerprint, a wide radius, and a check of what was found.

#: Words in a shingle, and least share of common shingles (Jaccard).
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: MinHashes in a band's key, and share of pairs at the threshold that meet in a band.
BAND_HASHES, MEET = 4, 0.9999
TILE = 1024
#: Shingle hashes in a tile where all pairs left open are checked.
TILE_HASHES = 800_000
#: Classes of a tile that are compared without bit planes, and rows of a batch of buckets (each takes 64 lanes at least).
FEW, BATCH_ROWS = 128, 10_000
WIDE = 128
#: Links checked first for each class, to classes before and after it each; a bucket offers its nearest.
NEAREST = 4


def chance_equal(similarity: float) -> float:
    """The chance that a SimHash bit of two texts agrees, by their Jaccard similarity."""
    return 1 - float(np.arccos(2 * similarity / (1 + similarity))) / np.pi


def bands(similarity: float = SIMILARITY, seed: int = SEED) -> np.ndarray:
    """Odd multipliers, a row a band.  Each MinHash is drawn anew and agrees with chance ``similarity``, so that
    the share of pairs that meet depends neither on other bands nor on the size of the table."""
    number = int(np.ceil(np.log(1 - MEET) / np.log(1 - similarity**BAND_HASHES)))
    return np.random.default_rng(seed).integers(0, 2**63, (number, BAND_HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """A key for each band of ``chosen``: its MinHashes of a text's shingles, mixed."""
    least = np.full(chosen.size, ~np.uint64(0))
    for k in range(0, len(hashes), 4096):
        np.minimum(least, (chosen.reshape(-1, 1) * hashes[k : k + 4096, 0]).min(1), out=least)
    key = np.zeros(len(chosen), np.uint64)
    for m in least.reshape(chosen.shape).T:
        key = (key ^ m) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def wide_radius(similarity: float = SIMILARITY) -> int:
    """Differing bits of four standard deviations over the mean at the threshold."""
    p = 1 - chance_equal(similarity)
    return int(np.ceil(WIDE * p + 4 * np.sqrt(WIDE * p * (1 - p))))


def wide_hashes(text: str | None, size: int) -> np.ndarray:
    """128-bit hashes of a text's distinct shingles, two words each."""
    words = text.encode("utf-8", "surrogatepass").translate(_upper).split() if text else []
    if not words:
        return np.empty((0, 2), np.uint64)
    h = xxhash.xxh3_128_digest
    data = b" ".join(words)
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    tails = ends[size - 1 :] or ends[-1:]
    digests = {h(data[a : b - 1]) for a, b in zip([0, *ends], tails)}  # noqa: B905
    return np.frombuffer(b"".join(sorted(digests)), np.uint64).reshape(-1, 2)


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    return tuple(fingerprint(np.ascontiguousarray(hashes[:, k])) for k in (0, 1))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """32-bit hashes of all shingles."""
    return np.unique((hashes[:, 0] ^ hashes[:, 1]).astype(np.uint32))


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two whole sketches."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    both = len(a) + len(b) - common
    return common / both if both else 1.0


def open_links(
    band: int, crossed: bool, fp: np.ndarray, root: np.ndarray, tile: np.ndarray, keys: np.ndarray,
    sketches: list[np.ndarray], radius: int, similarity: float,
) -> Iterator[tuple[int, int]]:
    """A forest of links between the roots of a tile's classes: every pair within the radius is checked that meets in no earlier band.

    Pairs of one root, or joined by now, need no check.  A ``crossed`` tile holds two tiles; pairs inside one are checked there.
    """
    ends = np.cumsum([0, *map(len, sketches)])
    names, ids = np.unique(np.concatenate(sketches), return_inverse=True)
    size, mark = np.diff(ends), np.zeros(len(names), bool)
    at = np.unique(root, return_inverse=True)[1]
    if len(fp) <= FEW:
        far = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2) > radius
        found = iter([np.nonzero(np.tril(~far, -1))])
    else:
        found = near_lanes(fp, np.array([0, len(fp)]), radius)
    for left, right in found:
        for k in range(0, len(left), 1 << 16):
            i, j = left[k : k + (1 << 16)], right[k : k + (1 << 16)]
            new = at[i] != at[j]
            if crossed:
                new &= tile[i] != tile[j]
            i, j = i[new], j[new]
            new = ~(keys[i, :band] == keys[j, :band]).any(1)
            i, j = i[new], j[new]
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
            for x, others in zip(i[starts], np.split(j, starts[1:]), strict=True) if len(i) else ():
                others = others[at[others] != at[x]]
                if not len(others):
                    continue
                mine = ids[ends[x] : ends[x + 1]]
                mark[mine] = True
                hits = np.cumsum(np.r_[0, mark[np.concatenate([ids[ends[y] : ends[y + 1]] for y in others])]])
                mark[mine] = False
                common = np.diff(hits[np.cumsum(np.r_[0, size[others]])])
                both = size[x] + size[others] - common
                for y in others[common / np.maximum(both, 1) >= similarity].tolist():
                    if at[x] != at[y]:
                        at[at == at[y]] = at[x]
                        yield int(root[x]), int(root[y])


def similar_groups(
    docs: DataFrame, size: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, text_hash and component (a number) of every row; components join texts of at least the similarity.

    Texts meet where all MinHashes of a band agree; buckets are compared bit-sliced as
    above (in tiles, if there are more than ``TILE`` classes).  Each bucket names each class's nearest
    before and after it; the ``NEAREST`` of these are checked on whole shingle sets and joined, which settles
    groups of near copies.  Then every other pair within the radius is checked that isn't in one group by now:
    the sketches go to the tiles of their buckets, and only a forest of links leaves a tile.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen, radius = bands(similarity), wide_radius(similarity)
    signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))

    def sign(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [wide_hashes(t, size) for t in b.column(1).to_pylist()]
        fps = [wide_fingerprint(h) for h in hashes]
        return pa.RecordBatch.from_arrays(
            [
                b.column(0), b.column(2), *(signed([f[k] for f in fps]) for k in (0, 1)),
                pa.array([band_keys(h, chosen) for h in hashes], pa.list_(pa.int64())), pa.array([sketch(h).tobytes() for h in hashes], pa.binary()),
            ],
            names=["doc_id", "text_hash", "fp0", "fp1", "keys", "sketch"],
        )

    rows = cut_lineage(
        map_batches(
            docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), text_hash(text_col)),
            sign, "doc_id long, text_hash long, fp0 long, fp1 long, keys array<long>, sketch binary",
        ),
        "signatures",
    )
    # the fingerprints, the keys and the sketch are functions of the shingles: a class has equal ones
    key = ["fp0", "fp1", "content"]
    rows = rows.withColumn("content", F.xxhash64("sketch"))
    classes = cut_lineage(
        rows.groupBy(*key)
        .agg(F.min(F.struct("doc_id", "text_hash", "keys", F.length("sketch").alias("bytes"))).alias("rep"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    met = classes.select("cid", "fp0", "fp1", F.posexplode("rep.keys").alias("band", "key"))
    counts = met.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    tiled = (
        met.join(counts, ["band", "key"])
        .withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
        .withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("band", "key", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "cid", "fp0", "fp1")
    )

    def nearest(keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        cid, fp = values[:, 0], np.ascontiguousarray(values[:, 1:]).view(np.uint64)
        none = np.iinfo(np.int64).max
        best = np.full((2, len(cid)), none)  # of the classes before, and after: the distance, then the row
        for i, j in near_lanes(fp, bucket_starts(keys), radius):
            d = np.bitwise_count(fp[i] ^ fp[j]).sum(1).astype(np.int64)
            low, high = np.where(cid[i] < cid[j], i, j), np.where(cid[i] < cid[j], j, i)
            np.minimum.at(best[0], high, (d << 32) | low)
            np.minimum.at(best[1], low, (d << 32) | high)
        for side in (0, 1):
            at = np.flatnonzero(best[side] != none)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at, 0].astype(np.int32)), pa.array(keys[at, 1]), pa.array(cid[at]), pa.array(np.full(len(at), side, np.int32)), pa.array((best[side][at] >> 32).astype(np.int32)), pa.array(cid[best[side][at] & 0xFFFFFFFF])],
                    names=["band", "key", "cid", "side", "distance", "other"],
                )

    near = cut_lineage(
        tiled.repartition("band", "key", "p", "q")
        .sortWithinPartitions("band", "key", "p", "q")
        .mapInArrow(by_bucket(nearest, 4, BATCH_ROWS), "band int, key long, cid long, side int, distance int, other long"),
        "near",
    )
    found = cut_lineage(
        near.groupBy("cid", "side")
        .agg(F.slice(F.sort_array(F.collect_set(F.struct("distance", "other"))), 1, NEAREST).alias("nearest"))
        .select("cid", F.explode("nearest.other").alias("other"))
        .select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b"))
        .distinct(),
        "found",
    )
    ends = near.select("cid").distinct()
    reps = cut_lineage(classes.join(ends, "cid", "left_semi").select("cid", F.col("rep.doc_id").alias("d"), F.col("rep.text_hash").alias("t")), "reps")
    of_rep = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    sketches = cut_lineage(rows.join(reps, of_rep).select("cid", "fp0", "fp1", "keys", "sketch").dropDuplicates(["cid"]), "sketches")
    of = lambda c: sketches.select(F.col("cid").alias(c), F.col("sketch").alias(f"sketch_{c}"))

    def check(b: pa.RecordBatch) -> pa.RecordBatch:
        pairs = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
        alike = [resemblance(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= similarity for x, y in pairs]
        return b.select(["a", "b"]).filter(pa.array(alike))

    links = map_batches(
        found.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sketch_a", "sketch_b"), check, "a long, b long"
    )
    roots = components(links, "similar")
    sides = classes.join(roots, F.col("cid") == F.col("node"), "left").select("cid", *key, "rep.bytes", F.coalesce("root", "cid").alias("root"))
    sides = cut_lineage(sides, "sides")

    # what is left open: buckets where classes of several roots have pairs within the radius
    places = near.select("band", "key", "cid").distinct().join(sides.select("cid", "root", "bytes"), "cid")
    left = (
        places.groupBy("band", "key")
        .agg(F.min("root").alias("a"), F.max("root").alias("b"), F.sum("bytes").alias("bytes"))
        .where("a <> b")
        .select("band", "key", F.greatest(F.lit(1), F.ceil(F.col("bytes") / (4 * TILE_HASHES))).cast("int").alias("tiles"))
    )
    still = (
        places.join(left, ["band", "key"])
        .withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("band", "key", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "cid", "root")
        .join(sketches, "cid")
        .select("band", "key", "p", "q", "tile", "root", "fp0", "fp1", "keys", "sketch")
    )

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        at, column = [t[c].to_numpy() for c in ("band", "p", "q")], lambda c: t[c].to_numpy()
        keys = t["keys"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        fp = np.stack([column("fp0"), column("fp1")], 1).view(np.uint64)
        root, tile, sketched = column("root"), column("tile"), [np.frombuffer(x, np.uint32) for x in t["sketch"].to_pylist()]
        starts = bucket_starts(np.stack([column(c) for c in ("band", "key", "p", "q")], 1))
        for x, y in zip(starts, starts[1:], strict=False):
            band, p, q = (int(c[x]) for c in at)
            if linked := list(open_links(band, p != q, fp[x:y], root[x:y], tile[x:y], keys[x:y], sketched[x:y], radius, similarity)):
                a, b = zip(*linked, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < 4 * ARROW_ROWS:
                continue
            t = pa.Table.from_batches(held)
            last = int(bucket_starts(np.stack([t[c].to_numpy() for c in ("band", "key", "p", "q")], 1))[-2])
            if last:
                yield from settle(t.slice(0, last))
            held = t.slice(last).to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held))
        tidy()

    more = (
        still.repartition("band", "key", "p", "q")
        .sortWithinPartitions("band", "key", "p", "q")
        .mapInArrow(by_tile, "a long, b long")
    )
    joined = components(more, "open").withColumnRenamed("root", "joined")
    grouped = sides.join(joined, F.col("root") == F.col("node"), "left").select(*key, F.coalesce("joined", "root").alias("component"))
    return rows.join(cut_lineage(grouped, "grouped"), key).select("doc_id", "text_hash", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """One document of each group of :func:`similar_groups`, that with the smallest id, with all its columns.

    Rows that repeat both id and text are one document; of rows that repeat the id alone, the smallest text hash stays.
    """
    stay = (
        similar_groups(docs, id_col=id_col, text_col=text_col, **options)
        .groupBy("component")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("kept"))
        .select("kept.doc_id", "kept.text_hash")
    )
    plain, names = numbered(docs)
    out = plain.join(
        stay,
        plain[names[id_col]].cast("long").eqNullSafe(stay["doc_id"]) & (text_hash(names[text_col]) == stay["text_hash"]),
        "left_semi",
    )
    return out.select(*named(out, names))


def op5_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir)).drop("text_hash")
