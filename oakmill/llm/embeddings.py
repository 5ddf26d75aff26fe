"""Embedding near-dedup with a forest of random-projection trees.

1. Equal vectors of a label form a class; from here on a class is one row with
   its number of members.
2. Trees: each splits by random directions until a leaf of the label holds ``LEAF`` classes
   on average.  Split points of the upper levels are medians of a bounded
   sample (``SAMPLE`` classes by hash, all labels together); levels beyond the
   sample's resolution reuse the medians of the sample leaf above them.  A
   vector closer to a split point than ``SPILL`` times the root mean square distance of
   a threshold link along one direction goes down both sides.  A level parts some pairs of a dense
   group, so a label's trees are as many as its depth needs (:func:`trees_for`).
3. Within a leaf all pairs are compared exactly, in double precision.  A leaf of more
   than ``LEAF_MOST`` rows is cut into tiles, and each pair of tiles is a group of its own: no
   pair is left out and no group grows with a cluster.
4. A pair that meets in several leaves counts in the first one only: rows carry
   the list of their leaves, and a leaf leaves out pairs that share an earlier one.
   So a leaf returns a count a row and a forest of its links, not its pairs.
5. Forests are joined by :func:`common.components`.

Recall is measured against brute force in the tests (and is over 0.99); a link
below the threshold is never reported.

Defined results: a vector that is null, empty, zero, or has a null or non-finite
component, and any vector with a null label, links with nothing and is kept;
vectors of different length are not compared; rows that repeat an id are rows of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut_lineage, map_batches
from .simhash import forest

COSINE = 0.98
TREES = 6
LEAF = 128
LEAF_MOST = 512
TILE = 256
SPILL = 0.4
#: Share of a dense group's links that a level of a tree keeps together, and share of links that all trees may lose.
LEVEL_KEEPS, LOST = 0.9, 0.005
SAMPLE = 4096
#: Sample rows below which a node's split point is its ancestor's.
NODE_ROWS = 32
DEEPEST = 32
SEED = 13


def directions(dim: int, tree: int, seed: int = SEED) -> np.ndarray:
    """Unit directions of a tree's levels, a row each."""
    d = np.random.default_rng([seed, dim, tree]).standard_normal((DEEPEST, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def trees_for(depth: int, least: int = TREES) -> int:
    """Trees of ``depth`` levels that lose no more than ``LOST`` of a dense group's links."""
    return max(least, int(np.ceil(np.log(LOST) / np.log(1 - LEVEL_KEEPS**depth)))) if depth else least


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision and without overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class Tree:
    """Split points of one tree: ``upper[level][node]`` from the sample, then a row a sample leaf for the levels below."""

    def __init__(self, sample: np.ndarray, tree: int, seed: int) -> None:
        self.directions = directions(sample.shape[1], tree, seed)
        self.levels = max(0, int(np.log2(max(1, len(sample)) / NODE_ROWS)))
        at = sample @ self.directions.T
        node = np.zeros(len(sample), np.int64)
        self.upper: list[np.ndarray] = []
        for level in range(self.levels):
            cut = self._medians(at[:, level], node, 1 << level)
            self.upper.append(cut)
            node = 2 * node + (at[:, level] > cut[node])
        self.lower = np.stack(
            [self._medians(at[:, level], node, 1 << self.levels) for level in range(self.levels, DEEPEST)], 1
        )

    @staticmethod
    def _medians(values: np.ndarray, node: np.ndarray, nodes: int) -> np.ndarray:
        whole = float(np.median(values)) if len(values) else 0.0
        out = np.full(nodes, whole)
        order = np.argsort(node, kind="stable")
        ends = np.searchsorted(node[order], np.arange(nodes + 1))
        for k in range(nodes):
            if ends[k + 1] > ends[k]:
                out[k] = np.median(values[order[ends[k] : ends[k + 1]]])
        return out

    def leaves(self, rows: np.ndarray, depth: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Row and leaf of every place that ``rows`` go; leaves of a depth have their own numbers."""
        at = rows @ self.directions.T
        row, node, top = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(DEEPEST + 1):
            ends = depth[row] <= level
            if ends.any():
                done.append((row[ends], node[ends] + (1 << level)))
                row, node, top = row[~ends], node[~ends], top[~ends]
            if not len(row) or level == DEEPEST:
                break
            if level < self.levels:
                cut = self.upper[level][node]
            else:
                top = node if level == self.levels else top
                cut = self.lower[top, level - self.levels]
            far = at[row, level] - cut
            left, right = far <= margin, far > -margin
            row, top = np.r_[row[left], row[right]], np.r_[top[left], top[right]]
            node = np.r_[2 * node[left], 2 * node[right] + 1]
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def classes_of(rows: DataFrame) -> DataFrame:
    """Valid vectors: one row for each label and vector, with a number of its own."""
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & sound & F.exists("v", lambda x: x != 0))
    return cut_lineage(
        valid.groupBy("label", "v")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("members"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "vectors",
    )


def link(classes: DataFrame, cosine: float = COSINE, trees: int = TREES, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Counts (cid, linked members of other classes) and a forest (a, b) of the links between ``classes``."""
    spark = classes.sparkSession
    keyed = classes.withColumn("dim", F.size("v"))
    depth = keyed.groupBy("label", "dim").agg(
        F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / F.lit(LEAF)))).cast("int").alias("depth")
    )
    every = max(1, classes.count() // SAMPLE)
    fitted: dict[int, list[np.ndarray]] = {}
    for r in keyed.where(F.pmod(F.xxhash64("v"), F.lit(every)) == 0).select("dim", "v").collect():
        fitted.setdefault(r.dim, []).append(np.array(r.v, np.float64))
    samples = spark.sparkContext.broadcast({d: unit(np.stack(v)) for d, v in fitted.items()})
    own: dict[tuple[int, int], Tree] = {}

    def tree(dim: int, k: int) -> Tree:
        if (dim, k) not in own:
            own[dim, k] = Tree(samples.value.get(dim, np.zeros((0, dim))), k, seed)
        return own[dim, k]

    def route(b: pa.RecordBatch) -> pa.RecordBatch:
        dims = b.column(5).to_numpy()
        out = []
        for dim in np.unique(dims):
            part = b.filter(pa.array(dims == dim))
            x = unit(_matrix(part.column(3), int(dim)))
            margin = SPILL * np.sqrt(2 - 2 * cosine) / np.sqrt(dim)
            row, leaf, depths = [], [], part.column(4).to_numpy()
            wanted = np.array([trees_for(n, trees) for n in range(int(depths.max()) + 1)])[depths]
            for k in range(int(wanted.max())):
                own_rows = np.flatnonzero(wanted > k)
                i, at = tree(int(dim), k).leaves(x[own_rows], depths[own_rows], margin)
                row.append(own_rows[i])
                leaf.append(at + (k << 40))
            i, at = np.concatenate(row), np.concatenate(leaf)
            order = np.lexsort((at, i))
            i, at = i[order], at[order]
            lists = pa.ListArray.from_arrays(np.searchsorted(i, np.arange(len(x) + 1)).astype(np.int32), pa.array(at))
            t = part.append_column("leaves", lists) if hasattr(part, "append_column") else pa.RecordBatch.from_arrays(
                [*part.columns, lists], names=[*part.schema.names, "leaves"]
            )
            t = t.take(pa.array(i))
            out.append(pa.RecordBatch.from_arrays([*t.columns, pa.array(at)], names=[*t.schema.names, "leaf"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    label_kind = classes.schema["label"].dataType.simpleString()
    v_kind = classes.schema["v"].dataType.simpleString()
    placed = map_batches(
        keyed.join(depth, ["label", "dim"]).select("label", "cid", "members", "v", "depth", "dim"),
        route,
        f"label {label_kind}, cid long, members long, v {v_kind}, depth int, dim int, leaves array<long>, leaf long",
    ).drop("depth")
    large = (
        placed.groupBy("label", "dim", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > LEAF_MOST)
        .withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).drop("n")
    )
    tiled = (
        placed.join(large, ["label", "dim", "leaf"], "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("p", F.least("tile", "other"))
        .withColumn("q", F.greatest("tile", "other"))
    )

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        dim, leaf, p, q = (k.as_py() for k in key[1:])
        x = unit(_matrix(t["v"], dim))
        cid, members, tile = (t[c].to_numpy() for c in ("cid", "members", "tile"))
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        if p != q:
            near &= tile[:, None] != tile[None, :]
        i = np.flatnonzero(near.any(1))
        near = near[np.ix_(i, i)]
        a, b = np.nonzero(np.triu(near))
        root = forest(len(i), iter([(a, b)]))
        # pairs that met in an earlier leaf count there
        lists = t["leaves"].combine_chunks().take(pa.array(i)) if len(i) else None
        if len(i):
            flat = lists.flatten().to_numpy()
            holder = np.repeat(np.arange(len(i)), np.diff(lists.offsets.to_numpy()))
            early = flat < leaf
            names, at = np.unique(flat[early], return_inverse=True)
            there = np.zeros((len(i), max(1, len(names))), np.float32)
            there[holder[early], at] = 1
            near &= there @ there.T == 0
        counts = near @ members[i]
        cid = cid[i]
        return pa.table({
            "a": pa.array(cid, pa.int64()),
            "b": pa.array(cid[root], pa.int64()) if len(i) else pa.array([], pa.int64()),
            "n": pa.array(counts.astype(np.int64), pa.int64()),
        })

    found = cut_lineage(
        tiled.groupBy("label", "dim", "leaf", "p", "q").applyInArrow(compare, "a long, b long, n long"), "links"
    )
    return found.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n")), found.where("a <> b").select("a", "b")


def near_dedup(
    vectors: DataFrame, cosine: float = COSINE, trees: int = TREES,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    classes = classes_of(rows)
    counts, links = link(classes, cosine, trees)
    roots = components(links, "embeddings")
    known = (
        classes.join(roots, F.col("cid") == F.col("node"), "left")
        .join(counts, "cid", "left")
        .select("label", "v", "least", "members", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "cid").alias("root"))
    )
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    known = cut_lineage(
        known.join(least, "root").select("label", "v", (F.col("n") + F.col("members") - 1).alias("n"), "component"), "known"
    )
    return rows.join(known, ["label", "v"], "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component", "vec_id")).alias("kept"),
    )


def op10_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), component AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT c.vec_id, coalesce(d.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM component c LEFT JOIN degree d USING (vec_id)
"""
