"""Quality classifier with hierarchical empirical Bayes over sites.

1. Document evidence: a logistic classifier on ``SHAPES`` shape features of the
   whole text and ``LEXICAL`` hashed counts of its words and word endings, fitted to a bounded share of the
   labelled rows (``TRAIN_ROWS`` on average, picked by hash).  Its log-odds less the log-odds of the training
   share is the document's evidence, free of any prior.  It is computed once a document and written.
2. Sites: the classifier's probabilities are summed by (host, path) over all
   documents, and from there by host: partial aggregates, so a host with a
   third of all rows is one row a map task.
3. Shrinkage: each host's mean is drawn towards the global mean, and each
   path's towards its host's, by prior strengths estimated from the spread
   between them (method of moments), so that sites with few documents stay near the prior.
4. Posterior: the site's log-odds, with the document's own part taken out, plus
   its evidence.  A document is rejected if its posterior is below ``REJECT``.

For ``documents`` the host is ``source`` and the path ``lang``.

Defined results: null text equals empty text; a null host or path is a site of
its own; without labels of both kinds there is no evidence and every document is
kept; rows that repeat an id are judged each, and the one with the least text hash is trained on;
of labels that repeat an id the highest counts; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, documents, named, numbered, small_batches, trim

TRAIN_ROWS = 20_000
REJECT = 0.5
SHAPES, LEXICAL = 16, 256
#: Ridge a training row of the shape features' weights, and of the lexical ones' in all.
RIDGE, LEXICAL_RIDGE = 1e-3, 50.0


def shapes(text: str, words: list[str]) -> list[float]:
    """Shape features of a whole text that has words."""
    n = len(words)
    chars = sum(map(len, words))
    joined = "".join(words)
    odd = sum(joined.count(c) for c in "#$%&*|!<>{}[]\\^~=_+@")
    alpha = sum(w.isalpha() for w in words)
    upper = sum(w.isupper() for w in words)
    distinct = len(set(words)) / n
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    lines = text.split("\n")
    capital = sum(w[0].isupper() for w in words) / n
    sentence = sum(w[-1] in ".!?" for w in words) / n
    log_n = float(np.log(n))
    digits = sum(map(joined.count, "0123456789")) if joined.isascii() else sum(map(str.isdigit, joined))
    return [
        log_n, log_n * log_n, float(n < 10), float(n < 20), chars / n, distinct, distinct * log_n, same, upper / n,
        odd / chars, min(1.0, 4 * odd / n), alpha / n, capital, sentence, len(set(lines)) / len(lines),
        digits / chars,
    ]


def lexical(words: list[str]) -> np.ndarray:
    """Signed hashed counts (logarithms) of words, and of their last three characters, scaled to length one each."""
    out = np.zeros(LEXICAL)
    for salt, counts in ((0, Counter(words)), (1, Counter([w[-3:] for w in words]))):
        n = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
        h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass"), salt) for w in counts), np.uint32, len(counts))
        out += np.bincount(h % LEXICAL, np.where(h >> 31, n, -n), LEXICAL) / np.sqrt(n @ n)
    return out


def features(text: str | None) -> np.ndarray:
    """All features of a whole text: shape, then words."""
    words = (text or "").split()
    return np.r_[shapes(text, words), lexical(words)] if words else np.zeros(SHAPES + LEXICAL)


class Logistic:
    """A ridge-penalised logistic model, fitted by Newton's method.  ``ridge``: of each feature's weight, a row."""

    #: Rows whose design is held at a time.
    ROWS = 2000

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: np.ndarray) -> None:
        n, blocks = len(y), [slice(i, i + self.ROWS) for i in range(0, len(y), self.ROWS)]
        self.mean = sum(x[b].sum(0, dtype=np.float64) for b in blocks) / n
        self.scale = np.sqrt(sum(((x[b] - self.mean) ** 2).sum(0) for b in blocks) / n) + 1e-9
        ridge = np.r_[ridge, 0.0]
        w = np.zeros(len(ridge))
        for _ in range(30):
            grad, hess = -ridge * w, np.diag(ridge + 1e-9)
            for b in blocks:
                z = self._design(x[b])
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                grad += z.T @ (y[b] - p) / n
                hess += (z * (p * (1 - p))[:, None]).T @ z / n
            step = np.linalg.solve(hess, grad)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.w, self.prior = w, float(np.log(y.mean() / (1 - y.mean())))

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, np.ones((len(z), 1))])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.w, -20, 20)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        train_rows: int = TRAIN_ROWS, label_id_col: str = "doc_id") -> Logistic | None:
    """The classifier, from about ``train_rows`` labelled documents; None where labels are of one kind."""
    rows = (
        labels.select(F.col(label_id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
        .where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    )
    every = max(1, round(rows.count() / train_rows))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)

    def measure(texts: pa.Array) -> pa.Array:
        out = pa.array([features(t).astype(np.float32).tobytes() for t in texts.to_pylist()], pa.binary())
        trim()
        return out

    got = (
        docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(some), F.col("doc") == F.col("id"))  # one row an id, about train_rows of them
        .select("id", "y", F.xxhash64("text").alias("h"), F.arrow_udf(measure, "binary")("text").alias("x"))
        .groupBy("id", "y").agg(F.min(F.struct("h", "x")).alias("m"))
        .select("id", "y", "m.x").orderBy("id")
        .toArrow()
    )
    y = (got["y"].to_numpy() > 0).astype(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(len(y), -1)
    return Logistic(x, y, np.r_[np.full(SHAPES, RIDGE), np.full(LEXICAL, LEXICAL_RIDGE / len(y))])


def evidence(model: Logistic | None, text: Column) -> Column:
    """The model's log-odds of a text, less its prior; 0 without a model."""
    if model is None:
        return F.lit(0.0)

    def score(texts: pa.Array) -> pa.Array:
        x = np.array([features(t) for t in texts.to_pylist()]).reshape(len(texts), SHAPES + LEXICAL)
        trim()
        return pa.array(model.log_odds(x) - model.prior, pa.float64())

    return F.arrow_udf(score, "double")(text)


def _logit(p):  # noqa: ANN001, ANN202
    return F.log(p / (1 - p))


def spread(groups: DataFrame, parent_mean: str) -> float:
    """Prior strength of groups (n, s, ss: rows, sum and sum of squares of probabilities) below their parent's mean."""
    r = groups.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n").cast("double")).alias("nn"),
        F.sum("s").alias("s"), F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("inside"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(parent_mean), F.lit(2))).alias("between"),
    ).first()
    if not r.n or r.k < 2 or r.n <= r.k:
        return 100.0
    mean, inside = r.s / r.n, r.inside / (r.n - r.k)
    tau = (r.between - (r.k - 1) * inside) / (r.n - r.nn / r.n) if r.n > r.nn / r.n else 0.0
    return float(np.clip(mean * (1 - mean) / tau - 1, 2, 1e6)) if tau > 0 else 1e6


def judge(
    docs: DataFrame, labels: DataFrame, reject: float = REJECT, id_col: str = "doc_id", text_col: str = "text",
    host_col: str = "source", path_col: str = "lang", label_col: str = "quality", label_id_col: str = "doc_id", carry: Sequence[str] | None = None,
) -> DataFrame:
    """``carry`` (all columns if None) of ``docs``, and ``oak_evidence``, ``oak_site``, ``oak_posterior``, ``oak_kept`` (a column so named before is replaced)."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, label_col, label_id_col=label_id_col)
    base = model.prior if model else 0.0
    plain, names = numbered(docs)
    handed = {n: c for n, c in names.items() if carry is None or n in carry}
    # written with what is handed on, so that texts are measured once
    own = cut_lineage(
        plain.select(
            *handed.values(), F.col(names[host_col]).alias("host"), F.col(names[path_col]).alias("path"),
            evidence(model, F.col(names[text_col]).cast("string")).alias("evidence"),
        ),
        "evidence",
    )
    p = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(base))))
    paths = cut_lineage(
        own.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("ss")), "sites"
    )
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = total.s / total.n if total.n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).withColumn("mean", F.lit(mean))
    strong = spread(hosts, "mean")
    hosts = hosts.select(F.col("host").alias("h"), ((F.lit(strong * mean) + F.col("s")) / (strong + F.col("n"))).alias("host_mean"))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    below = spread(sites, "host_mean")
    # written, so that its size is known when the join is planned: a small table is broadcast and no text is shuffled
    sites = cut_lineage(
        sites.select(F.col("host").alias("h"), F.col("path").alias("p"), (F.lit(below) * F.col("host_mean") + F.col("s")).alias("s"), (F.lit(below) + F.col("n")).alias("n")),
        "posteriors",
    )
    site = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), (F.col("s") - p) / (F.col("n") - 1)))
    out = (
        own.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
        .withColumn("site", site)
        .withColumn("posterior", 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("site"))))))
        .withColumn("kept", F.col("posterior") >= F.lit(reject) if model else F.lit(True))
    )
    made = {f"oak_{c}": c for c in ("evidence", "site", "posterior", "kept")}
    return out.select(*named(out, handed | made))


def keep_good(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    plain, names = numbered(docs)
    used = {k: options.pop(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("host_col", "source"), ("path_col", "lang"))}
    judged = judge(plain, labels, **{k: names[v] for k, v in used.items()}, **options)
    return judged.where("oak_kept").select(*named(judged, names))


def op8_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(documents(spark, sf_dir), labels, carry=["doc_id", "source", "lang"]).select(
        "doc_id",
        F.col("source").alias("host"),
        F.col("lang").alias("path"),
        F.round("oak_evidence", 6).alias("evidence"),
        F.round("oak_site", 6).alias("site_posterior"),
        F.round("oak_posterior", 6).alias("posterior"),
        F.col("oak_kept").alias("kept"),
    )
