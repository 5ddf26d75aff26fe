"""URL filter over a sorted array of 64-bit digests.

The rule list is stored as files in the shared folder: the xxHash64 digests of all rule strings
(``host`` + ``path``), sorted, and the rule strings themselves in the same
order.  Spark ships them to every executor once (``addFile``); Python workers
memory-map them, so the workers of a machine share one copy and the list never
has to fit on a heap.  A batch of URLs is probed by one vectorised binary search over
all its candidate strings, and each digest that matches is confirmed against
the stored string, so a collision cannot block a page.

A rule fits its host and all subdomains, and every path that starts with the
rule's path; the candidates of a URL are its host's suffixes of as many labels as a rule has at most, times its
path's prefixes of the lengths that rules have.  Of the rules that fit, the
longest string wins.  Where none fits, the verdict is the array's: a URL that
it doesn't hold is allowed.

Defined results: null URLs and URLs without ``://`` have empty host and path
and are allowed; an empty rule list allows all; rows keep their number and
order within a partition; other columns are ignored.  Rules are unique by
string (the last one given holds).  There is no shuffle, so no key can be hot.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import uuid
from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ..sources.files import delete, new_folder, write_bytes
from .common import map_batches

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SEED = 42


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


#: The list of the query.
RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:end]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


def suffixes(host: str, most: int) -> list[str]:
    """The host's suffixes of ``most`` labels at most, whole labels only."""
    out, at = [], len(host)
    while at >= 0 and len(out) < most:
        at = host.rfind(".", 0, at)
        out.append(host[at + 1 :])
    return out


class DigestArray:
    """The mapped files of a rule list."""

    FILES = ("digests", "offsets", "strings", "facts")

    @staticmethod
    def files(rules: Sequence[Rule]) -> dict[str, bytes]:
        """The files' contents by name."""
        keys = {r.key.encode(): r for r in rules}
        order = sorted(keys, key=lambda k: (xxhash.xxh64_intdigest(k, SEED), k))
        digests = np.array([xxhash.xxh64_intdigest(k, SEED) for k in order], np.uint64)
        blob = [bytes([keys[k].verdict == "block"]) + k for k in order]
        offsets = np.cumsum([0, *map(len, blob)]).astype(np.int64)
        facts = {
            "paths": sorted({len(r.path) for r in rules}), "labels": max((r.host.count(".") + 1 for r in rules), default=0), "n": len(order),
        }
        data = (digests.tobytes() or b"\0" * 8, offsets.tobytes(), b"".join(blob) or b"\0", json.dumps(facts).encode())
        return dict(zip(DigestArray.FILES, data, strict=True))

    def __init__(self, prefix: str) -> None:
        with open(f"{prefix}facts") as f:
            facts = json.load(f)
        self.n, self.paths, self.labels = facts["n"], facts["paths"], facts["labels"]
        self.digests = np.memmap(f"{prefix}digests", np.uint64, "r")[: self.n]
        self.offsets = np.memmap(f"{prefix}offsets", np.int64, "r")
        self.strings = np.memmap(f"{prefix}strings", np.uint8, "r")

    def probe(self, keys: list[bytes]) -> list[bool | None]:
        """For each key: whether it blocks, None where the list lacks it."""
        out: list[bool | None] = [None] * len(keys)
        if not keys or not self.n:
            return out
        wanted = np.array([xxhash.xxh64_intdigest(k, SEED) for k in keys], np.uint64)
        at = np.searchsorted(self.digests, wanted)
        hit = np.flatnonzero((at < self.n) & (self.digests[np.minimum(at, self.n - 1)] == wanted))
        for i in hit:
            j = int(at[i])
            while j < self.n and self.digests[j] == wanted[i]:
                stored = bytes(self.strings[self.offsets[j] : self.offsets[j + 1]])
                if stored[1:] == keys[i]:
                    out[i] = bool(stored[0])
                    break
                j += 1
        return out


@lru_cache(maxsize=4)
def _opened(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(f"{name}-"))


def _forget(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by now
        delete(spark, folder)


def filter_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, host, path, rule, verdict for every row of ``pages``."""
    spark = pages.sparkSession
    name = f"urls-{uuid.uuid4().hex}"
    folder = new_folder(spark, "urls")
    atexit.register(_forget, spark, folder)  # executors that start later fetch the files as well
    for kind, data in DigestArray.files(rules).items():
        write_bytes(spark, f"{folder}/{name}-{kind}", data)
        spark.sparkContext.addFile(f"{folder}/{name}-{kind}")

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        listed = _opened(name)
        parts = [split_url(u) for u in batch.column(1).to_pylist()]
        keys: dict[str, int] = {}
        of: list[list[str]] = []
        for host, path in parts:
            ends = suffixes(host, listed.labels)
            starts = [path[:n] for n in listed.paths if n <= len(path)]
            own = [h + p for h in ends if h for p in starts]
            for k in own:
                keys.setdefault(k, len(keys))
            of.append(own)
        found = listed.probe([k.encode("utf-8", "surrogatepass") for k in keys])
        rule, verdict = [], []
        for own in of:
            fits = [k for k in own if found[keys[k]] is not None]
            best = max(fits, key=len, default=None)
            rule.append(best)
            verdict.append("block" if best is not None and found[keys[best]] else "allow")
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.string()) for x in ([p[0] for p in parts], [p[1] for p in parts], rule, verdict))],
            names=[id_col, "host", "path", "rule", "verdict"],
        )

    kind = pages.schema[id_col].dataType.simpleString()
    return map_batches(
        pages.select(id_col, url_col),
        judge,
        f"`{id_col}` {kind}, host string, path string, rule string, verdict string",
    )


def op7_digest_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


SQL = r"""
WITH split AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0
              THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0) END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/]*', 0),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END, '') AS path
  FROM split
), rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), best AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b USING (page_id)
"""
