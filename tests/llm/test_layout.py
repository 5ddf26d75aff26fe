"""Sharding, packing, mixing, URL filter."""

import collections
import struct
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from oakmill.llm import mixing, packing, sharding, urls

ROWS = [
    (i, None if i % 17 == 0 else "" if i % 13 == 0 else f"Text {i} " * (i % 9 + 1), None if i % 19 == 0 else f"s{min(i % 9, 3)}")
    for i in range(700)
] + [(None, "no id", "s0"), (None, "no id", "s0"), (3, "again", "s1"), (3, "again", "s1"), (9000, "w " * 60_000, "s2")]
SCHEMA = "doc_id long, text string, source string, size long, shard int, bucket int, sequence_id long, no int, quota long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 97, 1000, 4099])
def test_feistel_is_a_permutation(spark, n):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(n).select(sharding.feistel(F.col("id"), n, 7)).collect()]
    assert sorted(got) == list(range(n)) and (n < 16 or got != list(range(n)))
    a, b = sharding.sides(n)
    assert n <= a * b < n + a


def test_shards(spark):
    got = sharding.shard(table(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(by) == 16 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in ROWS)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    again = sharding.shard(table(spark, ROWS[::-1]).repartition(7)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert sharding.shard(table(spark, [])).count() == 0


def spark_hash(*values):
    """Spark's xxhash64 of 32-bit (as i) and 64-bit (as q) numbers; nulls are passed over."""
    h = 42
    for kind, v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack(f"<{kind}", v), h)
    return h - 2**64 if h >= 2**63 else h


def test_shards_as_in_plain_python(spark):
    """Row number, Feistel rounds, cycle walk, shard and slot of every row; a third of the rows is equal, and ids repeat."""
    rows = [(5, "copy", "s")] * 200 + [(6, f"t{i}", "s") for i in range(150)] + [(i if i % 40 else None, "x" * (i % 11), "s") for i in range(250)]
    facts = [(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, _ in rows]
    order = sorted(facts, key=lambda f: (spark_hash(*(("q", v) for v in f)), f[0] is not None, f[0] or 0, *f[1:]))
    n, seed = len(rows), 7
    a, b = sharding.sides(n)

    def turn(p):
        left, right = divmod(p, b)
        for k in range(sharding.ROUNDS):
            if k % 2 == 0:
                left = (left + spark_hash(("i", seed), ("i", k), ("q", right)) % a) % a
            else:
                right = (right + spark_hash(("i", seed), ("i", k), ("q", left)) % b) % b
        return left * b + right

    want = collections.Counter()
    for number, f in enumerate(order):
        p = turn(number)
        while p >= n:
            p = turn(p)
        want[(*f, p % 16, p // 16)] += 1
    got = sharding.shard(table(spark, rows).repartition(5)).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == want


def test_packing_round_trip(spark):
    docs = table(spark, ROWS)
    parts = packing.pieces(docs)
    held = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = collections.Counter(
        (i, array("I", [*held.encode(t or "", add_special_tokens=False).ids, 1]).tobytes()) for i, t, _ in ROWS
    )
    packed = packing.pack(parts, len(ROWS), group_rows=100)
    rows = packed.collect()
    # whole documents from their pieces (repeated ids have equal texts here)
    whole = collections.defaultdict(dict)
    for r in rows:
        whole[r.doc_id].setdefault(r.start, []).append(bytes(r.ids))
    for (i, data), n in want.items():
        assert all(len(v) >= n for v in whole[i].values())
        if i != 3:
            assert b"".join(v[0] for _, v in sorted(whole[i].items())) == data
    assert sum(r.length for r in rows) == sum(len(d) // 4 * n for (_, d), n in want.items())
    at = collections.defaultdict(list)
    for r in rows:
        assert 0 < r.length == len(r.ids) // 4 <= 2048
        at[r.sequence_id].append((r.offset, r.length))
    for spans in at.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048
    for s in packing.sequences(packed).collect():
        assert len(s.ids) == 4 * (s.used if s.used & (s.used - 1) == 0 else 2048)
    assert packing.packed_documents(table(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, offsets = packing.first_fit_decreasing(lengths, 50) if lengths else ([], [])
    free: list[int] = []
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        want = next((k for k, f in enumerate(free) if f >= n), len(free))
        if want == len(free):
            free.append(50)
        assert (b, o) == (want, 50 - free[want])
        free[want] -= n


PARTS = [*" \n\taB1é!'s\u3000\u2003\x85\x1c漢😀", "<|endoftext|>", "<|endof", "word ", " the"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=20).map("".join), min_size=1, max_size=5))
def test_ids_are_the_tokenizers(texts):
    """Of every string, the strings of added tokens and odd white space included."""
    path = public_tokenizers.path(packing.VOCABULARY)
    held = Tokenizer.from_file(path)
    want = [held.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in packing.encoder(path).many(pa.array(texts, pa.string()))] == want
    assert [packing.encoder(path)(t).tolist() for t in texts] == want


@pytest.mark.parametrize("text", [" " * 300_000, "\n" * 5000 + " x" + " " * 1500 + "\n", "a" * 200_000, "x" + "\u3000" * 2000 + "y " + " " * 1200 + "z"])
def test_ids_of_long_runs(text):
    path = public_tokenizers.path(packing.VOCABULARY)
    assert packing.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_equal_rows_are_dealt_apart(spark):
    """A third of all rows equal in id and text: groups stay near their size, and nothing is lost."""
    rows = [(1, "same text", "s")] * 500 + [(None, "same text", "s")] * 300 + [(i, f"other {i}", "s") for i in range(2, 802)]
    parts = packing.pieces(table(spark, rows).repartition(3), with_ids=False)
    assert parts.count() == len(rows)
    sizes = [r["count"] for r in parts.groupBy((parts["copy"] % 16).alias("g")).count().collect()]
    assert max(sizes) < 3 * len(rows) / 16
    got = packing.pack(parts, len(rows), group_rows=100).collect()
    assert collections.Counter(r.doc_id for r in got)[1] == 500 and len(got) == len(rows)


def highest_quotients(weights, seats, most):
    got = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if got[i] < most[i] and weights[i] > 0]
        if not open_:
            break
        got[max(open_, key=lambda i: (weights[i] / (2 * got[i] + 1), -i))] += 1
    return got


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 30)), min_size=1, max_size=9), st.integers(0, 120))
def test_apportion(rows, seats):
    weights, most = zip(*rows, strict=True)
    got = mixing.apportion(np.array(weights), seats, np.array(most))
    assert got.tolist() == highest_quotients(weights, seats, most)


def test_mix(spark):
    got = mixing.mix(table(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    sizes = collections.Counter()
    for _, t, s in ROWS:
        sizes[s] += len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names], [i % 3 + 1 for i in range(len(names))]), strict=True))
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.taken <= 3 * r.size
    for s in names:
        assert abs(taken[s] - goal[s]) <= mixing.BLOCK
        assert goal[s] <= 3 * sizes[s] + 1e-9
    again = mixing.mix(table(spark, ROWS[::-1]).repartition(5)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert mixing.mix(table(spark, [])).count() == 0


def test_mixed_documents(spark):
    unique = [r for r in ROWS if r[0] not in (None, 3)]
    docs = table(spark, unique)
    want = {r.doc_id: (r.taken, r.size) for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = collections.Counter()
    texts = {i: t for i, t, _ in unique}
    for r in out.collect():
        n = len(r.text.split())
        words[r.doc_id] += n
        assert r.text == texts[r.doc_id] or (n < want[r.doc_id][1] and texts[r.doc_id].startswith(r.text))
    assert words == collections.Counter({i: n for i, (n, _) in want.items() if n})


def test_mixed_documents_of_null_and_repeated_ids(spark):
    docs = table(spark, ROWS)
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        for at in range(0, r.taken, r.size or 1):
            want[r.doc_id, r.source, min(r.size, r.taken - at)] += 1
    assert any(i is None for i, _, _ in want) and (3, "s1", 1) in want
    got = mixing.mixed_documents(docs).collect()
    assert collections.Counter((r.doc_id, r.source, len(r.text.split())) for r in got) == want
    again = mixing.mixed_documents(table(spark, ROWS[::-1]).repartition(5)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))


def test_targets_share_the_excess():
    assert mixing.targets([10, 90], [1, 1]) == [30.0, 70.0]
    assert mixing.targets([0, 10], [5, 1]) == [0.0, 10.0]
    assert sum(mixing.targets([5, 50, 500], [3, 2, 1])) == 555


URLS = [
    ("https://A.Example.com/en/7/x?q", "a.example.com", "/en/7/x", "example.com/en/7", "allow"),
    ("http://x.com/en/1", "x.com", "/en/1", "com/en/", "block"),
    ("http://com/en/", "com", "/en/", "com/en/", "block"),
    ("http://xcom/en/", "xcom", "/en/", None, "allow"),
    ("http://b.example.net/de/81", "b.example.net", "/de/81", "example.net/de/8", "block"),
    ("http://other.net/de/81", "other.net", "/de/81", "net/de/", "allow"),
    ("http://w.org/ES/", "w.org", "/ES/", None, "allow"),
    ("http://w.org/es/#top", "w.org", "/es/", "org/es/", "block"),
    ("http://w.org?x=/es/", "w.org", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("a://b://c.org/es/", "b:", "//c.org/es/", None, "allow"),
    ("http://" + "long." * 300 + "org/es/" + "p" * 50_000, "long." * 300 + "org", "/es/" + "p" * 50_000, "org/es/", "block"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u[0], "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = {r.page_id: tuple(r[1:]) for r in urls.filter_urls(pages, urls.RULES).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert {r.verdict for r in urls.filter_urls(pages, []).collect()} == {"allow"}
    assert urls.filter_urls(pages.limit(0), urls.RULES).count() == 0


def test_hosts_with_many_labels():
    host = "x." * 20_000 + "a.example.com"
    assert urls.suffixes(host, 2) == ["com", "example.com"] and urls.suffixes("com", 3) == ["com"]
    assert urls.suffixes("a..b", 9) == ["b", ".b", "a..b"] and urls.suffixes(".", 2) == ["", "."] and urls.suffixes("a", 0) == []


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    rules = [urls.Rule("block", f"h{i}.org", "/") for i in range(50)]
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda k, seed: len(k) % 2)
    for name, data in urls.DigestArray.files(rules).items():
        (tmp_path / f"x-{name}").write_bytes(data)
    listed = urls.DigestArray(f"{tmp_path}/x-")
    assert listed.probe([b"h7.org/", b"h77.org/", b"h49.org/"]) == [True, None, True]
