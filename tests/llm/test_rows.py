"""Rows of queries against SQL, and against plain Python over whole small tables."""

import collections
import itertools
import math
import os
import random
import struct

import duckdb
import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
from oakmill.llm import chat, mixing, queries


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_give_the_rows_of_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = collections.Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert collections.Counter(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want


def spark_hash(*values):
    """Spark's xxhash64 of numbers (kind, value) and strings; nulls are passed over."""
    h = 42
    for v in values:
        if isinstance(v, str):
            h = xxhash.xxh64_intdigest(v.encode(), h)
        elif v is not None and v[1] is not None:
            h = xxhash.xxh64_intdigest(struct.pack(f"<{v[0]}", v[1]), h)
    return h - 2**64 if h >= 2**63 else h


def highest_quotients(weights, seats, most):
    """Sainte-Lague one block at a time."""
    got = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if got[i] < most[i] and weights[i] > 0]
        if not open_:
            break
        got[max(open_, key=lambda i: (weights[i] / (2 * got[i] + 1), -i))] += 1
    return got


MIXED = [
    (i if i % 23 else None, None if i % 17 == 0 else f"text {i} " * (i % 9), None if i % 19 == 0 else f"s{min(i % 9, 3)}") for i in range(500)
] + [(7, "same words", "s1")] * 60 + [(7, f"other {i}", "s1") for i in range(40)] + [(9000, "w " * 3000, "s2")]


def shares_of(rows, per_shard):
    """Words taken of each row, as a multiset of (id, size, source, taken)."""
    size = [len((t or "").split()) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    of = {s: [k for k, r in enumerate(rows) if r[2] == s] for s in names}
    total = {s: sum(size[k] for k in of[s]) for s in names}
    goal = mixing.targets([total[s] for s in names], [i % 3 + 1 for i in range(len(names))])
    block = mixing.block_of(goal)
    quota = highest_quotients(goal, round(sum(goal) / block), [-(-3 * total[s] // block) for s in names])
    out = collections.Counter()
    for s, q in zip(names, quota, strict=True):
        shards = -(-len(of[s]) // per_shard)
        key = {k: (("q", rows[k][0]), ("q", size[k]), ("q", spark_hash(rows[k][1]))) for k in of[s]}
        own = collections.defaultdict(list)
        for k in of[s]:
            own[spark_hash(("i", mixing.SEED), *key[k]) % shards].append(k)
        ordered = sorted(own)
        z = [sum(size[k] for k in own[h]) for h in ordered]
        for h, stream, n in zip(ordered, z, highest_quotients(z, q, [-(-3 * x // block) for x in z]), strict=True):
            take = min(n * block, 3 * stream)
            passes, rest = divmod(take, stream) if stream else (0, 0)
            for k in sorted(own[h], key=lambda k: spark_hash(("i", mixing.SEED + 1), *key[k])):
                out[rows[k][0], size[k], s, size[k] * passes + max(0, min(size[k], rest))] += 1
                rest -= size[k]
    return out


def mixed(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, no int, taken long")


@pytest.mark.parametrize("rows", [MIXED, [(i, "one two three", f"s{i % 2}") for i in range(4)]], ids=["hot ids", "four texts"])
def test_mix_as_in_plain_python(spark, monkeypatch, rows):
    monkeypatch.setattr(mixing, "shard_rows", lambda n: 60)
    got = mixing.mix(mixed(spark, rows).repartition(3)).collect()
    want = shares_of(rows, 60)
    assert collections.Counter((r.doc_id, r.size, r.source, r.taken) for r in got) == want
    texts = collections.Counter()
    for (i, size, source, taken), n in want.items():
        for at in range(0, taken, size or 1):
            texts[i, source, min(size, taken - at)] += n
    out = mixing.mixed_documents(mixed(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.source, len(r.text.split())) for r in out) == texts


def test_a_small_corpus_is_not_emptied(spark):
    rows = [(i, "one two three", f"s{i % 2}") for i in range(4)]
    taken = collections.Counter()
    for r in mixing.mix(mixed(spark, rows)).collect():
        taken[r.source] += r.taken
    assert taken == {"s0": 4, "s1": 8}


def test_transcripts_as_in_plain_python(spark):
    """Every turn of whole transcripts, decoded in one piece; ids repeat and are null, and rows are equal."""
    rng = random.Random(9)
    roles = [None, "user", "assistant", "Robot", "system", "Human:"]
    rows = [(rng.randrange(12), rng.randrange(6), rng.choice(roles), rng.choice(["why?", "so\n- one\nuser: two", "", None, "AI: fine"])) for _ in range(300)]
    rows += [(None, k % 5, "user", "no id") for k in range(40)] + [(3, 2, "user", "equal row")] * 50
    null_first = lambda v: (v is not None, v if v is not None else 0)
    text_first = lambda v: (v is not None, v or "")
    order = sorted(rows, key=lambda r: (null_first(r[0]), null_first(r[1]), text_first(r[2]), spark_hash(r[2], r[3]), text_first(r[3])))
    talks = [list(g) for _, g in itertools.groupby(order, key=lambda r: r[0])]
    counts = np.zeros(sum(chat.Model.SIZES))
    coded = []
    for talk in talks:
        codes = [chat.observe(m, t) for _, _, m, t in talk]
        known = [k if 0 < (k := chat.marker_class(m)) < chat.CLASSES - 1 else 0 for _, _, m, _ in talk]
        counts += chat._count(codes, known, None, True)
        coded.append(codes)
    model = chat.Model(counts)
    want = collections.Counter()
    for talk, codes in zip(talks, coded, strict=True):
        states = model.decode([c for row in codes for c in row], chat.START, None)
        at = 0
        for (i, turn, _, text), row in zip(talk, codes, strict=True):
            for part, (role, said) in enumerate(chat.turns_of(text, states[at : at + len(row)])):
                want[i, turn, part, role, said, chat.render(role, said)] += 1
            at += len(row)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, h long, place long").repartition(4)
    for chunk_rows in (4, 1024):
        got = collections.Counter(tuple(r) for r in chat.parse(docs, chunk_rows=chunk_rows).collect())
        assert got == want


def test_logs_are_finite():
    assert math.isfinite(chat.Model(np.zeros(sum(chat.Model.SIZES))).emit[chat.CLASSES * chat.SHAPES].max())
