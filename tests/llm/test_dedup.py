"""Exact, fingerprint and similarity dedup against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from oakmill.llm import exactdedup, simhash
from oakmill.llm.common import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names an operator might use itself.
SCHEMA = "doc_id long, text string, part int, run long, norm string, fp long, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "n", 3, "c") for i, t in rows], SCHEMA)


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i % 7].upper()) for i in range(40)]  # hot group
    rows += [(200 + i, texts[9] + " tail") for i in range(30)]
    rows += [(300, None), (301, ""), (302, " \n"), (None, texts[0]), (None, None), (7, texts[7]), (303, "É"), (304, "é")]
    rows.append((305, "long " * 100_000))
    return rows


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(spark, keep):
    rows = corpus()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    pick = min if keep == "smallest" else max
    want = collections.Counter()
    for t, ids in groups.items():
        k = pick((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, k, len(ids), i == k, hashlib.sha256(t.encode()).hexdigest()] += 1
    got = exactdedup.dedup(table(spark, rows), keep).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_keeps_whole_rows(spark, keep):
    rows = corpus()
    docs = table(spark, rows)
    got = exactdedup.keep_one(docs, keep)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert not set(kept) - set(rows)
    texts = [(t or "").translate(LOWER) for _, t in kept]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(LOWER) for _, t in rows})
    pick = min if keep == "smallest" else max
    for (i, _), t in zip(kept, texts, strict=True):
        assert i == pick((j for j, x in rows if (x or "").translate(LOWER) == t and j is not None), default=None)


def fingerprint(text, size=3):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def merged(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark):
    rows = [r for r in corpus() if r[0] != 305]
    fps = [fingerprint(t) for _, t in rows]
    at = merged(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[at[k]] = min(least.get(at[k], i), i)
    want = collections.Counter((i, f"{fps[k]:016x}", least.get(at[k])) for k, (i, _) in enumerate(rows))
    got = simhash.near_dedup(table(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_long_text_fingerprint(spark):
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert simhash.fingerprint(simhash.shingle_hashes(text)) == fingerprint(text)


def test_bit_sliced_distances():
    rng = np.random.default_rng(0)
    for words, radius in ((1, 0), (1, 1), (1, 2), (1, 5), (2, 8), (2, 33)):
        base = rng.integers(0, 2**63, (5, words), dtype=np.uint64)
        fps = base[rng.integers(0, 5, 400)]
        for _ in range(radius + 2):
            flip = rng.integers(0, 64 * words, 400)
            fps[np.arange(400), flip // 64] ^= np.uint64(1) << (flip % 64).astype(np.uint64)
        starts = np.array([0, 1, 2, 70, 200, 400])
        got = {(i, j) for a, b in simhash.near_lanes(fps, starts, radius) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        d = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2)
        want = {(i, j) for x, y in zip(starts, starts[1:]) for i in range(x, y) for j in range(x, i) if d[i, j] <= radius}
        assert got == want


def test_large_buckets_are_dealt_again(spark, monkeypatch):
    """With a small bound every bucket goes through the second deal and gives the same components."""
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 6)
    fps = sorted({int(base[rng.integers(0, 6)]) ^ (1 << int(rng.integers(0, 60))) ^ (1 << int(rng.integers(0, 60))) for _ in range(150)})
    classes = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = merged(fps, [(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2])
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 3)
    roots = {r.node: r.root for r in components(simhash.link_forest(classes)).collect()}
    assert {f: roots.get(f, f) for f in fps} == want


def test_similar(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    rows, i = [], 0
    for _ in range(40):
        base = rng.choices(words, k=200)
        rows.append((i, " ".join(base)))
        i += 1
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            copy[rng.randrange(200)] = "changed"
            rows.append((i, " ".join(copy)))
            i += 1
        half = base[:100] + rng.choices(words, k=100)  # shares a passage, isn't alike
        rows.append((i, " ".join(half)))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "one two"), (i + 3, "ONE  two")]
    sets = {k: set(map(tuple, simhash.wide_hashes(t, 5).tolist())) for k, t in rows}

    def alike(a, b):
        both = len(sets[a] | sets[b])
        return not both or len(sets[a] & sets[b]) / both >= 0.8

    at = merged(list(sets), [(a, b) for a in sets for b in sets if a < b and alike(a, b)])
    docs = table(spark, rows)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(at.values()))


def kept_by_brute_force(rows):
    sets = [set(map(tuple, simhash.wide_hashes(t, 5).tolist())) for _, t in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common / (len(sets[a]) + len(sets[b]) - common) >= 0.8:
                links.append((a, b))
    at = merged(range(len(rows)), links)
    return sorted(rows[i][0] for i in set(at.values()))


def test_similar_among_siblings(spark):
    """Texts that share a template, and are refused, don't hide a true partner."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]

    def changed(words, n):
        out = list(words)
        for at in rng.sample(range(300), n):
            out[at] = f"x{rng.random()}"
        return out

    siblings = [changed(base, 5) for _ in range(400)]
    texts = siblings + [changed(s, 6) for s in siblings[:60]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = sorted(r.doc_id for r in simhash.keep_one(table(spark, rows)).collect())
    want = kept_by_brute_force(rows)
    assert len(want) < 420
    assert got == want


def test_similar_in_tiles_and_other_partitions(spark, monkeypatch):
    """Buckets of many tiles, texts with many true neighbours and long ones: as brute force, however the rows are dealt."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    rows, texts = [], []
    for _ in range(120):  # around one text: some alike, many not quite
        out = list(base)
        for at in rng.sample(range(200), rng.choice([1, 2, 6, 9])):
            out[at] = f"x{rng.random()}"
        texts.append(out)
    texts += [[f"long{i}" for i in range(k, 1500 + k)] for k in range(0, 240, 40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(500, " ".join(texts[3])), (None, " ".join(texts[3]))]
    want = kept_by_brute_force(rows[:-1])
    assert 2 < len(want) < 120
    for tile, hashes, parts in ((1024, 800_000, 1), (16, 3_000, 5), (7, 1_000, 3)):
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "TILE_HASHES", hashes)
        rng.shuffle(rows)
        assert sorted(r.doc_id for r in simhash.keep_one(table(spark, rows).repartition(parts)).collect()) == want


def test_similar_recall(spark):
    """Links at 0.8 or more among 10,000 documents, found by an inverted list of all shingles: 0.99 of them are in one group, and groups hold no others."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    group = {r.doc_id: r.component for r in simhash.similar_groups(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    sizes, holders = {}, collections.defaultdict(list)
    first = {}  # equal texts are one
    for i, t in sorted(texts.items()):
        key = " ".join((t or "").translate(LOWER).split())
        if first.setdefault(key, i) == i:
            own = simhash.wide_hashes(t, 5)[:, 0].tolist()
            sizes[i] = len(own)
            for h in own:
                holders[h].append(i)
        else:
            assert group[i] == group[first[key]]
    common = collections.Counter()
    for of in holders.values():
        for k, a in enumerate(of):
            for b in of[:k]:
                common[b, a] += 1
    links = [(a, b) for (a, b), n in common.items() if n / (sizes[a] + sizes[b] - n) >= 0.8]
    assert len(links) >= 40
    assert sum(group[a] == group[b] for a, b in links) >= 0.99 * len(links)
    whole = merged(list(sizes), links)
    of_group = {}
    for i in sizes:
        assert of_group.setdefault(group[i], whole[i]) == whole[i]


def test_bands_meet_at_the_threshold():
    """Pairs at 0.8 meet in a band with the chance that MEET names; nothing in it depends on the number of texts."""
    rng = np.random.default_rng(3)
    chosen, met = simhash.bands(), 0
    for _ in range(3000):
        h = rng.integers(0, 2**63, (360, 2), dtype=np.uint64) << np.uint64(1)
        a, b = h[:324], np.r_[h[:288], h[324:]]
        met += (simhash.band_keys(a, chosen) == simhash.band_keys(b, chosen)).any()
    assert met >= 2997


def test_similar_long_texts(spark):
    """Texts of thousands of shingles are linked by their true similarity, close to the threshold on either side."""
    rows = []
    for k in range(30):
        base = [f"b{k}w{i}" for i in range(5004)]
        lost = (530, 580)[k % 2]  # 0.808 and 0.792
        rows.append((2 * k, " ".join(base)))
        rows.append((2 * k + 1, " ".join(base[lost - 4 :] + [f"n{k}x{i}" for i in range(lost - 4)])))
    got = sorted(r.doc_id for r in simhash.keep_one(table(spark, rows)).collect())
    want = kept_by_brute_force(rows)
    assert len(want) == 45
    assert got == want


def test_empty(spark):
    docs = table(spark, [])
    assert exactdedup.dedup(docs).count() == 0 and exactdedup.keep_one(docs).count() == 0
    assert simhash.near_dedup(docs).count() == 0 and simhash.keep_one(docs).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(200, 300 + i) for i in range(100)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {200: 200} | {300 + i: 200 for i in range(100)}
