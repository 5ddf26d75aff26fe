"""Transcripts, language-model scores, quality, embeddings, and the pipeline."""

import collections
import itertools
import math
import random
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oakmill.llm import chat, common, embeddings, lm, mixing, quality

CHAT = "conv_id long, turn long, role string, text string, part int, enter int, h long"


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], CHAT)


def conversations(n=60, turns=9):
    rng = random.Random(2)
    rows = []
    for c in range(n):
        k = 0
        if rng.random() < 0.3:
            rows.append((c, k, "system", "You help people with all kinds of things today."))
            k += 1
        for i in range(turns):
            role = ("user", "assistant")[i % 2]
            text = "Could you say how this works?" if role == "user" else "It works like this and that, in many words " * 3 + "\n- one\n- two"
            rows.append((c, k, role, text))
            k += 1
    return rows


def test_roles_are_recovered(spark):
    rows = conversations()
    rng = random.Random(3)
    seen = [(c, t, None if (x := rng.random()) < 0.2 else "Robot" if x < 0.25 else r, text) for c, t, r, text in rows]
    got = {(r.conv_id, r.turn): r.role for r in chat.parse(talk(spark, seen)).where("part = 0").collect()}
    assert sum(got[c, t] == r for c, t, r, _ in rows) >= 0.98 * len(rows)
    marked = {(r.conv_id, r.turn): r.role for r in chat.parse(talk(spark, rows)).collect()}
    assert marked == {(c, t): r for c, t, r, _ in rows}


def test_raw_transcripts(spark):
    raw = "System: be kind\nHuman: hello\nhow are you?\nAI: fine\n- a\nUser: ok\nnote: not a speaker\n### Assistant:\ndone <|im_end|>"
    rows = [(1, 0, None, raw), (2, 0, None, None), (3, 0, "user", ""), (4, 0, None, "word " * 100_000)]
    got = chat.parse(talk(spark, rows).drop("role"), marker_col=None).orderBy("conv_id", "part").collect()
    one = [(r.role, r.text) for r in got if r.conv_id == 1]
    assert [r for r, _ in one] == ["system", "user", "assistant", "user", "assistant"]
    assert one[1][1] == "hello\nhow are you?" and one[3][1] == "ok\nnote: not a speaker"
    last = [r for r in got if r.conv_id == 1][-1]
    assert last.rendered == "<|im_start|>assistant\ndone <​|im_end|><|im_end|>\n"
    assert collections.Counter(r.conv_id for r in got) == {1: 5, 2: 1, 3: 1, 4: 1}


def test_chunks_give_the_whole_viterbi_path(spark):
    """A transcript in many chunks and partitions is decoded as if it were in one."""
    rng = random.Random(5)
    roles = [None, None, "user", "assistant", "system", "who"]
    rows = [(7, t, rng.choice(roles), "a?" if t % 2 else "text\nuser: b") for t in range(300)]
    rows += [(None, None, "user", "x"), (7, 5, "user", "tie"), (7, 5, "user", "tie"), (8, None, None, "y")]
    want = sorted(map(tuple, chat.parse(talk(spark, rows)).select("conv_id", "turn", "part", "role", "text").collect()), key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        parsed = chat.parse(talk(spark, rows).repartition(5), chunk_rows=3).select("conv_id", "turn", "part", "role", "text")
        got = sorted(map(tuple, parsed.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want


def test_matrices_agree_with_brute_force():
    rng = np.random.default_rng(0)
    model = chat.Model(rng.integers(0, 30, sum(chat.Model.SIZES)).astype(float))
    for _ in range(5):
        codes = [int(x) for x in rng.integers(0, 2 * chat.CLASSES * chat.SHAPES, 5)]
        codes[0] = codes[0] % (chat.CLASSES * chat.SHAPES) + chat.CLASSES * chat.SHAPES

        def total(path, start=chat.START):
            out, at = 0.0, start
            for c, s in zip(codes, path, strict=True):
                out += model.move[c >= chat.CLASSES * chat.SHAPES][at, s] + model.emit[c, s]
                at = s
            return out

        paths = list(itertools.product(range(chat.STATES), repeat=5))
        best = max(map(total, paths))
        assert total(model.decode(codes, chat.START, None)) == pytest.approx(best)
        m = model.matrix(codes[:2])[chat.START][:, None] + model.matrix(codes[2:])[: chat.START]
        assert m.max() == pytest.approx(best)


def test_empty_chat(spark):
    assert chat.parse(talk(spark, [])).count() == 0


DOCS = "doc_id long, text string, lang string, block long, words string, score double, held boolean"


def texts(spark, rows):
    return spark.createDataFrame([(*r, 1, "w", 0.5, True) for r in rows], DOCS)


LM_ROWS = [(i, f"the word {i % 7} Naïve {'x' * (i % 5)} lang", "en" if i % 3 else "fr") for i in range(60)] + [
    (60, None, "en"), (61, "", None), (62, " \n ", "en"), (None, "no id", "de"), (3, "again", "en"), (63, "z" * 3000 + " end", "en"),
]


def test_lattice_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b" a", b"ab", b"ba", b" ab"]
    scores = lm.scores(np.arange(1, 15, dtype=float).reshape(7, 2), pieces)

    def brute(word, scores):
        text, out = lm.MARK + word, 0.0
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
            parts = [text[a:b] for a, b in zip(at, at[1:])]
            if all(p in pieces for p in parts):
                out += math.exp(sum(scores[pieces.index(p), int(b == len(text))] for p, b in zip(parts, at[1:])))
        return out

    words = [b"a", b"ab", b"aba", b"babab", b"b"]
    lattice = lm.Lattice(pieces)
    flat = np.stack([scores.reshape(-1), scores.reshape(-1)[::-1]], 1)
    got = np.exp(lattice.log_probability(words, flat))
    for k in range(2):
        assert got[:, k] == pytest.approx([brute(w, flat[:, k].reshape(-1, 2)) for w in words])
    # expected uses are the derivative of the log probability by the score
    total = np.zeros(flat.shape)
    lattice.expect(words, np.tile([[1.0, 2.0]], (5, 1)), flat, total)
    for at in range(14):
        up = flat.copy()
        up[at] += 1e-6
        change = (lattice.log_probability(words, up) - lattice.log_probability(words, flat)).sum(0) / 1e-6
        assert total[at] == pytest.approx(change * [1, 2], abs=1e-4)


def test_lm(spark):
    got = lm.score(texts(spark, LM_ROWS)).collect()
    assert len(got) == len(LM_ROWS)
    count, n, docs = collections.Counter(), 0, 0
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = [(i, (t or "").translate(low).split(), zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1) for i, t, _ in LM_ROWS]
    for _, words, held in split:
        if not held:
            count.update([*words, None])
    total, kinds = sum(count.values()), len(count)
    want = collections.Counter(
        (i, held, len(w) + 1, sum(count[x] > 0 for x in [*w, None]), total,
         round(sum(math.log10((count[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in [*w, None]), 6))
        for i, w, held in split
    )
    assert want == collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    options = {"iterations": 2, "known_words": True, "part_col": "lang"}
    got = lm.score(texts(spark, LM_ROWS), **options).collect()
    again = {r.doc_id: r.score for r in lm.score(texts(spark, LM_ROWS[::-1]).repartition(3), **options).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, rel=1e-8) for r in got if r.doc_id not in (3, None))


def test_halves_keep_ten_digits():
    x = -np.random.default_rng(1).exponential(30, 10_000)
    assert np.abs(lm.joined(*lm.halves(x)) / x - 1).max() < 1e-10
    assert lm.joined(*lm.halves(np.array([-20_000.123456789])))[0] == pytest.approx(-20_000.123456789, rel=1e-10)


def spelling(word, weights, longest):
    """Log of the sum over all segmentations of a word, by plain recursion over its ends."""
    text, ways = lm.MARK + word, [0.0]
    for end in range(1, len(text) + 1):
        into = [ways[k] + weights[text[k:end], end == len(text)] for k in range(max(0, end - longest), end) if (text[k:end], True) in weights]
        top = max(into)
        ways.append(top + math.log(sum(math.exp(x - top) for x in into)))
    return ways[-1]


@pytest.mark.parametrize(("known_words", "part_col"), [(False, None), (True, None), (True, "lang")])
def test_lm_scores_of_whole_documents(spark, known_words, part_col):
    """Each document's score, against lattices of plain Python over the vocabulary's own scores, summed over the parts."""
    pieces, ranks = lm.vocabulary(public_tokenizers.path(lm.VOCABULARY))
    scored = lm.scores(np.repeat(ranks[:, None], 2, 1), pieces)
    weights = {(p, bool(last)): scored[k, last] for k, p in enumerate(pieces) for last in (0, 1)}
    longest = max(map(len, pieces))
    rows = [r for r in LM_ROWS if r[0] not in (3, 63)] + [(64, "zz" * 40 + " End 漢字 😀 " * 300, "en")]
    split = [(i, lm.words_of(t), lm.is_held_out(i), g if part_col else None) for i, t, g in rows]
    spelled = {w: spelling(w, weights, longest) for _, words, _, _ in split for w in words}
    parts = {g for _, _, _, g in split}
    ends = {g: sum(not held and g == x for _, _, held, x in split) for g in parts}
    want = collections.defaultdict(list)
    for g in parts:
        count = collections.Counter(w for _, words, held, x in split if not held and x == g for w in words)
        size, kinds = sum(count.values()), len(count)
        stop = (ends[g] + 0.5) / (size + ends[g] + 1)
        known = size / max(1, size + kinds) if known_words else 0.0
        log_p = {
            w: np.logaddexp(math.log((1 - stop) * (1 - known)) + x, math.log((1 - stop) * known * count[w] / size) if known and count[w] else -np.inf)
            for w, x in spelled.items()
        }
        prior = math.log((ends[g] + 1) / sum(n + 1 for n in ends.values()))
        for i, words, _, _ in split:
            want[i].append(prior + math.log(stop) + sum(log_p[w] for w in words))
    want = {i: float(np.logaddexp.reduce(x)) / math.log(10) for i, x in want.items()}
    got = {r.doc_id: r.score for r in lm.score(texts(spark, rows), known_words=known_words, part_col=part_col).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(x, rel=1e-8) for i, x in want.items())


def test_lm_hot_words_in_many_blocks(spark, monkeypatch):
    """A word of all documents, in blocks of a document or two that are dealt in shares, gives the same scores as in one block."""
    options = {"known_words": True, "iterations": 1, "part_col": "lang"}
    want = {r.doc_id: (r.score, r.base_score, r.n_known) for r in lm.score(texts(spark, LM_ROWS), **options).collect()}
    monkeypatch.setattr(lm, "BLOCK_BYTES", 30)
    monkeypatch.setattr(lm, "SHARE_BLOCKS", 8)
    got = {r.doc_id: (r.score, r.base_score, r.n_known) for r in lm.score(texts(spark, LM_ROWS).coalesce(1), **options).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-8) for k in want if k != 3)


def test_lm_holds_little_at_a_time(spark, monkeypatch):
    """Rows of a block, words that are spelled together and their places are bounded, whatever a block holds."""
    rows = [(i, " ".join(f"w{j}" for j in range(i, i + 3000)), "en") for i in range(200)] + [(200, None, "en"), (201, "a", "en")]
    got = lm.blocks_of(texts(spark, rows).coalesce(1).select("doc_id", "text", "lang"), {"en": 0}).collect()
    words = sorted((r for r in got if r.words), key=lambda r: (r.block, r["first"]))
    assert max(len(r.words) for r in words) <= 32 and max(len(r.pairs) for r in got if r.pairs is not None) <= 1 << 20
    assert [bytes(w).decode() for r in words for w in r.words] == [f"w{j}" for j in range(3199)] + ["a"]
    assert [i for r in got for i in r.doc_ids or []] == list(range(202)) and sum(r.ends is not None for r in got) == 1
    counts = {bytes(w).decode(): c[0] for r in words for w, c in zip(r.words, r.train, strict=True)}
    train = [i for i, _, _ in rows[:200] if not lm.is_held_out(i)]
    assert all(counts[f"w{j}"] == sum(i <= j < i + 3000 for i in train) for j in range(0, 3199, 7))
    lattice, chars = lm.lattice(public_tokenizers.path(lm.VOCABULARY)), []
    monkeypatch.setattr(lm.Lattice, "forward", lambda self, words, scores: (chars.append(sum(map(len, words))), np.zeros((len(words), 1))[None])[1])
    assert lattice.log_probability([b"x" * 5000] * 100 + [b"y"] * 5000, np.zeros((1, 1))).shape == (5100, 1)
    assert max(chars) <= 1 << 16 and sum(chars) == 505_000


def test_lm_gives_memory_back_after_each_block(monkeypatch):
    events = []
    monkeypatch.setattr(lm, "BLOCK_BYTES", 30)
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(lm, "tidy", lambda: events.append("tidy"))
    gather = lm.blocks_of(SimpleNamespace(mapInArrow=lambda f, _: f), {"en": 0})
    docs = pa.RecordBatch.from_pydict({"id": range(9), "text": ["some words of a text that fill a block"] * 9, "part": ["en"] * 9})
    for b in gather(iter([docs])):
        if b["ends"][0].is_valid:
            events.append("block")
    assert events[:18] == ["block", "tidy"] * 9


def test_lm_spells_few_places_at_a_time(monkeypatch):
    monkeypatch.setattr(lm, "BATCH_PLACES", 100)
    lists = [[{"block": b, "local": i} for b in range(n)] for i, n in enumerate([40, 60, 1, 99, 150, *[0] * 3, 30, 70, 1])]
    kind = pa.list_(pa.struct([("block", pa.int64()), ("local", pa.int32())]))
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, kind)], names=["word", "places"])
    got = list(lm.batches_of(iter([whole, whole.slice(0, 0), whole.slice(2, 3)])))
    assert [x for t in got for x in t["word"].to_pylist()] == [*range(len(lists)), 2, 3, 4]
    assert [x for t in got for x in t["places"].to_pylist()] == lists + lists[2:5]
    assert all(sum(map(len, t["places"].to_pylist())) <= 100 or len(t) == 1 for t in got)


def test_lm_beats_word_counts_on_held_out_text(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = lm.score(docs, iterations=lm.ITERATIONS, known_words=True, part_col="lang").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert row.s / row.n > row.b / row.n


def test_lm_without_training(spark):
    held = next(i for i in range(50) if lm.is_held_out(i))
    r = lm.score(texts(spark, [(held, "abc", "en")])).first()
    assert (r.held_out, r.train_tokens, r.n_known) == (True, 0, 0) and r.score < 0
    assert lm.score(texts(spark, [])).count() == 0


def test_vocabulary_spells_all_bytes():
    pieces, weights = lm.vocabulary(public_tokenizers.path(lm.VOCABULARY))
    assert len(pieces) == len(set(pieces)) == len(weights) and {bytes([b]) for b in range(256)} <= set(pieces)


QUALITY = "doc_id long, text string, source string, lang string, n long, s double, oak_host string, oak_kept string, x string"


def test_quality(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(800):
        bad = i % 4 == 0
        text = " ".join(rng.choices(words, k=60)) if not bad else " ".join(w + "***" for w in rng.choices(words, k=60))
        rows.append((i, text + ("" if bad else "."), None if i % 50 == 0 else f"s{min(i % 20, 9)}", None if i % 30 == 0 else "en", 1, 2.0, "h", "k", "x"))
        if i < 400:
            labels.append((i, None if i % 90 == 1 else int(not bad), "clash"))
    rows += [(900, None, "s1", "en", 1, 2.0, "h", "k", "x"), (901, "", None, None, 1, 2.0, "h", "k", "x"), (None, "w " * 99_999, "s1", "en", 1, 2.0, "h", "k", "x")]
    docs = spark.createDataFrame(rows, QUALITY)
    known = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    got = quality.judge(docs, known).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and 400 <= r.doc_id < 800]
    assert sum(r.oak_kept == (r.doc_id % 4 != 0) for r in held) >= 0.99 * len(held)
    # a small site is near the prior, whatever its own documents say
    assert all(0 < r.oak_site < 1 and 0 <= r.oak_posterior <= 1 for r in got)
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r.oak_kept for r in got)
    assert quality.keep_good(docs, known.limit(0)).count() == len(rows)
    assert quality.keep_good(docs.limit(0), known).count() == 0


def test_sites_move_the_posterior(spark):
    """The same doubtful evidence counts for more on a good site than on a bad one."""
    rows = []
    for i in range(400):
        good = i % 2 == 0
        text = "plain words that go on and on here. " * 4 if good else "bad*** stuff### here&&& now%%% " * 6
        rows.append((i, text, "good.org" if good else "bad.org", "en"))
    rows += [(1000, "short one.", "good.org", "en"), (1001, "short one.", "bad.org", "en"), (1002, "short one.", "rare.org", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(200)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).where("doc_id >= 1000").collect()}
    assert got[1000].oak_evidence == got[1001].oak_evidence
    assert got[1000].oak_site > got[1002].oak_site > got[1001].oak_site
    assert got[1000].oak_posterior > got[1001].oak_posterior


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2))
    got = quality.judge(docs, labels.where(half == 0)).join(labels.where(half == 1), "doc_id").collect()
    assert sum(r.oak_kept == (r.quality > 0) for r in got) >= 0.97 * len(got)
    assert sum(r.oak_kept for r in got if r.quality > 0) >= 0.99 * sum(r.quality > 0 for r in got)


def vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 16)).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    k = 300
    for i in range(150):  # near copies, one of them of a large group
        v = base[0] if i < 80 else base[i]
        rows.append((k, (v + rng.standard_normal(16) * 0.02 * np.linalg.norm(v)).astype(np.float32).tolist(), 0 if i < 80 else i % 3))
        k += 1
    rows += [(k + i, base[5].tolist(), 2) for i in range(40)]  # equal vectors
    k += 40
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    rows += [(k + i, v, 0) for i, v in enumerate(odd)]
    rows += [(k + 20, base[1].tolist(), None), (None, base[1].tolist(), 1), (1, base[1].tolist(), 1), (k + 21, (base[7] * 3).tolist(), 1)]
    return rows


def test_digits_count_over_the_whole_text():
    late = "word " * 1000 + "12345 ٣ " * 200
    joined = "".join(late.split())
    last = quality.SHAPES - 1
    assert quality.features(late)[last] == pytest.approx(sum(map(str.isdigit, joined)) / len(joined))
    assert quality.features("a" * 3000 + "77")[last] == pytest.approx(2 / 3002)


def shrunken(groups, parents):
    """Prior strength of groups (n, s, ss) below their parents' means, by the method of moments."""
    n, s, ss = (np.array([g[k] for g in groups], float) for k in range(3))
    if len(n) < 2 or n.sum() <= len(n):
        return 100.0
    mean, inside = s.sum() / n.sum(), (ss - s * s / n).sum() / (n.sum() - len(n))
    effective = n.sum() - (n * n).sum() / n.sum()
    tau = ((n * (s / n - np.array(parents)) ** 2).sum() - (len(n) - 1) * inside) / effective if effective > 0 else 0
    return min(max(mean * (1 - mean) / tau - 1, 2), 1e6) if tau > 0 else 1e6


def test_sites_are_shrunk_as_in_plain_python(spark):
    """Many sparse hosts with many paths each, one hot host, null hosts and paths."""
    rng = random.Random(8)
    rows = []
    for i in range(900):
        host = "hot" if i % 3 == 0 else None if i % 40 == 1 else f"h{rng.randrange(150)}"
        good = rng.random() < (0.9 if host and host < "h5" else 0.3)
        text = " ".join(rng.choices([f"w{k}" for k in range(80)] if good else [f"w{k}##" for k in range(80)], k=rng.randint(3, 30)))
        rows.append((i if i % 50 else None, text, host, None if i % 31 == 0 else f"/p{rng.randrange(12)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int("##" not in rows[i][1]), 0) for i in range(300)], "doc_id long, quality int, c0 int")
    got = quality.judge(docs, labels).collect()
    model = quality.fit(docs, labels)
    p = [1 / (1 + math.exp(-(r.oak_evidence + model.prior))) for r in got]
    total = sum(p) / len(p)
    paths = collections.defaultdict(lambda: [0, 0.0, 0.0])
    for r, x in zip(got, p, strict=True):
        for k, v in enumerate((1, x, x * x)):
            paths[r.source, r.lang][k] += v
    hosts = collections.defaultdict(lambda: [0, 0.0, 0.0])
    for (h, _), g in paths.items():
        for k in range(3):
            hosts[h][k] += g[k]
    strong = shrunken(list(hosts.values()), [total] * len(hosts))
    mean = {h: (strong * total + s) / (strong + n) for h, (n, s, _) in hosts.items()}
    below = shrunken(list(paths.values()), [mean[h] for h, _ in paths])
    assert len(hosts) > 100 and len(paths) > 400
    for r, x in zip(got, p, strict=True):
        n, s, _ = paths[r.source, r.lang]
        site = min(max((below * mean[r.source] + s - x) / (below + n - 1), 1e-6), 1 - 1e-6)
        assert r.oak_site == pytest.approx(site, rel=1e-9)
        assert r.oak_posterior == pytest.approx(1 / (1 + math.exp(-r.oak_evidence) * (1 - site) / site), rel=1e-9)
        assert r.oak_kept == (r.oak_posterior >= 0.5)


def test_training_is_bounded_under_repeated_ids(spark):
    """Labels and documents that repeat an id give one row to train on."""
    docs = spark.createDataFrame([(1, f"good text {i}.") for i in range(300)] + [(2, "bad*** %%%")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(2, 0), (2, 0), (None, 1), (1, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model.prior == pytest.approx(0.0)


def test_embeddings(spark, monkeypatch):
    rows = vectors()
    schema = "vec_id long, embedding array<float>, label int, cid long, dim int, members long, leaf long"
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], schema)

    def sound(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    x = [np.array(v, np.float64) / np.linalg.norm(v) if sound(v) else None for _, v, _ in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(len(rows))
        if i != j and rows[i][2] is not None and rows[i][2] == rows[j][2] and x[i] is not None and x[j] is not None
        and len(x[i]) == len(x[j]) and (rows[i][1] == rows[j][1] or x[i] @ x[j] >= 0.98)
    ]
    degree = collections.Counter(i for i, _ in links)
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if root[j] < root[i]:
                root[i], changed = root[j], True
    least = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            least[root[i]] = min(least.get(root[i], v), v)
    want = collections.Counter((v, degree[i], least.get(root[i]), v == least.get(root[i])) for i, (v, _, _) in enumerate(rows))
    for most in (512, 20):  # with and without tiles
        monkeypatch.setattr(embeddings, "LEAF_MOST", most)
        monkeypatch.setattr(embeddings, "TILE", 16)
        monkeypatch.setattr(embeddings, "LEAF", 32)
        got = collections.Counter(tuple(r) for r in embeddings.near_dedup(df).collect())
        assert sum((got & want).values()) >= 0.98 * len(rows)
        assert sum(n * c for (_, n, _, _), c in got.items()) <= len(links)
        assert sum(n * c for (_, n, _, _), c in got.items()) >= 0.98 * len(links)
    assert embeddings.near_dedup(df.limit(0)).count() == 0


def test_embeddings_recall(spark):
    d = "/root/testdata/sf0.1/embeddings.parquet"
    got = {r.vec_id: r.n_links for r in embeddings.near_dedup(spark.read.parquet(d)).collect()}
    rows = spark.read.parquet(d).collect()
    links = found = 0
    for label in {r.label for r in rows}:
        own = [r for r in rows if r.label == label]
        x = np.array([r.embedding for r in own], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        n = (x @ x.T >= 0.98).sum(1) - 1
        for r, k in zip(own, n, strict=True):
            assert got[r.vec_id] <= k
            links += k
            found += got[r.vec_id]
    assert found >= 0.9 * links


def test_embeddings_recall_in_a_dense_group(spark):
    """A third of a large label in one group of near copies: links are found in it as well."""
    rng = np.random.default_rng(5)
    rest, group = rng.standard_normal((20_000, 64)), 10_000
    centre = rng.standard_normal(64)
    near = centre / np.linalg.norm(centre) + rng.standard_normal((group, 64)) * 0.128 / 8
    x = np.concatenate([near, rest])
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: r.n_links for r in embeddings.near_dedup(df).where(F.col("vec_id") < group).collect()}
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    want = (near @ near.T >= 0.98).sum(1) - 1
    assert all(got[i] <= n for i, n in enumerate(want.tolist()))
    assert sum(got.values()) >= 0.99 * want.sum(), sum(got.values()) / want.sum()


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], sf_dir).cache()
        out.count()
        if name != "packing":
            assert sorted(out.columns) == sorted(columns)
        kept.append(out)
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = {i for i in ids[0] if labels.get(i) == 1}
    assert len(good & ids[1]) >= 0.98 * len(good)
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert {r[0] for r in kept[1].groupBy(low.alias("t")).agg(F.min("doc_id").alias("i")).select("i").collect()} == ids[2]
    taken = {r.doc_id: r.taken for r in mixing.mix(kept[3]).collect()}
    words = collections.Counter()
    for r in kept[4].collect():
        words[r.doc_id] += len(r.text.split())
    assert words == collections.Counter({i: n for i, n in taken.items() if n})
    assert kept[5].agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    again = corpus_pipeline.run(spark, sf_dir)
    assert again.exceptAll(kept[5]).count() == 0 and again.count() == kept[5].count()


def through_all_stages(spark, docs, sf_dir):
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(common.cut_lineage(stage(spark, kept[-1], sf_dir), "stage"))
        if name != "packing":
            assert kept[-1].dtypes == docs.dtypes
    return kept


def test_pipeline_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    assert [k.count() for k in through_all_stages(spark, docs, sf_dir)] == [0] * 6


def test_pipeline_on_odd_rows(spark, sf_dir):
    """Null and repeated ids, null columns, equal rows, empty and long texts, columns named as the operators' own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = docs.where("length(text) between 300 and 900").first().text
    long = " ".join(f"{text} {i}" for i in range(200))
    odd = [(None, text, "en", "src1", None), (None, None, None, None, 0), (5, "", "en", None, 0), (5, text + " more", None, "src1", 3)]
    odd += [(7, text, "en", "src1", 1)] * 20 + [(None, long, "en", "src2", 5), (8, long + " end", "en", "src2", 5)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({n: F.lit(1) for n in ("row", "tie", "size", "host", "evidence", "at", "part")})
    kept = through_all_stages(spark, docs, sf_dir)
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    distinct = kept[1].select(F.coalesce(low, F.lit("")).alias("t")).distinct().count()
    assert kept[2].count() == distinct and kept[3].count() <= distinct
    rows = kept[3].where(F.col("text") == text).collect() + kept[3].where(F.col("text") == long).collect()
    assert len(rows) <= 2  # one of the copies, one of the long texts at most
    # mixing: words of each row that stays are taken as op3 says
    want = collections.Counter((r.doc_id, r.source, min(r.size, r.taken - at)) for r in mixing.mix(kept[3]).collect() for at in range(0, r.taken, r.size or 1))
    assert collections.Counter((r.doc_id, r.source, len(r.text.split())) for r in kept[4].collect()) == want
    pieces = kept[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.sum(F.when(F.col("start") == 0, F.col("doc_tokens"))).alias("m")).collect()
    assert pieces and all(r.n == r.m for r in pieces)
