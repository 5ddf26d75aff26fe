"""Transcript parsing: a hidden Markov model recovers roles, then turns are rendered.

Lines are the observations.  A line's state is a role and whether it opens a
turn.  It emits a speaker marker's class (``User:``, ``### Assistant``,
``<|im_start|>system`` and the like, or none) and a shape (how long, a question,
a list or code).  Shapes, the order of roles and the first role are learned from
all rows with a known marker; how often markers are missing or wrong are
parameters.  Viterbi gives the likeliest roles, so a missing or wrong
marker is mended by its context.  Each turn becomes ``<|im_start|>role``, its text
without the marker, ``<|im_end|>``.

A row is one utterance of a transcript: it opens a turn, and further lines open
turns only by markers of their own.  A raw transcript is one row without a marker.

Layout: rows are range-partitioned by (transcript, turn, marker, text hash, place), so that equal rows can be
dealt apart, sorted, and stored as chunks: rows of one transcript that lie together in a
partition, ``CHUNK_ROWS`` rows or ``CHUNK_BYTES`` of text at most.  Viterbi is a product of max-plus matrices, so a
transcript that spans chunks is solved exactly without being gathered: each of its
chunks gives one small matrix, those of a partition one product.  A scan over the products of a transcript (one a
partition) fixes the states between partitions, a scan inside each partition those between its chunks, and chunks
are decoded one by one.  Text is shuffled once.

Defined results: null text is one empty line; a null or unknown marker is inferred;
rows of equal turn are ordered by marker and text; a null transcript id is a transcript of its
own; control strings inside a text are broken up by a zero-width space; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, small_batches

ROLES = ("system", "user", "assistant")
#: What speakers are called (fixed values).
NAMES = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "client", "question", "q", "me", "prompt", "you"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "gpt", "model", "support", "response"),
}
CHUNK_ROWS = 1024
CHUNK_BYTES = 4_000_000
#: Chances that a turn has no marker, and that its marker names another role.
MISSING, WRONG = 0.15, 0.02
#: Chance that a line opens a turn inside a row, and that a line inside a turn looks like a marker.
INNER, STRAY = 0.01, 0.001
SMOOTHING = 1.0

CLASSES = 5  # no marker, each role's, an unknown name's
SHAPES = 16
STATES = 2 * len(ROLES)  # role r: opens at 2 r, goes on at 2 r + 1
START = STATES

_class_of = {n: k + 1 for k, r in enumerate(ROLES) for n in NAMES[r]}
_line = re.compile(
    r"\s*(?:<\|im_start\|>\s*(?P<tag>\w+)\s*|(?:#{1,6}|\*\*|\[)?\s*(?P<name>[A-Za-z]{1,12})\s*(?:\*\*|\])?\s*(?P<colon>:)\s*(?:\*\*)?\s*"
    r"|#{1,6}\s*(?P<head>[A-Za-z]{1,12})\s*$)"
)
_list = re.compile(r"\s*(?:[-*•]\s|\d+[.)]\s|```|    )")


def marker_class(name: str | None) -> int:
    """0 for no marker, 1 to 3 for a role, 4 for a name that is none."""
    if name is None or not (name := name.strip(" \t\r\n:#*[]<>|").lower()):
        return 0
    return _class_of.get(name, CLASSES - 1)


def read_line(line: str) -> tuple[int, str]:
    """A line's marker class and what stands after the marker."""
    m = _line.match(line)
    if not m:
        return 0, line
    k = marker_class(m["tag"] or m["name"] or m["head"])
    return (k, line[m.end() :]) if 0 < k < CLASSES - 1 else (0, line)


def shape(line: str) -> int:
    n = len(line.split())
    long = 0 if n < 4 else 1 if n < 13 else 2 if n < 41 else 3
    return long + 4 * line.rstrip().endswith("?") + 8 * bool(_list.match(line))


def observe(marker: str | None, text: str | None) -> list[int]:
    """Codes of a row's lines: (opens the row, marker class, shape)."""
    own, out = marker_class(marker), []
    for i, line in enumerate((text or "").split("\n")):
        k, rest = read_line(line)
        if not i and 0 < own < CLASSES - 1:
            k = own
        out.append(((not i) * CLASSES + k) * SHAPES + shape(rest))
    return out


class Model:
    """Log probabilities of the chain, from counts."""

    #: counts: first role, role after role, shape of an opening line, shape of a further line
    SIZES = (3, 9, 3 * SHAPES, 3 * SHAPES)

    def __init__(self, counts: np.ndarray) -> None:
        first, turn, opening, further = np.split(counts + SMOOTHING, np.cumsum(self.SIZES)[:-1])
        first = first / first.sum()
        turn = turn.reshape(3, 3) / turn.reshape(3, 3).sum(1, keepdims=True)
        opening, further = (x.reshape(3, SHAPES) / x.reshape(3, SHAPES).sum(1, keepdims=True) for x in (opening, further))
        marks = np.full((3, CLASSES), WRONG / 2)
        marks[:, 0], marks[:, CLASSES - 1] = MISSING, WRONG
        marks[np.arange(3), np.arange(3) + 1] = 1 - MISSING - 2 * WRONG
        emit = np.full((2, CLASSES, SHAPES, STATES), -np.inf)
        for r in range(3):
            for k in range(CLASSES):
                emit[1, k, :, 2 * r] = np.log(marks[r, k] * opening[r])
                emit[0, k, :, 2 * r] = np.log((marks[r, k] if k else 1e-4) * opening[r])
                emit[0, k, :, 2 * r + 1] = np.log((STRAY / 4 if k else 1 - STRAY) * further[r])
        self.emit = emit.reshape(-1, STATES)
        move = np.full((STATES + 1, STATES), -np.inf)
        for r in range(3):
            move[START, 2 * r] = np.log(first[r])
            for s in range(3):
                move[2 * r : 2 * r + 2, 2 * s] = np.log(turn[r, s])
            move[2 * r : 2 * r + 2, 2 * r + 1] = np.log(1 - INNER)
        # inside a row, opening a turn has its own price
        self.move = [move.copy(), move]
        self.move[0][:START, ::2] += np.log(INNER)

    def matrix(self, codes: list[int]) -> np.ndarray:
        """Best score from each state before the lines to each state at the last."""
        best = None
        for c in codes:
            step = self.move[c >= CLASSES * SHAPES] + self.emit[c]
            best = step if best is None else (best[:, :, None] + step[None, :START, :]).max(1)
        return best

    def decode(self, codes: list[int], enter: int, leave: int | None) -> list[int]:
        """The best states between a state before the lines and one at the last (any, if None)."""
        score, back = None, []
        for c in codes:
            step = self.move[c >= CLASSES * SHAPES] + self.emit[c]
            if score is None:
                score = step[enter]
                continue
            ways = score[:, None] + step[:START]
            came = ways.argmax(0)
            back.append(came)
            score = ways[came, np.arange(STATES)]
        at = int(score.argmax()) if leave is None else leave
        out = [at]
        for came in reversed(back):
            at = int(came[at])
            out.append(at)
        return out[::-1]


_CHUNK = (
    "part int, chunk int, edge boolean, id long, turns array<long>, texts array<string>, codes array<array<int>>, "
    "known array<int>, counts array<long>"
)
_CHUNK_TYPES = [
    pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()),
    pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.int64()),
]
_CHUNK_NAMES = [c.split()[0] for c in _CHUNK.split(", ")]


def _count(codes: list[list[int]], known: list[int], before: int | None, first: bool) -> list[int]:
    """What a chunk adds to the model's counts; ``before``: the role known just before it."""
    first_n, turn, opening, further = (np.zeros(n, np.int64) for n in Model.SIZES)
    for row, k in zip(codes, known, strict=True):
        if k:
            opening[(k - 1) * SHAPES + row[0] % SHAPES] += 1
            for c in row[1:]:
                further[(k - 1) * SHAPES + c % SHAPES] += 1
            if first:
                first_n[k - 1] += 1
            elif before:
                turn[(before - 1) * 3 + k - 1] += 1
        before, first = k, False
    return np.concatenate([first_n, turn, opening, further]).tolist()


def _chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """Sorted rows (id, turn, marker, text) to chunks of ``most`` rows, one a batch."""
    part, no = TaskContext.get().partitionId(), 0
    now: int | None = None
    rows: list[tuple] = []
    size, started, before, goes_on = 0, False, None, True

    def chunk(edge: bool) -> pa.RecordBatch:
        codes = [observe(m, x) for _, m, x in rows]
        known = [k if 0 < (k := marker_class(m)) < CLASSES - 1 else 0 for _, m, _ in rows]
        # counts of a transcript's first row are taken where its start is sure; seams between partitions are added later
        counts = _count(codes, known, before, not goes_on)
        row = (part, no, edge, now, [r[0] for r in rows], [r[2] for r in rows], codes, known, counts)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _CHUNK_TYPES, strict=True)], names=_CHUNK_NAMES)

    for b in batches:
        for i, turn, marker, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            other = started and i != now
            if rows and (other or len(rows) >= most or size >= CHUNK_BYTES):
                out = chunk(goes_on or not other)
                yield out
                before = out.column(7)[0].as_py()[-1] if not other else None
                goes_on, no, rows, size = not other, no + 1, [], 0
            now, started = i, True
            rows.append((turn, marker, text))
            size += len(text or "")
    if rows:
        yield chunk(True)


def _steps(t: pa.Table) -> list[np.ndarray]:
    return [np.array(m).reshape(STATES + 1, STATES) for m in t["matrix"].to_pylist()]


def _product(key: tuple, t: pa.Table) -> pa.Table:
    """The matrix of all chunks of a transcript in a partition."""
    whole, *rest = _steps(t.sort_by("chunk"))
    for m in rest:
        whole = (whole[:, :, None] + m[None, :START, :]).max(1)
    return pa.table({"id": t["id"][:1], "part": t["part"][:1], "matrix": pa.array([whole.reshape(-1).tolist()], pa.list_(pa.float64()))})


def _between(steps: list[np.ndarray], enter: int, leave: int | None) -> tuple[list[int], list[int]]:
    """The best states before and after each step, from a state before them all to one after them (any, if None)."""
    forward = [steps[0][enter]]
    for m in steps[1:]:
        forward.append((forward[-1][:, None] + m[:START]).max(0))
    out = [int(forward[-1].argmax()) if leave is None else leave]
    for k in range(len(steps) - 1, 0, -1):
        out.append(int((forward[k - 1] + steps[k][:START, out[-1]]).argmax()))
    out.reverse()
    return [enter, *out[:-1]], out


def _parts(key: tuple, t: pa.Table) -> pa.Table:
    """States between the partitions of one transcript, from their products."""
    t = t.sort_by("part")
    enter, leave = _between(_steps(t), START, None)
    return pa.table({"id": t["id"], "part": t["part"], "enter": pa.array(enter, pa.int32()), "leave": pa.array(leave, pa.int32())})


def _seams(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """States at the seams of one transcript's chunks in a partition, from their matrices and the states before and after."""
    t = left.sort_by("chunk")
    enter, leave = _between(_steps(t), right["enter"][0].as_py(), right["leave"][0].as_py())
    return pa.table({"part": t["part"], "chunk": t["chunk"], "enter": pa.array(enter, pa.int32()), "leave": pa.array(leave, pa.int32())})


def render(role: str, text: str) -> str:
    """A turn in canonical form."""
    for tag in ("<|im_start|>", "<|im_end|>"):
        text = text.replace(tag, tag[0] + "​" + tag[1:])
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def turns_of(text: str | None, states: list[int]) -> Iterator[tuple[str, str]]:
    """Role and text of the turns in a row, given its lines' states."""
    lines = (text or "").split("\n")
    opens = [i for i, s in enumerate(states) if not i or s % 2 == 0]
    for a, b in zip(opens, [*opens[1:], len(lines)], strict=True):
        yield ROLES[states[a] // 2], "\n".join([read_line(lines[a])[1], *lines[a + 1 : b]]).strip()


def parse(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str | None = "turn", marker_col: str | None = "role", text_col: str = "text",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The turns of all transcripts: conv_id, turn, part (number in its row), role, text, rendered."""
    spark = rows.sparkSession
    small_batches(spark)
    own = rows.select(
        F.col(id_col).cast("long").alias("id"),
        (F.col(turn_col) if turn_col else F.lit(0)).cast("long").alias("turn"),
        (F.col(marker_col) if marker_col else F.lit(None)).cast("string").alias("marker"),
        F.col(text_col).cast("string").alias("text"),
    )
    chunks = cut_lineage(
        own.withColumns({"h": F.xxhash64("marker", "text"), "place": F.monotonically_increasing_id()})
        .repartitionByRange("id", "turn", "marker", "h", "place")
        .sortWithinPartitions("id", "turn", "marker", "h", "text")
        .drop("h", "place")
        .mapInArrow(partial(_chunks, most=chunk_rows), _CHUNK),
        "chunks",
    )
    total = chunks.select(F.posexplode("counts").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(sum(Model.SIZES))
    for r in total:
        counts[r["at"]] = r["n"]
    # the first chunk of a partition may begin a transcript or go on with the one before
    ends = chunks.groupBy("part").agg(
        F.min_by(F.struct("id", F.col("known")[0].alias("k")), "chunk").alias("head"),
        F.max_by(F.struct("id", F.element_at("known", -1).alias("k")), "chunk").alias("tail"),
    )
    last = None
    for r in ends.orderBy("part").collect():
        if r.head.k:
            if last is None or last.id != r.head.id:
                counts[r.head.k - 1] += 1
            elif last.k:
                counts[3 + (last.k - 1) * 3 + r.head.k - 1] += 1
        last = r.tail
    model = Model(counts)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = [model.matrix([c for row in codes for c in row]).reshape(-1).tolist() for codes in b.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:3], pa.array(found, pa.list_(pa.float64()))], names=["id", "part", "chunk", "matrix"]
                )

    steps = cut_lineage(
        chunks.where("edge").select("id", "part", "chunk", "codes").mapInArrow(matrices, "id long, part int, chunk int, matrix array<double>"), "matrices"
    )
    parts = (
        steps.groupBy("id", "part").applyInArrow(_product, "id long, part int, matrix array<double>")
        .groupBy("id").applyInArrow(_parts, "id long, part int, enter int, leave int")
    )
    seams = steps.groupBy("id", "part").cogroup(parts.groupBy("id", "part")).applyInArrow(_seams, "part int, chunk int, enter int, leave int")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            out: list[tuple] = []
            for i, turns, texts, codes, enter, leave in zip(*(c.to_pylist() for c in b.columns), strict=True):
                flat = model.decode([c for row in codes for c in row], START if enter is None else enter, leave)
                at = 0
                for turn, text, row in zip(turns, texts, codes, strict=True):
                    for k, (role, said) in enumerate(turns_of(text, flat[at : at + len(row)])):
                        out.append((i, turn, k, role, said, render(role, said)))
                    at += len(row)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)],
                    names=["conv_id", "turn", "part", "role", "text", "rendered"],
                )

    return (
        chunks.select("part", "chunk", "id", "turns", "texts", "codes")
        .join(seams, ["part", "chunk"], "left")
        .select("id", "turns", "texts", "codes", "enter", "leave")
        .mapInArrow(decode, "conv_id long, turn long, part int, role string, text string, rendered string")
    )


def op1_viterbi_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
