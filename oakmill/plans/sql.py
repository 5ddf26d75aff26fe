"""A small SQL dialect: one table or one inner join, one equality, a limit, join hints.

    SELECT * | c, ... FROM t [[INNER] JOIN u ON a = b [HASH | NESTED_LOOP]] [WHERE c = v] [LIMIT n] [;]

The text is read by tokens into a :class:`Select`, an access path and a join
strategy are chosen from the indexes that are stored, and a lazy DataFrame is
built that reads them.  The choice shows in ``explain`` and never changes the rows.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog, Entry
from ..errors import SqlError
from ..operators import indexes
from ..operators.joins import join, pick
from ..sources.tables import need
from ..sources.zones import ZonedTable

_token = re.compile(r"\s*(?:(?P<text>'[^']*')|(?P<mark>[=,;*])|(?P<word>[^\s=,;*']+))")
WORDS = {"select", "from", "inner", "join", "on", "hash", "nested_loop", "where", "limit"}
HINTS = {"hash": "HASH", "nested_loop": "NESTED_LOOP"}


@dataclass(frozen=True)
class Join:
    table: str
    left: str
    right: str
    hint: str = "AUTO"


@dataclass(frozen=True)
class Select:
    table: str
    columns: tuple[str, ...] = ()  # none: all
    join: Join | None = None
    where: tuple[str, str] | None = None
    limit: int = -1


@dataclass(frozen=True)
class Plan:
    """How a statement is answered."""

    scan: str
    join: str | None = None


class _Reader:
    def __init__(self, text: str) -> None:
        self.tokens: list[str] = []
        at, text = 0, text.strip()
        while at < len(text):
            m = _token.match(text, at)
            if not m:
                raise SqlError(f"can't read {text[at:at + 20]!r}")
            self.tokens.append(m[0].strip())
            at = m.end()
        if self.tokens and self.tokens[-1] == ";":
            self.tokens.pop()
        self.at = 0

    def take(self, *words: str) -> str | None:
        """The next token in lower case, if it is one of ``words``."""
        if self.at < len(self.tokens) and self.tokens[self.at].lower() in words:
            self.at += 1
            return self.tokens[self.at - 1].lower()
        return None

    def need(self, *words: str) -> str:
        if (got := self.take(*words)) is None:
            raise SqlError(f"{' or '.join(words).upper()} is missing")
        return got

    def name(self) -> str:
        if self.at >= len(self.tokens) or not re.fullmatch(r"[A-Za-z_][\w.]*", self.tokens[self.at]) or self.tokens[self.at].lower() in WORDS:
            raise SqlError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1]

    def column(self) -> str:
        return self.name().rsplit(".", 1)[-1].lower()

    def value(self) -> str:
        if self.at >= len(self.tokens) or re.fullmatch(r"[=,;*]", self.tokens[self.at]):
            raise SqlError("a value is missing")
        self.at += 1
        return self.tokens[self.at - 1].strip("'\"")


def parse(text: str) -> Select:
    """The statement that a text says; raises :class:`SqlError`."""
    r = _Reader(text or "")
    r.need("select")
    columns: list[str] = []
    if not r.take("*"):
        columns.append(r.column())
        while r.take(","):
            columns.append(r.column())
    r.need("from")
    table, joined, where, limit = r.name().lower(), None, None, -1
    inner = r.take("inner")
    if r.take("join"):
        other = r.name().lower()
        r.need("on")
        left = r.column()
        r.need("=")
        joined = Join(other, left, r.column(), HINTS.get(r.take(*HINTS) or "", "AUTO"))
    elif inner:
        raise SqlError("JOIN is missing")
    if r.take("where"):
        where = (r.column(), r.need("=") and r.value())
    if r.take("limit"):
        n = r.value()
        if not n.isdigit():
            raise SqlError("LIMIT needs a number")
        limit = int(n)
    if r.at != len(r.tokens):
        raise SqlError(f"can't read {r.tokens[r.at]!r}")
    return Select(table, tuple(columns), joined, where, limit)


#: Indexes of a key, and of text, in the order of preference, with their names.
BY_KEY = {"hashindex": "hash index", "bplustree": "B+tree index", "lsmtree": "LSM index"}
BY_TEXT = {"gin": "token index", "bitmap": "bitmap index"}


def choose(s: Select, indexes: Collection[str]) -> str | None:
    """The index that the first table is read through: on the key, for a whole number, or on text; or none."""
    if s.where is None:
        return None
    column, value = s.where
    if column == "id" or set(BY_KEY) & set(indexes):
        return next((k for k in BY_KEY if k in indexes), None) if re.fullmatch(r"[+-]?\d+", value) else None
    return next((k for k in BY_TEXT if k in indexes), None)


def plan_scan(s: Select, indexes: Collection[str]) -> str:
    """The access path of the first table, from the indexes that serve its filter."""
    on = f" on {s.where[0]}" if s.where else ""
    kind = choose(s, indexes)
    return f"{(BY_KEY | BY_TEXT)[kind]} scan{on}" if kind else f"full scan{on}"


def plan(s: Select, indexes: Collection[str], inner: Collection[str] | None = None) -> Plan:
    """Access path and join strategy, from the indexes that serve the filter and (``inner``; else the same) the join's right key."""
    scan = plan_scan(s, indexes)
    inner = indexes if inner is None else inner
    if s.join is None:
        return Plan(scan)
    if s.join.hint == "NESTED_LOOP":
        return Plan(scan, "nested loop join")
    if s.join.hint == "HASH":
        return Plan(scan, "hash join")
    if s.join.right == "id" and "hashindex" in inner:
        return Plan(scan, "index join by hash index")
    if s.join.right == "id" and "bplustree" in inner:
        return Plan(scan, "index join by B+tree index")
    return Plan(scan, "nested loop join" if choose(s, indexes) in BY_KEY else "hash join")


def explain(s: Select, catalog: Catalog) -> Plan:
    entry: Entry = catalog.find(s.table)
    own = entry.usable(s.where[0]) if s.where else {}
    return plan(s, own, catalog.find(s.join.table).usable(s.join.right) if s.join else None)


def _equals(df: DataFrame, column: str, value: str):  # noqa: ANN202
    """``column = value``; a value that the column's type can't hold matches nothing."""
    need(df, [column])
    kind = next(f.dataType for f in df.schema if f.name.lower() == column)
    if isinstance(kind, T.StringType):
        return F.col(column) == F.lit(value)
    return F.col(column) == F.lit(value).try_cast(kind)


def build(s: Select, catalog: Catalog) -> DataFrame:
    """The statement's rows, read through the indexes that its plan names."""
    entry = catalog.find(s.table)
    left = entry.data
    if s.where:
        column, value = s.where
        need(left, [column])
        own = entry.usable(column)
        if (kind := choose(s, own)) is not None:
            left = indexes.lookup(kind, catalog.spark, own[kind].path, entry.column(column).name, value)
        left = left.where(_equals(left, column, value))  # before the join: on the first table
    if s.join:
        other = catalog.find(s.join.table)
        right, folders = other.data, None
        how = explain(s, catalog).join
        strategy = {"nested loop join": "nested_loop", "hash join": "auto"}.get(how, "index")
        if s.join.hint == "HASH":
            strategy = "hash"
        elif how == "nested loop join" and s.join.hint == "AUTO":
            strategy = "index"  # one outer row: broadcast it
        elif how == "index join by hash index":
            index = indexes.HashIndex(catalog.spark, other.usable(s.join.right)["hashindex"].path)
            right, folders = index.data, index.folders
        elif how == "index join by B+tree index":
            right = ZonedTable(catalog.spark, other.usable(s.join.right)["bplustree"].path).rows()
        rows = join(left, s.join.left, right, s.join.right, list(s.columns) or None, strategy, null_safe=False, folders=folders)
    else:
        rows = left.select(*s.columns) if s.columns and not need(left, s.columns) else left
    return rows.limit(s.limit) if s.limit >= 0 else rows


__all__ = ["Join", "Plan", "Select", "build", "explain", "parse", "pick", "plan", "plan_scan"]
