"""Tokenisers and normalisers as column expressions, inside whole-stage codegen where Spark allows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens of documents and of columns, what counts as a number, what is trimmed.
DOCUMENT_MARKS = '{}":[]'
DOCUMENT_SEPARATOR = r"[\s,]+"
CONTROLS = r"[\x00-\x08\x0e-\x1f]"
COLUMN_SEPARATOR = r"[\s,;!?.]+"
NUMBER = r"^-?\d+(\.\d+)?$"
EDGES = r"^[\x00-\x20]+|[\x00-\x20]+$"


def trim_all(value: Column) -> Column:
    """``value`` without control characters and blanks (up to U+0020) at both ends."""
    return F.regexp_replace(value, EDGES, "")


def document_tokens(value: Column) -> Column:
    """Lower-cased tokens of a document's text, in order and with repeats; none for null.

    Marks become blanks, and one split at blanks and commas gives the tokens; only a text with other control
    characters has tokens left to trim.
    """
    plain = F.lower(F.translate(F.coalesce(value, F.lit("")), DOCUMENT_MARKS, " " * len(DOCUMENT_MARKS)))
    parts = F.split(plain, DOCUMENT_SEPARATOR)
    trimmed = F.transform(parts, trim_all)
    return F.array_remove(F.when(plain.rlike(CONTROLS), trimmed).otherwise(parts), "")


def lowered(value: Column) -> Column:
    """A document's text, lower-cased as :func:`document_tokens` does it, whose marks may still stand: only a sigma's lower case depends on what follows."""
    text = F.coalesce(value, F.lit(""))
    return F.lower(F.when(F.contains(text, F.lit("\u03a3")), F.translate(text, DOCUMENT_MARKS, " " * len(DOCUMENT_MARKS))).otherwise(text))


#: What becomes a blank in UTF-8 text of :func:`lowered`, as a table of bytes; a token may have other control characters left at its ends.
TO_BLANKS = bytes(0x20 if chr(b) in DOCUMENT_MARKS + ",\t\n\x0b\f\r" else b for b in range(256))


def column_tokens(name: str, value: Column) -> Column:
    """Tokens ``name:word`` of a column's value: a number is one token, null has none."""
    text = trim_all(F.lower(value.cast("string")))
    words = F.when(text.rlike(NUMBER), F.array(text)).otherwise(
        F.filter(F.split(text, COLUMN_SEPARATOR), lambda t: t != "")
    )
    tokens = F.transform(words, lambda t: F.concat(F.lit(f"{name.lower()}:"), t))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(tokens)


def bitmap_value(value: Column) -> Column:
    """A value as bitmaps know it: trimmed and lower-cased, null as empty."""
    return F.lower(trim_all(F.coalesce(value.cast("string"), F.lit(""))))


def json_field(json: Column, name: str) -> Column:
    """A top-level field of a JSON text, as a string."""
    return F.get_json_object(json, f"$['{name}']")
