"""Small text rules shared by the metadata, lineage and preview queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column_named(name: str) -> Column:
    """A column by its plain name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def or_null(column: Column) -> Column:
    """The empty string counts as missing."""
    return F.nullif(column, F.lit(""))


def or_default(column: Column, default: str) -> Column:
    return F.coalesce(or_null(column), F.lit(default))


def yes_no(flag: Column) -> Column:
    """NULL counts as No."""
    return F.when(flag, "Yes").otherwise("No")


def literal_search(column: Column, term: str) -> Column:
    """Case-insensitive substring test; `%`, `_` and `.` in the term stand for themselves."""
    return F.contains(F.lower(column), F.lower(F.lit(term)))


def last_part(full_name: Column) -> Column:
    return F.substring_index(full_name, ".", -1)


def dotted_name(*parts: Column) -> Column:
    """Parts joined by dots; NULL if any part is missing."""
    pieces: list[Column] = []
    for part in parts:
        if pieces:
            pieces.append(F.lit("."))
        pieces.append(part)
    return F.concat(*pieces)


def base64_line(data: Column) -> Column:
    """Base64 on one line: Spark's own form breaks the text every 76 characters."""
    return F.translate(F.base64(data), "\r\n", "")
