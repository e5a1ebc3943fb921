"""First rows of a table, safe to show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import base64_line, column_named

# Fixed value: rows of a preview when the caller names no number.
PREVIEW_ROWS = 100


def shown_columns(schema: T.StructType) -> list[str]:
    """Columns whose type text does not mention binary, in table order; all if none is left.

    The whole text counts, so arrays and structs that hold binary values are out, and so
    is a struct with a field that only has binary in its name.
    """
    plain = [f.name for f in schema.fields if "binary" not in f.dataType.simpleString().lower()]
    return plain or schema.names


def render(rows: DataFrame) -> DataFrame:
    """Binary as one line of base64, structs and maps as JSON; the rest unchanged. NULL stays NULL."""
    return rows.select(*[_shown(field).alias(field.name) for field in rows.schema.fields])


def _shown(field: T.StructField) -> Column:
    column = column_named(field.name)
    if isinstance(field.dataType, T.BinaryType):
        return base64_line(column)
    if isinstance(field.dataType, (T.StructType, T.MapType)):
        return F.to_json(column, {"ignoreNullFields": "false"})
    return column


def preview(
    rows: DataFrame,
    n: int = PREVIEW_ROWS,
    exclude_binary: bool = True,
    order_by: list[str] | None = None,
) -> DataFrame:
    """The first `n` rows, rendered; any `n` rows unless `order_by` is given."""
    names = shown_columns(rows.schema) if exclude_binary else rows.columns
    if order_by:
        rows = rows.orderBy(*order_by)
    return render(rows.limit(n).select(*[column_named(name) for name in names]))


def concat_batches(batches: list[DataFrame]) -> DataFrame:
    """All rows of results that have the same columns."""
    return reduce(DataFrame.unionByName, batches)
