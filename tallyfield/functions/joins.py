from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import column_named

MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether `df`, measured by one aggregation, is small enough for every executor.

    Use it on data that is written, or cheap to make.
    """
    width = sum((_width(field) for field in df.schema.fields), F.lit(0))
    measured = df.agg(F.sum(width.cast("bigint"))).first()[0] or 0
    return measured <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Mark `df` for broadcast if it is measured small, else leave the join to Spark.

    Beyond the bound the join is a shuffled one, where adaptive execution splits hot keys.
    """
    return F.broadcast(df) if fits_broadcast(df, max_bytes) else df


def _width(field: T.StructField) -> Column:
    """Bytes of a value in a hash table, about; a nested value counts as its JSON text."""
    column = column_named(field.name)
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        column = F.to_json(column)
    elif not isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.lit(16)
    return F.lit(16) + F.coalesce(F.octet_length(column), F.lit(0))
