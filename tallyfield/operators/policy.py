"""Per-user row filters and column masks.

A policy has one row per grant: `user, table` and the `key` value, or the `column`, that
the user may see in that table. Without a grant there are no rows, or only masked values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import column_named


def apply_row_filter(
    rows: DataFrame, user: str, table: str, key: str, policy: DataFrame
) -> DataFrame:
    """Rows of `table` whose `key` is granted to the user.

    Grants are text and take the type of the key column; one that cannot grants nothing.
    Repeated grants are merged first. Adaptive execution broadcasts few grants, and else
    splits a hot key; the policy is read once.
    """
    grant = F.col("key").try_cast(rows.schema[key].dataType).alias(key)
    granted = _of(policy, user, table).select(grant).distinct()
    allowed = rows.join(granted, key, "left_semi")
    return allowed.select(*[column_named(name) for name in rows.columns])


def apply_column_mask(
    rows: DataFrame,
    user: str,
    table: str,
    columns: list[str],
    policy: DataFrame,
    masks: dict[str, Column] | None = None,
) -> DataFrame:
    """`rows` with the protected `columns` masked, unless granted to the user; same schema.

    The mask is NULL, or the column's entry in `masks`. The grants reach the rows as one
    value, a list of at most `len(columns)` names.
    """
    masks = masks or {}
    granted = (
        _of(policy, user, table)
        .where(F.col("column").isin(columns))
        .agg(F.collect_set("column"))
        .scalar()
    )

    def shown(name: str) -> Column:
        field = rows.schema[name]
        mask = masks.get(name, F.lit(None)).cast(field.dataType)
        allowed = F.array_contains(granted, F.lit(name))
        return F.when(allowed, column_named(name)).otherwise(mask).alias(name)

    return rows.select(*[shown(n) if n in columns else column_named(n) for n in rows.columns])


def _of(policy: DataFrame, user: str, table: str) -> DataFrame:
    return policy.where((F.col("user") == F.lit(user)) & (F.col("table") == F.lit(table)))
