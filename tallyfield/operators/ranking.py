"""Rank of every row in one global order, without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import column_named, running_total
from ..session import ensure_checkpoint_dir


def global_rank(rows: DataFrame, measure: str, rank_name: str) -> DataFrame:
    """Add `RANK() OVER (ORDER BY measure DESC)`; NULL measures come last.

    Rows are first counted per value, so that ties, NaN and NULL send one row a task. The
    different values are put in order over range partitions, where a running total counts
    the rows above each; that is the rank less one, and is joined back to the rows. A
    value that holds very many rows is split by adaptive execution. Any type that can be
    sorted will do. The rows are written once, as they are used twice, and so are the counts,
    which the cuts between ranges are drawn from.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    rows = rows.checkpoint()
    value = column_named(measure)
    counts = rows.groupBy(value.alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    counts = counts.checkpoint()
    placed = running_total(counts, [F.col("_value")], "_rows", "_above", descending=True)
    ranks = placed.select("_value", (F.col("_above") + 1).cast("bigint").alias("_rank"))
    kept = [column_named(name) for name in rows.columns if name != rank_name]
    return rows.join(ranks, value.eqNullSafe(F.col("_value"))).select(
        *kept, F.col("_rank").alias(rank_name)
    )
