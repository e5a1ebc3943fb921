from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import column_named

# Rows looked at for each cut between two ranges.
SAMPLED = 20


def range_number(
    df: DataFrame, order: list[Column], descending: bool = False, parts: int | None = None
) -> Column:
    """The number of the range, from 0 to parts - 1, that a row of `df` lies in, in this order.

    The order is that of plain columns, ascending with NULL first, or descending with NULL
    last. The cuts come from one pass over a sample of the keys, about 20 rows a range,
    and become part of the expression: it gives a row the same range wherever and however
    often it is worked out, so nothing has to be written to hold on to it. Rows equal in
    `order` lie in one range. A row finds its range by binary search.
    """
    parts = parts or _parts(df)
    named = df.select(*[c.alias(f"_{i}") for i, c in enumerate(order)])
    cuts = _cuts(named, parts)
    if not cuts:
        return F.lit(0)
    # Types that compare equal; the text of a value may be a little off, but is the same for all.
    schema = T.ArrayType(T.StructType([T.StructField(f.name, f.dataType) for f in named.schema.fields]))
    found = F.sort_array(F.from_json(F.lit("[" + ",".join(cuts) + "]"), schema))
    key = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)])
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    below = F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(cuts)) & (F.get(found, at + step - 1) <= key), at + step
        ).otherwise(at),
    )
    return F.lit(len(cuts)) - below if descending else below


def _cuts(keys: DataFrame, parts: int) -> list[str]:
    """At most parts - 1 keys, as JSON, that cut the rows about evenly."""
    if parts < 2:
        return []
    rows = keys.count()
    if rows > SAMPLED * parts:
        # Which rows are drawn matters for the balance alone: the cuts are kept as they come.
        keys = keys.sample(SAMPLED * parts / rows, seed=17)
    # About twenty rows a range, a key that repeats being one with more weight.
    weighed = keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("_rows"))
    in_order = Window.orderBy(*keys.columns)
    before = F.sum("_rows").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    slot = F.floor(before * parts / F.sum("_rows").over(Window.partitionBy()))
    placed = weighed.withColumn("_slot", F.coalesce(slot, F.lit(0)))
    placed = placed.withColumn("_last", F.lag("_slot").over(in_order)).where("_slot > _last")
    found = placed.orderBy("_slot").select(F.to_json(F.struct(*keys.columns))).collect()
    return [row[0] for row in found]


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(
    df: DataFrame, order: list[Column], partition: str = "_part", descending: bool = False
) -> DataFrame:
    """`df` in partitions of value ranges, with their numbers in order as `partition`.

    Range i is partition i, so a window or grouping by `partition` needs no other exchange.
    Rows equal in `order` come to one partition. `df` is read again for the sample: give a
    table, a scan, or something written, not a long plan.
    """
    parts = _parts(df)
    numbered = df.withColumn(partition, range_number(df, order, descending, parts))
    return numbered.repartitionById(parts, F.col(partition))


def beside_ranges(rows: DataFrame, partition: str = "_part") -> DataFrame:
    """A few rows for each range, to be joined to what `ranged` gave without moving that."""
    return rows.repartitionById(_parts(rows), F.col(partition)).hint("merge")


def running_total(
    df: DataFrame,
    order: list[Column],
    value: str,
    into: str,
    partition: str = "_part",
    descending: bool = False,
) -> DataFrame:
    """Add `into`: the sum of `value` over all rows before this one in `order`.

    Each range is summed apart and the totals of the ranges before it are added, so no
    task sees all rows. The totals are one row a range, and are added up on the sending
    side. Rows should differ in `order`, or they are in no certain order. The rows go
    through one exchange; `df` is read three times, see `ranged`.
    """
    parts = _parts(df)
    numbered = df.withColumn(partition, range_number(df, order, descending, parts))
    name = column_named(value)
    totals = numbered.groupBy(partition).agg(F.sum(name).alias("_total"))
    # One row for each range: a bounded number.
    before = Window.orderBy(partition).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(partition, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    by = [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in order]
    within = Window.partitionBy(partition).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return (
        numbered.repartitionById(parts, F.col(partition))
        .join(F.broadcast(starts), partition, "left")
        .withColumn(into, F.col("_start") + F.coalesce(F.sum(name).over(within), F.lit(0)))
        .drop("_start", partition)
    )
