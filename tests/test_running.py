"""Ranges and running totals over one exchange."""

import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.functions import ranged, running_total
from tallyfield.operators.messages import question_answer_pairs

from row_helpers import rows_of


def _plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Final Plan ==")[-1].split("== Initial Plan ==")[0]


def test_ranges_are_in_order_even_and_stay_where_they_are(spark):
    df = spark.range(0, 40_000, 1, 5).select(
        F.when(F.col("id") % 9 > 0, F.xxhash64("id") % 10_000).alias("k"), "id"
    )
    parts = ranged(df, [F.col("k"), F.col("id")], "part")
    found = rows_of(
        parts.withColumn("at", F.spark_partition_id()).groupBy("part").agg(
            F.min(F.struct("k", "id")), F.max(F.struct("k", "id")), F.count("*"),
            F.countDistinct("at"), F.min("at"),
        ), 0,
    )
    assert [row[0] for row in found] == [0, 1, 2, 3] == [row[5] for row in found]
    assert {row[4] for row in found} == {1}
    assert sum(row[3] for row in found) == 40_000 and max(row[3] for row in found) < 20_000
    nulls_first = [(x is not None, x) for row in found for x in (row[1]["k"], row[2]["k"])]
    assert nulls_first == sorted(nulls_first, key=lambda p: (p[0], p[1] or 0))


def test_one_exchange_for_window_and_range(spark):
    df = spark.range(0, 5_000, 1, 5).withColumn("v", F.col("id") % 7)
    plan = _plan(running_total(df, [F.col("id")], "v", "above"))
    above = plan.split("BroadcastExchange")[0]
    assert above.count("Exchange shufflepartitionidpassthrough") == 1
    assert "hashpartitioning" not in above and "rangepartitioning" not in plan


VALUES = {
    "bigint": [5, -3, None, 2**62, 5, 0],
    "double": [0.1, float("nan"), float("inf"), None, -0.0, 1e-300, float("-inf")],
    "string": ["a", "", None, "é\n\"q\"", "a\\b", "中", "\x00"],
    "date": [date(2024, 1, 2), None, date(1, 1, 1), date(9999, 12, 31)],
    "timestamp": [datetime(2024, 1, 2, 3, 4, 5, 678901), None, datetime(1970, 1, 1)],
    "decimal(38,10)": [Decimal("1.0000000001"), None, Decimal("-99999999999999999999.5")],
    "binary": [bytearray(b"a"), bytearray(b"\xff\x00"), None, bytearray(b"")],
    "boolean": [True, None, False],
    "array<int>": [[1, 2], [], None, [1, None], [1]],
    "struct<a: int, b: string>": [(1, "x"), None, (1, None), (None, "y"), (0, "z")],
}


@pytest.mark.parametrize("kind", VALUES)
@pytest.mark.parametrize("descending", [False, True])
def test_totals_over_keys_of_any_type(spark, kind, descending):
    rng = random.Random(3)
    rows = [(i, rng.choice(VALUES[kind]), rng.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, f"id int, k {kind}, v int").repartition(6).cache()
    by = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in ("k", "id")]
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select("id", F.coalesce(F.sum("v").over(before), F.lit(0)).alias("above"))
    mine = running_total(df, [F.col("k"), F.col("id")], "v", "above", descending=descending)
    assert rows_of(mine.select("id", "above"), 0) == rows_of(plain, 0)
    df.unpersist()


@pytest.mark.parametrize("rows", [[], [(1, 1)], [(1, 1)] * 300])
def test_few_or_equal_keys(spark, rows):
    df = spark.createDataFrame(rows, "k int, v int")
    totals = running_total(df, [F.col("k")], "v", "above")
    assert sorted(r["above"] for r in totals.collect()) == list(range(len(rows)))


def test_answers_come_from_one_exchange_of_the_log(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"{c}-{t}") for c in range(40) for t in range(30)]
    chats = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    plan = _plan(question_answer_pairs(chats))
    log = [line for line in plan.splitlines() if "Exchange" in line and "conv_id" not in line]
    assert sum("shufflepartitionidpassthrough" in x and "Reused" not in x for x in log) == 2  # log, firsts
    assert plan.count("ReusedExchange") == 1 and "hashpartitioning" not in plan
