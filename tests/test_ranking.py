import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.operators.ranking import global_rank

from row_helpers import rows_of


def _values(kind):
    rng = random.Random(11)
    if kind == "spread":
        return [rng.randrange(10**9) for _ in range(3000)]
    if kind == "one value holds a third":
        return [500 if rng.random() < 0.34 else rng.randrange(1000) for _ in range(3000)]
    if kind == "all tied":
        return [7] * 1000
    if kind == "a third is NULL":
        return [None if rng.random() < 0.34 else rng.randrange(-500, 500) for _ in range(3000)]
    if kind == "only NULL":
        return [None] * 500
    if kind == "lowest and highest repeat":
        return [0] * 900 + [1000] * 900 + [rng.randrange(1001) for _ in range(900)]
    raise ValueError(kind)


def _check(df, measure):
    plain = df.select(
        "id", F.rank().over(Window.orderBy(F.col(measure).desc_nulls_last())).cast("bigint")
    )
    mine = global_rank(df, measure, "place").select("id", "place")
    assert rows_of(mine, 0) == rows_of(plain, 0)


@pytest.mark.parametrize(
    "kind",
    [
        "spread",
        "one value holds a third",
        "all tied",
        "a third is NULL",
        "only NULL",
        "lowest and highest repeat",
    ],
)
@pytest.mark.parametrize("as_type", ["bigint", "decimal(28,2)", "double"])
def test_equals_plain_rank(spark, kind, as_type):
    data = list(enumerate(_values(kind)))
    df = spark.createDataFrame(data, "id int, v bigint").select(
        "id", F.col("v").cast(as_type).alias("v")
    )
    _check(df, "v")


def test_special_doubles(spark):
    values = [0.0, -0.0, float("nan"), float("inf"), -float("inf"), 1.5, -1.5, None] * 60
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    _check(df, "v")


def test_no_finite_value(spark):
    values = [float("nan"), float("inf"), None, None] * 100
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    _check(df, "v")


def test_decimals_that_are_one_double(spark):
    big = Decimal("90071992547409930000.01")
    values = [big + Decimal(i % 5) / 100 for i in range(400)] + [big] * 400 + list(range(100))
    df = spark.createDataFrame(
        [(i, Decimal(v)) for i, v in enumerate(values)], "id int, v decimal(28,2)"
    )
    _check(df, "v")


def test_small_inputs(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 1)], "id int, v int")
    assert rows_of(global_rank(df, "v", "place"), 0) == [(1, 5, 1), (2, 5, 1), (3, 1, 3)]
    assert rows_of(global_rank(df.where("false"), "v", "place")) == []


@pytest.mark.parametrize("as_type", ["date", "string", "boolean"])
def test_any_type_that_sorts(spark, as_type):
    value = {
        "date": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 7).cast("int")),
        "string": F.concat(F.lit("n"), (F.col("id") % 5).cast("string")),
        "boolean": F.col("id") % 3 == 0,
    }[as_type]
    df = spark.range(500).select(F.col("id").cast("int").alias("id"), value.alias("v"))
    df = df.withColumn("facts", F.create_map(F.lit("k"), "id"))
    plain = df.select("id", F.rank().over(Window.orderBy(F.desc("v"))).cast("bigint"))
    assert rows_of(global_rank(df, "v", "place").select("id", "place"), 0) == rows_of(plain, 0)


def test_ties_meet_as_one_row_a_task(spark):
    df = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"))
    counted = df.groupBy("v").count()
    assert counted.where("v IS NULL").count() == 1
    ranked = global_rank(df, "v", "place")
    assert ranked.where("v IS NULL").select("place").distinct().first()[0] == 4000 - 1334 + 1
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Scan ExistingRDD")[0].split("BroadcastExchange")[0]
