import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import exact_total, sum_in_any_order


@pytest.mark.parametrize("scale", [0, 2, 6])
def test_total_is_exact(spark, scale):
    rng = random.Random(scale)
    top = 10 ** (14 - scale)
    values = [rng.randrange(-(10**14), 10**14) / 10**scale for _ in range(2000)]
    values += [0.0, -0.0, float(top), -float(top), 0.5 if scale else 1.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    places = Decimal(1).scaleb(-scale)
    expected = sum(Decimal(repr(v)).quantize(places) for v in values if v is not None)
    found = df.agg(exact_total(df, "v", scale)).first()[0]
    assert found == expected


def test_total_beyond_bigint(spark):
    df = spark.range(1000).select(F.lit(9e16).alias("v"))
    assert df.agg(exact_total(df, "v", 2)).first()[0] == Decimal("90000000000000000000")


def test_whole_and_decimal_amounts_are_added_as_they_are(spark):
    df = spark.sql("SELECT 1.005BD AS d, 7 AS i")
    assert df.agg(exact_total(df, "d", 2), exact_total(df, "i", 2)).first()[:] == (
        Decimal("1.005"),
        7,
    )


def test_no_amounts(spark):
    df = spark.sql("SELECT cast(NULL AS double) AS v")
    assert df.agg(exact_total(df, "v", 2)).first()[0] is None


@pytest.mark.parametrize("value", [1.234, float("nan"), float("inf"), 1e300])
def test_a_value_that_does_not_fit_stops(spark, value):
    df = spark.createDataFrame([(0.29,), (value,), (None,)], "v double")
    with pytest.raises(Exception, match="does not fit 2 decimal places"):
        df.agg(exact_total(df, "v", 2)).collect()
    fine = spark.createDataFrame([(0.29,), (-1234567.01,), (None,)], "v double")
    assert str(fine.agg(exact_total(fine, "v", 2)).first()[0]) == "-1234566.72"


def _bits(value):
    return None if value is None else struct.pack(">d", value)


DOUBLES = {
    "cancelling": [1e16, 1.0, -1e16, 0.1, -0.1] * 40,
    "money": [i * 0.01 for i in range(-500, 1500)],
    "wide": [math.ldexp((-1) ** i * (1 + i / 997), (i * 37) % 400 - 200) for i in range(600)],
    "extremes": [5e-324, 1e-308, 1.7e308, -1.7e308, 2.5e-320, 3.0],
    "nothing finite": [float("inf"), 1.0],
    "both infinite": [float("inf"), float("-inf"), 1.0],
    "nan": [1.0, float("nan"), 2.0],
    "null alone": [None, None],
    "zeros": [0.0, -0.0, None],
}


@pytest.mark.parametrize("kind", DOUBLES)
def test_sums_have_the_same_bits_in_any_order(spark, kind):
    values = DOUBLES[kind]
    found = set()
    for seed in range(10 if kind in ("wide", "cancelling") else 3):
        rows = [(i % 3, v) for i, v in enumerate(values)]
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k int, v double").repartition(seed % 5 + 1)
        found.add(_bits(df.agg(sum_in_any_order(df, "v")).first()[0]))
    assert len(found) == 1
    got = next(iter(found))
    present = [v for v in values if v is not None]
    if not present:
        assert got is None
    elif all(map(math.isfinite, present)):
        exact = math.fsum(present)
        assert math.isclose(struct.unpack(">d", got)[0], exact, rel_tol=1e-15, abs_tol=0.0)
    else:
        plain = sum(present)
        assert got == _bits(plain) or math.isnan(plain) and math.isnan(struct.unpack(">d", got)[0])


def test_groups_and_totals_without_a_scale(spark):
    rows = [("a", 1e16), ("a", 1.0), ("a", -1e16), ("b", 0.1), ("b", 0.2), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    found = {r["k"]: r["t"] for r in df.groupBy("k").agg(exact_total(df, "v", None).alias("t")).collect()}
    assert found == {"a": 1.0, "b": 0.1 + 0.2, "c": None}
