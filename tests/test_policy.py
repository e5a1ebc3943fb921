import pytest
from pyspark.sql import functions as F

from tallyfield.functions import joins
from tallyfield.operators import policy as p

from row_helpers import as_set, rows_of


@pytest.fixture(scope="module")
def accounts(spark):
    rows = [(1, "east", 10.0), (2, "west", 20.0), (3, None, 30.0), (4, "east", None)]
    return spark.createDataFrame(rows, "id int, region string, balance double")


@pytest.fixture(scope="module")
def grants(spark):
    rows = [
        ("ann", "accounts", "east", "balance"),
        ("ann", "accounts", "east", "balance"),
        ("ann", "other", "west", "region"),
        ("bob", "accounts", "west", "id"),
        ("bob", "accounts", None, None),
    ]
    return spark.createDataFrame(rows, "user string, table string, key string, column string")


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_row_filter(spark, accounts, grants, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

    def ids(user):
        seen = p.apply_row_filter(accounts, user, "accounts", "region", grants)
        assert seen.columns == accounts.columns
        return sorted(r["id"] for r in seen.collect())

    assert ids("ann") == [1, 4]
    assert ids("bob") == [2]
    assert ids("eve") == []
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_column_mask(accounts, grants):
    def seen(user, **masks):
        masked = p.apply_column_mask(
            accounts, user, "accounts", ["region", "balance"], grants, masks
        )
        assert masked.dtypes == accounts.dtypes
        return rows_of(masked, 0)

    assert seen("ann", region=F.lit("***")) == [
        (1, "***", 10.0),
        (2, "***", 20.0),
        (3, "***", 30.0),
        (4, "***", None),
    ]
    # A grant for an unprotected column, or for another table, opens nothing.
    assert as_set(accounts.select("id")) == {(r[0],) for r in seen("bob")}
    assert all(r[1:] == (None, None) for r in seen("bob") + seen("eve"))


def test_broadcast_only_below_the_bound(spark):
    df = spark.range(10)
    other = spark.range(5).selectExpr("id", "repeat('x', 84) AS t", "array(id) AS a")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:

        def plan(bound):
            joined = df.join(joins.broadcast_if_small(other, bound), "id")
            return joined._jdf.queryExecution().toString()

        # 16 for the number, 100 for the text, 19 for [0].
        assert "BroadcastHashJoin" in plan(5 * 135)
        assert "BroadcastHashJoin" not in plan(5 * 135 - 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_grant_of_another_type_grants_nothing(spark):
    rows = spark.range(5)
    policy = spark.createDataFrame(
        [("u", "t", "3"), ("u", "t", "n/a"), ("u", "t", None)], "user string, table string, key string"
    )
    assert [r[0] for r in p.apply_row_filter(rows, "u", "t", "id", policy).collect()] == [3]
