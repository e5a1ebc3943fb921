import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyfield.operators import sales

from row_helpers import rows_of


@pytest.fixture(params=[None, 2], ids=["doubles", "cents"])
def scale(request):
    return request.param


def test_monthly_sales_summary(shop, scale):
    summary = sales.monthly_sales_summary(shop["sales_transactions"], scale)
    assert summary.dtypes == [
        ("year_month", "string"),
        ("region", "string"),
        ("channel", "string"),
        ("transaction_count", "bigint"),
        ("total_quantity", "bigint"),
        ("total_revenue", "double"),
        ("avg_transaction_value", "double"),
    ]
    rows = rows_of(summary, 0, 1, 2)
    assert len(rows) == 36
    assert rows[:5] == [
        ("2024-01", "名古屋", "店舗", 1, 15, 67500.0, 67500.0),
        ("2024-01", "名古屋", "法人", 1, 1, 54800.0, 54800.0),
        ("2024-01", "大阪", "オンライン", 1, 4, 63200.0, 63200.0),
        ("2024-01", "大阪", "店舗", 1, 5, 64000.0, 64000.0),
        ("2024-01", "東京", "オンライン", 2, 12, 328000.0, 164000.0),
    ]
    per_month = [sum(row[0] == f"2024-0{m}" for row in rows) for m in range(1, 7)]
    assert per_month == [7, 6, 5, 6, 6, 6]


def test_monthly_preview_is_the_head_of_the_summary(shop, scale):
    summary = rows_of(sales.monthly_sales_summary(shop["sales_transactions"], scale), 0, 1, 2)
    assert rows_of(sales.monthly_preview(shop["sales_transactions"], 10, scale)) == summary[:10]


def test_monthly_sales_trend(shop, scale):
    trend = sales.monthly_sales_trend(shop["sales_transactions"], scale)
    assert rows_of(trend, 0) == [
        ("2024-01", 761500.0),
        ("2024-02", 899300.0),
        ("2024-03", 1428400.0),
        ("2024-04", 1137600.0),
        ("2024-05", 942500.0),
        ("2024-06", 1034600.0),
    ]


RANKED = [
    (1, 5, 16, 2368000.0),
    (11, 3, 6, 708000.0),
    (4, 4, 10, 548000.0),
    (7, 4, 18, 396000.0),
    (3, 4, 28, 358400.0),
    (8, 3, 17, 268600.0),
    (6, 3, 27, 240300.0),
    (14, 2, 3, 204000.0),
    (5, 3, 45, 202500.0),
    (9, 3, 19, 186200.0),
    (15, 2, 5, 160000.0),
    (10, 2, 55, 154000.0),
    (2, 3, 45, 144000.0),
    (13, 2, 22, 136400.0),
    (12, 2, 7, 129500.0),
]


def test_product_sales_ranking(shop, scale):
    ranking = sales.product_sales_ranking(
        shop["sales_transactions"], shop["products"], scale
    )
    assert ranking.columns == [
        "product_id",
        "product_name",
        "category",
        "supplier",
        "transaction_count",
        "total_quantity_sold",
        "total_revenue",
        "revenue_rank",
    ]
    rows = rows_of(ranking, 7)
    assert [(r[0], r[4], r[5], r[6]) for r in rows] == RANKED
    assert [r[7] for r in rows] == list(range(1, 16))


def test_ranking_preview(shop, scale):
    full = rows_of(
        sales.product_sales_ranking(shop["sales_transactions"], shop["products"], scale), 7
    )
    head = sales.ranking_preview(shop["sales_transactions"], shop["products"], 10, scale)
    assert rows_of(head, 7) == full[:10]


def test_top_products(shop, scale):
    by_quantity = sales.top_products(
        shop["sales_transactions"], shop["products"], 5, "quantity", scale
    )
    assert [(r[0], r[2]) for r in rows_of(by_quantity)] == [
        (10, 55),
        (2, 45),
        (5, 45),
        (3, 28),
        (6, 27),
    ]
    by_revenue = sales.top_products(shop["sales_transactions"], shop["products"], 5)
    assert [r[0] for r in rows_of(by_revenue)] == [1, 11, 4, 7, 3]


def test_customer_segment_performance(shop, scale):
    rows = rows_of(
        sales.customer_segment_performance(
            shop["sales_transactions"], shop["customer_segments"], scale
        )
    )
    expected = [
        ("エンタープライズ", "オンライン", 3, 36, 3555300.0, 98758.33333333333),
        ("SMB", "法人", 2, 8, 2881200.0, 360150.0),
        ("エンタープライズ", "法人", 3, 15, 1952400.0, 130160.0),
        ("ミッドマーケット", "法人", 2, 9, 1791200.0, 199022.22222222222),
        ("ミッドマーケット", "オンライン", 2, 15, 1433300.0, 95553.33333333333),
        ("SMB", "店舗", 2, 10, 770900.0, 77090.0),
        ("ミッドマーケット", "店舗", 1, 6, 491400.0, 81900.0),
        ("SMB", "オンライン", 2, 4, 312200.0, 78050.0),
        ("スタートアップ", "オンライン", 1, 4, 282200.0, 70550.0),
        ("スタートアップ", "店舗", 1, 2, 121500.0, 60750.0),
    ]
    assert sorted(rows, key=lambda r: -r[4]) == expected


def test_channel_category_analysis(shop, scale):
    rows = rows_of(
        sales.channel_category_analysis(shop["sales_transactions"], shop["products"], scale)
    )
    expected = [
        ("法人", "PC・周辺機器", 7, 20, 2780000.0, 135142.85714285713),
        ("オンライン", "PC・周辺機器", 5, 42, 568000.0, 36000.0),
        ("法人", "ディスプレイ", 4, 10, 548000.0, 54800.0),
        ("店舗", "PC・周辺機器", 6, 78, 432900.0, 7050.0),
        ("オンライン", "スマートデバイス", 5, 24, 346200.0, 18680.0),
        ("店舗", "音響機器", 4, 15, 305500.0, 20250.0),
        ("オンライン", "ストレージ", 3, 17, 268600.0, 15800.0),
        ("オンライン", "映像機器", 3, 27, 240300.0, 8900.0),
        ("オンライン", "音響機器", 2, 10, 220000.0, 22000.0),
        ("法人", "映像機器", 2, 3, 204000.0, 68000.0),
        ("店舗", "アクセサリ", 2, 55, 154000.0, 2800.0),
        ("オンライン", "アクセサリ", 2, 22, 136400.0, 6200.0),
    ]
    assert sorted(rows, key=lambda r: -r[4]) == expected


# The rewritten queries against the plain ones, on rows that keep no rule at all: NULLs
# everywhere, ids that repeat, customers of several regions, one product and one region
# with a third of the rows.

SALES = (
    "transaction_id int, product_id int, sale_date date, quantity int, unit_price double, "
    "amount double, region string, channel string"
)


def _maybe(rng, value):
    return None if rng.random() < 0.1 else value


@pytest.fixture(scope="module")
def untidy(spark):
    rng = random.Random(5)
    day = datetime.date(2023, 1, 1)

    def hot(values):
        return values[0] if rng.random() < 0.34 else rng.choice(values)

    sold = [
        (
            _maybe(rng, i % 300),
            _maybe(rng, hot(range(40))),
            _maybe(rng, day + datetime.timedelta(days=rng.randrange(400))),
            _maybe(rng, rng.randrange(-3, 20)),
            _maybe(rng, rng.randrange(1, 5000) / 100),
            _maybe(rng, rng.randrange(-900, 5000) / 100),
            _maybe(rng, hot("ABCDEFG")),
            _maybe(rng, rng.choice(["web", "shop", "phone"])),
        )
        for i in range(1500)
    ]
    # A product and a group whose amounts are all NULL.
    sold += [(1, 99, day, 1, None, None, "Z", "fax")] * 3
    products = [
        (
            _maybe(rng, i % 30),
            _maybe(rng, f"p{i % 11}"),
            _maybe(rng, f"c{i % 3}"),
            _maybe(rng, f"s{i % 4}"),
        )
        for i in range(45)
    ] + [(99, "none", None, None)]
    buyers = [
        (
            _maybe(rng, hot(range(60))),
            _maybe(rng, rng.choice(["big", "small"])),
            _maybe(rng, hot("ABCDEFX")),
        )
        for _ in range(300)
    ]
    buyers += [(None, "ghost", "A"), (7, "big", "Z")]
    views = {
        "sales": spark.createDataFrame(sold, SALES),
        "products": spark.createDataFrame(
            products, "product_id int, product_name string, category string, supplier string"
        ),
        "customers": spark.createDataFrame(
            buyers, "customer_id int, segment string, region string"
        ),
    }
    for name, df in views.items():
        df.createOrReplaceTempView("untidy_" + name)
    return views


def _same(left, right):
    def key(row):
        return [(v is not None, str(v)) for v in row]

    return sorted(rows_of(left), key=key) == sorted(rows_of(right), key=key)


def test_summary_equals_plain_sql(spark, untidy):
    plain = spark.sql(
        """SELECT date_format(sale_date, 'yyyy-MM') AS year_month, region, channel,
                  count(transaction_id), sum(quantity), cast(sum(cast(amount AS decimal(18,2))) AS double),
                  cast(sum(cast(amount AS decimal(18,2))) AS double) / nullif(count(amount), 0)
           FROM untidy_sales GROUP BY date_format(sale_date, 'yyyy-MM'), region, channel"""
    )
    assert _same(sales.monthly_sales_summary(untidy["sales"], 2), plain)


def test_ranking_equals_plain_sql(spark, untidy):
    plain = spark.sql(
        """SELECT p.product_id, p.product_name, p.category, p.supplier, count(s.transaction_id),
                  sum(s.quantity), cast(sum(cast(s.amount AS decimal(18,2))) AS double),
                  cast(rank() OVER (ORDER BY sum(cast(s.amount AS decimal(18,2))) DESC) AS bigint)
           FROM untidy_sales s JOIN untidy_products p ON s.product_id = p.product_id
           GROUP BY p.product_id, p.product_name, p.category, p.supplier"""
    )
    ranking = sales.product_sales_ranking(
        untidy["sales"], untidy["products"], 2
    )
    assert _same(ranking, plain)


@pytest.mark.parametrize("word_bits", [62, 2])
@pytest.mark.parametrize("small", [True, False])
def test_segments_equal_plain_sql(spark, untidy, monkeypatch, word_bits, small):
    monkeypatch.setattr(sales, "WORD_BITS", word_bits)
    monkeypatch.setattr(sales, "fits_broadcast", lambda df: small)
    plain = spark.sql(
        """SELECT c.segment, s.channel, count(DISTINCT c.customer_id), count(s.transaction_id),
                  cast(sum(cast(s.amount AS decimal(18,2))) AS double),
                  cast(sum(cast(s.amount AS decimal(18,2))) AS double) / nullif(count(s.amount), 0)
           FROM untidy_sales s JOIN untidy_customers c ON s.region = c.region
           GROUP BY c.segment, s.channel"""
    )
    assert plain.where("segment = 'ghost'").count() > 0
    mine = sales.customer_segment_performance(untidy["sales"], untidy["customers"], 2)
    assert _same(mine, plain)


def test_segments_with_many_channels(spark):
    rows = [(i, "A" if i % 3 else "B", f"channel {i % 100}", float(i)) for i in range(1000)]
    sold = spark.createDataFrame(
        rows, "transaction_id int, region string, channel string, amount double"
    )
    buyers = spark.createDataFrame(
        [(1, "x", "A"), (1, "x", "B"), (2, "x", "A"), (3, "y", "B")],
        "customer_id int, segment string, region string",
    )
    plain = (
        sold.join(buyers, "region")
        .groupBy("segment", "channel")
        .agg(
            F.countDistinct("customer_id"),
            F.count("transaction_id"),
            F.sum("amount"),
            F.avg("amount"),
        )
    )
    assert _same(sales.customer_segment_performance(sold, buyers), plain)


def test_segments_without_sales(spark, untidy):
    none = untidy["sales"].where("false")
    assert rows_of(sales.customer_segment_performance(none, untidy["customers"])) == []


def test_months_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        sold = spark.sql(
            """SELECT 1 AS transaction_id, 1 AS quantity, 1D AS amount, 'r' AS region, 'c' AS channel,
                      timestamp_ntz'2024-03-31 23:59:59' AS sale_date"""
        )
        assert rows_of(sales.monthly_sales_summary(sold))[0][0] == "2024-03"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_too_large_amounts_stop_the_query(spark):
    sold = spark.sql("SELECT date'2024-01-01' AS sale_date, 1e17D AS amount")
    with pytest.raises(Exception, match="does not fit 2 decimal places"):
        sales.monthly_sales_trend(sold, 2).collect()
    assert rows_of(sales.monthly_sales_trend(sold)) == [("2024-01", 1e17)]
