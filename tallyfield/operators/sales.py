"""Sales aggregates.

Inputs have the columns of the base tables in `sources.schemas`: `sales` one row per
transaction, `products` one per product, `customers` one per customer. `money_scale`
is explained at `functions.measures.exact_total`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (
    exact_total,
    fits_broadcast,
    mean_of,
    month_label,
    month_start,
    running_total,
)
from ..session import ensure_checkpoint_dir
from .ranking import global_rank

# Bits of a BIGINT that stand for channels.
WORD_BITS = 62


def monthly_sales_summary(sales: DataFrame, money_scale: int | None = None) -> DataFrame:
    """Transactions, units, revenue and average per month, region and channel."""
    totals = sales.groupBy(month_start("sale_date").alias("month"), "region", "channel").agg(
        F.count("transaction_id").alias("transaction_count"),
        F.sum("quantity").alias("total_quantity"),
        exact_total(sales, "amount", money_scale).alias("revenue"),
        F.count("amount").alias("amounts"),
    )
    return totals.select(
        month_label("month").alias("year_month"),
        "region",
        "channel",
        "transaction_count",
        "total_quantity",
        F.col("revenue").cast("double").alias("total_revenue"),
        mean_of(F.col("revenue"), F.col("amounts")).alias("avg_transaction_value"),
    )


def monthly_preview(
    sales: DataFrame, rows: int = 10, money_scale: int | None = None
) -> DataFrame:
    """First rows of the monthly summary; region and channel settle ties within a month."""
    summary = monthly_sales_summary(sales, money_scale)
    return summary.orderBy("year_month", "region", "channel").limit(rows)


def monthly_sales_trend(sales: DataFrame, money_scale: int | None = None) -> DataFrame:
    """Revenue per month."""
    totals = sales.groupBy(month_start("sale_date").alias("month")).agg(
        exact_total(sales, "amount", money_scale).alias("revenue")
    )
    return totals.select(
        month_label("month").alias("year_month"),
        F.col("revenue").cast("double").alias("total_revenue"),
    )


def product_totals(
    sales: DataFrame, products: DataFrame, money_scale: int | None = None
) -> DataFrame:
    """Transactions, units and revenue (not yet cast to double) per product that was sold.

    Sales are added up per product id before the join, so a best seller reaches it as
    one row and the names travel with products, not with transactions. The second
    grouping, which keeps the result right if ids repeat, needs no further shuffle.
    """
    per_id = sales.groupBy("product_id").agg(
        F.count("transaction_id").alias("id_transactions"),
        F.sum("quantity").alias("id_quantity"),
        exact_total(sales, "amount", money_scale).alias("id_revenue"),
    )
    named = products.select("product_id", "product_name", "category", "supplier")
    return (
        per_id.join(named, "product_id")
        .groupBy("product_id", "product_name", "category", "supplier")
        .agg(
            F.sum("id_transactions").alias("transaction_count"),
            F.sum("id_quantity").alias("total_quantity_sold"),
            F.sum("id_revenue").alias("revenue"),
        )
    )


def product_sales_ranking(
    sales: DataFrame, products: DataFrame, money_scale: int | None = None
) -> DataFrame:
    """Totals per product and their rank by revenue; ties share a rank and leave a gap."""
    totals = product_totals(sales, products, money_scale)
    ranked = global_rank(totals, "revenue", "revenue_rank")
    return ranked.select(*_product_columns(), "revenue_rank")


def ranking_preview(
    sales: DataFrame, products: DataFrame, rows: int = 10, money_scale: int | None = None
) -> DataFrame:
    """First rows of the ranking; the product id settles ties.

    Every product that outranks one of these rows is among them, so ranking just them is enough.
    """
    first = (
        product_totals(sales, products, money_scale)
        .orderBy(F.desc_nulls_last("revenue"), "product_id")
        .limit(rows)
    )
    rank = F.rank().over(Window.orderBy(F.desc_nulls_last("revenue")))
    return first.select(*_product_columns(), rank.cast("bigint").alias("revenue_rank"))


def top_products(
    sales: DataFrame,
    products: DataFrame,
    k: int = 5,
    by: str = "revenue",
    money_scale: int | None = None,
) -> DataFrame:
    """The k best sellers by `revenue` or `quantity`; the product id settles ties."""
    order, name = {
        "revenue": ("revenue", "total_revenue"),
        "quantity": ("total_quantity_sold", "total_quantity_sold"),
    }[by]
    first = (
        product_totals(sales, products, money_scale)
        .orderBy(F.desc_nulls_last(order), "product_id")
        .limit(k)
    )
    measure = F.col(order).cast("double") if by == "revenue" else F.col(order)
    return first.select("product_id", "product_name", measure.alias(name))


def customer_segment_performance(
    sales: DataFrame, customers: DataFrame, money_scale: int | None = None
) -> DataFrame:
    """Sales joined to customers on region, per customer segment and channel.

    Region is a key of neither side: each sale counts once for every customer of its
    region, and revenue is multiplied accordingly. That is the query's meaning. The
    multiplied rows are never made: sales are added up per region and channel, customers
    counted per region and segment, and the totals multiplied by the counts.
    """
    ensure_checkpoint_dir(sales.sparkSession)
    # Written, because it is used twice and rests on the whole of the sales.
    by_channel = (
        sales.where(F.col("region").isNotNull())
        .groupBy("region", "channel")
        .agg(
            F.count("transaction_id").alias("region_transactions"),
            exact_total(sales, "amount", money_scale).alias("region_revenue"),
            F.count("amount").alias("region_amounts"),
        )
        .checkpoint()
    )
    # What is made of it later has fewer and narrower rows, so one measurement is enough.
    small = fits_broadcast(by_channel)
    by_segment = customers.groupBy("region", "segment").agg(F.count(F.lit(1)).alias("copies"))

    def copied(column: str):
        return F.sum(F.col(column) * F.col("copies"))

    totals = (
        by_segment.join(_sent_out(by_channel, small), "region")
        .groupBy("segment", "channel")
        .agg(
            copied("region_transactions").alias("transaction_count"),
            copied("region_revenue").alias("revenue"),
            copied("region_amounts").alias("amounts"),
        )
    )
    counted = _customer_counts(by_channel, customers, small)
    # The groups are the same on both sides, NULL ones included.
    same_group = F.col("segment").eqNullSafe(F.col("s")) & F.col("channel").eqNullSafe(F.col("c"))
    return totals.join(counted, same_group).select(
        "segment",
        "channel",
        "customer_count",
        "transaction_count",
        F.col("revenue").cast("double").alias("total_revenue"),
        mean_of(F.col("revenue"), F.col("amounts")).alias("avg_order_value"),
    )


def _customer_counts(by_channel: DataFrame, customers: DataFrame, small: bool) -> DataFrame:
    """Distinct customers per segment `s` and channel `c` that their regions sell in.

    Each channel is a bit of a word, a region has the bits of its channels. Customers are
    shuffled once per word, not once per channel, and a customer of several regions gets
    the bits of all.
    """
    # Dense numbers, so that few channels make few words however they are partitioned.
    channels = by_channel.select(F.col("channel").alias("c"), F.lit(1).alias("one")).distinct()
    if small:
        before = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
        numbered = channels.withColumn("number", F.coalesce(F.sum("one").over(before), F.lit(0)))
    else:
        numbered = running_total(channels.checkpoint(), [F.col("c")], "one", "number").checkpoint()
    bits = numbered.select(
        "c",
        F.expr(f"number div {WORD_BITS}").alias("word"),
        F.expr(f"shiftleft(1L, cast(number % {WORD_BITS} as int))").alias("bit"),
    )
    in_regions = (
        by_channel.join(_sent_out(bits, small), F.col("channel").eqNullSafe(F.col("c")))
        .groupBy("region", "word")
        .agg(F.bit_or("bit").alias("mask"))
    )
    customers_per_mask = (
        customers.select("region", "segment", "customer_id")
        .join(_sent_out(in_regions, small), "region")
        .groupBy("segment", "customer_id", "word")
        .agg(F.bit_or("mask").alias("mask"))
        .groupBy(F.col("segment").alias("s"), "word", "mask")
        .agg(F.count("customer_id").alias("customers"))
    )
    return (
        customers_per_mask.join(_sent_out(bits, small), "word")
        .where(F.col("mask").bitwiseAND(F.col("bit")) != 0)
        .groupBy("s", "c")
        .agg(F.sum("customers").alias("customer_count"))
    )


def _sent_out(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def channel_category_analysis(
    sales: DataFrame, products: DataFrame, money_scale: int | None = None
) -> DataFrame:
    """Transactions, units, revenue and average sale price per channel and product category.

    The average price is not weighted by units. Sales are added up per product and channel
    before they meet the products, so a best seller is a row for each channel by then.
    """
    per_id = sales.groupBy("product_id", "channel").agg(
        F.count("transaction_id").alias("id_transactions"),
        F.sum("quantity").alias("id_quantity"),
        exact_total(sales, "amount", money_scale).alias("id_revenue"),
        exact_total(sales, "unit_price", money_scale).alias("id_prices"),
        F.count("unit_price").alias("id_priced"),
    )
    totals = (
        per_id.join(products.select("product_id", "category"), "product_id")
        .groupBy("channel", "category")
        .agg(
            F.sum("id_transactions").alias("transaction_count"),
            F.sum("id_quantity").alias("total_quantity"),
            F.sum("id_revenue").alias("revenue"),
            F.sum("id_prices").alias("prices"),
            F.sum("id_priced").alias("priced"),
        )
    )
    return totals.select(
        "channel",
        "category",
        "transaction_count",
        "total_quantity",
        F.col("revenue").cast("double").alias("total_revenue"),
        mean_of(F.col("prices"), F.col("priced")).alias("avg_unit_price"),
    )


def _product_columns() -> list:
    return [
        "product_id",
        "product_name",
        "category",
        "supplier",
        "transaction_count",
        "total_quantity_sold",
        F.col("revenue").cast("double").alias("total_revenue"),
    ]
