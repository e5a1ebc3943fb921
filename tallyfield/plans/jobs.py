"""The derived tables as jobs: what each reads, how it is built, how it is written."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sales
from ..sources.catalog import write_table


@dataclass(frozen=True)
class Job:
    sources: tuple[str, ...]
    build: Callable[..., DataFrame]
    order_by: tuple[str | Column, ...]
    comment: str
    # Decimal places of the money it adds up: its sums are the same in every run.
    money_scale: int | None = 2


def jobs() -> dict[str, Job]:
    by_revenue = (F.desc("total_revenue"),)
    return {
        "monthly_sales_summary": Job(
            ("sales_transactions",),
            sales.monthly_sales_summary,
            ("year_month", "region", "channel"),
            "Sales per month, region and channel",
        ),
        "product_sales_ranking": Job(
            ("sales_transactions", "products"),
            sales.product_sales_ranking,
            ("revenue_rank",),
            "Products by revenue",
        ),
        "customer_segment_performance": Job(
            ("sales_transactions", "customer_segments"),
            sales.customer_segment_performance,
            by_revenue,
            "Sales per customer segment and channel",
        ),
        "channel_category_analysis": Job(
            ("sales_transactions", "products"),
            sales.channel_category_analysis,
            by_revenue,
            "Sales per channel and product category",
        ),
    }


def run_job(spark: SparkSession, name: str, namespace: str, money_scale: int | None = -1) -> None:
    """Build one derived table from the base tables of `namespace` and replace it there.

    `money_scale` takes the place of the job's own, if given; None is the plain double sum.
    """
    job = jobs()[name]
    money_scale = job.money_scale if money_scale == -1 else money_scale
    inputs = [spark.table(f"{namespace}.{source}") for source in job.sources]
    write_table(
        job.build(*inputs, money_scale=money_scale),
        f"{namespace}.{name}",
        job.comment,
        job.order_by,
    )


def run_all(spark: SparkSession, namespace: str, money_scale: int | None = -1) -> None:
    """Build all derived tables; they read base tables only, so any order will do."""
    for name in jobs():
        run_job(spark, name, namespace, money_scale)


def declared_edges(spark: SparkSession, namespace: str) -> DataFrame:
    """The lineage that the jobs declare: `source, target`."""
    edges = [(source, name) for name, job in jobs().items() for source in job.sources]
    columns = {
        "source": [f"{namespace}.{source}" for source, _ in edges],
        "target": [f"{namespace}.{name}" for _, name in edges],
    }
    return spark.createDataFrame(pa.table(columns))
