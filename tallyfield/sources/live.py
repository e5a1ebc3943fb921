"""Tables of the session catalog made from the star schema: loaded, derived and only listed.

Each call makes a scratch schema of its own, so that reading back is reading what was written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import star
from .catalog import create_schema, load_table, scratch_schema
from .schemas import BASE_TABLES


def _products(spark: SparkSession, folder: str) -> DataFrame:
    """As a service would deliver them: all text, columns in no certain order."""
    return star.table(spark, folder, "part").select(
        F.concat_ws("-", F.lit("2024"), F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0"), F.lit("05")).alias(
            "launch_date"
        ),
        F.col("p_size").cast("string").alias("stock_qty"),
        F.col("p_brand").alias("supplier"),
        F.col("p_retailprice").cast("string").alias("unit_price"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("product_name"),
        F.col("p_partkey").cast("string").alias("product_id"),
        F.lit("not declared").alias("remark"),
    )


def _sales(spark: SparkSession, folder: str) -> DataFrame:
    return star.sales(spark, folder).withColumn("sales_rep", F.lit(None).cast("string"))


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    unknown = {c: F.lit(None).cast("int") for c in ("annual_revenue", "employee_count", "since_year")}
    return star.customer_segments(spark, folder).withColumns(unknown)


ROWS = {"products": _products, "sales_transactions": _sales, "customer_segments": _customers}


def loaded_shop(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(ROWS), times: int = 1) -> str:
    """A schema with base tables, each loaded so many times over."""
    schema = scratch_schema(spark)
    create_schema(spark, schema)  # there already: does nothing
    for name in names:
        for _ in range(times):
            load_table(spark, f"{schema}.{name}", ROWS[name](spark, folder), *BASE_TABLES[name])
    return schema


def listed_files(spark: SparkSession, folder: str) -> str:
    """A schema in which every table of the folder is an external table."""
    schema = scratch_schema(spark)
    for name in star.TABLES:
        spark.catalog.createTable(f"{schema}.{name}", path=f"{folder}/{name}.parquet", source="parquet")
    return schema
