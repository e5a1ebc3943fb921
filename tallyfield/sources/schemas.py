"""Declared schemas of the base tables and of the metadata inventory."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*columns: tuple[str, T.DataType, str]) -> T.StructType:
    return T.StructType(
        [T.StructField(name, kind, True, {"comment": comment}) for name, kind, comment in columns]
    )


PRODUCTS = _schema(
    ("product_id", T.IntegerType(), "Product id"),
    ("product_name", T.StringType(), "Product name"),
    ("category", T.StringType(), "Category"),
    ("unit_price", T.DoubleType(), "List price in yen"),
    ("stock_qty", T.IntegerType(), "Units in stock"),
    ("supplier", T.StringType(), "Supplier"),
    ("launch_date", T.DateType(), "Launch date"),
)

SALES_TRANSACTIONS = _schema(
    ("transaction_id", T.IntegerType(), "Transaction id"),
    ("product_id", T.IntegerType(), "Product id"),
    ("sale_date", T.DateType(), "Date of sale"),
    ("quantity", T.IntegerType(), "Units sold"),
    ("unit_price", T.DoubleType(), "Price per unit in yen"),
    ("amount", T.DoubleType(), "Amount in yen"),
    ("region", T.StringType(), "Region"),
    ("sales_rep", T.StringType(), "Sales person"),
    ("channel", T.StringType(), "Sales channel"),
)

CUSTOMER_SEGMENTS = _schema(
    ("customer_id", T.IntegerType(), "Customer id"),
    ("company_name", T.StringType(), "Company"),
    ("segment", T.StringType(), "Customer segment"),
    ("region", T.StringType(), "Region"),
    ("annual_revenue", T.DoubleType(), "Revenue per year in 10,000 yen"),
    ("employee_count", T.IntegerType(), "Employees"),
    ("since_year", T.IntegerType(), "Customer since"),
)

BASE_TABLES = {
    "products": (PRODUCTS, "Product catalog"),
    "sales_transactions": (SALES_TRANSACTIONS, "Sales transactions"),
    "customer_segments": (CUSTOMER_SEGMENTS, "Customer segments"),
}

TABLES_META = (
    "catalog string, schema string, name string, full_name string, table_type string, "
    "comment string, data_source_format string, storage_location string, "
    "created_by string, updated_by string"
)
COLUMNS_META = (
    "full_name string, position int, name string, type_text string, nullable boolean, "
    "comment string"
)
