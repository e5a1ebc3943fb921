"""Every query of the package over the star-schema test tables, with its SQL counterpart."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The package lies beside this file, wherever it is loaded from.
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallyfield.operators import (  # noqa: E402
    lineage,
    messages,
    metadata,
    policy,
    preview,
    ranking,
    sales,
)
from tallyfield.plans import jobs  # noqa: E402
from tallyfield.sources import catalog, live, star  # noqa: E402
from tallyfield.sources.schemas import PRODUCTS  # noqa: E402

# The training-data operators are a part of their own; everything else works without it.
try:
    import tallyfield.llm.queries as llm_queries  # noqa: E402
except ModuleNotFoundError as missing:
    if not (missing.name or "").startswith(("tallyfield.llm", "corpus_pipeline")):
        raise
    llm_queries = None

# Money in the test tables has two decimal places.
CENTS = 2
NAMESPACE = "lake.shop"
DERIVED = (
    "monthly_sales_summary",
    "product_sales_ranking",
    "customer_segment_performance",
    "channel_category_analysis",
)
PART = "lake.mart.part_42"
SUPPLIER = "lake.raw.supplier_7"
ORDER_ROW = T.StructType(
    [
        T.StructField("order", T.LongType()),
        T.StructField("col_1", T.StringType()),
        T.StructField("total", T.DoubleType()),
        T.StructField("absent", T.StringType()),
    ]
)
# Of the same documents: flags that are no numbers, and totals that not all fit.
ORDER_STRICT = T.StructType(
    [
        T.StructField("order", T.LongType()),
        T.StructField("col_1", T.IntegerType()),
        T.StructField("total", T.DecimalType(7, 2)),
        T.StructField("absent", T.StringType()),
    ]
)
ORDER_COLUMNS = T.StructType(
    [
        T.StructField("o_orderkey", T.StringType()),
        T.StructField("o_totalprice", T.DecimalType(18, 2)),
    ]
)


def entry(spark: SparkSession) -> DataFrame:
    return queries()["monthly_sales_summary"](spark, "/root/testdata/sf0.001")


def _flat_messages(spark: SparkSession, d: str) -> DataFrame:
    flat = messages.flatten_messages(star.chat_messages(spark, d))
    return flat.select(
        "question",
        "message_id",
        "conversation_id",
        "status",
        F.size("text_responses").cast("bigint").alias("texts"),
        F.array_join("text_responses", "|").alias("text"),
        "sql_query",
        "query_description",
        "attachment_id",
        "error",
    )


def _chat_history(spark: SparkSession, d: str) -> DataFrame:
    entries = messages.chat_history(star.chat_messages(spark, d), star.chat_results(spark, d))
    return entries.select(
        "message_id",
        "question",
        F.array_join("text_responses", "|").alias("text"),
        "sql_query",
        "error",
        F.array_join("result_columns", ",").alias("result_columns"),
        F.array_join(F.flatten("result_rows"), ",").alias("result_values"),
        "query_result_error",
    )


def _masked_customers(spark: SparkSession, d: str) -> DataFrame:
    return policy.apply_column_mask(
        star.table(spark, d, "customer"),
        "Supplier#000000001",
        "customer",
        ["c_name", "c_mktsegment", "c_acctbal"],
        star.column_policy(spark, d),
        masks={"c_name": F.lit("***")},
    )


def _derived(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A derived table, built and written by its job, as it is read back."""
    schema = live.loaded_shop(spark, d, jobs.jobs()[name].sources)
    jobs.run_job(spark, name, schema)
    return catalog.scan(spark, f"{schema}.{name}")


def _loaded_products(spark: SparkSession, d: str) -> DataFrame:
    schema = live.loaded_shop(spark, d, ("products",), times=2)
    return catalog.scan(spark, f"{schema}.products")


def _harvested_tables(spark: SparkSession, d: str) -> DataFrame:
    schema = live.listed_files(spark, d)
    found = metadata.search_tables(catalog.harvest_tables(spark, schema), "spark_catalog", schema)
    return found.drop("full_name")


def _harvested_columns(spark: SparkSession, d: str) -> DataFrame:
    found = metadata.describe_columns(catalog.harvest_columns(spark, live.listed_files(spark, d)))
    return found.withColumn("full_name", F.substring_index("full_name", ".", -1))


def _search_by_index(spark: SparkSession, d: str) -> DataFrame:
    tables = star.tables_meta(spark, d)
    name = f"{catalog.scratch_schema(spark)}.names"
    metadata.write_name_index(spark, name, tables)
    return metadata.search_tables_by_index(tables, catalog.scan(spark, name), "lake", "Brand#1", "BOLT_1")


def _one_live_table(spark: SparkSession, d: str) -> DataFrame:
    schema = live.loaded_shop(spark, d, ("products",))
    table, columns = catalog.describe_one(spark, f"{schema}.products")
    about = metadata.describe_table(table).select(
        "full_name", F.col("type").alias("table_type"), "data_source_format", F.col("comment").alias("table_comment")
    )
    return metadata.describe_columns(columns).join(about, "full_name").drop("full_name")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core_queries() | (llm_queries.queries() if llm_queries else {})


def oracle_sql() -> dict[str, str]:
    return core_oracle_sql() | (llm_queries.oracle_sql() if llm_queries else {})


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "monthly_sales_summary": lambda s, d: sales.monthly_sales_summary(star.sales(s, d), CENTS),
        "monthly_preview": lambda s, d: sales.monthly_preview(star.sales(s, d), 10, CENTS),
        "monthly_sales_trend": lambda s, d: sales.monthly_sales_trend(
            star.channel_sales(s, d), CENTS
        ),
        "product_sales_ranking": lambda s, d: sales.product_sales_ranking(
            star.sale_lines(s, d), star.products(s, d), CENTS
        ),
        "product_sales_ranking_in_slices": lambda s, d: sales.product_sales_ranking(
            star.sale_lines(s, d), star.products(s, d), CENTS
        ),
        "ranking_preview": lambda s, d: sales.ranking_preview(
            star.sale_lines(s, d), star.products(s, d), 10, CENTS
        ),
        "customer_segment_performance": lambda s, d: sales.customer_segment_performance(
            star.sales(s, d), star.customer_segments(s, d), CENTS
        ),
        "customer_segment_performance_by_order": lambda s, d: sales.customer_segment_performance(
            star.order_sales(s, d), star.customer_segments(s, d), CENTS
        ),
        "channel_category_analysis": lambda s, d: sales.channel_category_analysis(
            star.channel_sales(s, d), star.products(s, d), CENTS
        ),
        "top_products_by_revenue": lambda s, d: sales.top_products(
            star.sale_lines(s, d), star.products(s, d), 5, "revenue", CENTS
        ),
        "top_products_by_quantity": lambda s, d: sales.top_products(
            star.sale_lines(s, d), star.products(s, d), 5, "quantity", CENTS
        ),
        "order_quantity_rank": lambda s, d: ranking.global_rank(
            star.sale_lines(s, d).groupBy("transaction_id").agg(F.sum("quantity").alias("units")),
            "units",
            "units_rank",
        ),
        "upstream_tables": lambda s, d: lineage.upstream_tables(star.lineage_events(s, d), PART),
        "downstream_tables": lambda s, d: lineage.downstream_tables(
            star.lineage_events(s, d), SUPPLIER
        ),
        "lineage_for_all": lambda s, d: lineage.lineage_for_all(star.lineage_events(s, d)),
        "lineage_edges_from_documents": lambda s, d: lineage.lineage_edges_from_documents(
            star.lineage_documents(s, d)
        ),
        "neighbours_in_documents": lambda s, d: lineage.neighbours_in_documents(
            star.lineage_documents(s, d), PART, "downstream"
        ),
        "missing_edges": lambda s, d: lineage.missing_edges(
            jobs.declared_edges(s, NAMESPACE), star.job_events(s, d, NAMESPACE)
        ),
        "list_catalogs": lambda s, d: metadata.list_catalogs(
            star.tables_meta(s, d).withColumn("catalog", F.concat("schema", F.lit("_cat")))
        ),
        "list_schemas": lambda s, d: metadata.list_schemas(star.tables_meta(s, d), "lake"),
        "list_tables": lambda s, d: metadata.search_tables(
            star.tables_meta(s, d), "lake", "Brand#1"
        ),
        "search_tables": lambda s, d: metadata.search_tables(
            star.tables_meta(s, d), "lake", "Brand#1", "BOLT_1"
        ),
        "search_result_count": lambda s, d: metadata.row_count(
            metadata.search_tables(star.tables_meta(s, d), "lake", "Brand#1", "_")
        ),
        "describe_tables": lambda s, d: metadata.describe_table(star.tables_meta(s, d)),
        "describe_columns": lambda s, d: metadata.describe_columns(star.columns_meta(s, d)),
        "describe_columns_of_table": lambda s, d: metadata.describe_columns(
            star.columns_meta(s, d), PART
        ),
        "table_row_counts": lambda s, d: metadata.table_row_counts(star.tables(s, d)),
        "preview": lambda s, d: preview.preview(star.binary_pages(s, d), order_by=["page_id"]),
        "render_binary": lambda s, d: preview.render(star.binary_pages(s, d).drop("parts")),
        "flatten_messages": _flat_messages,
        "rows_from_result_documents": lambda s, d: messages.rows_from_result_documents(
            star.result_documents(s, d), ORDER_ROW
        ),
        "rejected_cells": lambda s, d: messages.rejected_cells(star.result_documents(s, d), ORDER_STRICT),
        "result_cells": lambda s, d: messages.result_cells(star.result_documents(s, d)),
        "chat_history": _chat_history,
        "question_answer_pairs": lambda s, d: messages.question_answer_pairs(
            star.table(s, d, "conversations")
        ),
        "question_answer_pairs_in_slices": lambda s, d: messages.question_answer_pairs(
            star.table(s, d, "conversations").withColumn("turn", F.col("turn") * 3)
        ),
        "concat_batches": lambda s, d: preview.concat_batches(
            [
                star.table(s, d, "orders").where(F.col("o_orderstatus") == status)
                .select("o_orderkey", "o_orderstatus")
                for status in ("F", "O", "P")
            ]
        ),
        "declared_columns": lambda s, d: catalog.declared_columns(
            star.table(s, d, "orders").select("o_totalprice", "o_orderkey"), ORDER_COLUMNS
        ),
        "render_cells": lambda s, d: preview.render(
            star.table(s, d, "part").select(
                "p_partkey",
                F.when(F.col("p_size") > 10, F.create_map(F.lit("size"), "p_size")).alias("facts"),
                F.when(F.col("p_size") > 20, F.encode("p_brand", "UTF-8")).alias("body"),
            )
        ),
        "preview_all_binary": lambda s, d: preview.preview(
            star.table(s, d, "nation").select(F.encode("n_name", "UTF-8").alias("body")), n=1000
        ),
        "apply_row_filter": lambda s, d: policy.apply_row_filter(
            star.customer_segments(s, d),
            "ASIA",
            "customer_segments",
            "region",
            star.region_policy(s, d),
        ),
        "apply_column_mask": _masked_customers,
        "search_tables_by_index": _search_by_index,
        "loaded_products": _loaded_products,
        "harvested_tables": _harvested_tables,
        "harvested_columns": _harvested_columns,
        "one_live_table": _one_live_table,
    } | {f"built_{name}": lambda s, d, name=name: _derived(s, d, name) for name in DERIVED}


# ---------------------------------------------------------------------------------------
# SQL counterparts
# ---------------------------------------------------------------------------------------

_SALES = """
WITH sales AS (
  SELECT l_orderkey AS transaction_id, l_partkey AS product_id,
         CAST(l_quantity AS integer) AS quantity,
         CAST(l_extendedprice AS decimal(18,2)) AS amount,
         CAST(CAST(CAST(CAST(l_extendedprice AS decimal(18,2)) * 100 AS bigint)
              // CAST(l_quantity AS bigint) AS double) / 100 AS decimal(18,2)) AS unit_price,
         o_orderdate AS sale_date, o_orderpriority AS channel, n_name AS region
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
)
"""

_MONTHLY = (
    _SALES
    + """
SELECT strftime(sale_date, '%Y-%m') AS year_month, region, channel,
       count(transaction_id) AS transaction_count,
       CAST(sum(quantity) AS bigint) AS total_quantity,
       CAST(sum(amount) AS double) AS total_revenue,
       CAST(sum(amount) AS double) / count(amount) AS avg_transaction_value
FROM sales
GROUP BY 1, 2, 3
"""
)

_RANKING = """
WITH totals AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
         p_brand AS supplier, count(l_orderkey) AS transaction_count,
         CAST(sum(CAST(l_quantity AS integer)) AS bigint) AS total_quantity_sold,
         sum(CAST(l_extendedprice AS decimal(18,2))) AS revenue
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY ALL
)
SELECT product_id, product_name, category, supplier, transaction_count, total_quantity_sold,
       CAST(revenue AS double) AS total_revenue,
       rank() OVER (ORDER BY revenue DESC) AS revenue_rank
FROM totals
"""

_TOP = """
SELECT p_partkey AS product_id, p_name AS product_name, {measure}
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_partkey, p_name
ORDER BY 3 DESC, 1
LIMIT 5
"""

_EVENTS = """
WITH events_log AS (
  SELECT CASE WHEN l_linenumber <> 7 THEN 'lake.raw.supplier_' || l_suppkey END AS source,
         CASE WHEN l_linenumber <> 6 OR l_returnflag <> 'R'
              THEN 'lake.mart.part_' || l_partkey END AS target
  FROM lineitem
)
"""

_TABLES_META = """
WITH inventory AS (
  SELECT *, replace(p_name, ' ', '_') || '_' || p_partkey AS name,
         'lake.' || p_brand || '.' || replace(p_name, ' ', '_') || '_' || p_partkey AS full_name
  FROM part
)
"""

_SEARCH = (
    _TABLES_META
    + """
SELECT name,
       CASE WHEN p_size > 40 THEN 'VIEW' WHEN p_size > 5 THEN 'TABLE' ELSE 'UNKNOWN' END AS type,
       CASE WHEN p_size > 10 THEN p_type ELSE '' END AS comment,
       full_name, name AS display_name
FROM inventory
WHERE p_brand = 'Brand#1'
"""
)

_COLUMNS = """
SELECT 'lake.mart.part_' || l_partkey AS full_name, l_linenumber AS position,
       'c_' || l_orderkey AS column,
       CASE WHEN l_linestatus = 'O' THEN 'bigint' ELSE 'string' END AS type,
       CASE WHEN l_returnflag = 'A' THEN 'Yes' ELSE 'No' END AS nullable,
       CASE WHEN l_returnflag <> 'R' THEN 'supplier ' || l_suppkey ELSE '' END AS comment
FROM lineitem
"""

_MESSAGES = """
WITH flat AS (
  SELECT *, 'turn ' || turn AS question, 'm-' || conv_id || '-' || turn AS message_id,
         'k-' || conv_id AS conversation_id, role = 'user' AND turn % 6 = 4 AS broken,
         CASE WHEN role = 'assistant' THEN text ELSE '' END AS texts,
         CASE WHEN role = 'assistant' THEN 'SELECT ' || turn END AS sql_query,
         CASE WHEN role = 'assistant' THEN
              CASE WHEN turn > 2 THEN 'q-' ELSE 'b-' END || conv_id || '-' || turn
         END AS attachment_id,
         CASE WHEN role = 'system' THEN 'stopped'
              WHEN role = 'user' AND turn % 6 = 4 THEN 'unreadable document'
              WHEN role = 'user' AND turn % 6 = 2 THEN '0'
              WHEN role = 'user' THEN 'no answer' END AS error
  FROM conversations
)
"""

_PAIRS = """
SELECT conv_id, turn, question, answer
FROM (
  SELECT conv_id, turn, role, text AS question,
         CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer
  FROM (SELECT conv_id, role, text, turn * {gap} AS turn FROM conversations)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
)
WHERE role = 'user'
"""

_RESULT_ROWS = """
WITH result_rows AS (
  SELECT o_orderkey AS doc_id, 0 AS row_no, o_orderstatus AS status,
         CAST(CAST(o_totalprice AS decimal(18,2)) AS varchar) AS total, o_orderpriority
  FROM orders WHERE o_orderstatus IN ('F', 'O')
  UNION ALL
  SELECT o_orderkey, 1, NULL, CAST(CAST(o_totalprice AS decimal(18,2)) AS varchar), o_orderpriority
  FROM orders WHERE o_orderstatus = 'F'
)
"""


_LIVE_NAMES = ", ".join(f"'{name}'" for name in star.TABLES)
_LIVE_TYPE = """CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
  WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END"""
_PRODUCT_COLUMNS = [(f.name, f.dataType.simpleString(), f.metadata["comment"]) for f in PRODUCTS.fields]
_PRODUCT_ROWS = ", ".join(f"({i}, '{n}', '{t}', '{c}')" for i, (n, t, c) in enumerate(_PRODUCT_COLUMNS))


def core_oracle_sql() -> dict[str, str]:
    own = _core_sql()
    return own | {
        "search_tables_by_index": own["search_tables"],
        "built_monthly_sales_summary": own["monthly_sales_summary"],
        "built_product_sales_ranking": own["product_sales_ranking"],
        "built_customer_segment_performance": own["customer_segment_performance"],
        "built_channel_category_analysis": own["channel_category_analysis"],
        "loaded_products": """
SELECT CAST(p_partkey AS integer) AS product_id, p_name AS product_name, p_type AS category,
       p_retailprice AS unit_price, p_size AS stock_qty, p_brand AS supplier,
       make_date(2024, p_size % 12 + 1, 5) AS launch_date
FROM part
""",
        "harvested_tables": f"""
SELECT DISTINCT table_name AS name, 'EXTERNAL' AS type, '' AS comment, table_name AS display_name
FROM information_schema.tables WHERE table_name IN ({_LIVE_NAMES})
""",
        "harvested_columns": f"""
SELECT DISTINCT table_name AS full_name, CAST(ordinal_position - 1 AS integer) AS position,
       column_name AS "column", {_LIVE_TYPE} AS type, 'Yes' AS nullable, '' AS comment
FROM information_schema.columns WHERE table_name IN ({_LIVE_NAMES})
""",
        "one_live_table": f"""
SELECT CAST(position AS integer) AS position, name AS "column", kind AS type, 'Yes' AS nullable, said AS comment,
       'MANAGED' AS table_type, 'parquet' AS data_source_format, 'Product catalog' AS table_comment
FROM (VALUES {_PRODUCT_ROWS}) AS t(position, name, kind, said)
""",
    }


def _core_sql() -> dict[str, str]:
    return {
        "monthly_sales_summary": _MONTHLY,
        "monthly_preview": _MONTHLY + "ORDER BY 1, 2, 3 LIMIT 10",
        "monthly_sales_trend": _SALES
        + """
SELECT strftime(sale_date, '%Y-%m') AS year_month, CAST(sum(amount) AS double) AS total_revenue
FROM sales GROUP BY 1
""",
        "product_sales_ranking": _RANKING,
        "product_sales_ranking_in_slices": _RANKING,
        "ranking_preview": _RANKING + "ORDER BY revenue_rank, product_id LIMIT 10",
        "customer_segment_performance": _SALES
        + """
SELECT c_mktsegment AS segment, channel, count(DISTINCT c_custkey) AS customer_count,
       count(transaction_id) AS transaction_count, CAST(sum(amount) AS double) AS total_revenue,
       CAST(sum(amount) AS double) / count(amount) AS avg_order_value
FROM sales
JOIN (SELECT c_custkey, c_mktsegment, n_name
      FROM customer JOIN nation ON c_nationkey = n_nationkey) ON region = n_name
GROUP BY 1, 2
""",
        "customer_segment_performance_by_order": """
WITH homes AS (
  SELECT c_custkey, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
)
SELECT b.c_mktsegment AS segment, o_orderpriority AS channel,
       count(DISTINCT b.c_custkey) AS customer_count, count(o_orderkey) AS transaction_count,
       CAST(sum(CAST(o_totalprice AS decimal(18,2))) AS double) AS total_revenue,
       CAST(sum(CAST(o_totalprice AS decimal(18,2))) AS double) / count(o_totalprice)
         AS avg_order_value
FROM orders JOIN homes a ON o_custkey = a.c_custkey JOIN homes b ON a.n_name = b.n_name
GROUP BY 1, 2
""",
        "channel_category_analysis": _SALES
        + """
SELECT channel, p_type AS category, count(transaction_id) AS transaction_count,
       CAST(sum(quantity) AS bigint) AS total_quantity,
       CAST(sum(amount) AS double) AS total_revenue,
       CAST(sum(unit_price) AS double) / count(unit_price) AS avg_unit_price
FROM sales JOIN part ON product_id = p_partkey
GROUP BY 1, 2
""",
        "top_products_by_revenue": _TOP.format(
            measure="CAST(sum(CAST(l_extendedprice AS decimal(18,2))) AS double) AS total_revenue"
        ),
        "top_products_by_quantity": _TOP.format(
            measure="CAST(sum(CAST(l_quantity AS integer)) AS bigint) AS total_quantity_sold"
        ),
        "order_quantity_rank": """
SELECT l_orderkey AS transaction_id, CAST(sum(CAST(l_quantity AS integer)) AS bigint) AS units,
       rank() OVER (ORDER BY sum(CAST(l_quantity AS integer)) DESC) AS units_rank
FROM lineitem GROUP BY 1
""",
        "upstream_tables": _EVENTS
        + f"""
SELECT DISTINCT source AS tbl FROM events_log
WHERE target = '{PART}' AND source IS NOT NULL ORDER BY tbl LIMIT 100
""",
        "downstream_tables": _EVENTS
        + f"""
SELECT DISTINCT target AS tbl FROM events_log
WHERE source = '{SUPPLIER}' AND target IS NOT NULL ORDER BY tbl LIMIT 100
""",
        "lineage_for_all": _EVENTS
        + """
, edges AS (
  SELECT DISTINCT target AS "table", 'upstream' AS direction, source AS tbl FROM events_log
  WHERE source IS NOT NULL AND target IS NOT NULL
  UNION ALL
  SELECT DISTINCT source, 'downstream', target FROM events_log
  WHERE source IS NOT NULL AND target IS NOT NULL
)
SELECT "table", direction, tbl FROM edges
QUALIFY row_number() OVER (PARTITION BY "table", direction ORDER BY tbl) <= 100
""",
        "lineage_edges_from_documents": """
SELECT DISTINCT 'lake.mart.part_' || l_partkey AS "table", 'upstream' AS direction,
       'lake.raw.supplier_' || l_suppkey AS tbl
FROM lineitem WHERE l_linenumber <> 6 AND l_returnflag <> 'R'
UNION ALL
SELECT DISTINCT 'lake.mart.part_' || l_partkey, 'downstream', 'lake.ops.order_' || l_orderkey
FROM lineitem WHERE l_linenumber <> 7
""",
        "neighbours_in_documents": f"""
SELECT DISTINCT 'lake.ops.order_' || l_orderkey AS tbl
FROM lineitem WHERE l_linenumber <> 7 AND 'lake.mart.part_' || l_partkey = '{PART}' ORDER BY tbl
""",
        "missing_edges": f"""
WITH declared(source, target) AS (VALUES
  ('sales_transactions', 'monthly_sales_summary'),
  ('sales_transactions', 'product_sales_ranking'),
  ('products', 'product_sales_ranking'),
  ('sales_transactions', 'customer_segment_performance'),
  ('customer_segments', 'customer_segment_performance'),
  ('sales_transactions', 'channel_category_analysis'),
  ('products', 'channel_category_analysis')
), seen AS (
  SELECT CASE WHEN l_linenumber <= 2 THEN 'products' WHEN l_linenumber <= 5
              THEN 'sales_transactions' WHEN l_linenumber = 6 THEN 'customer_segments' END AS source,
         CASE WHEN l_returnflag = 'A' THEN 'monthly_sales_summary' WHEN l_returnflag = 'N'
              THEN 'product_sales_ranking' WHEN l_linestatus = 'F'
              THEN 'customer_segment_performance' END AS target
  FROM lineitem
)
SELECT '{NAMESPACE}.' || source AS source, '{NAMESPACE}.' || target AS target
FROM (SELECT source, target FROM declared EXCEPT SELECT source, target FROM seen)
""",
        "list_catalogs": "SELECT DISTINCT p_brand || '_cat' AS catalog FROM part",
        "list_schemas": "SELECT DISTINCT p_brand AS schema FROM part",
        "list_tables": _SEARCH,
        "search_tables": _SEARCH + "AND contains(lower(name), 'bolt_1')",
        "search_result_count": _TABLES_META
        + "SELECT count(*) AS cnt FROM inventory WHERE p_brand = 'Brand#1' AND contains(name, '_')",
        "describe_tables": _TABLES_META
        + """
SELECT full_name,
       CASE WHEN p_size > 40 THEN 'VIEW' WHEN p_size > 5 THEN 'TABLE' ELSE 'N/A' END AS type,
       CASE WHEN p_size <= 40 THEN 'PARQUET' ELSE 'N/A' END AS data_source_format,
       CASE WHEN p_size <= 40 THEN '/lake/' || name END AS storage_location,
       CASE WHEN p_size <> 7 THEN p_brand ELSE 'N/A' END AS created_by,
       CASE WHEN p_size > 20 THEN p_brand ELSE 'N/A' END AS updated_by,
       CASE WHEN p_size > 10 THEN p_type END AS comment
FROM inventory
""",
        "describe_columns": _COLUMNS,
        "describe_columns_of_table": _COLUMNS + f"WHERE 'lake.mart.part_' || l_partkey = '{PART}'",
        "table_row_counts": "\nUNION ALL\n".join(
            f"SELECT '{name}' AS \"table\", count(*) AS cnt FROM {name}" for name in star.TABLES
        ),
        "preview": """
SELECT page_id, url, '{"id":' || page_id || ',"n_chars":' || length(html) || '}' AS facts
FROM pages ORDER BY page_id LIMIT 100
""",
        "render_binary": """
SELECT page_id, url, to_base64(encode(html)) AS body,
       '{"id":' || page_id || ',"n_chars":' || length(html) || '}' AS facts
FROM pages
""",
        "flatten_messages": _MESSAGES
        + """
SELECT question, CASE WHEN broken THEN '' ELSE message_id END AS message_id, conversation_id,
       CASE WHEN role = 'assistant' THEN 'COMPLETED' WHEN role = 'user' AND NOT broken THEN 'FAILED'
            ELSE 'UNKNOWN' END AS status,
       CAST(CASE WHEN texts <> '' THEN 1 ELSE 0 END AS bigint) AS texts, texts AS text,
       sql_query,
       CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'about the turn' END AS query_description,
       attachment_id, error
FROM flat
""",
        "chat_history": _MESSAGES
        + """
SELECT CASE WHEN broken THEN '' ELSE message_id END AS message_id, question, texts AS text,
       sql_query, error,
       CASE WHEN role = 'assistant' AND turn % 10 NOT IN (3, 9) THEN 'turn,col_1' END
         AS result_columns,
       CASE WHEN role = 'assistant' AND turn % 10 NOT IN (3, 9) THEN turn || ',' || conv_id END
         AS result_values,
       CASE WHEN role = 'assistant' AND turn % 10 = 3 THEN 'timed out' END AS query_result_error
FROM flat
""",
        "rows_from_result_documents": _RESULT_ROWS
        + """
SELECT doc_id, row_no, doc_id AS "order", status AS col_1, CAST(total AS double) AS total,
       CAST(NULL AS varchar) AS absent
FROM result_rows
""",
        "rejected_cells": _RESULT_ROWS
        + """
SELECT doc_id, row_no, 1 AS position, 'col_1' AS "column", status AS text, 'int' AS wanted
FROM result_rows WHERE status IS NOT NULL
UNION ALL
SELECT doc_id, row_no, 2, 'total', total, 'decimal(7,2)'
FROM result_rows WHERE CAST(total AS decimal(18,2)) >= 100000
""",
        "result_cells": _RESULT_ROWS
        + """
, cells AS (
  SELECT *, CAST(doc_id AS varchar) AS key, o_orderpriority = '1-URGENT' AS urgent
  FROM result_rows
)
SELECT doc_id, row_no, 0 AS position, CASE WHEN urgent THEN 'total' ELSE 'order' END AS "column",
       CASE WHEN urgent THEN total ELSE key END AS value
FROM cells
UNION ALL
SELECT doc_id, row_no, 1, 'col_1', status FROM cells
UNION ALL
SELECT doc_id, row_no, 2, CASE WHEN urgent THEN 'order' ELSE 'total' END,
       CASE WHEN urgent THEN key ELSE total END
FROM cells
""",
        "question_answer_pairs": _PAIRS.format(gap=1),
        "question_answer_pairs_in_slices": _PAIRS.format(gap=3),
        "concat_batches": "SELECT o_orderkey, o_orderstatus FROM orders "
        "WHERE o_orderstatus IN ('F', 'O', 'P')",
        "declared_columns": "SELECT CAST(o_orderkey AS varchar) AS o_orderkey, "
        "CAST(o_totalprice AS decimal(18,2)) AS o_totalprice FROM orders",
        "render_cells": """
SELECT p_partkey, CASE WHEN p_size > 10 THEN '{"size":' || p_size || '}' END AS facts,
       CASE WHEN p_size > 20 THEN to_base64(encode(p_brand)) END AS body
FROM part
""",
        "preview_all_binary": "SELECT to_base64(encode(n_name)) AS body FROM nation",
        "apply_row_filter": """
SELECT c_custkey AS customer_id, c_name AS company_name, c_mktsegment AS segment, n_name AS region
FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE n_name IN (SELECT n2.n_name FROM supplier JOIN nation n2 ON s_nationkey = n2.n_nationkey
                 JOIN region ON n2.n_regionkey = r_regionkey WHERE r_name = 'ASIA')
""",
        "apply_column_mask": """
WITH granted AS (
  SELECT CASE WHEN s_acctbal > 5000 THEN 'c_name' ELSE 'c_mktsegment' END AS col
  FROM supplier WHERE s_name = 'Supplier#000000001'
)
SELECT c_custkey,
       CASE WHEN 'c_name' IN (SELECT col FROM granted) THEN c_name ELSE '***' END AS c_name,
       c_nationkey, CAST(NULL AS double) AS c_acctbal,
       CASE WHEN 'c_mktsegment' IN (SELECT col FROM granted) THEN c_mktsegment END AS c_mktsegment
FROM customer
""",
    }
