"""The logical tables of this package, over Parquet tables of an order-processing star schema.

Sales lines carry the money, orders the date and channel, the customer's nation is the
region; parts are the products. Event logs, inventories and documents, which a lake's
services would deliver, are derived from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Declared, so that opening a table needs no job to look into its files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLES = list(SCHEMAS)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: table(spark, folder, name) for name in TABLES}


def sale_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Sales without date, region and channel: what product totals need."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("transaction_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        # Whole cents, cut off.
        F.expr(
            "cast(cast(cast(l_extendedprice as decimal(18,2)) * 100 as bigint)"
            " div cast(l_quantity as bigint) as double) / 100"
        ).alias("unit_price"),
        F.col("l_extendedprice").alias("amount"),
    )


def orders_placed(spark: SparkSession, folder: str) -> DataFrame:
    """Date and channel of each order."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("sale_date"),
        F.col("o_orderpriority").alias("channel"),
    )


def channel_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales with date and channel, without region."""
    orders = orders_placed(spark, folder).drop("customer_id")
    return sale_lines(spark, folder).join(orders, "transaction_id")


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """Whole sales rows. Orders meet their customers before the lines, which are many more."""
    homes = customer_segments(spark, folder).select("customer_id", "region")
    orders = orders_placed(spark, folder).join(homes, "customer_id").drop("customer_id")
    return sale_lines(spark, folder).join(orders, "transaction_id")


def order_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales with one row per order and its total, where the lines do not matter."""
    homes = customer_segments(spark, folder).select("customer_id", "region")
    totals = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_orderpriority").alias("channel"),
        F.col("o_totalprice").alias("amount"),
    )
    return totals.join(homes, "customer_id").drop("customer_id")


def products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("unit_price"),
        F.col("p_brand").alias("supplier"),
    )


def customer_segments(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("region"))
    customers = table(spark, folder, "customer")
    return customers.join(nations, customers.c_nationkey == nations.n_nationkey).select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("company_name"),
        F.col("c_mktsegment").alias("segment"),
        "region",
    )


def lineage_events(spark: SparkSession, folder: str) -> DataFrame:
    """Each line is a run that read its supplier's table and wrote its part's; some ends are unknown."""
    line = F.col("l_linenumber")
    source = F.concat(F.lit("lake.raw.supplier_"), F.col("l_suppkey"))
    target = F.concat(F.lit("lake.mart.part_"), F.col("l_partkey"))
    return table(spark, folder, "lineitem").select(
        F.when(line != 7, source).alias("source_table_full_name"),
        F.when((line != 6) | (F.col("l_returnflag") != "R"), target).alias("target_table_full_name"),
    )


def job_events(spark: SparkSession, folder: str, namespace: str) -> DataFrame:
    """Runs of the derived tables' jobs: the line number picks the source, the status the target."""
    source = (
        F.when(F.col("l_linenumber") <= 2, "products")
        .when(F.col("l_linenumber") <= 5, "sales_transactions")
        .when(F.col("l_linenumber") == 6, "customer_segments")
    )
    target = (
        F.when(F.col("l_returnflag") == "A", "monthly_sales_summary")
        .when(F.col("l_returnflag") == "N", "product_sales_ranking")
        .when(F.col("l_linestatus") == "F", "customer_segment_performance")
    )
    prefix = F.lit(namespace + ".")
    return table(spark, folder, "lineitem").select(
        F.concat(prefix, source).alias("source_table_full_name"),
        F.concat(prefix, target).alias("target_table_full_name"),
    )


def lineage_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One document per line, about its part's table: the supplier's table is upstream, unless
    returned, when it is a view; the order's table is downstream. Some nodes lack their facts."""
    returned = F.col("l_returnflag") == "R"
    kind = F.when(returned, "VIEW").otherwise("TABLE")
    up = F.concat(
        F.lit('{"tableInfo":{"catalog_name":"lake","schema_name":"raw","name":"supplier_'),
        F.col("l_suppkey"),
        F.lit('","table_type":"'),
        kind,
        F.lit('"}}'),
    )
    down = F.concat(
        F.lit('{"tableInfo":{"catalog_name":"lake","schema_name":"ops","name":"order_'),
        F.col("l_orderkey"),
        F.lit('","table_type":"TABLE"}}'),
    )
    document = (
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit('{"upstreams":[{},'), up, F.lit("]}")))
        .when(
            F.col("l_linenumber") == 6,
            F.concat(F.lit('{"upstreams":null,"downstreams":['), down, F.lit("]}")),
        )
        .otherwise(
            F.concat(
                F.lit('{"upstreams":['), up, F.lit('],"downstreams":['), down, F.lit(","), down,
                F.lit("]}"),
            )
        )
    )
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("lake.mart.part_"), F.col("l_partkey")).alias("table"),
        document.alias("document"),
    )


def tables_meta(spark: SparkSession, folder: str) -> DataFrame:
    """An inventory with a table per part: its brand is the schema."""
    name = F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey"))
    size = F.col("p_size")
    return table(spark, folder, "part").select(
        F.lit("lake").alias("catalog"),
        F.col("p_brand").alias("schema"),
        name.alias("name"),
        F.concat(F.lit("lake."), F.col("p_brand"), F.lit("."), name).alias("full_name"),
        F.when(size > 5, F.when(size > 40, "VIEW").otherwise("TABLE")).alias("table_type"),
        F.when(size > 10, F.col("p_type")).when(size > 8, "").alias("comment"),
        F.when(size <= 40, "PARQUET").alias("data_source_format"),
        F.when(size <= 40, F.concat(F.lit("/lake/"), name)).otherwise("").alias("storage_location"),
        F.when(size != 7, F.col("p_brand")).alias("created_by"),
        F.when(size > 20, F.col("p_brand")).otherwise("").alias("updated_by"),
    )


def columns_meta(spark: SparkSession, folder: str) -> DataFrame:
    """A column per line, in its part's table."""
    flag = F.col("l_returnflag")
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("lake.mart.part_"), F.col("l_partkey")).alias("full_name"),
        F.col("l_linenumber").alias("position"),
        F.concat(F.lit("c_"), F.col("l_orderkey")).alias("name"),
        F.when(F.col("l_linestatus") == "O", "bigint").otherwise("string").alias("type_text"),
        F.when(flag == "A", True).when(flag == "N", False).alias("nullable"),
        F.when(flag != "R", F.concat(F.lit("supplier "), F.col("l_suppkey"))).alias("comment"),
    )


def binary_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with columns of the types that a preview treats in its own way."""
    body = F.col("html").cast("binary")
    return table(spark, folder, "pages").select(
        "page_id",
        "url",
        body.alias("body"),
        F.array(body).alias("parts"),
        F.struct(F.col("page_id").alias("id"), F.length("html").alias("n_chars")).alias("facts"),
    )


def chat_messages(spark: SparkSession, folder: str) -> DataFrame:
    """A message document per turn. Assistants attach a text and two queries, of which the last
    counts; system turns failed; users' attachments are NULL."""
    key = F.concat(F.col("conv_id"), F.lit("-"), F.col("turn"))
    parts = [
        F.struct(F.struct(F.col("text").alias("content")).alias("text")),
        F.struct(
            F.concat(F.lit("a-"), key).alias("attachment_id"),
            F.struct(F.lit("SELECT 1").alias("query"), F.lit("first").alias("description")).alias(
                "query"
            ),
        ),
        F.struct(
            F.concat(F.lit("b-"), key).alias("attachment_id"),
            F.struct(
                F.when(F.col("turn") > 2, F.concat(F.lit("q-"), key)).alias("id"),
                F.concat(F.lit("SELECT "), F.col("turn")).alias("query"),
                F.when(F.col("turn") % 4 == 1, "about the turn").alias("description"),
            ).alias("query"),
        ),
        F.struct(F.struct().alias("query"), F.struct(F.lit("").alias("content")).alias("text")),
    ]
    attachments = F.concat_ws(",", *[F.to_json(part) for part in parts])
    head = F.concat(
        F.lit('{"id":"m-'), key, F.lit('","conversation_id":"c-'), F.col("conv_id"), F.lit('"')
    )
    role = F.col("role")
    document = (
        F.when(
            role == "assistant",
            F.concat(head, F.lit(',"status":"COMPLETED","attachments":['), attachments, F.lit("]}")),
        )
        .when(role == "system", F.concat(head, F.lit(',"error":{"message":"stopped","code":7}}')))
        # Broken off, an error that reads like a number, a plain error.
        .when(F.col("turn") % 6 == 4, F.concat(head, F.lit(',"status":"FAIL')))
        .when(F.col("turn") % 6 == 2, F.concat(head, F.lit(',"status":"FAILED","error":"0"}')))
        .otherwise(F.concat(head, F.lit(',"status":"FAILED","error":"no answer","attachments":null}')))
    )
    # The conversation asked in is not the one the documents name.
    return table(spark, folder, "conversations").select(
        F.concat(F.lit("turn "), F.col("turn")).alias("question"),
        F.concat(F.lit("k-"), F.col("conv_id")).alias("conversation_id"),
        document.alias("document"),
    )


def chat_results(spark: SparkSession, folder: str) -> DataFrame:
    """The results of the assistants' queries; every tenth turn has none, the third of ten failed."""
    turns = table(spark, folder, "conversations").where(
        (F.col("role") == "assistant") & (F.col("turn") % 10 != 9)
    )
    key = F.concat(F.col("conv_id"), F.lit("-"), F.col("turn"))
    late = F.col("turn") > 2
    return turns.select(
        F.concat(F.lit("m-"), key).alias("message_id"),
        F.concat(F.lit("k-"), F.col("conv_id")).alias("conversation_id"),
        F.concat(F.when(late, "q-").otherwise("b-"), key).alias("attachment_id"),
        F.concat(
            F.lit('{"statement_response":{"manifest":{"schema":{"columns":[{"name":"turn"},{}]}},'),
            F.lit('"result":{"data_array":[["'),
            F.col("turn"),
            F.lit('","'),
            F.col("conv_id"),
            F.lit('"]]}}}'),
        ).alias("document"),
        F.when(F.col("turn") % 10 == 3, "timed out").alias("error"),
    )


def result_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A result document per order: two rows for finished orders, none for pending ones. The
    second column has no name; the third comes first in urgent orders."""
    total = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    names = F.when(urgent, '[{"name":"total"},{},{"name":"order"}]').otherwise(
        '[{"name":"order"},{},{"name":"total"}]'
    )

    def row(second):
        plain = F.concat(
            F.lit('["'), F.col("o_orderkey"), F.lit('",'), second, F.lit(',"'), total, F.lit('"]')
        )
        turned = F.concat(
            F.lit('["'), total, F.lit('",'), second, F.lit(',"'), F.col("o_orderkey"), F.lit('"]')
        )
        return F.when(urgent, turned).otherwise(plain)

    status = F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"'))
    rows = (
        F.when(F.col("o_orderstatus") == "F", F.concat(row(status), F.lit(","), row(F.lit("null"))))
        .when(F.col("o_orderstatus") == "O", row(status))
        .otherwise("")
    )
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(
            F.lit('{"statement_response":{"manifest":{"schema":{"columns":'),
            names,
            F.lit('}},"result":{'),
            F.when(rows != "", F.concat(F.lit('"data_array":['), rows, F.lit("]"))).otherwise(""),
            F.lit("}}}"),
        ).alias("document"),
    )


def region_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Grants: the staff of a region see the customers of the nations its suppliers are in."""
    nations = table(spark, folder, "nation")
    regions = table(spark, folder, "region")
    suppliers = table(spark, folder, "supplier")
    return (
        suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey)
        .join(regions, nations.n_regionkey == regions.r_regionkey)
        .select(
            F.col("r_name").alias("user"),
            F.lit("customer_segments").alias("table"),
            F.col("n_name").alias("key"),
        )
    )


def column_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Grants: a supplier's balance decides which customer columns it may see."""
    balance = F.col("s_acctbal")
    return table(spark, folder, "supplier").select(
        F.col("s_name").alias("user"),
        F.lit("customer").alias("table"),
        F.when(balance > 5000, "c_name").otherwise("c_mktsegment").alias("column"),
    )
