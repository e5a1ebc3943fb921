"""Search and description over an inventory of tables and columns.

`tables` has one row per table, `columns` one per column, with the schemas
`sources.schemas.TABLES_META` and `COLUMNS_META`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import last_part, literal_search, or_default, or_null, yes_no
from ..sources.catalog import write_table

# Folders of a search index.
INDEX_BUCKETS = 64


def list_catalogs(tables: DataFrame) -> DataFrame:
    return tables.select("catalog").distinct()


def list_schemas(tables: DataFrame, catalog: str) -> DataFrame:
    return tables.where(F.col("catalog") == F.lit(catalog)).select("schema").distinct()


def search_tables(tables: DataFrame, catalog: str, schema: str, term: str = "") -> DataFrame:
    """Tables of one schema whose name contains `term`, in any case; the empty term finds all.

    Only the table's own name is searched.
    """
    found = tables.where(
        (F.col("catalog") == F.lit(catalog)) & (F.col("schema") == F.lit(schema))
    )
    if term:
        found = found.where(literal_search(F.col("name"), term))
    return found.select(
        "name",
        or_default(F.col("table_type"), "UNKNOWN").alias("type"),
        F.coalesce("comment", F.lit("")).alias("comment"),
        "full_name",
        last_part(F.col("full_name")).alias("display_name"),
    )


def write_name_index(spark: SparkSession, name: str, tables: DataFrame, buckets: int = INDEX_BUCKETS) -> None:
    """Replace the search index `name`: the inventory's rows, once for every three characters in a
    row of the table's name in lower case, in folders by a hash of these."""
    rows = tables.withColumn("gram", F.explode(F.array_distinct(_grams(F.lower("name")))))
    rows = rows.withColumn("bucket", _gram_bucket(F.col("gram"), buckets))
    # A gram that many names have is spread over files; readers open one folder.
    spread = rows.repartition("bucket", F.pmod(F.xxhash64("full_name"), F.lit(8))).sortWithinPartitions("bucket", "gram")
    write_table(spread, name, "Tables by three characters of their names", partition_by=("bucket",))


def search_tables_by_index(
    tables: DataFrame, index: DataFrame, in_catalog: str, schema: str, term: str, buckets: int = INDEX_BUCKETS
) -> DataFrame:
    """The same as `search_tables`, by the rows of the rarest three characters of the term.

    These are counted first, in their folders alone; what is read then is every row that can
    contain the term, and the test for the term itself decides. A term of fewer than three
    characters has none, and is searched for in the whole inventory.
    """
    asked = index.sparkSession.range(1).select(F.array_distinct(_grams(F.lower(F.lit(term)))).alias("grams"))
    grams = asked.first()["grams"]
    if not grams:
        return search_tables(tables, in_catalog, schema, term)
    in_folders = F.col("bucket").isin([row[0] for row in _buckets_of(index.sparkSession, grams, buckets)])
    counts = index.where(in_folders & F.col("gram").isin(grams)).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    found = {row["gram"]: row["n"] for row in counts.collect()}
    rarest = min(grams, key=lambda g: (found.get(g, 0), g))
    folder = _buckets_of(index.sparkSession, [rarest], buckets)[0][0]
    rows = index.where((F.col("bucket") == folder) & (F.col("gram") == F.lit(rarest)))
    return search_tables(rows, in_catalog, schema, term)


def _grams(text: Column) -> Column:
    """All three characters in a row of a text; none of a shorter one."""
    starts = F.when(F.char_length(text) >= 3, F.sequence(F.lit(1), F.char_length(text) - 2))
    return F.coalesce(F.transform(starts, lambda i: F.substring(text, i, 3)), F.array().cast("array<string>"))


def _gram_bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def _buckets_of(spark: SparkSession, grams: list[str], buckets: int) -> list:
    made = spark.range(1).select(F.explode(F.array(*[F.lit(g) for g in grams])).alias("gram"))
    return made.select(_gram_bucket(F.col("gram"), buckets)).collect()


def describe_table(tables: DataFrame, full_name: str | None = None) -> DataFrame:
    """Properties of one table, or of all; storage location and comment are NULL when empty."""
    wanted = tables if full_name is None else tables.where(F.col("full_name") == F.lit(full_name))
    return wanted.select(
        "full_name",
        or_default(F.col("table_type"), "N/A").alias("type"),
        or_default(F.col("data_source_format"), "N/A").alias("data_source_format"),
        or_null(F.col("storage_location")).alias("storage_location"),
        or_default(F.col("created_by"), "N/A").alias("created_by"),
        or_default(F.col("updated_by"), "N/A").alias("updated_by"),
        or_null(F.col("comment")).alias("comment"),
    )


def describe_columns(columns: DataFrame, full_name: str | None = None) -> DataFrame:
    """Columns of one table, or of all; `position` gives their order within a table."""
    wanted = columns if full_name is None else columns.where(F.col("full_name") == F.lit(full_name))
    return wanted.select(
        "full_name",
        "position",
        F.col("name").alias("column"),
        F.col("type_text").alias("type"),
        yes_no(F.col("nullable")).alias("nullable"),
        F.coalesce("comment", F.lit("")).alias("comment"),
    )


def row_count(rows: DataFrame) -> DataFrame:
    """How many rows a result has, as one row."""
    return rows.agg(F.count(F.lit(1)).alias("cnt"))


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per named table: `table, cnt`."""
    counts = [
        row_count(rows).select(F.lit(name).alias("table"), "cnt") for name, rows in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
