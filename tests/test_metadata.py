import pytest

from tallyfield.operators import metadata
from tallyfield.sources.schemas import COLUMNS_META, TABLES_META

from tallyfield.sources.catalog import scratch_schema

from row_helpers import as_set, rows_of


@pytest.fixture(scope="module")
def tables(spark):
    def row(name, kind="MANAGED", comment="", schema="s", catalog="c", **rest):
        return (
            catalog,
            schema,
            name,
            f"{catalog}.{schema}.{name}",
            kind,
            comment,
            rest.get("format"),
            rest.get("location"),
            rest.get("creator"),
            rest.get("updater"),
        )

    rows = [
        row("a_b", comment="first"),
        row("axb", kind=None, comment=None),
        row("A%B", kind="", location="", creator="", updater="me"),
        row("Sales.2024", kind="VIEW", format="DELTA", location="/l", creator="you"),
        row("a_b", schema="other"),
        row("a_b", catalog="d"),
    ]
    return spark.createDataFrame(rows, TABLES_META)


@pytest.mark.parametrize(
    "term, names",
    [
        ("", ["A%B", "Sales.2024", "a_b", "axb"]),
        ("_", ["a_b"]),
        ("%", ["A%B"]),
        (".", ["Sales.2024"]),
        ("SALES", ["Sales.2024"]),
        ("a", ["A%B", "Sales.2024", "a_b", "axb"]),
        (" a", []),
        ("c.s", []),
        ("first", []),
    ],
)
def test_search(tables, term, names):
    found = metadata.search_tables(tables, "c", "s", term)
    assert sorted(r["name"] for r in found.collect()) == names
    assert rows_of(metadata.row_count(found)) == [(len(names),)]


def test_search_shows_defaults(tables):
    found = {r["name"]: r for r in metadata.search_tables(tables, "c", "s").collect()}
    assert tuple(found["axb"]) == ("axb", "UNKNOWN", "", "c.s.axb", "axb")
    assert found["A%B"]["type"] == "UNKNOWN"
    assert found["a_b"]["comment"] == "first"
    assert found["Sales.2024"]["display_name"] == "2024"


def test_lists(tables):
    assert as_set(metadata.list_catalogs(tables)) == {("c",), ("d",)}
    assert as_set(metadata.list_schemas(tables, "c")) == {("s",), ("other",)}


def test_describe_table(tables):
    assert rows_of(metadata.describe_table(tables, "c.s.Sales.2024")) == [
        ("c.s.Sales.2024", "VIEW", "DELTA", "/l", "you", "N/A", None)
    ]
    assert rows_of(metadata.describe_table(tables, "c.s.A%B")) == [
        ("c.s.A%B", "N/A", "N/A", None, "N/A", "me", None)
    ]
    assert metadata.describe_table(tables).count() == 6


def test_describe_columns(spark):
    rows = [
        ("c.s.t", 0, "id", "bigint", False, None),
        ("c.s.t", 1, "name", "string", True, "a name"),
        ("c.s.t", 2, "odd", None, None, ""),
        ("c.s.u", 0, "id", "int", True, None),
    ]
    columns = spark.createDataFrame(rows, COLUMNS_META)
    assert rows_of(metadata.describe_columns(columns, "c.s.t"), 1) == [
        ("c.s.t", 0, "id", "bigint", "No", ""),
        ("c.s.t", 1, "name", "string", "Yes", "a name"),
        ("c.s.t", 2, "odd", None, "No", ""),
    ]
    assert metadata.describe_columns(columns).count() == 4


def test_table_row_counts(shop):
    assert as_set(metadata.table_row_counts(shop)) == {
        ("products", 15),
        ("sales_transactions", 45),
        ("customer_segments", 10),
    }


def test_the_index_finds_what_the_scan_finds(spark):
    names = ["Sales_2024", "sales%2024", "sales.2024", "x", "ab", "É_été_sales", "SALES_2024_sales", "sale", "中文表格", None]
    rows = [("c", s, n, f"c.{s}.{n}", "TABLE", None, "parquet", None, None, None) for s in ("s", "t") for n in names]
    rows += [("c", "s", f"other_{i}", f"c.s.other_{i}", None, "said", "parquet", None, None, None) for i in range(300)]
    tables = spark.createDataFrame(rows, TABLES_META)
    name = f"{scratch_schema(spark)}.names"
    metadata.write_name_index(spark, name, tables)
    index = spark.table(name)
    for term in ("", "a", "ES", "ales", "sales_2024", "s%2", "s.2", "_20", "ÉTÉ", "文表格", "nothing", "other_1", "20244"):
        want = rows_of(metadata.search_tables(tables, "c", "s", term), 3)
        assert rows_of(metadata.search_tables_by_index(tables, index, "c", "s", term), 3) == want, term
    rare = metadata.search_tables_by_index(tables, index, "c", "s", "s%2")
    rare.collect()
    # One folder of the index is opened.
    assert "PartitionCount: 1" in rare._jdf.queryExecution().executedPlan().treeString() or len(
        {f.split("bucket=")[1].split("/")[0] for f in rare.inputFiles()}
    ) == 1
