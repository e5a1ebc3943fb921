import threading

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import types as T

from tallyfield.operators import metadata, sales
from tallyfield.plans import jobs
from tallyfield.sources import catalog, schemas

from row_helpers import as_set, rows_of
from fixture_rows import base_tables


@pytest.fixture(scope="module")
def namespace(spark):
    """The base tables loaded and all derived tables built, twice over."""
    for _ in range(2):
        catalog.create_schema(spark, "shop_demo", "It's a \\ demo")
        for name, rows in base_tables().items():
            schema, comment = schemas.BASE_TABLES[name]
            catalog.load_table(spark, f"shop_demo.{name}", rows, schema, comment)
        jobs.run_all(spark, "shop_demo")
    yield "shop_demo"
    spark.sql("DROP SCHEMA shop_demo CASCADE")


DERIVED = {
    "monthly_sales_summary": 36,
    "product_sales_ranking": 15,
    "customer_segment_performance": 10,
    "channel_category_analysis": 12,
}
ALL = {"products": 15, "sales_transactions": 45, "customer_segments": 10, **DERIVED}


def test_row_counts_of_all_tables(spark, namespace):
    tables = {name: catalog.scan(spark, f"{namespace}.{name}") for name in ALL}
    assert as_set(metadata.table_row_counts(tables)) == set(ALL.items())


def test_derived_tables_hold_their_query(spark, namespace, shop):
    table = spark.table(f"{namespace}.monthly_sales_summary")
    built = sales.monthly_sales_summary(shop["sales_transactions"])
    assert rows_of(table, 0, 1, 2) == rows_of(built, 0, 1, 2)
    first = rows_of(spark.table(f"{namespace}.product_sales_ranking"), 7)[0]
    assert (first[0], first[6], first[7]) == (1, 2368000.0, 1)


def test_names(spark, namespace):
    assert namespace in catalog.schemas(spark)
    assert "spark_catalog" in catalog.catalogs(spark)
    comment = spark.sql(f"DESCRIBE SCHEMA {namespace}").collect()
    assert "It's a \\ demo" in {row[1] for row in comment}


def test_inventory(spark, namespace):
    tables = catalog.harvest_tables(spark, namespace)
    found = metadata.search_tables(tables, "spark_catalog", namespace, "SALES")
    assert {r["name"]: r["comment"] for r in found.collect()} == {
        "sales_transactions": "Sales transactions",
        "monthly_sales_summary": "Sales per month, region and channel",
        "product_sales_ranking": "Products by revenue",
    }
    (row,) = metadata.describe_table(
        tables, f"spark_catalog.{namespace}.products"
    ).collect()
    assert (row["type"], row["data_source_format"]) == ("MANAGED", "parquet")
    assert "/products__v" in row["storage_location"]


def test_columns_inventory(spark, namespace):
    columns = catalog.harvest_columns(spark, namespace)
    assert columns.count() == 7 + 9 + 7 + 7 + 8 + 6 + 6
    rows = rows_of(
        metadata.describe_columns(columns, f"spark_catalog.{namespace}.products"), 1
    )
    assert [(r[2], r[3], r[4]) for r in rows] == [
        (f.name, f.dataType.simpleString(), "Yes") for f in schemas.PRODUCTS.fields
    ]
    assert rows[0][5] == "Product id"


def test_load_takes_columns_by_name_and_casts(spark, namespace):
    raw = spark.sql(
        "SELECT '2024-01-02' AS launch_date, 5 AS stock_qty, 'n' AS product_name, 'c' AS category,"
        " 's' AS supplier, '9' AS product_id, 12.5 AS unit_price"
    )
    catalog.load_table(spark, f"{namespace}.one_product", raw, schemas.PRODUCTS)
    table = spark.table(f"{namespace}.one_product")
    assert [f.dataType for f in table.schema.fields] == [f.dataType for f in schemas.PRODUCTS.fields]
    assert table.first()["unit_price"] == 12.5
    wrong = raw.withColumn("launch_date", raw.product_name)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        catalog.load_table(spark, f"{namespace}.one_product", wrong, schemas.PRODUCTS)
    assert rows_of(spark.table(f"{namespace}.one_product").select("product_name")) == [("n",)]
    catalog.drop_table(spark, f"{namespace}.one_product")


def _tables(spark, namespace, start):
    listed = spark.sql(f"SHOW TABLES IN {namespace}").collect()
    return sorted(r["tableName"] for r in listed if r["tableName"].startswith(start))


def test_a_reader_always_finds_a_table(spark, namespace):
    """Fifty replacements, of changing columns, beside a reader that never stops."""
    name = f"{namespace}.moving"
    catalog.write_table(spark.range(3), name)
    found, failures, done = [], [], threading.Event()

    def read():
        other = spark.newSession()
        while not done.is_set():
            try:
                found.append(other.table(name).count())
            except Exception as error:
                failures.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for i in range(50):
            df = spark.range(3) if i % 2 else spark.range(4).selectExpr("id AS k", "'x' AS v")
            catalog.write_table(df.coalesce(1), name, f"round {i}")
    finally:
        done.set()
        reader.join()
    assert not failures and len(found) > 10 and set(found) <= {3, 4}
    # The view, its version and the one before.
    assert len(_tables(spark, namespace, "moving")) == 3
    catalog.drop_table(spark, name)
    assert _tables(spark, namespace, "moving") == []


@pytest.mark.parametrize("at", range(8))
@pytest.mark.parametrize("plain", [False, True])
def test_a_stop_between_any_two_statements_leaves_a_table(spark, namespace, monkeypatch, at, plain):
    """The driver is lost after `at` statements that change something."""
    name = f"{namespace}.stopped"
    if plain:
        spark.range(3).write.saveAsTable(name)
    else:
        for _ in range(3):
            catalog.write_table(spark.range(3), name, "old")
    left = [at]
    sql, save = type(spark).sql, DataFrameWriter.saveAsTable

    def stop(first):
        if first.startswith(("CREATE", "ALTER", "DROP", "save")):
            if not left[0]:
                raise KeyboardInterrupt
            left[0] -= 1

    monkeypatch.setattr(type(spark), "sql", lambda self, q, *a, **k: (stop(q), sql(self, q, *a, **k))[1])
    monkeypatch.setattr(DataFrameWriter, "saveAsTable", lambda self, *a, **k: (stop("save"), save(self, *a, **k))[1])
    stopped = False
    try:
        catalog.write_table(spark.range(9), name, "new")
    except KeyboardInterrupt:
        stopped = True
    monkeypatch.undo()
    if plain and at == 1:  # between the two statements that make a plain table a version
        assert stopped and not spark.catalog.tableExists(name)
        catalog.recover_table(spark, name)
    assert spark.table(name).count() == (9 if not stopped or at >= (4 if plain else 2) else 3)
    catalog.write_table(spark.range(5), name, "newer")
    assert spark.table(name).count() == 5 and len(_tables(spark, namespace, "stopped")) <= 3
    catalog.drop_table(spark, name)
    assert _tables(spark, namespace, "stopped") == []


def test_a_version_that_lost_its_view_is_found_again(spark, namespace):
    name = f"{namespace}.halfway"
    catalog.write_table(spark.range(3), name)
    spark.sql(f"DROP VIEW {name}")
    assert len(catalog.harvest_tables(spark, namespace).where("name LIKE 'halfway%'").collect()) == 1
    catalog.recover_table(spark, name)
    assert spark.table(name).count() == 3
    (row,) = catalog.harvest_tables(spark, namespace).where("name LIKE 'halfway%'").collect()
    assert (row["name"], row["table_type"]) == ("halfway", "MANAGED")
    catalog.drop_table(spark, name)


def test_catalog_and_single_table(spark, namespace):
    assert namespace in catalog.schemas(spark, "spark_catalog")
    assert catalog.harvest_tables(spark, f"spark_catalog.{namespace}").count() == 7
    assert catalog.harvest_columns(spark, namespace, "spark_catalog").count() == 50
    table, columns = catalog.describe_one(spark, f"spark_catalog.{namespace}.products")
    assert table.first()["full_name"] == f"spark_catalog.{namespace}.products"
    assert [r["type_text"] for r in columns.orderBy("position").collect()] == [
        f.dataType.simpleString() for f in schemas.PRODUCTS.fields
    ]
    assert catalog.name_parts("a.`b``c.d`.e") == ["a", "b`c.d", "e"]


def test_scan_reads_paths(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert catalog.scan(spark, str(tmp_path / "t")).count() == 3


def test_a_failed_build_leaves_the_old_table(spark, namespace):
    name = f"{namespace}.kept"
    catalog.write_table(spark.range(3), name, "three")
    broken = spark.range(5).selectExpr("id", "if(id = 4, raise_error('no'), 1) AS v")
    with pytest.raises(Exception, match="no"):
        catalog.write_table(broken, name)
    assert spark.table(name).count() == 3
    # A build may read the table it replaces.
    catalog.write_table(spark.table(name).where("id > 0"), name, "two")
    assert rows_of(spark.table(name), 0) == [(1,), (2,)]
    tables = catalog.harvest_tables(spark, namespace)
    (row,) = metadata.describe_table(tables, f"spark_catalog.{name}").collect()
    assert row["comment"] == "two"
    catalog.drop_table(spark, name)


def _above_scans(plan):
    """Exchanges between a scan and the first join above it."""
    return plan.split("Join", 1)[1]


@pytest.mark.parametrize("query", [sales.product_sales_ranking, sales.channel_category_analysis])
def test_bucketed_tables_are_joined_without_an_exchange(spark, query):
    schema = catalog.scratch_schema(spark)
    for name in ("products", "sales_transactions"):
        declared, comment = schemas.BASE_TABLES[name]
        catalog.load_table(
            spark, f"{schema}.{name}", base_tables()[name], declared, comment, bucket_by=("product_id",), buckets=4
        )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact, parts = (spark.table(f"{schema}.{n}") for n in ("sales_transactions", "products"))
        joined = sales.product_totals(fact, parts, 2) if query is sales.product_sales_ranking else query(fact, parts, 2)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan
        assert "Exchange" not in _above_scans(plan)
        want = query(*(spark.createDataFrame(base_tables()[n], schemas.BASE_TABLES[n][0]) for n in ("sales_transactions", "products")), 2)
        assert sorted(map(tuple, query(fact, parts, 2).collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_key_is_not_put_into_one_bucket(spark, caplog):
    schema = catalog.scratch_schema(spark)
    rows = spark.range(900).selectExpr("cast(if(id % 3 = 0, 7, id) as int) AS product_id", "'x' AS category")
    declared = T.StructType([T.StructField("product_id", T.IntegerType()), T.StructField("category", T.StringType())])
    catalog.load_table(spark, f"{schema}.hot", rows, declared, bucket_by=("product_id",), buckets=64)
    assert "without buckets" in caplog.text and spark.table(f"{schema}.hot").count() == 900
    even = rows.where("product_id <> 7")
    catalog.load_table(spark, f"{schema}.even", even, declared, bucket_by=("product_id",), buckets=8)
    plan = spark.table(f"{schema}.even").groupBy("product_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_harvest_describes_only_what_changed(spark, monkeypatch):
    schema, inventory = catalog.scratch_schema(spark), catalog.scratch_schema(spark)
    for i in range(60):
        spark.sql(f"CREATE TABLE {schema}.t{i} (id bigint COMMENT 'number {i}', v array<string>) USING parquet")
    catalog.write_table(spark.range(2), f"{schema}.own", "first")
    described, facts = [], catalog._facts
    monkeypatch.setattr(catalog, "_facts", lambda s, n, **k: described.append(n[-1]) or facts(s, n, **k))

    def harvest():
        described.clear()
        n = catalog.harvest_into(spark, schema, f"{inventory}.harvest", batch=25)
        found = {x for x in described if x == "own" or x.startswith("t")}
        assert len(found) == n
        return found

    assert len(harvest()) == 61 and harvest() == set()
    spark.sql(f"ALTER TABLE {schema}.t7 ADD COLUMNS (extra int)")
    spark.sql(f"DROP TABLE {schema}.t8")
    catalog.write_table(spark.range(3).selectExpr("id", "1 AS w"), f"{schema}.own", "second")
    assert harvest() == {"t7", "own"} and harvest() == set()
    tables, columns = catalog.harvested(spark.table(f"{inventory}.harvest"))
    assert as_set(tables) == as_set(catalog.harvest_tables(spark, schema))
    assert as_set(columns) == as_set(catalog.harvest_columns(spark, schema))
    assert tables.count() == 60


def test_a_harvest_goes_on_where_it_was(spark, monkeypatch):
    schema, inventory = catalog.scratch_schema(spark), catalog.scratch_schema(spark)
    for i in range(20):
        spark.sql(f"CREATE TABLE {schema}.t{i:02d} (id bigint) USING parquet")
    facts = catalog._facts

    def lost(s, name, **k):
        if name[-1] == "t15":
            raise KeyboardInterrupt
        return facts(s, name, **k)

    monkeypatch.setattr(catalog, "_facts", lost)
    with pytest.raises(KeyboardInterrupt):
        catalog.harvest_into(spark, schema, f"{inventory}.harvest", workers=2, batch=5)
    monkeypatch.undo()
    assert catalog.harvested(spark.table(f"{inventory}.harvest"))[0].count() == 15
    assert catalog.harvest_into(spark, schema, f"{inventory}.harvest", workers=2, batch=5) == 5
    assert catalog.harvested(spark.table(f"{inventory}.harvest"))[0].count() == 20
