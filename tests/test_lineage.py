import json

import pytest

from tallyfield.sources import catalog
from tallyfield.operators import lineage
from tallyfield.plans import jobs

from row_helpers import as_set, rows_of

EVENTS = "source_table_full_name string, target_table_full_name string"


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        ("c.s.a", "c.s.x"),
        ("c.s.a", "c.s.x"),
        ("c.s.b", "c.s.x"),
        (None, "c.s.x"),
        ("c.s.a", None),
        (None, None),
        ("c.s.x", "c.s.x"),
        ("c.s.x", "c.s.it's"),
    ]
    # One table with a third of all edges and more neighbours than are listed.
    rows += [("c.s.hub", f"c.s.t{i:04d}") for i in range(250)] * 2
    return spark.createDataFrame(rows, EVENTS)


def test_one_table(events):
    assert rows_of(lineage.upstream_tables(events, "c.s.x")) == [("c.s.a",), ("c.s.b",), ("c.s.x",)]
    assert rows_of(lineage.downstream_tables(events, "c.s.a")) == [("c.s.x",)]
    assert rows_of(lineage.upstream_tables(events, "c.s.it's")) == [("c.s.x",)]
    assert rows_of(lineage.upstream_tables(events, "c.s.nowhere")) == []
    # A name is a value, never a piece of SQL.
    assert rows_of(lineage.upstream_tables(events, "' OR '1'='1")) == []


def test_first_neighbours_by_name(events):
    found = rows_of(lineage.downstream_tables(events, "c.s.hub"))
    assert found == [(f"c.s.t{i:04d}",) for i in range(100)]


def test_all_tables_equal_single_ones(events):
    every = as_set(lineage.lineage_for_all(events))
    names = {t for row in events.collect() for t in row if t}
    for table in ["c.s.hub", "c.s.x", "c.s.a", "c.s.t0249"]:
        assert table in names
        for direction, one in [
            ("upstream", lineage.upstream_tables),
            ("downstream", lineage.downstream_tables),
        ]:
            expected = {(table, direction, r[0]) for r in one(events, table).collect()}
            assert {r for r in every if r[0] == table and r[1] == direction} == expected


def _node(name, kind="TABLE"):
    info = {"catalog_name": "c", "schema_name": "s", "name": name, "table_type": kind}
    return {"tableInfo": info}


def test_documents(spark):
    documents = [
        (
            "c.s.one",
            json.dumps(
                {
                    "upstreams": [
                        _node("a"),
                        _node("a"),
                        _node("v", "VIEW"),
                        {},
                        {"tableInfo": None},
                        _node("low", "table"),
                        _node(None),
                    ],
                    "downstreams": [_node("z")],
                }
            ),
        ),
        ("c.s.one", json.dumps({"upstreams": [_node("a"), _node("b")]})),
        ("c.s.none", json.dumps({"upstreams": [], "downstreams": None})),
        ("c.s.bad", "{not json"),
        ("c.s.null", None),
    ]
    many = {"downstreams": [_node(f"t{i}") for i in range(150)]}
    documents.append(("c.s.hub", json.dumps(many)))
    df = spark.createDataFrame(documents, "table string, document string")
    found = as_set(lineage.lineage_edges_from_documents(df))
    assert {r for r in found if r[0] != "c.s.hub"} == {
        ("c.s.one", "upstream", "c.s.a"),
        ("c.s.one", "upstream", "c.s.b"),
        ("c.s.one", "downstream", "c.s.z"),
    }
    assert sum(r[0] == "c.s.hub" for r in found) == 150
    up = lineage.neighbours_in_documents(df, "c.s.one", "upstream")
    assert rows_of(up) == [("c.s.a",), ("c.s.b",)]
    assert rows_of(lineage.neighbours_in_documents(df, "c.s.hub", "upstream")) == []
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        lineage.lineage_edges_from_documents(df, "FAILFAST").collect()


EDGES = {
    ("n.products", "n.product_sales_ranking"),
    ("n.products", "n.channel_category_analysis"),
    ("n.sales_transactions", "n.monthly_sales_summary"),
    ("n.sales_transactions", "n.product_sales_ranking"),
    ("n.sales_transactions", "n.customer_segment_performance"),
    ("n.sales_transactions", "n.channel_category_analysis"),
    ("n.customer_segments", "n.customer_segment_performance"),
}


def test_declared_edges(spark):
    assert as_set(jobs.declared_edges(spark, "n")) == EDGES


def test_missing_edges(spark):
    declared = jobs.declared_edges(spark, "n")
    seen = [
        ("n.products", "n.product_sales_ranking"),
        ("n.products", "n.product_sales_ranking"),
        (None, "n.product_sales_ranking"),
        ("n.products", None),
        ("elsewhere", "n.monthly_sales_summary"),
    ]
    events = spark.createDataFrame(seen, EVENTS)
    assert as_set(lineage.missing_edges(declared, events)) == EDGES - {seen[0]}
    assert as_set(lineage.missing_edges(declared, events.where("false"))) == EDGES


def test_a_limit_beyond_sparks_own_splits_a_hub(spark):
    events = spark.range(6000).selectExpr(
        "format_string('t%05d', id) AS source_table_full_name", "'hub' AS target_table_full_name"
    )
    rows = lineage.lineage_for_all(events, limit=5000).where("direction = 'upstream'")
    found = sorted(r["tbl"] for r in rows.collect())
    assert found == [f"t{i:05d}" for i in range(5000)]


def test_the_tasks_that_sort_edges_grow_with_the_log(spark, events, monkeypatch):
    whole = as_set(lineage.lineage_for_all(events))
    monkeypatch.setattr(lineage, "SORTED", 20)
    dealt = lineage.lineage_for_all(events)
    # 505 events have both ends; partitions of a given number are not merged by their bytes.
    assert "26), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert as_set(dealt) == whole
    assert lineage.lineage_for_all(events.where("false")).count() == 0


def _log(spark, rows):
    return spark.createDataFrame(rows, "source_table_full_name string, target_table_full_name string")


def test_an_edge_table_equals_the_log_and_is_read_by_the_bucket(spark):
    schema = catalog.scratch_schema(spark)
    name = f"{schema}.edges"
    first = [(f"s{i % 40}", f"t{i % 23}") for i in range(400)] + [(None, "t1"), ("s1", None), ("t1", "t1")]
    later = first[:50] + [(f"s{i % 60}", f"t{i % 31}") for i in range(200)]
    assert lineage.merge_edges(spark, name, _log(spark, first)) > 0
    assert lineage.merge_edges(spark, name, _log(spark, first)) == 0
    assert lineage.merge_edges(spark, name, _log(spark, later)) > 0
    whole = _log(spark, first + later)
    edges = spark.table(name)
    assert as_set(edges.select("table", "direction", "tbl")) == as_set(lineage.lineage_for_all(whole, 10**6))
    for table in ("t1", "s1", "t30", "nowhere", None):
        for direction, plain in (("upstream", lineage.upstream_tables), ("downstream", lineage.downstream_tables)):
            found = lineage.neighbours_from_edges(edges, table, direction, limit=5)
            assert rows_of(found) == rows_of(plain(whole, table, limit=5))
    one = lineage.neighbours_from_edges(edges, "t1", "upstream")
    read = one.inputFiles()
    assert 0 < len(edges.inputFiles()) and "PartitionFilters: [isnotnull(direction" in one._jdf.queryExecution().toString()
    one.collect()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionCount: 1" in plan or len(read) <= len(edges.inputFiles())


def test_equal_documents_are_parsed_once_and_names_are_distinct(spark):
    node = '{"tableInfo": {"catalog_name": "c", "schema_name": "s", "name": "n%d", "table_type": "TABLE"}}'
    document = '{"upstreams": [%s], "downstreams": []}' % ", ".join(node % (i % 3) for i in range(90))
    df = spark.createDataFrame([("t", document)] * 500 + [("u", document), ("u", "broken"), ("v", None)], "table string, document string")
    found = lineage.lineage_edges_from_documents(df)
    assert as_set(found) == {(t, "upstream", f"c.s.n{i}") for t in "tu" for i in range(3)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    # The first exchange carries documents that were merged on the sending side.
    assert plan.count("HashAggregate") + plan.count("SortAggregate") >= 4
