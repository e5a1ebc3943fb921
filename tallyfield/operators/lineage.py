"""One-hop table lineage, from an event log and from nested documents.

An event log has one row per observed read or write, with `source_table_full_name` and
`target_table_full_name`; either may be NULL, and the same pair comes again and again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import broadcast_if_small, dotted_name
from ..session import ensure_checkpoint_dir
from ..sources import catalog

SOURCE = "source_table_full_name"
TARGET = "target_table_full_name"
# Fixed value: neighbours listed per table and direction.
NEIGHBOUR_LIMIT = 100
# Spark's own bound for limiting a ranked group before it is sent.
SENT_LIMIT = 1000
SHARES = 64
# Events a task of `lineage_for_all` sorts, about: their names compress so well that partitions
# merged by their bytes would hold several times as many.
SORTED = 1_000_000

# Parts an edge table is cut into by table name: a lookup reads one of them.
BUCKETS = 64

_NODE = "struct<tableInfo: struct<catalog_name: string, schema_name: string, name: string, table_type: string>>"
LINEAGE_DOCUMENT = f"upstreams array<{_NODE}>, downstreams array<{_NODE}>"


def upstream_tables(events: DataFrame, table: str, limit: int = NEIGHBOUR_LIMIT) -> DataFrame:
    """Tables that `table` was written from: the first `limit` by name."""
    return _neighbours(events, table, of=TARGET, at=SOURCE, limit=limit)


def downstream_tables(events: DataFrame, table: str, limit: int = NEIGHBOUR_LIMIT) -> DataFrame:
    """Tables that were written from `table`: the first `limit` by name."""
    return _neighbours(events, table, of=SOURCE, at=TARGET, limit=limit)


def _neighbours(events: DataFrame, table: str, of: str, at: str, limit: int) -> DataFrame:
    return (
        events.where((F.col(of) == F.lit(table)) & F.col(at).isNotNull())
        .select(F.col(at).alias("tbl"))
        .distinct()
        .orderBy("tbl")
        .limit(limit)
    )


def lineage_for_all(events: DataFrame, limit: int = NEIGHBOUR_LIMIT) -> DataFrame:
    """Both directions for every table of the log: `table, direction, tbl`.

    Repeated events are merged before the first shuffle. A table with very many neighbours
    is cut into shares that are limited apart, so that no task gets more than the first
    `limit` of each share. The log is counted first: the more events, the more tasks sort edges.
    """
    parts = -(-_linked(events).count() // SORTED)
    both = _in_both_ways(_linked(events).distinct().repartition(max(1, parts), SOURCE, TARGET))
    by_name = Window.partitionBy("table", "direction").orderBy("tbl")
    if limit > SENT_LIMIT:
        # Up to there Spark limits on the sending side by itself.
        both = both.withColumn("share", F.pmod(F.xxhash64("tbl"), F.lit(SHARES)))
        in_share = Window.partitionBy("table", "direction", "share").orderBy("tbl")
        both = both.withColumn("position", F.row_number().over(in_share))
        both = both.where(F.col("position") <= limit).drop("position", "share")
    return (
        both.withColumn("position", F.row_number().over(by_name))
        .where(F.col("position") <= limit)
        .drop("position")
    )


def merge_edges(spark: SparkSession, name: str, events: DataFrame, buckets: int = BUCKETS) -> int:
    """Add the edges of new events to the edge table `name`; gives how many were new.

    The table has `table, tbl`, each edge once for either direction, in folders by `direction`
    and `bucket`, a hash of `table`. It is made if it is not there. Events that were merged
    before add nothing, so a merge that was interrupted, or came twice, is run again. Only the
    new events are shuffled, and what the table has of them. One merge runs at a time.
    """
    edges = _both_ways(events).withColumn("bucket", _bucket(F.col("table"), buckets))
    if not spark.catalog.tableExists(name):
        catalog.write_table(edges.limit(0), name, "Lineage edges", partition_by=("direction", "bucket"))
    known = spark.table(name)
    key = ["direction", "bucket", "table", "tbl"]
    ensure_checkpoint_dir(spark)
    new = edges.join(known, key, "left_anti").repartition("direction", "bucket").checkpoint()
    n = new.count()
    if n:
        catalog.append_table(new, name)
    return n


def neighbours_from_edges(
    edges: DataFrame, table: str, direction: str, limit: int = NEIGHBOUR_LIMIT, buckets: int = BUCKETS
) -> DataFrame:
    """The `upstream` or `downstream` tables of one table, the first `limit` by name, from an
    edge table: only files of its bucket are read."""
    found = edges.where(
        (F.col("direction") == F.lit(direction))
        & (F.col("bucket") == _bucket(F.lit(table), buckets))
        & (F.col("table") == F.lit(table))
    )
    return found.select("tbl").distinct().orderBy("tbl").limit(limit)


def _bucket(table, buckets: int):
    return F.pmod(F.xxhash64(table), F.lit(buckets)).cast("int")


def _both_ways(events: DataFrame) -> DataFrame:
    """Each different edge of a log, once for either end: `table, direction, tbl`."""
    return _in_both_ways(_linked(events).distinct())


def _linked(events: DataFrame) -> DataFrame:
    return events.where(F.col(SOURCE).isNotNull() & F.col(TARGET).isNotNull()).select(SOURCE, TARGET)


def _in_both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.inline(
            F.array(
                _link(F.col(TARGET), "upstream", F.col(SOURCE)),
                _link(F.col(SOURCE), "downstream", F.col(TARGET)),
            )
        )
    )


def _link(table, direction: str, neighbour):
    return F.struct(
        table.alias("table"), F.lit(direction).alias("direction"), neighbour.alias("tbl")
    )


def lineage_edges_from_documents(documents: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """Neighbours named in lineage documents: `table, direction, tbl`, each once, without limit.

    Input: `table` and its `document` as JSON text. Nodes that are not plain tables, or
    lack part of their name, are left out. With mode FAILFAST an unreadable document
    stops the job; otherwise it names no neighbours.

    Equal documents are merged on the sending side and dealt out by their text before they
    are parsed, so that neither a document that holds many rows nor a large file is parsed in
    one task. A document's names are made distinct within it, so that no more rows than it has
    different neighbours leave it.
    """
    spread = documents.select("table", "document").distinct()
    parsed = spread.select(
        "table", F.from_json("document", LINEAGE_DOCUMENT, {"mode": mode}).alias("d")
    )
    sides = parsed.select(
        "table",
        F.inline(
            F.array(
                F.struct(F.lit("upstream").alias("direction"), _table_names("d.upstreams").alias("names")),
                F.struct(F.lit("downstream").alias("direction"), _table_names("d.downstreams").alias("names")),
            )
        ),
    )
    return sides.select("table", "direction", F.explode("names").alias("tbl")).distinct()


def _table_names(nodes: str):
    """The different full names of the plain tables among the nodes."""
    plain = F.filter(nodes, lambda n: n["tableInfo"]["table_type"] == "TABLE")
    names = F.transform(
        plain,
        lambda n: dotted_name(*[n["tableInfo"][part] for part in ("catalog_name", "schema_name", "name")]),
    )
    return F.array_distinct(F.array_compact(names))


def neighbours_in_documents(documents: DataFrame, table: str, direction: str) -> DataFrame:
    """The `upstream` or `downstream` tables that one table's documents name, sorted."""
    own = documents.where(F.col("table") == F.lit(table))
    return (
        lineage_edges_from_documents(own)
        .where(F.col("direction") == F.lit(direction))
        .select("tbl")
        .orderBy("tbl")
    )


def missing_edges(declared: DataFrame, events: DataFrame) -> DataFrame:
    """Declared edges that the log never shows: `source, target`.

    `declared` has one row per source of each derived table (`plans.jobs.declared_edges`).
    As a rule it is small, and then sent to the log, so that only edges that are declared
    and seen are shuffled, each once per task.
    """
    seen = (
        events.select(F.col(SOURCE).alias("source"), F.col(TARGET).alias("target"))
        .join(broadcast_if_small(declared), ["source", "target"], "left_semi")
        .distinct()
    )
    return declared.join(seen, ["source", "target"], "left_anti")
