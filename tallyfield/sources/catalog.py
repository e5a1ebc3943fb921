"""Tables of the session catalog: create, load, replace, list, describe.

A table that is loaded or derived is a version with a name of its own, and a view of the
table's name that points to it. One statement moves the view, so at no moment is there no
table, whatever the new version's columns are; readers that have begun keep the version they
began with, which stays for one more replacement.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import logging
import re
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import column_named
from ..session import ensure_checkpoint_dir
from .schemas import COLUMNS_META, TABLES_META

_log = logging.getLogger(__name__)

# How many times an even bucket the most frequent key may be, for a table to be bucketed.
BUCKET_SHARE = 4
VERSION = "__v"
POINTS_TO, BEFORE = "tallyfield.points_to", "tallyfield.before"


def scan(spark: SparkSession, name: str) -> DataFrame:
    """A table by its qualified name, or a Parquet path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def create_schema(
    spark: SparkSession, schema: str, comment: str = "", location: str | None = None
) -> None:
    at = f" LOCATION '{_quoted(location)}'" if location else ""
    spark.sql(
        "CREATE SCHEMA IF NOT EXISTS IDENTIFIER(:name) COMMENT '" + _quoted(comment) + "'" + at,
        args={"name": schema},
    )


def scratch_schema(spark: SparkSession) -> str:
    """A new schema below the shared checkpoint folder, dropped when the driver ends."""
    ensure_checkpoint_dir(spark)
    name = f"scratch_{uuid.uuid4().hex}"
    create_schema(spark, name, "scratch", f"{spark.sparkContext.getCheckpointDir()}/{name}")
    atexit.register(_drop_schema, spark, name)
    return name


def _drop_schema(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP SCHEMA IF EXISTS {_ticked(name)} CASCADE")
    except Exception as error:  # the session may be gone already
        _log.info("a scratch schema was left behind: %s", error)


def load_table(
    spark: SparkSession,
    name: str,
    rows: DataFrame | list,
    schema: T.StructType,
    comment: str = "",
    bucket_by: tuple[str, ...] = (),
    buckets: int = 64,
) -> None:
    """Fill a table of declared columns anew; loading twice leaves the same rows.

    A list is for a few literal rows. Columns of a DataFrame are taken by name, cast to
    the declared types, and a value that does not fit stops the load: the old rows stay.

    With `bucket_by` the rows are written in so many buckets by these columns, sorted in each:
    tables with equal buckets are joined and grouped on them without an exchange. A bucket is
    read by one task, so a key that holds more than BUCKET_SHARE times a bucket's even part of the
    rows makes this worse than an exchange, where hot keys are split: such a table is
    written without buckets, and a warning says so. To know, the keys are counted first.
    """
    if isinstance(rows, list):
        rows = spark.createDataFrame(rows, schema)
    declared = declared_columns(rows, schema)
    if bucket_by and _hottest(declared, bucket_by) * buckets > BUCKET_SHARE:
        _log.warning("%s is written without buckets: one key of %s holds too many rows", name, bucket_by)
        bucket_by = ()
    _replace(declared, name, comment, bucket_by=bucket_by, buckets=buckets)


def _hottest(rows: DataFrame, key: tuple[str, ...]) -> float:
    """The share of the rows that the most frequent key has."""
    counts = rows.groupBy(*[column_named(c) for c in key]).agg(F.count(F.lit(1)).alias("n"))
    most, total = counts.agg(F.max("n"), F.sum("n")).first()
    return most / total if total else 0.0


def declared_columns(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns, found by name and cast to the declared types."""
    return rows.select(
        *[
            column_named(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata)
            for f in schema.fields
        ]
    )


def write_table(
    df: DataFrame, name: str, comment: str = "", order_by: tuple = (), partition_by: tuple[str, ...] = ()
) -> None:
    """Replace the whole of a derived table.

    Until the rows are complete the old table stays, and `df` may read it. The order only
    clusters the files; readers sort again. `partition_by` puts rows into folders by value.
    """
    _replace(df.orderBy(*order_by) if order_by else df, name, comment, partition_by=partition_by)


def append_table(df: DataFrame, name: str) -> None:
    """Add rows to the version that the table's name points to; columns go by their names."""
    spark = df.sparkSession
    version = _pointer(spark, name)[POINTS_TO]
    df.select(*[column_named(c) for c in spark.table(version).columns]).write.insertInto(version)
    spark.catalog.refreshTable(_beside(name))


def _replace(
    df: DataFrame,
    name: str,
    comment: str,
    partition_by: tuple[str, ...] = (),
    bucket_by: tuple[str, ...] = (),
    buckets: int = 64,
) -> None:
    """Write a new version, move the view to it, and drop all but it and the one before."""
    spark = df.sparkSession
    recover_table(spark, name)
    version = _beside(name, f"{VERSION}{time.time_ns():020d}_{uuid.uuid4().hex[:6]}")
    before = _pointer(spark, name).get(POINTS_TO, "")
    writer = df.write.mode("error").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        # One task a bucket, so that a bucket is one file.
        writer = df.repartition(buckets, *[column_named(c) for c in bucket_by]).write.mode("error")
        writer = writer.format("parquet").bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    writer.saveAsTable(version)
    _point(spark, name, version, before, comment)
    _drop_versions(spark, name, keep=(version, before))


def _point(spark: SparkSession, name: str, version: str, before: str, comment: str) -> None:
    """Let the name mean a version: one statement, also where it meant another one before."""
    about = f"'{POINTS_TO}' = '{_quoted(version)}', '{BEFORE}' = '{_quoted(before)}'"
    said = f"COMMENT '{_quoted(comment)}' " if comment else ""
    spark.sql(
        f"CREATE OR REPLACE VIEW {_beside(name)} {said}TBLPROPERTIES ({about}) AS SELECT * FROM {version}"
    )


def _pointer(spark: SparkSession, name: str) -> dict[str, str]:
    """What the view of this name points to, and the version before; empty if there is none."""
    if not spark.catalog.tableExists(_beside(name)):
        return {}
    return _facts(spark, name_parts(name), follow=False).get("table_properties", {})


def _versions(spark: SparkSession, name: str) -> list[str]:
    """Quoted names of all versions that are written in full, oldest first."""
    parts = name_parts(name)
    inside = f" IN {'.'.join(map(_ticked, parts[:-1]))}" if parts[:-1] else ""
    listed = [row["tableName"] for row in spark.sql(f"SHOW TABLES{inside}").collect()]
    wanted = re.compile(re.escape(parts[-1].lower()) + _VERSION_ENDING)
    found = sorted(t for t in listed if wanted.fullmatch(t.lower()))
    return [".".join(map(_ticked, [*parts[:-1], t])) for t in found]


_VERSION_ENDING = VERSION + r"\d{20}_[0-9a-f]{6}"


def _drop_versions(spark: SparkSession, name: str, keep: tuple[str, ...] = ()) -> None:
    for version in _versions(spark, name):
        if version not in keep:
            spark.sql(f"DROP TABLE IF EXISTS {version}")


def recover_table(spark: SparkSession, name: str) -> None:
    """Make a name a view of a version again, after anything that was interrupted.

    A plain table of this name, made by other means, becomes its first version; should that
    be interrupted between its two statements, the next call points to the version. Rows
    that were being written when the driver was lost are no version, and those that
    never got the view are dropped by the next replacement. Does nothing otherwise.
    """
    plain = spark.catalog.tableExists(_beside(name))
    if plain and _facts(spark, name_parts(name), follow=False).get("type") != "VIEW":
        version = _beside(name, f"{VERSION}{time.time_ns():020d}_{uuid.uuid4().hex[:6]}")
        comment = _facts(spark, name_parts(name), follow=False).get("comment") or ""
        spark.sql(f"ALTER TABLE {_beside(name)} RENAME TO {version}")
        _point(spark, name, version, "", comment)
    elif not plain:
        versions = _versions(spark, name)
        if versions:
            _point(spark, name, versions[-1], "", "")


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a table with all its versions; a plain table or view as well."""
    if spark.catalog.tableExists(_beside(name)):
        is_view = _facts(spark, name_parts(name), follow=False).get("type") == "VIEW"
        spark.sql(f"DROP {'VIEW' if is_view else 'TABLE'} {_beside(name)}")
    _drop_versions(spark, name)


def _beside(name: str, ending: str = "") -> str:
    """The quoted name with an ending on its last part."""
    parts = name_parts(name)
    return ".".join(_ticked(part) for part in [*parts[:-1], parts[-1] + ending])


def name_parts(name: str) -> list[str]:
    """Parts of a name that dots separate; a part in backticks may hold any character."""
    found = re.findall(r"`((?:[^`]|``)*)`|([^.`]+)", name)
    return [quoted.replace("``", "`") if quoted else plain for quoted, plain in found]


def _ticked(part: str) -> str:
    return "`" + part.replace("`", "``") + "`"


def _quoted(text: str) -> str:
    # DDL takes no bound value for a comment.
    return text.replace("\\", "\\\\").replace("'", "\\'")


def catalogs(spark: SparkSession) -> list[str]:
    return [c.name for c in spark.catalog.listCatalogs()]


def schemas(spark: SparkSession, catalog: str | None = None) -> list[str]:
    """Schemas of a catalog, of the current one unless it is named."""
    inside = f" IN {_ticked(catalog)}" if catalog else ""
    return [row[0] for row in spark.sql("SHOW SCHEMAS" + inside).collect()]


def harvest_tables(spark: SparkSession, schema: str, catalog: str | None = None) -> DataFrame:
    """Inventory of a schema's tables, one row each, as `TABLES_META`.

    The catalog may be given apart or in the name (`catalog.schema`); else it is the
    current one. Metadata lives with the driver, so it is read there; searching it is a
    query. The session catalog does not record who changed a table last.
    """
    names = _listed(spark, schema, catalog)
    return spark.createDataFrame([_table_meta(n, _facts(spark, n)) for n in names], TABLES_META)


def harvest_columns(spark: SparkSession, schema: str, catalog: str | None = None) -> DataFrame:
    """Inventory of their columns, one row each, as `COLUMNS_META`."""
    names = _listed(spark, schema, catalog)
    found = [row for n in names for row in _columns_meta(n, _facts(spark, n))]
    return spark.createDataFrame(found, COLUMNS_META)


def harvest_into(
    spark: SparkSession, schema: str, name: str, catalog: str | None = None, workers: int = 8, batch: int = 100
) -> int:
    """Bring the harvest table `name` up to date with a schema; gives how many tables were described.

    One statement lists all tables with what the catalog says of each; only tables that are new
    or of which that has changed are described, `workers` at a time. Each batch is added to
    the table when it is complete, so a harvest that was interrupted goes on where it was.
    Tables that are gone are marked so. Read it with `harvested`.
    """
    parts = _schema_parts(spark, schema, catalog)
    if not spark.catalog.tableExists(_beside(name)):
        write_table(spark.createDataFrame([], HARVEST), name, "Harvested tables")
    latest = _latest(spark.table(_beside(name))).where((F.col("of") == ".".join(parts)) & ~F.col("gone"))
    known = {row["full_name"]: row["print"] for row in latest.select("full_name", "print").collect()}
    listed = {".".join([*parts, t]): (t, p) for t, p in _prints(spark, parts).items()}
    stale = [full for full, (_, printed) in listed.items() if known.get(full) != printed]
    rows = [(full, ".".join(parts), "", time.time_ns(), True, None, []) for full in known if full not in listed]

    def described(full: str) -> tuple:
        own, printed = listed[full]
        facts = _facts(spark, [*parts, own])
        columns = [c[1:] for c in _columns_meta([*parts, own], facts)]
        return (full, ".".join(parts), printed, time.time_ns(), False, _table_meta([*parts, own], facts), columns)

    with ThreadPoolExecutor(workers) as pool:
        for start in range(0, max(len(stale), 1), batch):
            rows += pool.map(described, stale[start : start + batch])
            if rows:
                append_table(spark.createDataFrame(rows, HARVEST), name)
            rows = []
    return len(stale)


def harvested(harvest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inventory of tables (`TABLES_META`) and of columns (`COLUMNS_META`) from a harvest table."""
    latest = _latest(harvest).where(~F.col("gone"))
    return latest.select("about.*"), latest.select("full_name", F.inline("columns"))


_COLUMN_FACTS = COLUMNS_META.split(", ", 1)[1]
HARVEST = (
    "full_name string, of string, print string, at bigint, gone boolean, "
    f"about struct<{TABLES_META}>, columns array<struct<{_COLUMN_FACTS}>>"
)


def _latest(harvest: DataFrame) -> DataFrame:
    row = F.struct(*[c for c in harvest.columns if c != "full_name"])
    return harvest.groupBy("full_name").agg(F.max_by(row, "at").alias("_row")).select("full_name", "_row.*")


def _prints(spark: SparkSession, parts: list[str]) -> dict[str, str]:
    """The tables of a schema and a digest of what the catalog says of each, by one statement."""
    rows = spark.sql(f"SHOW TABLE EXTENDED IN {'.'.join(map(_ticked, parts))} LIKE '*'").collect()
    said = {row["tableName"]: row["information"] for row in rows if not row["isTemporary"]}
    moving = re.compile(r"^Last Access.*$", re.MULTILINE)
    return {
        name: hashlib.sha256(moving.sub("", said[name]).encode()).hexdigest() for name in _without_versions(said)
    }


def describe_one(spark: SparkSession, full_name: str) -> tuple[DataFrame, DataFrame]:
    """The inventory rows of one table and of its columns, from a single statement."""
    parts = name_parts(full_name)
    if len(parts) < 3:
        parts = [spark.catalog.currentCatalog(), *parts]
    if len(parts) < 3:
        parts.insert(1, spark.catalog.currentDatabase())
    facts = _facts(spark, parts)
    return (
        spark.createDataFrame([_table_meta(parts, facts)], TABLES_META),
        spark.createDataFrame(_columns_meta(parts, facts), COLUMNS_META),
    )


def _schema_parts(spark: SparkSession, schema: str, catalog: str | None) -> list[str]:
    parts = [catalog, *name_parts(schema)[-1:]] if catalog else name_parts(schema)
    return [spark.catalog.currentCatalog(), *parts] if len(parts) == 1 else parts


def _listed(spark: SparkSession, schema: str, catalog: str | None) -> list[list[str]]:
    parts = _schema_parts(spark, schema, catalog)
    inside = ".".join(map(_ticked, parts))
    rows = spark.sql(f"SHOW TABLES IN {inside}").collect()
    names = [row["tableName"] for row in rows if not row["isTemporary"]]
    return [[*parts, name] for name in _without_versions(names)]


def _without_versions(names) -> list[str]:
    """A version is no table of its own where its view is there."""
    version = re.compile("(.*)" + _VERSION_ENDING)
    return [n for n in names if not ((found := version.fullmatch(n)) and found[1] in names)]


def _table_meta(name: list[str], facts: dict) -> tuple:
    return (
        *name,
        ".".join(name),
        facts.get("type"),
        facts.get("comment"),
        facts.get("provider"),
        facts.get("location"),
        facts.get("owner"),
        None,
    )


def _columns_meta(name: list[str], facts: dict) -> list[tuple]:
    return [
        (
            ".".join(name),
            position,
            column["name"],
            _type_text(column["type"]),
            column.get("nullable", True),
            column.get("comment"),
        )
        for position, column in enumerate(facts["columns"])
    ]


def _type_text(kind: dict) -> str:
    """A described type as it is written in SQL."""
    name = kind["name"]
    if name == "array":
        return f"array<{_type_text(kind['element_type'])}>"
    if name == "map":
        return f"map<{_type_text(kind['key_type'])},{_type_text(kind['value_type'])}>"
    if name == "struct":
        fields = (f"{f['name']}:{_type_text(f['type'])}" for f in kind["fields"])
        return f"struct<{','.join(fields)}>"
    if name == "decimal":
        return f"decimal({kind['precision']},{kind['scale']})"
    if name in ("char", "varchar"):
        return f"{name}({kind['length']})"
    return {"timestamp_ltz": "timestamp", "integer": "int"}.get(name, name)


def _facts(spark: SparkSession, name: list[str], follow: bool = True) -> dict:
    """What the catalog knows of a table; of a view that points to a version, the version's
    facts under the view's name and comment."""
    full = ".".join(map(_ticked, name))
    facts = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {full} AS JSON").first()[0])
    version = facts.get("table_properties", {}).get(POINTS_TO)
    if not version or not follow:
        return facts
    return {**_facts(spark, name_parts(version)), "comment": facts.get("comment")}
