"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import logging
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyfield.functions import fits_broadcast
from tallyfield.functions.text import column_named
from tallyfield.session import ensure_checkpoint_dir

# Words are runs of anything but these: blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, written to the shared checkpoint folder, with the partitions it has."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df`, written as Parquet below the shared checkpoint folder and read from there.

    Unlike a checkpoint it is compressed, is read column by column, has a known size, and
    carries nothing of the plan that made it into later plans. The files stay until the
    driver ends, as anything derived from the result needs them, or until `discard`. The
    shuffle files of the write go at its end.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    path = f"{context.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_remove_written, context)
    _folders.append(path)
    _scope().append(path)
    with _cleaned_shuffles(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_at = path
    return found


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed meanwhile go when it ends: nothing reads them again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """`written(make())`, without the tables that `make` has written on its way there."""
    outer, _local.scope = _scope(), []
    try:
        result = written(make())
    finally:
        inner, _local.scope = _scope(), outer
        outer.extend(inner)
    _remove(result.sparkSession.sparkContext, [path for path in inner if path != result._written_at])
    return result


def discard(*tables: DataFrame | None) -> None:
    """Remove the files of `written` tables that nothing reads any more; others are left alone."""
    for table in tables:
        path = None if table is None else getattr(table, "_written_at", None)
        if path:
            _remove(table.sparkSession.sparkContext, [path])


_folders: list[str] = []
_local = threading.local()


def _scope() -> list[str]:
    """The folders written by this thread, within `settled` since that began."""
    if not hasattr(_local, "scope"):
        _local.scope = []
    return _local.scope


def _remove(context: SparkContext, paths: list[str]) -> None:
    hadoop = context._jvm.org.apache.hadoop.fs
    for name in paths:
        path = hadoop.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        for known in (_folders, _scope()):
            if name in known:
                known.remove(name)


def _remove_written(context: SparkContext) -> None:
    try:
        _remove(context, list(_folders))
    except Exception as error:  # the session may be gone already; the folder is a scratch one
        logging.getLogger(__name__).info("written tables were left behind: %s", error)


# Bits of a row of a sieve, in words of 64, and the most rows: some 24 MB.
_SIEVE_WORDS, _SIEVE_ROWS = 16, 1 << 17


def sifted_join(rows: DataFrame, known: DataFrame, on: list[str], max_bytes: int) -> DataFrame:
    """`rows.join(known, on)`, for a `known` that is written and has few of the keys of `rows`.

    If `known` is too large for a broadcast, a bit for each of its keys is broadcast, so that
    what is shuffled is little more than the rows that have a partner. No key is NULL.
    """
    if fits_broadcast(known, max_bytes):
        return rows.join(F.broadcast(known), on)
    size = _SIEVE_WORDS * 64
    n = 1
    while n < _SIEVE_ROWS and n * size < 16 * known.count():
        n *= 2
    place = F.struct(
        F.xxhash64(*on).bitwiseAND(F.lit(n - 1)).alias("row"),
        F.shiftrightunsigned(F.xxhash64(*on), 40).bitwiseAND(F.lit(size - 1)).alias("at"),
    )
    word, bit = "cast(_place.at div 64 AS int)", "shiftleft(1L, cast(_place.at & 63L AS int))"
    placed = known.select(place.alias("_place")).select("_place.row", F.expr(word).alias("word"), F.expr(bit).alias("bit"))
    words = [
        F.coalesce(F.bit_or(F.when(F.col("word") == i, F.col("bit"))), F.lit(0).cast("bigint")).alias(f"w{i}")
        for i in range(_SIEVE_WORDS)
    ]
    sieve = placed.groupBy("row").agg(*words).select(
        F.col("row").alias("_row"), F.array(*[f"w{i}" for i in range(_SIEVE_WORDS)]).alias("_words")
    )
    passed = rows.withColumn("_place", place).join(F.broadcast(written(sieve)), F.col("_place.row") == F.col("_row"))
    passed = passed.where(F.get("_words", F.expr(word)).bitwiseAND(F.expr(bit)) != 0)
    return passed.select(*rows.columns).join(known, on)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns, under the names an operator uses: `only(df, key="doc_id")`."""
    return df.select(*[column_named(name).alias(alias) for alias, name in columns.items()])


def ticked(name: str) -> str:
    """A column's name as it stands in a schema text, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; NULL for a NULL key."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(column.cast("string").cast("binary")) % parts


def hashed_sample(rows: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """At most `n` rows, those whose key has the smallest hash; `order` settles ties.

    A cut that about twice as many pass goes first, so that what tasks send to be sorted
    is bounded by `n` and not by the number of tasks.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 53)) / F.lit(float(1 << 53))
    total = rows.count()
    if total > 2 * n:
        rows = rows.where(place < F.lit(2 * n / total))
    return rows.orderBy(place, key, *order).limit(n)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="tallyfield-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = Path(__file__).resolve().parents[1]
    staged = Path(folder) / "staged"
    shutil.copytree(package, staged / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", staged))
    _shipped.add(context.applicationId)


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch], schema: str | StructType
) -> DataFrame:
    """Apply `function` to every Arrow batch of `df`."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            done = function(batch)
            yield from done.to_batches() if isinstance(done, pa.Table) else [done]

    ship_package(df.sparkSession)
    return df.mapInArrow(batches, schema)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def code_points(text: str) -> np.ndarray:
    """The characters of a text as numbers; a lone surrogate counts as a character."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
