"""Near-duplicates of texts by DartMinHash.

An element (a run of five words, with the number of times it occurs as its weight) owns a
strip of the plane, as wide as its weight; time runs along the strip. Darts are thrown at
the strip by hashes of the element alone, one a unit square on average, so that texts that
share a part of a strip share its darts. Each dart belongs to one coordinate of the
signature, which keeps its earliest dart. Two texts agree in a coordinate with a
probability equal to their weighted Jaccard similarity. Throwing stops as soon as all
coordinates have a dart, after about k log k darts whatever the weights.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.text import column_named

from .common import map_batches, mix, only, settled, written
from .graph import link, shared_buckets

WORDS = 5
SIMILARITY = 0.8
# At similarity 0.8 a pair shares no band with probability (1 - 0.8 ** ROWS) ** BANDS = 0.2 %.
BANDS, ROWS = 20, 6
# Elements of the texts that are worked on at once: bounds the memory of a task.
_ELEMENTS = 200_000
_REMEMBERED = 500_000
_TO_UNIT = 2.0**-64


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """`key`, `text_hash`, `class_id`, `class_hash` and `class_rows` of every row of `docs`.

    Texts of at least the given weighted Jaccard similarity (runs of five lower-cased
    words, weighted by how often they occur) are in one class, and so are those linked
    through others; its id is the smallest key in it. A text of fewer than five words is
    one run. A text without words, or NULL, is alone: its class is its own key.
    `text_hash` tells rows with one key but different texts apart, and `class_hash`, the
    smallest `text_hash` under the smallest key, classes with one id; it is NULL for a text
    without words. Repeated rows are exact copies. Classes of rows without any key have a
    NULL id.

    Exact copies are merged before signatures are compared. Signatures and pairs are
    written to the checkpoint folder.
    """
    rows = only(docs, key=key, text=text).withColumn("text_hash", F.xxhash64("text"))
    kind = rows.schema["key"].dataType.simpleString()
    signed = written(
        map_batches(rows, _sign_batch, f"key {kind}, text_hash bigint, hi bigint, lo bigint, bands array<bigint>")
    )
    worded = signed.where(F.col("hi").isNotNull())
    nodes = written(
        worded.groupBy("hi", "lo")
        .agg(
            F.first("bands").alias("bands"),
            F.min(F.struct("key", "text_hash")).alias("sample"),
            F.min(F.when(F.col("key").isNotNull(), F.struct("key", "text_hash"))).alias("least"),
            F.count("*").alias("copies"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    candidates = shared_buckets(members)
    sets = _sets(rows, nodes, candidates)
    labels = link(
        candidates,
        lambda pairs: _similar(pairs, sets, similarity),
        lambda some: sets.join(some.distinct(), "node").select("node", "elements"),
        similarity,
        parts=1,
    )
    labelled = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = labelled.groupBy("component").agg(
        F.coalesce(F.min("least"), F.min("sample")).alias("first"), F.sum("copies").alias("class_rows")
    )
    of_text = labelled.join(classes, "component").select(
        "hi", "lo", F.col("first.key").alias("class_id"), F.col("first.text_hash").alias("class_hash"), "class_rows"
    )
    named = worded.join(of_text, ["hi", "lo"]).select("key", "text_hash", "class_id", "class_hash", "class_rows")
    alone = signed.where(F.col("hi").isNull()).select(
        "key",
        "text_hash",
        F.col("key").alias("class_id"),
        F.lit(None).cast("bigint").alias("class_hash"),
        F.lit(1).cast("bigint").alias("class_rows"),
    )
    return named.unionByName(alone).withColumnRenamed("key", key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` without all but one document of each class, the one of smallest key.

    Of several texts under the smallest key the one of smallest hash stays. Rows without
    words stay. Of rows that repeat the key and the text of a kept one only one stays, also
    where the key is NULL.
    """
    # The input row is one column, so that its columns may have any names.
    rows = docs.select(
        F.struct(*[column_named(c) for c in docs.columns]).alias("row"),
        column_named(key).alias("of_key"),
        F.xxhash64(column_named(text)).alias("of_hash"),
    )
    texts = only(docs, key=key, text=text)
    classes = settled(lambda: near_duplicates(texts, "key", "text").where(F.col("class_hash").isNotNull()))
    is_kept = F.col("key").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))
    same = F.col("of_key").eqNullSafe(F.col("key")) & (F.col("of_hash") == F.col("text_hash"))
    dropped = classes.where(~is_kept).select("key", "text_hash").distinct()
    left = rows.join(dropped, same, "left_anti")
    # Several rows may hold the key and the text that are kept: one of them is enough.
    again = classes.where(is_kept).groupBy("key", "text_hash").agg(F.count("*").alias("n"))
    again = written(again.where(F.col("n") > 1).select("key", "text_hash"))
    if not again.isEmpty():
        several = left.join(again, same, "left_semi").dropDuplicates(["of_key", "of_hash"])
        left = left.join(again, same, "left_anti").unionByName(several)
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _sets(rows: DataFrame, nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """The elements of every candidate: an element that occurs n times stands as n elements,
    which makes the weighted similarity that of plain sets."""
    chosen = candidates.select("node").distinct().join(nodes, "node").select(
        "node", F.col("sample.key").alias("key"), F.col("sample.text_hash").alias("text_hash")
    )
    texts = (
        rows.withColumnsRenamed({"key": "row_key", "text_hash": "row_hash"})
        .join(
            chosen,
            F.col("row_key").eqNullSafe(F.col("key")) & (F.col("row_hash") == F.col("text_hash")),
        )
        .dropDuplicates(["node"])
        .select("node", "text")
    )
    return written(map_batches(texts, _set_batch, "node bigint, elements array<bigint>"))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    a = sets.withColumnsRenamed({"node": "a", "elements": "of_a"})
    b = sets.withColumnsRenamed({"node": "b", "elements": "of_b"})
    both = pairs.join(a, "a").join(b, "b").select(
        "a", "b", F.size("of_a").alias("m"), F.size("of_b").alias("n"), F.size(F.array_intersect("of_a", "of_b")).alias("i")
    )
    # The small term is for 0.8 itself, which has no exact double.
    return both.where(
        F.col("i") >= F.lit(similarity) * (F.col("m") + F.col("n") - F.col("i")) - F.lit(1e-9)
    ).select("a", "b")


# ---------------------------------------------------------------------------------------
# Signatures
# ---------------------------------------------------------------------------------------


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def elements_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of five words, each once, and how often each occurs."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    if len(_words) > _REMEMBERED:
        _words.clear()
    hashes = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - WORDS + 1)
    runs = np.zeros(n, dtype=np.uint64)
    for i in range(min(WORDS, len(words))):
        runs = mix(runs + hashes[i : i + n], seed=5)
    found, counts = np.unique(runs, return_counts=True)
    return found, counts.astype(np.float64)


def _sign_batch(batch: pa.RecordBatch) -> pa.Table:
    texts = batch.column("text").to_pylist()
    hi: list[int | None] = [None] * len(texts)
    lo: list[int | None] = [None] * len(texts)
    bands: list[np.ndarray | None] = [None] * len(texts)
    at, parts, size = [], [], 0

    def flush() -> None:
        for i, keys in zip(at, band_keys(signatures(parts))):
            bands[i] = keys
        at.clear()
        parts.clear()

    for i, text in enumerate(texts):
        words = words_of(text)
        if not words:
            continue
        digest = xxhash.xxh3_128_digest(b" ".join(words))
        hi[i] = int.from_bytes(digest[:8], "little", signed=True)
        lo[i] = int.from_bytes(digest[8:], "little", signed=True)
        at.append(i)
        parts.append(elements_of(words))
        size += len(words) + 1000
        if size >= _ELEMENTS:
            flush()
            size = 0
    if at:
        flush()
    return pa.table(
        {
            "key": batch.column("key"),
            "text_hash": batch.column("text_hash"),
            "hi": pa.array(hi, pa.int64()),
            "lo": pa.array(lo, pa.int64()),
            "bands": pa.array(bands, pa.list_(pa.int64())),
        }
    )


def _set_batch(batch: pa.RecordBatch) -> pa.Table:
    sets = []
    for text in batch.column("text").to_pylist():
        found, counts = elements_of(words_of(text))
        sets.append(np.sort(_squares(found, counts)[0].view(np.int64)))
    return pa.table({"node": batch.column("node"), "elements": pa.array(sets, pa.list_(pa.int64()))})


def _squares(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each strip in squares of width 1: their hashes, the element each belongs to, and
    how much of its width the element owns (the last one may be owned in part)."""
    n = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    owned = np.minimum(weights[owner] - step, 1.0)
    hashes = elements[owner]
    later = step > 0
    hashes[later] = mix(hashes[later] + step[later].astype(np.uint64), seed=11)
    return hashes, owner, owned


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1, 20)))))


def signatures(
    texts: list[tuple[np.ndarray, np.ndarray]], size: int = BANDS * ROWS
) -> np.ndarray:
    """The earliest dart of each coordinate, a row a text. Every text has an element."""
    out = np.zeros((len(texts), size), dtype=np.uint64)
    parts = [_squares(*text)[::2] for text in texts]
    weights = np.array([w.sum() for _, w in texts])
    until = size * (np.log(size) + 3) / weights  # leaves a coordinate empty for one in twenty
    left = np.arange(len(texts))
    while len(left):
        done = _throw([parts[i] for i in left], until[left], out, left)
        left = left[~done]
        until[left] *= 2
    return out


def _throw(
    parts: list[tuple[np.ndarray, np.ndarray]], until: np.ndarray, out: np.ndarray, rows: np.ndarray
) -> np.ndarray:
    """Throw all darts before `until`; whether each text then has all its coordinates."""
    size = out.shape[1]
    squares = np.concatenate([p[0] for p in parts])
    owned = np.concatenate([p[1] for p in parts])
    lengths = np.array([len(p[0]) for p in parts])
    slots = np.ceil(until).astype(np.int64)
    text = np.repeat(np.arange(len(parts)), lengths)
    # A square for each unit of time.
    times = slots[text]
    at = np.repeat(np.arange(len(squares)), times)
    start = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    seeds = mix(squares[at] + mix(start.astype(np.uint64), seed=1), seed=2)
    # A Poisson number of darts, on average one, in each.
    darts = np.searchsorted(_POISSON, seeds * _TO_UNIT, side="right")
    at, start = np.repeat(at, darts), np.repeat(start, darts)
    number = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
    ids = mix(np.repeat(seeds, darts) + number.astype(np.uint64), seed=3)
    when = start + mix(ids, seed=4) * _TO_UNIT
    valid = when < until[text[at]]
    inside = owned[at]
    if (inside < 1).any():
        valid &= mix(ids, seed=6) * _TO_UNIT < inside
    ids, when, at = ids[valid], when[valid], at[valid]
    cell = text[at] * size + ((mix(ids, seed=7) >> np.uint64(32)) % np.uint64(size)).astype(np.int64)
    first = np.full(len(parts) * size, np.inf)
    np.minimum.at(first, cell, when)
    wins = when == first[cell]
    found = np.zeros(len(parts) * size, dtype=np.uint64)
    found[cell[wins]] = ids[wins]
    done = np.isfinite(first).reshape(-1, size).all(axis=1)
    out[rows[done]] = found.reshape(-1, size)[done]
    return done


def band_keys(found: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One number for each band of each signature."""
    rows = found.reshape(len(found), bands, -1)
    keys = np.zeros((len(found), bands), dtype=np.uint64)
    for i in range(rows.shape[2]):
        keys = mix(keys + rows[:, :, i], seed=9)
    keys = mix(keys + np.arange(bands, dtype=np.uint64), seed=10)  # bands share no bucket
    return keys.view(np.int64)
