"""Exact top-k inner products with block-at-a-time pruning.

Vectors are put in an order in which similar ones lie near each other, and that order is
cut into blocks. A block has a forward index (its vectors) and, for every dimension, its
largest and smallest value. Their products with a query add up to a bound that no score in
the block exceeds. A query takes blocks by falling bound, scores them through the forward
index, and stops when the next bound is below its k-th score so far.

Blocks lie in groups of about equal size, with bounds of their own. Equal vectors are one, with
the few smallest of their ids, which are all that can count. A query first meets the group
it lies in itself, then the group of highest bound, and so has a k-th score early; it is
sent to another group only if that one's bound reaches it. So what is shuffled are queries
that may find something, and groups that are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions import broadcast_if_small, range_number

from .common import map_batches, mix, ship_package, written

BLOCK, GROUP = 64, 8192
# Queries that meet a group in one task, about.
CHUNK = 4096
PLANES = 16
# Bytes of bounds that are held against the queries at once.
BOUNDS_BYTES = 32 * 1024 * 1024
# Doubles hold integers exactly up to here; larger sums are added as Python integers.
_EXACT = 2.0**53


def scaled(embedding: str, scale: int = 64):
    """floor(scale * x) of every component; NULL if the vector or a component is NULL or not finite."""
    usable = F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    whole = F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    return F.when(usable & (F.size(embedding) > 0), whole)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score` of the k best of every query.

    `vectors` has `vec_id` (an integer) and `values`, an array of BIGINT. Queries are the
    rows whose id is divisible by `every`; each is held against every row but itself. Ties
    go to the smaller id. NULL ids and vectors take no part; rows equal in id and vector are
    one row. Rows that share an id alone are rows of their own, also as queries: each has
    its ranks from 1. Vectors meet only those of their own length. Scores are exact; one
    beyond BIGINT is an error. Other columns count for nothing, whatever their names.
    """
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("values").isNotNull())
    usable = written(usable.select(F.col("vec_id").cast("bigint").alias("vec_id"), "values").distinct())
    # One row more than k, as a query's own row does not count.
    few = usable.withColumn("_n", F.row_number().over(Window.partitionBy("values").orderBy("vec_id")))
    kinds = few.where(F.col("_n") <= k + 1).groupBy("values").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    kinds = kinds.select(F.monotonically_increasing_id().alias("v"), F.size("values").alias("dims"), "ids", "values")
    kinds = written(_with_place(kinds))
    groups = max(1, -(-kinds.count() // GROUP))
    order = [F.col(c) for c in ("dims", "place", "v")]
    placed = written(kinds.withColumn("group", range_number(kinds, order, parts=groups)))
    asked = usable.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "values")
    asked = written(asked.join(placed.select("values", "v"), "values").select("query_id", "v"))
    own = placed.join(asked.select("v").distinct(), "v", "left_semi")
    per_chunk = max(1, groups * CHUNK // max(1, own.count()))
    queries = written(
        own.select(
            "v", "dims", "values", F.expr(f"group div {per_chunk}").alias("chunk"), F.array("group").alias("seen")
        )
    )
    bounds = written(_bounds(placed))
    home = queries.withColumns({"group": F.element_at("seen", 1), "floor": F.lit(None).cast("bigint")})
    found = written(_meet(placed, home.drop("seen"), k + 1))
    for only_best in (True, False):
        sent = written(_sent(_with_floor(queries, found, k + 1), bounds, only_best))
        found = written(found.unionByName(_meet(placed, sent, k + 1)))
        if only_best:
            went = sent.groupBy("v").agg(F.collect_set("group").alias("went"))
            queries = queries.join(went, "v", "left").withColumn(
                "seen", F.concat("seen", F.coalesce("went", F.array().cast("array<int>")))
            )
            queries = written(queries.drop("went"))
    best = Window.partitionBy("of").orderBy(F.desc("score"), "least_id")
    near = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    rows = near.join(placed.select("v", F.explode("ids").alias("vec_id")), "v")
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("score"), "vec_id")))
    lists = ranked.where(F.col("_n") <= k + 1).groupBy("of").agg(
        F.sort_array(F.collect_list(F.struct("_n", "v", "vec_id", "score"))).alias("list")
    )
    others = F.filter("list", lambda x: (x["v"] != F.col("of")) | (x["vec_id"] != F.col("query_id")))
    ends = asked.join(lists, asked["v"] == lists["of"]).select(
        "query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "best")
    )
    return ends.select("query_id", (F.col("at") + 1).alias("rank"), "best.vec_id", "best.score")


def _bounds(placed: DataFrame) -> DataFrame:
    """`group`, `dims`, the `low` and the `high` of every dimension, and the least id, of every group."""

    def bound(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.array(rows["values"].tolist(), dtype=np.int64)
        out = {"group": [rows["group"].iloc[0]], "dims": [rows["dims"].iloc[0]]}
        out |= {"low": [values.min(axis=0).tolist()], "high": [values.max(axis=0).tolist()]}
        return pd.DataFrame(out | {"least_id": [min(ids[0] for ids in rows["ids"])]})

    ship_package(placed.sparkSession)
    schema = "group int, dims int, low array<bigint>, high array<bigint>, least_id bigint"
    return placed.select("group", "dims", "ids", "values").groupBy("group", "dims").applyInPandas(bound, schema)


def _with_floor(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The queries with `floor` and `floor_id`: score and id of the k-th so far; NULL if there are fewer."""
    place = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("score"), "least_id"))
    kth = found.withColumn("_n", place).where(F.col("_n") == k)
    kth = kth.select(F.col("of").alias("v"), F.col("score").alias("floor"), F.col("least_id").alias("floor_id"))
    return queries.join(kth, "v", "left")


def _sent(queries: DataFrame, bounds: DataFrame, only_best: bool) -> DataFrame:
    """The queries once for each group they go to: those not seen yet whose bound reaches the
    query's floor, or the one of them with the highest bound.

    An equal bound reaches it only with a smaller id. Bounds are sent to all tasks in slices
    of bounded size; each slice is one pass over the queries.
    """
    spark = queries.sparkSession
    ship_package(spark)
    size = bounds.agg(F.sum(16 * F.size("low") + 32)).first()[0] or 0
    slices = max(1, math.ceil(size / BOUNDS_BYTES))
    total = None
    for i in range(slices):
        part = bounds.where(F.pmod(F.xxhash64("group"), F.lit(slices)) == i).toPandas()
        shared = spark.sparkContext.broadcast(
            {
                int(dims): tuple(np.array(rows[c].tolist(), dtype=np.int64) for c in ("group", "low", "high", "least_id"))
                for dims, rows in part.groupby("dims")
            }
        )

        def send(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, to = [], []
                for row, query in enumerate(batch.to_pylist()):
                    if query["dims"] in shared.value:
                        group = _reached(query, *shared.value[query["dims"]], only_best)
                        at += [row] * len(group)
                        to += group
                chosen = batch.select(["v", "dims", "values", "chunk", "floor"]).take(pa.array(at, pa.int64()))
                columns = [*chosen.columns, pa.array(to, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[*chosen.schema.names, "group"])

        sent = queries.mapInArrow(send, "v bigint, dims int, values array<bigint>, chunk bigint, floor bigint, group int")
        total = sent if total is None else total.unionByName(sent)
    return total


def _reached(query: dict, group, low, high, least_id, only_best: bool) -> list[int]:
    """The groups a query goes to."""
    values = np.array(query["values"], dtype=object if _wide(query["values"], low, high) else np.float64)
    kind = values.dtype.type if values.dtype != object else object
    low, high = low.astype(kind), high.astype(kind)
    bound = np.maximum(values, 0) @ high.T + np.minimum(values, 0) @ low.T
    open_ = ~np.isin(group, query["seen"])
    if query["floor"] is not None:
        tie = (bound == query["floor"]) & (least_id < query["floor_id"])
        open_ &= np.asarray((bound > query["floor"]) | tie, dtype=bool)
    if only_best and open_.any():
        at = np.flatnonzero(open_)
        return [int(group[min(at, key=lambda i: (-bound[i], least_id[i]))])]
    return group[open_].tolist()


def _wide(values: list[int], low: np.ndarray, high: np.ndarray) -> bool:
    """Whether a sum of products may be beyond what doubles hold exactly."""
    most = max(abs(float(low.min(initial=0))), abs(float(high.max(initial=0))))
    return most * max(map(abs, values), default=0) * len(values) >= _EXACT


def _with_place(vectors: DataFrame) -> DataFrame:
    """Add `place`: the signs of pseudo-random sums of the components, alike for near vectors."""

    def place(batch: pa.RecordBatch) -> pa.Table:
        places = np.zeros(batch.num_rows, dtype=np.int64)
        for i, values in enumerate(batch.column("values").to_pylist()):
            seeds = np.arange(len(values) * PLANES, dtype=np.uint64).reshape(-1, PLANES)
            signs = (mix(seeds, seed=3) >> np.uint64(63)).astype(np.float64) * 2 - 1
            above = np.array(values, dtype=np.float64) @ signs > 0
            places[i] = int(above @ (1 << np.arange(PLANES)))
        return pa.Table.from_batches([batch]).append_column("place", pa.array(places))

    return map_batches(
        vectors, place, "v bigint, dims int, ids array<bigint>, values array<bigint>, place bigint"
    )


def _meet(placed: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each query within each group it is sent to: `of`, `v`, `least_id`, `score`.

    `queries` has `v`, `dims`, `values`, `chunk`, `floor` and `group`. A group is copied for each
    chunk of queries that asks for it.
    """
    keys = ["group", "dims", "chunk"]
    wanted = broadcast_if_small(queries.select(*keys).distinct())
    copies = placed.select("group", "dims", "v", F.element_at("ids", 1).alias("least_id"), "values").join(
        wanted, ["group", "dims"]
    )
    asked = queries.select([F.col(c).alias(f"of_{c}") for c in (*keys, "v", "values", "floor")])

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("of", "v", "least_id", "score")})
        # In order of ids, so that of equal vectors' blocks the same ones are skipped always.
        left = left.sort_values("v")
        values = np.array(left["values"].tolist(), dtype=np.int64)
        queries = np.array(right["of_values"].tolist(), dtype=np.int64)
        floor = np.array([-np.inf if pd.isna(x) else float(x) for x in right["of_floor"].astype(object)])
        ids = left["least_id"].to_numpy(np.int64)
        row, at, score = search_blocks(ids, values, queries, k, floor)
        of = right["of_v"].to_numpy(np.int64)[row]
        return pd.DataFrame({"of": of, "v": left["v"].to_numpy(np.int64)[at], "least_id": ids[at], "score": score})

    ship_package(placed.sparkSession)
    return (
        copies.groupBy(*keys)
        .cogroup(asked.groupBy(*[f"of_{c}" for c in keys]))
        .applyInPandas(search, "of bigint, v bigint, least_id bigint, score bigint")
    )


def search_blocks(
    ids: np.ndarray, values: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray, block: int = BLOCK
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, place of the vector and score of the k best of each query that score at least
    `floor`; ties go to the smaller id."""
    largest = float(np.abs(values.astype(float)).max(initial=0)) * float(
        np.abs(queries.astype(float)).max(initial=0)
    )
    kind = np.float64 if largest * values.shape[1] < _EXACT else object
    values, queries = values.astype(kind), queries.astype(kind)
    starts = range(0, len(ids), block)
    high = np.stack([values[s : s + block].max(axis=0) for s in starts])
    low = np.stack([values[s : s + block].min(axis=0) for s in starts])
    zero = kind(0) if kind is np.float64 else 0
    bounds = np.maximum(queries, zero) @ high.T + np.minimum(queries, zero) @ low.T
    turn = np.argsort(-bounds, axis=1, kind="stable")
    m, none = len(queries), -np.inf if kind is np.float64 else -(2**200)
    top_score = np.full((m, k), none, dtype=kind)
    top_at = np.full((m, k), -1)
    # A place that holds nothing comes after all others.
    id_of = np.append(ids, np.iinfo(np.int64).max)
    active = np.arange(m)
    for step in range(len(high)):
        at = turn[active, step]
        kth = np.maximum(top_score[active, -1], floor[active])
        going = np.asarray(bounds[active, at] >= kth, dtype=bool)  # an equal score may have the smaller id
        active, at = active[going], at[going]
        if not len(active):
            break
        for b in np.unique(at):
            rows = active[at == b]
            scores = queries[rows] @ values[b * block : (b + 1) * block].T
            enough = np.asarray(scores >= np.maximum(top_score[rows, -1], floor[rows])[:, None], dtype=bool)
            useful = enough.any(axis=1)
            if not useful.any():
                continue
            rows, scores, enough = rows[useful], scores[useful], enough[useful]
            here = np.arange(b * block, b * block + scores.shape[1])
            both = np.concatenate([top_score[rows], np.where(enough, scores, none)], axis=1)
            both_at = np.concatenate([top_at[rows], np.where(enough, here[None, :], -1)], axis=1)
            both_ids = id_of[both_at]
            best = np.lexsort((both_ids, -both), axis=1)[:, :k] if kind is np.float64 else np.array(
                [sorted(range(both.shape[1]), key=lambda j: (-both[i, j], both_ids[i, j]))[:k] for i in range(len(both))]
            )
            top_score[rows] = np.take_along_axis(both, best, axis=1)
            top_at[rows] = np.take_along_axis(both_at, best, axis=1)
    found = top_at >= 0
    score = top_score[found]
    if kind is object and len(score) and max(abs(int(x)) for x in score) >= 2**63:
        raise OverflowError("a score does not fit BIGINT")
    return np.repeat(np.arange(m), k).reshape(m, k)[found], top_at[found], score.astype(np.int64)
