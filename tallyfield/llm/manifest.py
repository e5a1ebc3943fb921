"""A Merkle manifest of a dataset, kept in blocks of van Emde Boas layout.

Every row is a leaf, the digest of its fields. The leaves of a source, in order of their
keys, are the lowest level of a 16-ary tree; the trees' roots, in order of the sources, are
the leaves of one more. A tree is cut into aligned blocks of up to three steps (4,096 leaves).
A block stores its subtree recursively split at half height: the upper half of the levels
first, then each lower subtree, all in the same way. Where a node lies is arithmetic alone, at
every depth, so building and looking up siblings read neighbouring bytes whatever the size
of a cache line. The roots of a level's blocks are the leaves of the next level's, until one
block holds the rest. A task sees one block at a time, and no tree passes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import broadcast_if_small, running_total
from tallyfield.functions.text import column_named

from .common import fold, ship_package, written

BITS = 4
FAN = 1 << BITS
# Steps from the leaves of a block to its root.
STEPS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32
PATH = "array<struct<left: string, right: string>>"
BLOCKS = "tree string, n bigint, block bigint, done boolean, root string, nodes binary"


# --- addresses ---------------------------------------------------------------------------


def complete(levels: int) -> int:
    """Nodes of a complete subtree of so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes `index` of a depth (0: the root) lie in a subtree of so many levels."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, index)
    below, lower = depth - upper, levels - upper
    subtree = index >> (BITS * below)
    within = index & ((1 << (BITS * below)) - 1)
    return complete(upper) + subtree * complete(lower) + address(lower, below, within)


@lru_cache(maxsize=64)
def _places(levels: int, depth: int) -> np.ndarray:
    return address(levels, depth, np.arange(FAN**depth, dtype=np.int64))


def height(n: int) -> int:
    """Steps from the leaves of a tree of `n` leaves to its root."""
    steps = 0
    while n > 1:
        n, steps = -(-n // FAN), steps + 1
    return steps


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lay_out(leaves: list[str], levels: int) -> np.ndarray:
    """The digests of the subtree over `leaves` in van Emde Boas order, up to the last one used."""
    nodes = np.zeros((complete(levels), DIGEST), dtype=np.uint8)
    row, end = leaves, 0
    for depth in range(levels - 1, -1, -1):
        at = _places(levels, depth)[: len(row)]
        nodes[at] = np.frombuffer(bytes.fromhex("".join(row)), dtype=np.uint8).reshape(-1, DIGEST)
        end = max(end, int(at.max()) + 1)
        if depth:
            row = [_digest("".join(row[i : i + FAN])) for i in range(0, len(row), FAN)]
    return nodes[:end]


def read_level(nodes: np.ndarray, levels: int, depth: int, count: int) -> list[str]:
    """The digests of the first `count` nodes of a depth."""
    text = nodes[_places(levels, depth)[:count]].tobytes().hex()
    return [text[i : i + 2 * DIGEST] for i in range(0, len(text), 2 * DIGEST)]


def sibling_paths(nodes: np.ndarray, levels: int, leaves: int) -> list[list[tuple[str, str]]]:
    """For each leaf of a block, from the leaf to the block's root, the digests left and
    right of it in its run of sixteen."""
    counts = [leaves]
    for _ in range(levels - 1):
        counts.append(-(-counts[-1] // FAN))
    above: list[list[tuple[str, str]]] = [[]]
    for depth in range(1, levels):
        row = read_level(nodes, levels, depth, counts[levels - 1 - depth])
        here = []
        for i in range(len(row)):
            first = i - i % FAN
            beside = ("".join(row[first:i]), "".join(row[i + 1 : first + FAN]))
            here.append([beside, *above[i // FAN]])
        above = here
    return above


# --- tables ------------------------------------------------------------------------------


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields: each `-` if NULL, else its bytes, `:` and the value."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(
            F.when(text.isNull(), "-").otherwise(
                F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
            )
        )
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _block_leaves(n: int, level: int, block: int) -> tuple[int, int, bool]:
    """Leaves and levels of a block of a tree of `n` leaves, and whether it is the topmost."""
    steps, top = height(n), (level + 1) * STEPS
    for _ in range(level * STEPS):
        n = -(-n // FAN)
    here = min(FAN**STEPS, n - block * FAN**STEPS)
    return here, min(STEPS, steps - level * STEPS) + 1, steps <= top


def _built(rows: DataFrame, level: int) -> DataFrame:
    """The blocks of a level from its leaves: `tree`, `n`, `pos`, `digest`."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaves = None, []

        def block() -> pa.RecordBatch:
            tree, n, number = key
            count, levels, done = _block_leaves(n, level, number)
            if count != len(leaves):
                raise ValueError(f"block {number} of {tree!r} has {len(leaves)} of {count} leaves")
            nodes = lay_out(leaves, levels)
            made = {"tree": [tree], "n": [n], "block": [number], "done": [done]}
            made |= {"root": [nodes[0].tobytes().hex()], "nodes": [nodes.tobytes()]}
            return pa.RecordBatch.from_pydict(made, schema=_schema(BLOCKS))

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("tree", "n", "block", "digest"))
            for tree, n, number, digest in zip(*columns):
                if key != (tree, n, number):
                    if leaves:
                        yield block()
                    key, leaves = (tree, n, number), []
                leaves.append(digest)
        if leaves:
            yield block()

    ship_package(rows.sparkSession)
    placed = rows.select(
        "tree", "n", F.shiftright("pos", BITS * STEPS).alias("block"), "pos", "digest"
    )
    dealt = placed.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.mapInArrow(build, BLOCKS)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.rsplit(" ", 1) for c in ddl.split(", "))])


def build(rows: DataFrame) -> list[DataFrame]:
    """The blocks of all trees by level, lowest first, written.

    `rows` has `tree`, the number `n` of leaves in the tree, `pos` (from 0) and `digest`.
    """
    levels = []
    while True:
        levels.append(written(_built(rows, len(levels))))
        unfinished = levels[-1].where(~F.col("done"))
        if unfinished.isEmpty():
            return levels
        rows = unfinished.select("tree", "n", F.col("block").alias("pos"), F.col("root").alias("digest"))


def roots(levels: list[DataFrame]) -> DataFrame:
    """`tree`, `root` of every tree."""
    tops = [level.where("done").select("tree", "root") for level in levels]
    done = tops[0]
    for more in tops[1:]:
        done = done.unionByName(more)
    return done


def _leaf_paths(blocks: DataFrame, level: int) -> DataFrame:
    """`tree`, `pos`, `path` of every leaf of a level's blocks, from the blocks' own `path`s."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                leaves, levels, _ = _block_leaves(row["n"], level, row["block"])
                nodes = np.frombuffer(row["nodes"], dtype=np.uint8).reshape(-1, DIGEST)
                beyond = [{"left": p["left"], "right": p["right"]} for p in row["path"]]
                paths = [
                    [{"left": a, "right": b} for a, b in own] + beyond
                    for own in sibling_paths(nodes, levels, leaves)
                ]
                first = row["block"] * FAN**STEPS
                for start in range(0, leaves, 256):
                    part = paths[start : start + 256]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["tree"]] * len(part), pa.string()),
                            pa.array(range(first + start, first + start + len(part)), pa.int64()),
                            pa.array(part, _PATHS),
                        ],
                        names=["tree", "pos", "path"],
                    )

    ship_package(blocks.sparkSession)
    return blocks.mapInArrow(expand, f"tree string, pos bigint, path {PATH}")


_PATHS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def block_paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest blocks with `path`, the siblings from their root to the end.

    `tops` has, for each `tree`, the `path` that follows its root. From the topmost level
    down, a block's own path goes on to every block below it.
    """
    given = None
    for level in range(len(levels) - 1, -1, -1):
        blocks = levels[level]
        found = blocks.where("done").join(tops, "tree")
        if given is not None:
            below = given.select("tree", F.col("pos").alias("block"), "path")
            found = found.unionByName(blocks.where(~F.col("done")).join(below, ["tree", "block"]))
        if level:
            given = written(_leaf_paths(found, level))
    return found


class Manifest:
    """The written trees: `rows` (with their places), `levels`, and the tree `over` their roots."""

    def __init__(self, rows: DataFrame, levels: list[DataFrame], over: list[DataFrame], trees: DataFrame):
        self.rows, self.levels, self.over, self.trees = rows, levels, over, trees

    def root(self) -> str | None:
        """The digest of the whole dataset; None if it has no rows."""
        row = roots(self.over).first()
        return row["root"] if row else None


def manifest(rows: DataFrame) -> Manifest:
    """The manifest of `rows`: `tree` (a label; '' comes first), `key`, `leaf`, more columns.

    Leaves are in order of key (NULL first), then of their digest: rows with the same digest
    are leaves of their own beside each other. Trees are in order of their labels' bytes.
    """
    order = [F.col("tree"), F.col("key"), F.col("leaf")]
    rows = written(rows.withColumn("_one", F.lit(1).cast("bigint")))
    placed = written(running_total(rows, order, "_one", "_at"))
    sizes = written(placed.groupBy("tree").agg(F.min("_at").alias("_first"), F.count("*").alias("n")))
    known = placed.join(broadcast_if_small(sizes), "tree")
    known = written(known.withColumn("pos", F.col("_at") - F.col("_first")).drop("_at", "_first", "_one"))
    levels = build(known.select("tree", "n", "pos", F.col("leaf").alias("digest")))
    subroots = written(roots(levels).withColumn("_one", F.lit(1).cast("bigint")))
    trees = written(running_total(subroots, [F.col("tree")], "_one", "pos").drop("_one"))
    n = trees.count()
    over = build(
        trees.select(
            F.lit("").alias("tree"), F.lit(n).cast("bigint").alias("n"), "pos", F.col("root").alias("digest")
        )
    )
    return Manifest(known, levels, over, trees)


def proofs(made: Manifest) -> DataFrame:
    """The lowest blocks of all trees with the `path` from their root to the dataset's, and
    the `subroot` of their tree."""
    whole = made.over[0].select("tree").distinct().withColumn("path", F.array().cast(PATH))
    over = written(_leaf_paths(block_paths(made.over, whole), 0))
    tops = written(
        made.trees.join(over.select("pos", "path"), "pos").select("tree", "path", F.col("root").alias("subroot"))
    )
    found = block_paths(made.levels, tops.select("tree", "path"))
    return found.join(tops.select("tree", "subroot"), "tree")


PROVED = "key bigint, leaf string, subroot string, proof_sha256 string, folded_root string"


def fold_leaves(made: Manifest, presented: str) -> DataFrame:
    """For every row its `subroot`, the digest of its proof and the root that the digest in
    column `presented` folds to along that proof."""
    blocks = proofs(made).select(
        "tree", "n", "block", F.lit(-1).cast("bigint").alias("pos"), "nodes", "path", "subroot",
        *[F.lit(None).cast(t).alias(c) for c, t in (("key", "bigint"), ("leaf", "string"), ("shown", "string"))],
    )
    leaves = made.rows.select(
        "tree", "n", F.shiftright("pos", BITS * STEPS).alias("block"), "pos",
        F.lit(None).cast("binary").alias("nodes"), F.lit(None).cast(PATH).alias("path"),
        F.lit(None).cast("string").alias("subroot"),
        F.col("key").cast("bigint").alias("key"), "leaf", F.col(presented).alias("shown"),
    )

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, beyond, rest, subroot = [], [], "", None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["pos"] < 0:  # the block comes ahead of its leaves
                    count, levels, _ = _block_leaves(row["n"], 0, row["block"])
                    nodes = np.frombuffer(row["nodes"], dtype=np.uint8).reshape(-1, DIGEST)
                    own = sibling_paths(nodes, levels, count)
                    beyond = [(p["left"], p["right"]) for p in row["path"]]
                    rest, subroot = "".join(a + b for a, b in beyond), row["subroot"]
                    continue
                path = own[row["pos"] % FAN**STEPS]
                node = row["shown"]
                for left, right in path:
                    node = _digest(left + node + right)
                for left, right in beyond:
                    node = _digest(left + node + right)
                proof = _digest("".join(a + b for a, b in path) + rest)
                out.append((row["key"], row["leaf"], subroot, proof, node))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out), _schema(PROVED).types)]
                yield pa.RecordBatch.from_arrays(columns, schema=_schema(PROVED))

    ship_package(made.rows.sparkSession)
    together = blocks.unionByName(leaves)
    dealt = together.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.mapInArrow(prove, PROVED)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def audit_documents(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The manifest of the documents, held against a copy in which some texts are altered.

    `doc_id`, `leaf`, `subroot`, `root`, `proof_sha256` of every row as it is; `folded_root` and
    `verified` of the copy, in which the text of every row where 5 divides the crc32 of its
    decimal key has its letters A-Z in lower case. The fields are, in this order, key, source,
    language, length and text; a table lacking rows gives none. A NULL key comes first and is
    never altered, a NULL source is a source of its own, the first. Repeated rows are leaves
    of their own; rows sharing a key are in order of their digests. Other columns of `docs`
    count for nothing, whatever their names.
    """
    key, source, text = (column_named(fields[i]) for i in (0, 1, 4))
    columns = [column_named(c) for c in fields]
    changed = [*columns[:4], F.translate(text, UPPER, LOWER)]
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("")).alias("tree"),
        key.alias("key"),
        leaf(columns).alias("leaf"),
        F.when(fold(key, 5) == 0, leaf(changed)).alias("altered"),
    )
    rows = rows.withColumn("altered", F.coalesce("altered", "leaf"))
    made = manifest(rows)
    root = F.lit(made.root()).cast("string")
    return fold_leaves(made, "altered").select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        root.alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


# Unrolled in SQL: trees of up to 16 ** LEVELS leaves.
LEVELS = 6


def _sql_levels(start: str, tree: str, name: str, levels: int) -> tuple[list[str], str]:
    """CTEs that take `start` (tree, id, pos, node, shown, proof) up to the root of each tree."""
    steps, last = [], start
    for level in range(levels):
        step = f"{name}_{level}"
        steps.append(
            f"""{step}_runs AS MATERIALIZED (
  SELECT {tree}, pos // 16 AS pos, string_agg(node, '' ORDER BY pos) AS joined, list(node ORDER BY pos) AS nodes,
         any_value(size) AS size
  FROM (SELECT DISTINCT {tree}, pos, node, size FROM {last}) GROUP BY ALL
), {step} AS MATERIALIZED (
  SELECT l.id, l.{tree}, l.pos // 16 AS pos,
         CASE WHEN l.size > 1 THEN sha256(joined) ELSE l.node END AS node,
         CASE WHEN l.size > 1 THEN sha256(array_to_string(nodes[1:CAST(l.pos % 16 AS bigint)], '') || shown
           || array_to_string(nodes[CAST(l.pos % 16 AS bigint) + 2:], '')) ELSE shown END AS shown,
         CASE WHEN l.size > 1 THEN proof || array_to_string(nodes[1:CAST(l.pos % 16 AS bigint)], '')
           || array_to_string(nodes[CAST(l.pos % 16 AS bigint) + 2:], '') ELSE proof END AS proof,
         (l.size + 15) // 16 AS size
  FROM {last} l JOIN {step}_runs r ON l.{tree} = r.{tree} AND l.pos // 16 = r.pos
)"""
        )
        last = step
    return steps, last


def audit_sql(levels: int = LEVELS) -> str:
    """The same in SQL, for trees of up to 16 ** levels leaves."""

    def field(name: str) -> str:
        return f"coalesce(strlen(CAST({name} AS varchar)) || ':' || CAST({name} AS varchar), '-')"

    def digest(text: str) -> str:
        return "sha256(" + " || ".join([*map(field, FIELDS[:4]), field(text)]) + ")"

    inner, subroots = _sql_levels("leaves", "tree", "step", levels)
    outer, last = _sql_levels("trees", "whole", "over", levels)
    # crc32, bit by bit: a byte is xor-ed in, then eight shifts (-1 in the list) follow.
    crc = (
        "xor(list_reduce(list_prepend(CAST(4294967295 AS bigint), flatten([[CAST(ord(c) AS bigint),"
        "-1,-1,-1,-1,-1,-1,-1,-1] FOR c IN string_split(CAST(doc_id AS varchar), '')])), "
        "LAMBDA a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
        ", 4294967295)"
    )
    return f"""
WITH hashed AS MATERIALIZED (
  SELECT *, CASE WHEN crc % 5 = 0 THEN {digest(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE node END AS shown
  FROM (SELECT *, {digest("text")} AS node, {crc} AS crc FROM documents)
), leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, node) - 1 AS pos,
         node, shown, '' AS proof, count(*) OVER (PARTITION BY source) AS size
  FROM hashed
), {", ".join(inner)}, trees AS MATERIALIZED (
  SELECT id, 'all' AS whole, dense_rank() OVER (ORDER BY tree) - 1 AS pos, node, shown, proof,
         (SELECT count(DISTINCT tree) FROM {subroots}) AS size
  FROM {subroots}
), {", ".join(outer)}
SELECT doc_id, leaves.node AS leaf, s.node AS subroot, r.node AS root, sha256(r.proof) AS proof_sha256,
       r.shown AS folded_root, r.shown = r.node AS verified
FROM leaves JOIN {subroots} s ON leaves.id = s.id JOIN {last} r ON leaves.id = r.id
"""
