"""Fixity audit of archived records by Merkle trees.

A record's leaf is the SHA-256 of its content. The lowest nodes hash the leaves of an
offset range of fixed width, in order; a node above hashes the nodes of FANOUT ranges that
follow each other, up to one root an archive and replica. An audit compares roots and goes
down only where digests differ, to the records that were altered, lost or added.

Ranges are cut by byte offset, not by counting records, so that a node is made from a
bounded number of children whatever the size of the archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import running_total

from .common import written

# Bytes of a lowest range, and children of a node, as powers of two.
RANGE_BITS, FANOUT_BITS = 16, 4


def content(*fields: Column) -> Column:
    """The bytes that stand for a record: NULL and the empty text differ."""
    marked = [F.coalesce(F.concat(F.lit("1"), f.cast("string")), F.lit("0")) for f in fields]
    return F.concat_ws("\n", *marked)


def with_offsets(records: DataFrame, order: list[str], length: str = "length") -> DataFrame:
    """Add `offset`: where each record begins if they lie one after the other in `order`.

    The records are written first, as they are read several times.
    """
    return running_total(written(records), [F.col(c) for c in order], length, "offset")


def build_tree(records: DataFrame) -> list[DataFrame]:
    """The levels of the trees, lowest first: `archive`, `replica`, `node`, `digest`.

    `records` has `archive`, `replica`, `offset`, `length` and `digest`. Only digests are
    shuffled; each level is written, being about a sixteenth of the one below.
    """
    keyed = records.withColumn("node", F.shiftright("offset", RANGE_BITS))
    leaf = F.concat_ws(
        ":", F.col("offset").cast("string"), F.col("length").cast("string"), F.col("digest")
    )
    children = F.sort_array(F.collect_list(F.struct("offset", leaf.alias("leaf"))))
    level = keyed.groupBy("archive", "replica", "node").agg(
        F.sha2(F.concat_ws(";", children["leaf"]).cast("binary"), 256).alias("digest")
    )
    levels = [written(level)]
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while top > 0:
        below = levels[-1].withColumnsRenamed({"node": "child", "digest": "of_child"})
        part = F.concat_ws(":", F.col("child").cast("string"), F.col("of_child"))
        children = F.sort_array(F.collect_list(F.struct("child", part.alias("part"))))
        level = (
            below.withColumn("node", F.shiftright("child", FANOUT_BITS))
            .groupBy("archive", "replica", "node")
            .agg(F.sha2(F.concat_ws(";", children["part"]).cast("binary"), 256).alias("digest"))
        )
        levels.append(written(level))
        top >>= FANOUT_BITS
    return levels


def audit(originals: DataFrame, replicas: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """What differs: `archive`, `replica`, `offset`, `kind`, and length and digest of both sides.

    `originals` has `archive`, `offset`, `length`, `digest`, and `replicas` also `replica`
    (an integer of at least 1). `kind` is 'altered', 'missing' or 'extra'. Records at one
    offset are told apart by their digests: a repeated record counts once. `pairs`
    (`archive`, `replica`) are the replicas there should be: of one that holds no record of
    an archive all are missing. Without `pairs` such a replica is not seen. An empty original
    makes all extra.
    """
    originals = originals.select("archive", F.lit(0).alias("replica"), "offset", "length", "digest")
    replicas = replicas.select("archive", F.col("replica").cast("int"), "offset", "length", "digest")
    records = written(originals.unionByName(replicas).distinct())
    levels = build_tree(records)
    known = levels[-1].where("replica > 0").select("archive", "replica").distinct()
    if pairs is not None:
        wanted = pairs.select("archive", F.col("replica").cast("int").alias("replica"))
        known = written(known.unionByName(wanted).distinct())
    # Roots of every replica, also against an archive without an original.
    suspect = None
    for level in reversed(levels):
        if suspect is not None:
            suspect = suspect.select("archive", "replica", F.col("node").alias("parent")).distinct()
        suspect = written(_differing(level, suspect, known))
    at_fault = suspect.select("archive", "replica", F.col("node").alias("range"))
    ranged = records.withColumn("range", F.shiftright("offset", RANGE_BITS))
    left = (
        ranged.where("replica = 0").drop("replica").join(at_fault, ["archive", "range"])
    )
    right = ranged.where("replica > 0").join(at_fault, ["archive", "replica", "range"])
    key = ["archive", "replica", "offset"]
    same = [*key, "length", "digest"]
    only_left = left.select(*same).join(right.select(*same), same, "left_anti")
    only_right = right.select(*same).join(left.select(*same), same, "left_anti")
    expected = only_left.withColumnsRenamed({"length": "length_expected", "digest": "expected"})
    found = only_right.withColumnsRenamed({"length": "length_found", "digest": "found"})
    return expected.join(found, key, "full").select(
        *key,
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("expected").isNull(), "extra")
        .otherwise("altered")
        .alias("kind"),
        "length_expected",
        "length_found",
        "expected",
        "found",
    )


def _differing(level: DataFrame, parents: DataFrame | None, known: DataFrame) -> DataFrame:
    """`archive`, `replica`, `node` of the nodes of this level that differ, below `parents`."""
    nodes = level.withColumn("parent", F.shiftright("node", FANOUT_BITS))
    theirs = nodes.where("replica > 0")
    ours = nodes.where("replica = 0").drop("replica")
    if parents is None:
        ours = ours.join(known, "archive")
    else:
        theirs = theirs.join(parents, ["archive", "replica", "parent"])
        ours = ours.join(parents, ["archive", "parent"])
    key = ["archive", "replica", "node"]
    pairs = ours.select(*key, F.col("digest").alias("ours")).join(
        theirs.select(*key, F.col("digest").alias("theirs")), key, "full"
    )
    return pairs.where(~F.col("ours").eqNullSafe(F.col("theirs"))).select(*key)
