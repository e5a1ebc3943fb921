"""Links between near-duplicates: candidate pairs from shared buckets, and union-find.

Nodes are BIGINT. Nothing here is collected; every round's edges are written, so that a
lost executor costs that round alone and the lineage stays short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, sifted_join, written

# Nodes of a bucket up to which those apart are tested pair by pair: at most so many tests a
# node. Larger buckets go another, equally exact way.
DIRECT = 16
# Elements of a block of sets, about.
BLOCK = 16_384
# Nodes of a share of those around one component, about, and the most shares they are dealt to.
SHARE = 2_048
SHARES = 64
# Nodes of a bucket of which the most central one is looked for.
CENTRAL = 8
# A set of up to so many elements is folded into bits of this many words, twice the set in bits
# at least; with each doubling of the set the words double.
FOLDED = 512
WORDS = 16
# Edges a file of a round of union-find, about, and its fewest files.
EDGES = 250_000
FEWEST = 16
# Bytes of shared buckets up to which they are broadcast whole.
SHARED_BYTES = 8 * 1024 * 1024


def components(edges: DataFrame) -> DataFrame:
    """`node`, `component` (its smallest node) of every node with an edge (`a`, `b`), written.

    Alternates the large-star and small-star steps until every edge leads to the smallest
    node: a number of rounds logarithmic in the nodes. Each step sends an edge and one
    minimum for each node; where a node has very many edges, only its minimum is copied,
    and adaptive execution splits the edges. Edges that are stars already take no round.
    """
    current = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = written(current.where(F.col("u") != F.col("v")).distinct())
    n, left = _progress(current)
    while left:
        # Edges never become more, so the files of a round need be no more than these ask for.
        stars = _small_star(_large_star(current)).coalesce(max(FEWEST, n // EDGES))
        before, current = current, written(stars)
        discard(before)
        n, left = _progress(current)
    pairs = F.array(
        F.struct(F.col("u").alias("node"), F.col("v").alias("component")),
        F.struct(F.col("v").alias("node"), F.col("v").alias("component")),
    )
    found = written(current.select(F.inline(pairs)).distinct())
    discard(current)
    return found


def _progress(edges: DataFrame) -> tuple[int, int]:
    """The number of edges, and of nodes with more than one smaller neighbour or with both a
    smaller and a larger one: none if the edges are stars around their smallest nodes."""
    ends = F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("smaller"), F.lit(1).alias("larger")),
    )
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(
        F.sum("smaller").alias("smaller"), F.max("larger").alias("larger")
    )
    row = nodes.agg(F.sum("smaller"), F.count_if(F.col("smaller") + F.col("larger") * F.least("smaller", F.lit(1)) > 1)).first()
    return row[0] or 0, row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node's surroundings.

    Links come as often as they are found: the next step makes them distinct.
    """
    ways = F.array(
        F.struct(F.col("u").alias("u"), F.col("v").alias("v")),
        F.struct(F.col("v").alias("u"), F.col("u").alias("v")),
    )
    both = edges.select(F.inline(ways))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where(F.col("v") > F.col("u"))
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are all linked to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    # The edge to the smallest neighbour stays; any other now leads from that neighbour.
    return (
        edges.join(least, "u")
        .select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def shared_buckets(members: DataFrame) -> DataFrame:
    """`bucket`, `node` of the buckets with at least two nodes, written."""
    groups = members.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    # Few buckets are shared: the members of the others are not shuffled again.
    shared = written(groups.where(F.col("lo") < F.col("hi")).select("bucket"))
    return written(sifted_join(members, shared, ["bucket"], SHARED_BYTES))


def link(
    shared: DataFrame,
    similar: Callable[[DataFrame], DataFrame],
    elements: Callable[[DataFrame], DataFrame],
    similarity: float,
    parts: int = 4,
) -> DataFrame:
    """`node`, `component` of all nodes that are similar to another one.

    `shared` has `bucket`, `node`, each once; nodes of a bucket are candidates. `similar`
    takes distinct pairs (`a` < `b`) and gives back those whose Jaccard similarity is at
    least `similarity`; `elements` gives the sets of some nodes, in rows (`node`, `element`) or
    whole (`node`, `elements`).

    Not all pairs of a bucket are made. The buckets are taken in `parts`. In each, a bucket
    whose nodes are not yet all in one component tests every node against the bucket's
    first one. After that, in buckets still apart, every node outside the bucket's largest
    component has to be held against the rest. Small buckets do so pair by pair. In large
    ones they first meet the most central node. Those still outside then meet what lies in
    buckets with the same largest component, as bits their sets are folded into: only pairs
    that these bits, and the sizes of the sets, do not rule out become rows. Of those, each
    outside node's nearest is tested first, then what is still apart. So every pair of a bucket
    is tested, or cannot be similar, or its nodes are in one component anyway: no link between
    components is lost.
    """
    edges = tested = labels = None
    for part in range(parts):
        apart = _apart(shared.where(F.pmod("bucket", F.lit(parts)) == part), labels)
        first = apart.groupBy("bucket").agg(F.min_by(F.struct("node", "label"), "node").alias("lead"))
        pairs = _pairs(apart.join(first, "bucket"), F.col("lead.node"), F.col("lead.label"), tested)
        edges, tested, labels = _add(pairs, similar, edges, tested, labels)
    placed = _placed(_apart(shared, labels))
    large = placed.where(F.col("nodes") > DIRECT)
    folded = None
    if not large.isEmpty():
        folded = written(_folded(elements(large.select("node"))))
        centre = _centres(large, folded)
        pairs = _pairs(large.join(centre, "bucket"), F.col("lead.node"), F.col("lead.label"), tested)
        edges, tested, labels = _add(pairs, similar, edges, tested, labels)
        placed = _placed(_apart(placed.select("bucket", "node"), labels))
        large = placed.where(F.col("nodes") > DIRECT)
    small = placed.where(F.col("nodes") <= DIRECT)
    others = small.where(F.col("label") != F.col("main")).select(
        "bucket", F.col("node").alias("other"), F.col("label").alias("other_label")
    )
    # Two nodes outside the main component meet once, from the smaller label.
    crossing = small.join(others, "bucket").where(
        (F.col("label") == F.col("main")) | (F.col("label") < F.col("other_label"))
    )
    pairs = _pairs(crossing, F.col("other"), F.col("other_label"), tested)
    if folded is None:
        return _add(pairs, similar, edges, tested, labels)[2]
    met = written(_met(folded, large, similarity))
    discard(folded)
    nearest = met.groupBy("out").agg(F.min_by(F.struct("a", "b"), F.struct("far", "a", "b")).alias("pair"))
    nearest = nearest.select("pair.a", "pair.b").join(tested, ["a", "b"], "left_anti")
    edges, tested, labels = _add(pairs.unionByName(nearest).distinct(), similar, edges, tested, labels)
    pairs = _still_apart(met.select("a", "b").distinct(), labels).join(tested, ["a", "b"], "left_anti")
    return _add(pairs, similar, edges, tested, labels)[2]


def _placed(apart: DataFrame) -> DataFrame:
    """Add each bucket's largest component, `main`, and its number of `nodes`."""
    apart = written(apart)
    sizes = apart.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("nodes")
    )
    placed = written(apart.join(main, "bucket"))
    discard(apart)
    return placed


def _facts(sets: DataFrame) -> DataFrame:
    """`node`, its `elements`, the `size` of its set, and how many of them are its `own`, in no other set. Written.

    `sets` has `node` and either `elements` or rows of `element`. Sets meet in blocks of about
    BLOCK elements first, so that an element is one row a block and not one a set that has it.
    The sets are written and shuffled whole: for bounded sets only. `link` works by `_folded`.
    """
    if "element" in sets.columns:
        sets = sets.groupBy("node").agg(F.collect_list("element").alias("elements"))
    whole = written(sets.select("node", "elements", F.size("elements").cast("bigint").alias("size")))
    total = whole.agg(F.sum("size")).first()[0] or 0
    block = F.pmod(F.xxhash64("node"), F.lit(max(1, -(-total // BLOCK))))
    entries = F.transform("elements", lambda e: F.struct(e.alias("element"), F.col("node").alias("node")))
    met = whole.groupBy(block.alias("block")).agg(F.array_sort(F.flatten(F.collect_list(entries))).alias("entries"))

    def same(e, at):
        return F.coalesce(F.get("entries", at)["element"] == e["element"], F.lit(False))

    # The first of each element, and whether the block has it again.
    firsts = F.filter(
        F.transform(
            "entries",
            lambda e, i: F.struct(
                e["element"].alias("element"),
                e["node"].alias("node"),
                same(e, i + 1).alias("again"),
                same(e, i - 1).alias("later"),
            ),
        ),
        lambda e: ~e["later"],
    )
    each = met.select(F.inline(firsts)).drop("later")
    # Only elements that one node has come back to it: no row for each node that shares one.
    lone = each.groupBy("element").agg(F.min("node").alias("node"), F.count("*").alias("blocks"), F.bool_or("again").alias("again"))
    own = lone.where("blocks = 1 and not again").groupBy("node").agg(F.count("*").alias("own"))
    facts = written(whole.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0))))
    discard(whole)
    return facts


def _level(size: Column) -> Column:
    """How often the words of a set of this size are doubled: 0 up to FOLDED elements, then 1 up to twice as many."""
    return F.when(size <= FOLDED, F.lit(0)).otherwise(F.length(F.bin(F.floor((size - 1) / F.lit(FOLDED)))))


def _folded(sets: DataFrame) -> DataFrame:
    """`node`, `size`, `level`, `bits` of sets in rows as `elements` gives them to `link`.

    There is a place for each hash, modulo the number of places, set where an odd number of
    elements fall on it. Places where the bits of two sets differ are never more than the
    elements that one of the sets has alone. A set becomes bits in the task that makes it: it
    is not written, and what is shuffled of it does not grow with its elements.
    """
    if "element" in sets.columns:
        sets = sets.groupBy("node").agg(F.collect_list("element").alias("elements"))
    sized = sets.select("node", F.size("elements").cast("bigint").alias("size"), F.explode_outer("elements").alias("element"))
    rows = sized.select("node", "size", _level(F.col("size")).alias("level"), F.xxhash64("element").alias("h"))
    place = {
        "section": f"(h div {64 * WORDS}) & (shiftleft(1L, level) - 1)",
        "word": f"(h & {64 * WORDS - 1}L) div 64",
        "bit": "shiftleft(1L, cast(h & 63L AS int))",
    }
    rows = rows.withColumn("h", F.shiftrightunsigned("h", 1)).select(
        "node", "size", "level", *[F.expr(e).alias(c) for c, e in place.items()]
    )
    words = [F.bit_xor(F.when(F.col("word") == i, F.col("bit")).otherwise(F.expr("0L"))).alias(f"w{i}") for i in range(WORDS)]
    sections = rows.groupBy("node", "size", "level", "section").agg(*words)
    part = F.struct("section", F.array(*[f"w{i}" for i in range(WORDS)]).alias("words"))
    parts = sections.groupBy("node", "size", "level").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    # A section that no element falls on would shift the others; without bits a set is tested with all.
    whole_bits = F.flatten(F.transform("parts", lambda p: p["words"]))
    bits = F.when(F.size("parts") == F.expr("shiftleft(1, level)"), whole_bits)
    return parts.select("node", "size", "level", bits.alias("bits"))


def _first_differing(a: str, b: str) -> Column:
    """Places that differ in the first words of two columns of bits; at level 0 these are all."""
    total = F.lit(0)
    for i in range(WORDS):
        total = total + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return total


def _centres(large: DataFrame, folded: DataFrame) -> DataFrame:
    """`bucket`, `lead`: of a few nodes of each bucket the one whose bits differ least from the others'.

    It is alike to most of those that are alike to any. Which nodes are looked at changes no
    component, only how many are left outside.
    """
    order = Window.partitionBy("bucket").orderBy(F.xxhash64("node"), "node")
    some = large.select("bucket", "node", "label", F.row_number().over(order).alias("nth"))
    some = written(some.where(F.col("nth") <= CENTRAL).drop("nth").join(folded, "node"))
    peers = some.select("bucket", "level", F.col("size").alias("size_o"), F.col("bits").alias("bits_o"))
    alike = 1 - _first_differing("bits", "bits_o") / (F.col("size") + F.col("size_o"))
    scores = some.join(peers, ["bucket", "level"]).groupBy("bucket", "node", "label").agg(
        F.sum(F.coalesce(F.greatest(alike, F.lit(0.0)), F.lit(0.0))).alias("score")
    )
    return scores.groupBy("bucket").agg(
        F.max_by(F.struct("node", "label"), F.struct("score", -F.col("node"))).alias("lead")
    )


def _met(folded: DataFrame, large: DataFrame, similarity: float) -> DataFrame:
    """`out`, `a`, `b`, `far`: pairs `a` < `b` of different labels that may be similar by `folded`, one of
    them, `out`, outside its bucket's main component; `far` is the share of places they differ in.

    Nodes are gathered by the main component of their buckets, once however many buckets
    they share, and dealt to shares where these are many. Two sets of sizes m and n are
    similar only if they share s / (1 + s) * (m + n) elements, and what they do not share is at
    least what their bits differ in. Sets of different levels meet at the lower one, where
    the bits of the larger are folded once more.
    """
    about = large.groupBy(F.col("main").alias("around"), "node", "label").agg(F.count("*").alias("_n")).drop("_n")
    about = written(about.join(folded, "node").withColumn("outside", F.col("label") != F.col("around")))
    sizes = about.groupBy("around").agg(F.count("*").alias("nodes"))
    factor = F.lit(similarity / (1 + similarity))
    about = about.join(sizes, "around")
    lowest = F.least(_level(F.ceil(F.col("size") * similarity - 1e-9)), F.col("level"))
    about = about.withColumn("at", F.explode(F.sequence(lowest, F.col("level"))))
    lower = f"shiftleft({WORDS}, at)"
    fold = F.expr(
        f"transform(sequence(0, {lower} - 1), i -> "
        f"aggregate(sequence(i, size(bits) - 1, {lower}), 0L, (x, j) -> x ^ bits[j]))"
    )
    about = about.withColumn("bits", F.when(F.col("at") == F.col("level"), F.col("bits")).otherwise(fold))
    shares = F.least(F.lit(SHARES), F.ceil(F.col("nodes") / F.lit(SHARE))).cast("int")
    kept = ["around", "at", "share"]
    of_node = {c: f"{c}_o" for c in ("node", "label", "size", "level", "bits")}
    about = about.withColumn("shares", shares)
    rest = about.select(*kept[:2], F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"), "outside", *of_node)
    outs = about.where("outside").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    outs = outs.select(*kept, *of_node).withColumnsRenamed(of_node)
    total = F.col("size") + F.col("size_o")
    need = factor * total - 1e-9
    longer = F.aggregate(
        F.zip_with("bits", "bits_o", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d
    )
    differing = F.when(F.col("at") > 0, longer).otherwise(_first_differing("bits", "bits_o"))
    met = rest.join(outs, kept).where(
        (F.col("label") != F.col("label_o"))
        & (~F.col("outside") | (F.col("node") > F.col("node_o")))
        & (F.least("level", "level_o") == F.col("at"))
        & (F.least("size", "size_o") >= need)
        & F.coalesce(differing <= total - 2 * need, F.lit(True))
    )
    return met.select(
        F.col("node_o").alias("out"),
        F.least("node", "node_o").alias("a"),
        F.greatest("node", "node_o").alias("b"),
        F.coalesce(differing / total, F.lit(1.0)).alias("far"),
    )


def _still_apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components."""
    for end in "ab":
        known = labels.withColumnsRenamed({"node": end, "component": f"label_{end}"})
        pairs = pairs.join(known, end, "left")
    return pairs.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def _apart(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The members with their components, of the buckets that have more than one."""
    if labels is None:
        return members.withColumn("label", F.col("node"))
    known = labels.select("node", "component")
    labelled = members.join(known, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("label")
    )
    spread = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    spread = spread.where(F.col("lo") < F.col("hi")).select("bucket")
    return labelled.join(spread, "bucket")


def _pairs(rows: DataFrame, other, other_label, tested: DataFrame | None) -> DataFrame:
    pairs = (
        rows.where(F.col("label") != other_label)
        .select(F.least("node", other).alias("a"), F.greatest("node", other).alias("b"))
        .distinct()
    )
    return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")


def _add(pairs, similar, edges, tested, labels):
    pairs = written(pairs)
    if pairs.isEmpty() and labels is not None:
        return edges, tested, labels
    found = written(similar(pairs))
    edges = found if edges is None else edges.unionByName(found)
    tested = pairs if tested is None else tested.unionByName(pairs)
    # What is known stays joined: the old stars and the new edges.
    stars = found if labels is None else found.unionByName(
        labels.where(F.col("node") != F.col("component")).select(
            F.col("component").alias("a"), F.col("node").alias("b")
        )
    )
    joined = components(stars)
    # What was derived from the old labels is written by now.
    discard(labels)
    return edges, tested, joined
