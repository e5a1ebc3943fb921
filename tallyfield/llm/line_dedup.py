"""Fuzzy deduplication of lines by MinHash, with DataFrame functions alone.

A line is compared in a form of its own, as the set of its runs of eight characters: the query
and the pipeline compare lower-case characters without white space and ASCII punctuation
(`normal`), and a shorter form is one run. Equal forms are one node; the text that stays is the original. A signature holds, for
each of 24 multiply-add hashes, the smallest of a run; eight bands of three are buckets.
Candidates whose signatures agree enough are verified by their exact Jaccard similarity;
union-find joins what is similar, and of each component one line stays in the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import broadcast_if_small, column_named

from .common import mix, only, settled, sifted_join, written
from .graph import link, shared_buckets

RUN = 8
SIMILARITY = 0.8
# At similarity 0.8 a pair shares no band with probability (1 - 0.8 ** ROWS) ** BANDS = 0.3 %.
BANDS, ROWS = 8, 3
HASHES = BANDS * ROWS
# Of 24 signature places, a pair of similarity 0.8 that shares a band agrees in fewer than 12
# with probability 0.0002 at most (simulated, lines of 5 to 300 runs).
AGREE = 12
# Places are hashed within so many bits: a product of two such numbers is a BIGINT.
_BITS = 2**31 - 1
BLANKS = " \t\r\x0b\x0c"
DROPPED = BLANKS + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Runs that one generated row hashes: fewer rows to make and to group.
STEP = 4
MAX_BROADCAST_BYTES = 32 * 1024 * 1024


def trimmed(line: Column) -> Column:
    """A line without blanks at its ends."""
    return F.trim(line)


def normal(line: Column) -> Column:
    """The lower-case characters of a line without white space and ASCII punctuation.

    A line of such punctuation alone is compared as it is, without white space.
    """
    # Patterns, not `translate`, which looks up each character as a string of its own.
    plain = F.regexp_replace(F.lower(line), F.lit(f"[{_escaped(DROPPED)}]+"), F.lit(""))
    unblanked = F.regexp_replace(line, F.lit(f"[{_escaped(BLANKS)}]+"), F.lit(""))
    return F.when(F.regexp_like(line, F.lit(f"[^{_escaped(DROPPED)}]")), plain).otherwise(unblanked)


def _escaped(characters: str) -> str:
    """Characters as they stand between brackets in a pattern."""
    return "".join(f"\\x{ord(c):02x}" for c in characters)


Form = Callable[[Column], Column]


def dedup_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    form: Form = trimmed,
    shortest: int = RUN,
) -> DataFrame:
    """All columns of `docs`, with the text that is left, and `n_lines`, `n_removed`.

    Of all lines of a component, in all documents, the one in the document of smallest key
    stays, there the first one. Lines are compared in the given form; those with fewer
    than `shortest` characters in it are not compared and stay. A form of fewer than eight
    characters is one run: it is like its copies alone. Lines are what line feeds separate. Keys are integers. Rows that
    repeat key and text are one document: they keep the same lines. A NULL key comes after
    all others. A NULL text stays NULL, with 0 lines. The two new columns replace columns
    of the same name.
    """
    found = _deduplicated(docs, key, text, similarity, form, shortest)
    return found.select(
        *[
            (F.col("kept") if c == text else F.col("row").getField(c)).alias(c)
            for c in docs.columns
            if c not in ("n_lines", "n_removed")
        ],
        "n_lines",
        "n_removed",
    )


def dedup_stage(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the lines that are left; those that lost every line they had go."""
    found = _deduplicated(docs, key, text, SIMILARITY, normal, 1)
    something = F.regexp_instr("kept", F.lit(r"\S")) > 0
    stays = (F.col("n_removed") == 0) | something
    return found.where(stays).select(
        *[(F.col("kept") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns]
    )


def _deduplicated(
    docs: DataFrame, key: str, text: str, similarity: float, form: Form, shortest: int
) -> DataFrame:
    """`row`, a document as it was, `kept`, the text that is left, `n_lines` and `n_removed`."""
    rows = only(docs, key=key, text=text).withColumn("text_hash", F.xxhash64("text"))
    removed = settled(lambda: removed_lines(rows, similarity, form, shortest))
    # The input row is one column, so that its columns may have any names, and the only one
    # that carries the text through the join.
    ready = docs.select(
        F.struct(*[column_named(c) for c in docs.columns]).alias("row"),
        column_named(key).alias("of_key"),
        F.xxhash64(column_named(text)).alias("of_hash"),
    )
    gone = broadcast_if_small(removed.withColumnRenamed("gone", "_gone"), MAX_BROADCAST_BYTES)
    same = F.col("of_key").eqNullSafe(F.col("key")) & (F.col("of_hash") == F.col("text_hash"))
    whole = F.col("row").getField(text)
    left = F.filter(F.split(whole, "\n"), lambda _, i: ~F.array_contains("_gone", i))
    kept = F.when(F.col("_gone").isNull(), whole).otherwise(F.array_join(left, "\n"))
    n_lines = F.coalesce(F.size(F.split(whole, "\n")), F.lit(0))
    return ready.join(gone, same, "left").select(
        "row",
        kept.alias("kept"),
        F.when(whole.isNull(), 0).otherwise(n_lines).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def removed_lines(
    rows: DataFrame, similarity: float = SIMILARITY, form: Form = trimmed, shortest: int = RUN
) -> DataFrame:
    """`key`, `text_hash` and `gone`, the numbers (from 0) of the lines that go."""
    nodes = written(_nodes(_lines(rows, form, shortest)))
    members = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = shared_buckets(members)
    texts = _texts(_lines(rows, form, shortest), nodes, shared)
    labels = link(
        shared,
        lambda pairs: _similar(pairs, nodes, texts, similarity),
        lambda some: _elements(texts.join(some.distinct(), "node")),
        similarity,
        parts=2,
    )
    labelled = nodes.join(labels, "node", "left").select(
        "i1", "i2", "first_key", "copies", F.coalesce("component", "node").alias("class")
    )
    classes = labelled.groupBy("class").agg(
        F.min("first_key").alias("first_key"), F.sum("copies").alias("lines")
    )
    several = classes.where(F.col("lines") > 1).select("class", "first_key")
    affected = written(
        labelled.select("i1", "i2", "class").join(several, "class")
    )
    lines = _lines(rows, form, shortest, F.posexplode).drop("line")
    found = sifted_join(lines, affected, ["i1", "i2"], MAX_BROADCAST_BYTES)
    found = written(found.select("key", "text_hash", "at", "class", "first_key"))
    in_first = found.where(F.col("key").eqNullSafe(F.col("first_key")))
    keeper = in_first.groupBy("class").agg(F.min(F.struct("at", "text_hash")).alias("keeper"))
    # At most one line a class is kept, in the document of the smallest key.
    goes = ~(
        F.col("key").eqNullSafe(F.col("first_key"))
        & (F.col("at") == F.col("keeper.at"))
        & (F.col("text_hash") == F.col("keeper.text_hash"))
    )
    return (
        found.join(keeper, "class")
        .where(goes)
        .groupBy("key", "text_hash")
        .agg(F.collect_set("at").alias("gone"))
    )


def _lines(rows: DataFrame, form: Form, shortest: int, explode=F.explode) -> DataFrame:
    """The lines that are compared, in their form, with the two halves of its 128-bit hash.

    (i1, i2) stands for the form from here on.
    """
    # Within the array a form is worked out once a line; as a column it would be once for the
    # test of its length and once for each use.
    forms = explode(F.transform(F.split("text", "\n"), form))
    forms = forms.alias("line") if explode is F.explode else forms.alias("at", "line")
    lines = rows.select("key", "text_hash", forms)
    names = [c for c in lines.columns if c != "line"]
    lines = lines.where(F.char_length("line") >= max(1, shortest))
    return lines.select(
        *names, "line", F.xxhash64("line").alias("i1"), F.xxhash64(F.lit(RUN), "line").alias("i2")
    )


def _nodes(lines: DataFrame) -> DataFrame:
    """A row per different line: number, hash, smallest key, copies, buckets and sketch.

    Each generated row hashes STEP runs that follow each other, and takes the last run of
    the line for those that would lie beyond its end. Fixed-width characters make a run's
    place a multiplication; all of it runs in generated code, with no lambda.
    """
    width = 4 * RUN
    lines = lines.select(
        "key", "i1", "i2", F.encode("line", "UTF-32").alias("b")
    ).withColumn("last", F.greatest(F.octet_length("b") - (width - 1), F.lit(1)))
    runs = lines.select(
        "key", "i1", "i2", "b", "last", F.explode(F.expr(f"sequence(1, last, {4 * STEP})")).alias("p")
    )
    hashed = runs.select(
        "key",
        "i1",
        "i2",
        (F.col("p") == 1).cast("bigint").alias("starts"),
        *[
            F.expr(f"xxhash64(substring(b, least(p + {4 * i}, last), {width})) & {_BITS}L").alias(f"h{i}")
            for i in range(STEP)
        ],
    )
    least = [
        F.min(
            F.least(*[(F.col(f"h{i}") * F.lit(by) + F.lit(plus)).bitwiseAND(F.lit(_BITS)) for i in range(STEP)])
        ).alias(f"m{j}")
        for j, (by, plus) in enumerate(_places())
    ]
    signed = hashed.groupBy("i1", "i2").agg(
        F.min("key").cast("bigint").alias("first_key"), F.sum("starts").alias("copies"), *least
    )
    buckets = [
        F.xxhash64(F.lit(band), *[F.col(f"m{band * ROWS + i}") for i in range(ROWS)]) for band in range(BANDS)
    ]
    # The low byte of each place, eight to a number; one in 256 agrees by chance.
    sketch = []
    for start in range(0, HASHES, 8):
        parts = [
            F.shiftleft(F.col(f"m{j}").bitwiseAND(F.lit(0xFF)), 8 * (j - start))
            for j in range(start, min(start + 8, HASHES))
        ]
        packed = parts[0]
        for part in parts[1:]:
            packed = packed.bitwiseOR(part)
        sketch.append(packed.alias(f"s{start // 8}"))
    return signed.select(
        F.monotonically_increasing_id().alias("node"),
        "i1",
        "i2",
        "first_key",
        "copies",
        F.array(*buckets).alias("buckets"),
        *sketch,
    )


def _places() -> list[tuple[int, int]]:
    """Fixed pseudo-random factors (odd) and summands, one pair a place of the signature.

    Each orders the hashes in its own way. XOR with masks would not: which run can be the
    smallest then hangs on the same binary tree of hashes for every mask, and lines of few
    runs agree far less evenly than their similarity says.
    """
    drawn = mix(np.arange(2 * HASHES, dtype=np.uint64), seed=13) >> np.uint64(33)
    return [(int(drawn[2 * j]) | 1, int(drawn[2 * j + 1])) for j in range(HASHES)]


def _texts(lines: DataFrame, nodes: DataFrame, shared: DataFrame) -> DataFrame:
    wanted = nodes.join(shared.select("node").distinct(), "node").select("i1", "i2", "node")
    found = sifted_join(lines, written(wanted), ["i1", "i2"], MAX_BROADCAST_BYTES)
    # By the keys of the join, so that a line is shuffled once; they stand for the node.
    return written(found.groupBy("i1", "i2").agg(F.first("node").alias("node"), F.first("line").alias("line")).drop("i1", "i2"))


def _similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    sketches = [f"s{i}" for i in range(-(-HASHES // 8))]
    known = nodes.select("node", *sketches)
    near = pairs
    for end in "ab":
        side = known.withColumnsRenamed({"node": end} | {s: f"{s}_{end}" for s in sketches})
        near = near.join(side, end)
    agree = F.lit(0)
    for j in range(HASHES):
        differs = F.col(f"s{j // 8}_a").bitwiseXOR(F.col(f"s{j // 8}_b"))
        agree = agree + F.when(
            F.shiftrightunsigned(differs, 8 * (j % 8)).bitwiseAND(F.lit(0xFF)) == 0, 1
        ).otherwise(0)
    near = written(near.where(agree >= AGREE).select("a", "b"))
    both = near.join(texts.withColumnsRenamed({"node": "a", "line": "of_a"}), "a").join(
        texts.withColumnsRenamed({"node": "b", "line": "of_b"}), "b"
    )
    return both.where(_jaccard(F.col("of_a"), F.col("of_b")) >= similarity - 1e-12).select("a", "b")


def _runs(line: Column) -> Column:
    runs = F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{RUN}}}))"), 1)
    return F.when(F.char_length(line) < RUN, F.array(line)).otherwise(runs)


def _elements(lines: DataFrame) -> DataFrame:
    runs = F.array_distinct(_runs(F.col("line")))
    return lines.select("node", F.transform(runs, lambda run: F.xxhash64(run)).alias("elements"))


def _jaccard(a: Column, b: Column) -> Column:
    runs = [_runs(a), _runs(b)]
    # In a lambda the two lists are made once and used twice.
    sizes = F.transform(
        F.array(F.struct(runs[0].alias("a"), runs[1].alias("b"))),
        lambda x: F.size(F.array_intersect(x["a"], x["b"])) / F.size(F.array_union(x["a"], x["b"])),
    )
    return F.element_at(sizes, 1)
