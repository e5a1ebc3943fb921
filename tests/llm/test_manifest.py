"""The dataset manifest against a plain Merkle tree, and its addresses against a recursive layout."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import manifest

from llm_cases import docs_of, odd_rows, prose  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(*fields):
    return _h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def _climb(row):
    """The root over a row of digests, and each digest's siblings, level by level."""
    paths = [[] for _ in row]
    groups = [[i] for i in range(len(row))]
    while len(row) > 1:
        for start in range(0, len(row), 16):
            run = row[start : start + 16]
            for at in range(len(run)):
                for i in groups[start + at]:
                    paths[i].append(("".join(run[:at]), "".join(run[at + 1 :])))
        groups = [sum(groups[i : i + 16], []) for i in range(0, len(row), 16)]
        row = [_h("".join(row[i : i + 16])) for i in range(0, len(row), 16)]
    return row[0], paths


def _plain(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of (doc_id, text, lang, source, n_chars)."""
    by_source = {}
    for doc_id, text, lang, source, n_chars in rows:
        node = _leaf(doc_id, source, lang, n_chars, text)
        shown = node
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            shown = _leaf(doc_id, source, lang, n_chars, text and text.translate(LOWER))
        by_source.setdefault(source, []).append((doc_id is not None, doc_id or 0, node, doc_id, shown))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by_source[s]) for s in sources}
    subs = {s: _climb([leaf[2] for leaf in trees[s]]) for s in sources}
    root, over = _climb([subs[s][0] for s in sources])
    out = []
    for place, s in enumerate(sources):
        for leaf, path in zip(trees[s], subs[s][1]):
            whole, node = path + over[place], leaf[4]
            for left, right in whole:
                node = _h(left + node + right)
            proof = _h("".join(a + b for a, b in whole))
            out.append((leaf[3], leaf[2], subs[s][0], root, proof, node, node == root))
    return sorted(out, key=str)


def _recursive(levels, depth, index):
    """All nodes of a subtree in van Emde Boas order, as (depth, index)."""
    if levels == 1:
        return [(depth, index)]
    upper = levels // 2
    nodes = _recursive(upper, depth, index)
    for i in range(16**upper):
        nodes += _recursive(levels - upper, depth + upper, index * 16**upper + i)
    return nodes


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_are_those_of_the_recursive_layout(levels):
    order = {node: at for at, node in enumerate(_recursive(levels, 0, 0))}
    assert len(order) == manifest.complete(levels)
    for depth in range(levels):
        index = np.arange(16**depth, dtype=np.int64)
        got = manifest.address(levels, depth, index).tolist()
        assert got == [order[depth, i] for i in range(16**depth)]


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 257, 4096])
def test_a_block_gives_back_its_nodes_and_siblings(n):
    leaves = [_h(str(i)) for i in range(n)]
    levels = manifest.height(n) + 1
    nodes = manifest.lay_out(leaves, levels)
    root, paths = _climb(leaves)
    assert nodes[0].tobytes().hex() == root
    assert manifest.read_level(nodes, levels, levels - 1, n) == leaves
    assert manifest.sibling_paths(nodes, levels, n) == paths


def _audited(docs):
    return sorted((tuple(r) for r in manifest.audit_documents(docs).collect()), key=str)


def test_odd_rows_against_a_plain_tree(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    rows = [tuple(r) for r in docs.collect()]
    assert _audited(docs) == _plain(rows)
    # One source is NULL, one empty; a column's name clashes with one of the operator's.
    odd = docs.withColumn("source", F.when(F.col("doc_id") > 6, None).when(F.col("doc_id") > 4, "").otherwise("é"))
    rows = [tuple(r) for r in odd.collect()]
    assert _audited(odd.withColumns({"tree": F.lit(1), "pos": F.lit(2), "leaf": F.lit("x"), "a`b": F.lit(0)})) == _plain(rows)


def test_no_rows_and_one_row(docs_of):
    assert _audited(docs_of([])) == []
    one = docs_of([(5, "Some Text")])
    [row] = _audited(one)
    assert row[1] == row[2] == row[3] and row[4] == _h("")
    assert [row] == _plain([tuple(r) for r in one.collect()])


def test_a_tree_of_several_blocks(spark):
    rng = random.Random(3)
    rows = [(i, f"Text {rng.random()}", None, "big" if i % 9 else f"s{i % 40}", 1) for i in range(9_500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert len(manifest.manifest(docs.select(
        F.concat(F.lit("="), "source").alias("tree"), F.col("doc_id").alias("key"), F.sha2("text", 256).alias("leaf")
    )).levels) == 2
    assert _audited(docs) == _plain(rows)
    verified = {r[0]: r[6] for r in _audited(docs)}
    assert not all(verified.values()) and sum(verified.values()) > 7_000
