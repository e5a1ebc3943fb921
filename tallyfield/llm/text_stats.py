"""Counts of whole texts, for the learned rules and the quality classifier."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import code_points, map_batches, mix, only

WINDOW = 8
COUNTS = [
    "n_chars",
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_letters",
    "n_upper",
    "n_digits",
    "n_marks",
    "n_distinct_words",
    "n_echo_words",
]
_SYMBOLS = b"#*$%&|<>"
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_PIECE = 1 << 22


def text_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: `key` and the counts of its whole text, all BIGINT.

    A NULL text has only zeros. A key that repeats gives a row each time. `n_marks` are
    ASCII punctuation marks that are not among the symbols, `n_echo_words` words equal to
    the one before.
    """
    rows = only(docs, key=key, text=text)
    schema = f"key {rows.schema['key'].dataType.simpleString()}, "
    return map_batches(rows, _stats_batch, schema + ", ".join(f"{c} bigint" for c in COUNTS))


def _stats_batch(batch: pa.RecordBatch) -> pa.Table:
    texts = batch.column("text").to_pylist()
    found = np.array([stats_of(t) for t in texts], dtype=np.int64).reshape(len(texts), len(COUNTS))
    columns = {"key": batch.column("key")}
    columns |= {name: pa.array(found[:, i]) for i, name in enumerate(COUNTS)}
    return pa.table(columns)


def stats_of(text: str | None) -> list[int]:
    """The counts of one text, in the order of COUNTS."""
    if not text:
        return [0] * len(COUNTS)
    kinds = np.zeros(8, dtype=np.int64)
    for start in range(0, len(text), _PIECE):  # bounds the memory a very long text needs
        kind = _kinds()[code_points(text[start : start + _PIECE])]
        kinds += np.bincount(kind, minlength=8)
    other, space, symbol, lower, upper, digit, mark, _ = kinds.tolist()
    words = _SPACE.split(text)
    if not words[0]:
        del words[0]
    if words and not words[-1]:
        del words[-1]
    lines, n_lines, n_dup = set(), 0, 0
    for line in text.split("\n"):
        if line and _SPACE.sub("", line):
            n_lines += 1
            n_dup += line in lines
            lines.add(line)
    return [
        len(text),
        len(words),
        len(text) - space,
        symbol,
        n_lines,
        n_dup,
        repeat_words(words),
        lower + upper,
        upper,
        digit,
        mark,
        len(set(words)),
        sum(map(str.__eq__, words[1:], words)),
    ]


def repeat_words(words: list[str]) -> int:
    """Words that lie in a window of eight words found at least twice.

    Windows are compared by hash, and those with equal hashes word by word.
    """
    if len(words) < WINDOW + 1:
        return 0
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).astype(np.uint64)
    n = len(words) - WINDOW + 1
    rolled = np.zeros(n, dtype=np.uint64)
    for i, factor in enumerate(mix(np.arange(WINDOW)) | np.uint64(1)):
        rolled += hashes[i : i + n] * factor
    order = np.argsort(rolled, kind="stable")
    equal = rolled[order[1:]] == rolled[order[:-1]]
    if not equal.any():
        return 0
    alike = np.zeros(n, dtype=bool)
    alike[order[1:][equal]] = True
    alike[order[:-1][equal]] = True
    seen: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(alike).tolist():
        seen.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for starts in seen.values():
        if len(starts) > 1:
            np.add.at(covered, starts, 1)
            np.add.at(covered, np.array(starts) + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


@functools.cache
def _kinds() -> np.ndarray:
    """Per code point: 0 other, 1 space, 2 symbol, 3 letter, 4 capital, 5 digit, 6 mark."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            kinds[i] = 4 if c.isupper() else 3
        elif c.isdigit():
            kinds[i] = 5
        elif i < 128 and c.isprintable() and c != " ":
            kinds[i] = 6
    kinds[list(_SPACES)] = 1
    kinds[list(_SYMBOLS)] = 2
    return kinds
