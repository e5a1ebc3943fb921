"""Packing of token ids into sequences of a fixed length, best fit decreasing.

Every text is turned into ids once. A text longer than a window is cut into full windows
and a rest; full windows are sequences already. The rests are dealt into shares of bounded
size; in each share they are taken from the longest to the shortest, each into the open
sequence with the least room that is still enough, which a segment tree over the room
finds.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_batches, only, ship_package, written

WINDOW = 2048
END_ID = 1
# Rests that one task packs together: bounds its memory, and is far more than good packing needs.
SHARE = 50_000
# Distinct words a Python worker remembers the ids of.
_REMEMBERED = 800_000


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: `key`, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`,
    `offset` and `sequence_tokens` (the ids of the whole sequence).

    `tokenizer` is a file of the `tokenizers` library that every worker can read. Each row
    of `docs` is a document, also one that repeats; it ends with `end_id`, and an empty or
    NULL text is that id alone. Sequence ids are unique, not dense. The pieces (no text, no
    ids) are written once, so that a lost executor cannot deal them out differently.
    """
    rows = only(docs, key=key, text=text)
    kind = rows.schema["key"].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> pa.Table:
        encode = word_encoder(tokenizer)
        found = [
            (i, *piece)
            for i, value in enumerate(batch.column("text").to_pylist())
            for piece in pieces_of(encode(value or ""), window, end_id)
        ]
        table = np.array(found, dtype=np.int64).reshape(-1, 5)
        columns = {"key": batch.column("key").take(pa.array(table[:, 0]))}
        names = ["start", "length", "ids_crc32", "doc_tokens"]
        columns |= {name: pa.array(table[:, i]) for i, name in enumerate(names, 1)}
        return pa.table(columns)

    columns = f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    pieces = written(map_batches(rows, cut, columns))
    shares = max(1, -(-pieces.where(F.col("length") < window).count() // SHARE))
    dealt = checkpointed(pieces.where(F.col("length") < window).repartition(shares))
    packed = _pack_partitions(dealt, columns, window)
    full = pieces.where(F.col("length") == window).withColumns(
        {
            # Even numbers for full windows, odd ones for packed sequences.
            "sequence_id": F.monotonically_increasing_id() * 2,
            "offset": F.lit(0).cast("bigint"),
            "sequence_tokens": F.lit(window).cast("bigint"),
        }
    )
    done = packed.unionByName(full)
    return done.withColumnRenamed("key", key)


def _pack_partitions(pieces: DataFrame, columns: str, window: int) -> DataFrame:
    numbered = pieces.withColumn("share", F.spark_partition_id().cast("bigint"))

    def pack_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        share = pa.Table.from_batches(parts).combine_chunks()
        # The same order whatever order the rows came in; equal rows are interchangeable.
        names = ["key", "start", "ids_crc32", "doc_tokens"]
        share = share.sort_by([("length", "descending"), *[(n, "ascending") for n in names]])
        sequence, offset, total = best_fit(share["length"].to_numpy(), window)
        at = share["share"].to_numpy()
        share = share.drop_columns(["share"])
        share = share.append_column("sequence_id", pa.array(((at << 32) + sequence) * 2 + 1))
        share = share.append_column("offset", pa.array(offset))
        share = share.append_column("sequence_tokens", pa.array(total[sequence]))
        yield from share.to_batches(max_chunksize=10_000)

    ship_package(pieces.sparkSession)
    return numbered.mapInArrow(
        pack_share, f"{columns}, sequence_id bigint, offset bigint, sequence_tokens bigint"
    )


def pieces_of(ids: bytes, window: int, end_id: int) -> list[tuple[int, int, int, int]]:
    """Start, length, checksum and document length of each window of a document."""
    ids += end_id.to_bytes(4, "little")
    n = len(ids) // 4
    return [
        (start, min(window, n - start), zlib.crc32(ids[4 * start : 4 * (start + window)]), n)
        for start in range(0, n, window)
    ]


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each length (descending), and the fill of each sequence.

    Leaf r of the tree stands for a room of r and holds the open sequences that have it;
    a node knows whether any leaf below it holds one. The tightest fit for a length is the
    leftmost such leaf from `length` on. O(log window) a piece.
    """
    size = 1 << window.bit_length()
    tree = bytearray(2 * size)
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    fill: list[int] = []
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        room = _tightest(tree, size, length)
        if room < 0:
            at = len(fill)
            fill.append(0)
            room = window
        else:
            at = open_at[room].pop()
            if not open_at[room]:
                _mark(tree, size + room, 0)
        sequence[i], offset[i] = at, fill[at]
        fill[at] += length
        left = room - length
        if left:
            if not open_at[left]:
                _mark(tree, size + left, 1)
            open_at[left].append(at)
    return sequence, offset, np.array(fill, dtype=np.int64)


def _mark(tree: bytearray, node: int, value: int) -> None:
    tree[node] = value
    while node > 1:
        node >>= 1
        value = tree[2 * node] | tree[2 * node + 1]
        if tree[node] == value:
            return
        tree[node] = value


def _tightest(tree: bytearray, size: int, least: int) -> int:
    """The smallest room of at least `least` that some open sequence has, or -1."""
    node = size + least
    while not tree[node]:
        # Up until a right sibling exists that holds something, then down its left edge.
        while node & 1:
            node >>= 1
        if node <= 1:
            return -1
        node += 1
    while node < size:
        node *= 2
        if not tree[node]:
            node += 1
    return node - size


# ---------------------------------------------------------------------------------------
# Ids of texts
# ---------------------------------------------------------------------------------------

# How the tokenizer file cuts lower-cased text into words.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Words of these characters are left as they are by NFC and have one small form each.
_PLAIN = re.compile(r"[!-~¡-¬®-ÿ]+").fullmatch
# Python parts words at these; the tokenizer does not.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")


class _Parts(dict):
    """Ids of lower-case runs of letters, of digits and of other characters."""

    def __init__(self, tokenize) -> None:
        self.tokenize = tokenize
        self.letters = str.maketrans(_byte_letters())

    def __missing__(self, part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        ids = self[part] = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
        return ids


class _Words(dict):
    """Ids of words, as little-endian bytes; learns the words it has not met."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(_SPLIT).findall
        self.parts = _Parts(self.tokenizer.model.tokenize)

    def __missing__(self, word: str) -> bytes:
        last = word[-1]
        if _PLAIN(word) is None:
            ids = self.whole(word)
        elif word.isalpha():
            ids = self.parts[word.lower()]
        elif last in ".," and word[:-1].isalpha():  # the most common other form
            ids = self.parts[word[:-1].lower()] + self.parts[last]
        else:
            ids = b"".join([self.parts[p] for p in self.split(word.lower())])
        self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        # The library looks for added tokens, such as <|endoftext|>, in whole texts, also
        # across what is cut here.
        plain = text.lower()
        if _SEPARATORS.search(text) or any(token in plain for token in self.added):
            return self.whole(text)
        if len(self) > _REMEMBERED or len(self.parts) > _REMEMBERED:
            self.clear()
            self.parts.clear()
        return b"".join(map(self.__getitem__, text.split()))


@functools.lru_cache(maxsize=4)
def word_encoder(path: str):
    """Text to ids, the same as the tokenizer's own, but remembering words.

    The tokenizer drops white space and works on what lies between it alone, so a text's
    ids are those of its words one after the other. That holds for files of this kind
    (lower case, NFC, white space removed, BPE with word ends); any other file, any word
    beyond Latin-1, and any text with an added token in it, goes through the library whole.
    """
    import json

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    cutter = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    known = (
        [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        == ["NFC", "Replace", "Lowercase"]
        and cutter[0].get("pattern") == {"Regex": _SPLIT}
        and cutter[-1].get("type") == "ByteLevel"
    )
    words = _Words(path)
    return words.encode if known else words.whole


def _byte_letters() -> dict[str, str]:
    """Byte-level BPE writes each byte as a letter: printable Latin-1 as itself, others from U+0100 on."""
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in itself]
    return {chr(b): chr(256 + i) for i, b in enumerate(others)}
