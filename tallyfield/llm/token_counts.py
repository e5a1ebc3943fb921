"""Token counts of whole texts by a two-tier lookup of pre-token lengths, without a shuffle of them.

A text is cut ahead of every run of blanks and every line feed. No piece of the vocabulary lies
across such a place, so the tokens of a text are those of its pre-tokens added up. The lengths
of frequent pre-tokens are broadcast as one compact table; a worker encodes any other
pre-token when it first meets it and remembers its length in a cache of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, ship_package, written

LIMIT = 4096
# Pre-tokens that are at least one in SHARE of all are broadcast: at most SHARE of them.
SHARE = 32_768
# Counters a task keeps while it looks for them, and characters of the longest one looked at.
COUNTERS = 8 * SHARE
LONGEST = 64
# Pre-tokens a worker remembers beyond those that were broadcast.
CACHE = 400_000

_PRE_TOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*")
_SPACE = "▁"


def pre_tokens(text: str) -> list[str]:
    """The pieces a text is cut into; each begins with the blanks or the line feed ahead of it."""
    return _PRE_TOKEN.findall(" " + text.replace(_SPACE, " ")) if text else []


class Encoder:
    """A sentencepiece model, and how many tokens it makes of one pre-token.

    Refuses models whose pieces may lie across a cut, or that change texts before they
    encode them.
    """

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_proto=model)
        for i in range(self.processor.get_piece_size()):
            piece = self.processor.id_to_piece(i)
            crosses = _SPACE in piece.lstrip(_SPACE) or (len(piece) > 1 and "\n" in piece)
            if crosses and not self.processor.is_control(i):
                raise ValueError(f"piece {piece!r} lies across a blank or a line feed")
        probe = " ａ①  x\t\r \n"
        if self.processor.normalize(probe) != (" " + probe).replace(" ", _SPACE):
            raise ValueError("this model changes texts before it encodes them")

    def length(self, pre_token: str) -> int:
        if pre_token == " ":
            return 1
        # The library puts a blank ahead of a text: a token by itself ahead of a line feed.
        if pre_token[0] == " ":
            return len(self.processor.encode(pre_token[1:]))
        return len(self.processor.encode(pre_token)) - 1


class Lengths(dict):
    """Lengths by pre-token: the broadcast ones, and those a worker encoded itself.

    With `cache` of the latter it forgets them and starts again. Long ones are not kept.
    """

    def __init__(self, frequent: dict[str, int], encoder: Encoder, cache: int) -> None:
        super().__init__(frequent)
        self.frequent, self.encoder, self.room = frequent, encoder, len(frequent) + cache

    def __missing__(self, pre_token: str) -> int:
        length = self.encoder.length(pre_token)
        if len(pre_token) <= LONGEST:
            if len(self) >= self.room:
                self.clear()
                self.update(self.frequent)
            self[pre_token] = length
        return length


def pack_table(lengths: dict[str, int]) -> tuple[bytes, bytes, bytes]:
    """The table as three byte strings: the pre-tokens one after the other, the bytes of each,
    and the tokens of each."""
    encoded = [p.encode() for p in lengths]
    sizes = np.array([len(e) for e in encoded], dtype=np.uint16)
    return b"".join(encoded), sizes.tobytes(), np.array(list(lengths.values()), dtype=np.uint16).tobytes()


def unpack_table(packed: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    text, sizes, lengths = packed[0], np.frombuffer(packed[1], np.uint16), np.frombuffer(packed[2], np.uint16)
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    return {text[a:b].decode(): n for a, b, n in zip(starts.tolist(), ends.tolist(), lengths.tolist())}


def frequent_pre_tokens(texts: DataFrame, share: int = SHARE) -> DataFrame:
    """`pre_token`, `n` of those that are about one in `share` of all, at most 2 * share of them.

    `texts` has a column `text`. Every task counts all its pre-tokens with a bounded number of counters
    (when there are twice as many, all are lowered by the count of the one that is just too
    many) and reports those that may be one in 2 * share of its own. So only summaries, at
    most 2 * share rows a task, are shuffled, and what makes up one in `share` of all is found.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = Counter(), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    found = pre_tokens(text)
                    total += len(found)
                    counts.update(p for p in found if len(p) <= LONGEST)
                if len(counts) > 2 * COUNTERS:
                    counts = _lowered(counts)
        least = total / (2 * share)
        kept = ((p, n) for p, n in counts.items() if n >= least)
        while part := list(islice(kept, 10_000)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())],
                names=["pre_token", "n"],
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.string()), pa.array([total], pa.int64())], names=["pre_token", "n"]
        )

    ship_package(texts.sparkSession)
    found = texts.select("text").mapInArrow(count, "pre_token string, n bigint")
    sums = written(found.groupBy("pre_token").agg(F.sum("n").alias("n")))
    total = sums.where(F.col("pre_token").isNull()).agg(F.sum("n")).first()[0] or 0
    return sums.where(F.col("pre_token").isNotNull() & (F.col("n") * (2 * share) >= total))


def _lowered(counts: Counter) -> Counter:
    cut = sorted(counts.values(), reverse=True)[COUNTERS]
    return Counter({p: n - cut for p, n in counts.items() if n > cut})


@lru_cache(maxsize=2)
def _worker_lengths(model: bytes, packed: tuple[bytes, bytes, bytes], cache: int) -> Lengths:
    """A worker's lengths, kept from one task to the next."""
    return Lengths(unpack_table(packed), Encoder(model), cache)


def count_tokens(
    docs: DataFrame,
    model_file: str,
    key: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
    share: int = SHARE,
    cache: int = CACHE,
) -> DataFrame:
    """`doc_id`, `n_bytes` (UTF-8), `n_tokens`, `over_limit` of every row of `docs`.

    Tokens are those the sentencepiece model gives for the whole text, no begin or end added,
    special strings being ordinary text. A NULL text counts as empty: 0 bytes, 0 tokens.
    Rows that repeat, and rows with a NULL key, are counted each by itself. Other columns of
    `docs` count for nothing, whatever their names. The table's bound is `share`: at most twice
    as many entries of at most 64 characters; which ones it holds changes no result.
    """
    spark = docs.sparkSession
    model = Path(model_file).read_bytes()
    encoder = Encoder(model)
    texts = only(docs, key=key, text=text)
    found = frequent_pre_tokens(texts, share).select("pre_token").toLocalIterator()
    frequent = {p: encoder.length(p) for (p,) in found}
    shared = spark.sparkContext.broadcast((model, pack_table(frequent)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, packed = shared.value
        length = _worker_lengths(given, packed, cache).__getitem__
        for batch in batches:
            n = [sum(map(length, pre_tokens(t))) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                names=["key", "n_bytes", "n_tokens"],
            )

    ready = texts.select("key", _bytes(F.col("text")).alias("n_bytes"), "text")
    counted = ready.mapInArrow(count, f"key {dict(texts.dtypes)['key']}, n_bytes bigint, n_tokens bigint")
    return counted.select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def _bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
