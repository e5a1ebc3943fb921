"""Phrase collocations from the weighted de Bruijn graph of the words of a corpus.

Nodes are phrases of four words and edges phrases of five, which lead from the node of their
first four words to that of their last four. Only edges are counted in texts: one window of
five words from every word on, and where a piece of text ends sooner, a window of what is
left (the correction for piece ends). The flow through a node is the weight of its edges and
of the windows that end there; the flow through a phrase of three words is that of the nodes
it begins, and so on down to single words. A node all of whose flow comes from one edge, or
goes to one, lies on an unary path and is compacted into that edge; what is left is scored.

Before that, a pass over the texts counts words and pairs of neighbours by hash, in a table of
fixed size, and another one three words in a row, of those whose pairs may be frequent. A hash
that stays below the least count rules out its words, pairs or threes: windows are cut there,
and what cannot become a phrase is not shuffled. The tables are upper bounds, so nothing else
is lost; the larger the corpus, the less they rule out. The first one also tells pairs that
hold a large share of all windows: these are dealt out by their third word as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions import broadcast_if_small
from tallyfield.functions.text import column_named

from .common import mix, ship_package, written

LONGEST = 5
LEAST = 100
TOP = 2000
# Slots of a table, 2 ** SLOT_BITS: a bit each when broadcast, 16 MB.
SLOT_BITS = 27
# Pairs in a slot with at least one in SPREAD of all words are dealt out by three words: at
# most 2 * SPREAD slots.
SPREAD = 2000
# Bytes of text that are cut into words at once: bounds a worker's memory, at about fifty times this.
CHUNK = 2 * 1024 * 1024
UNKNOWN = "und"
PIECE_END, BETWEEN = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
# Windows a task holds back to add up equal ones of several chunks.
HELD = 400_000
# Ranks are cut in so many shares of a language first.
SHARES = 64


# --- words of a chunk ----------------------------------------------------------------------


class Words:
    """The words of some texts in a row, as numbers, with their hashes.

    `word` is the place of each word in `names`, `tag` that of its language in `langs`, and
    `piece` the number of its piece.
    """

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        pieces = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=PIECE_END)
        cut = pc.split_pattern_regex(pieces.flatten(), pattern=BETWEEN)
        words = cut.flatten()
        kept = np.flatnonzero(pc.not_equal(words, "").to_numpy(zero_copy_only=False))
        piece = pc.list_parent_indices(cut).to_numpy(zero_copy_only=False)[kept]
        row = pc.list_parent_indices(pieces).to_numpy(zero_copy_only=False)[piece]
        coded = words.take(pa.array(kept)).dictionary_encode()
        tags = pc.fill_null(langs, UNKNOWN).dictionary_encode()
        self.names, self.langs, self.piece = coded.dictionary, tags.dictionary, piece
        self.word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.tag = tags.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        self._hash, self._salt = _hashes(self.names), _hashes(self.langs)

    def __len__(self) -> int:
        return len(self.word)

    def follows(self) -> np.ndarray:
        """Whether the next word is in the same piece."""
        return np.append(self.piece[1:] == self.piece[:-1], False) if len(self) else np.zeros(0, dtype=bool)

    def hashed(self, tag: np.ndarray, *words: np.ndarray) -> np.ndarray:
        """A 64-bit hash of a language and one or more words in a row."""
        total = self._salt[tag]
        for word in words:
            total = mix(total ^ self._hash[word], seed=len(words))
        return total

    def in_a_row(self, first: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n words from each of these places on."""
        return self.hashed(self.tag[first], *[self.word[first + i] for i in range(n)])


def _hashes(names: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(names.to_pylist(), dtype=object), categorize=False)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        langs, texts = batch.column("lang"), batch.column("text")
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(texts):
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + CHUNK, side="right")))
            yield Words(langs.slice(start, end - start), texts.slice(start, end - start))
            pa.default_memory_pool().release_unused()
            start = end


# --- the table -----------------------------------------------------------------------------


def slot_counts(texts: DataFrame) -> DataFrame:
    """`slot`, `lang`, `n`: words and pairs by slot (`lang` NULL), and the words of each
    language (`slot` NULL). `texts` has `lang`, `text`. Written."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _chunks(batches):
            pairs = np.flatnonzero(words.follows())
            tag, word = words.tag, words.word
            both = np.concatenate(
                [_slots(words.hashed(tag, word)), _slots(words.hashed(tag[pairs], word[pairs], word[pairs + 1]))]
            )
            slots, n = np.unique(both, return_counts=True)
            yield _counted(pa.array(slots, pa.int64()), pa.nulls(len(slots), pa.string()), n)
            tags, n = np.unique(tag, return_counts=True)
            yield _counted(pa.nulls(len(tags), pa.int64()), words.langs.take(pa.array(tags)), n)

    ship_package(texts.sparkSession)
    found = texts.mapInArrow(count, "slot bigint, lang string, n bigint")
    return written(found.groupBy("slot", "lang").agg(F.sum("n").alias("n")))


def triple_counts(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """`slot`, `n` of three words in a row whose pairs are possible by the table."""
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _chunks(batches):
            first = _triples(_going_on(words, shared.value))
            slots, n = np.unique(_slots(words.in_a_row(first, 3)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(n, pa.int64())], names=["slot", "n"])

    ship_package(texts.sparkSession)
    return texts.mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))


def _going_on(words: Words, table: np.ndarray) -> np.ndarray:
    """Whether a window may go on from a word to the next."""
    able = _is_set(table, _slots(words.hashed(words.tag, words.word)))
    goes_on = words.follows()
    pairs = np.flatnonzero(goes_on)
    goes_on[pairs] = able[pairs] & able[pairs + 1] & _is_set(table, _slots(words.in_a_row(pairs, 2)))
    return goes_on


def _triples(goes_on: np.ndarray) -> np.ndarray:
    """Where three words in a row begin."""
    return np.flatnonzero(goes_on[:-1] & goes_on[1:])


def _counted(slots: pa.Array, langs: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([slots, langs, pa.array(n, pa.int64())], names=["slot", "lang", "n"])


def possible(slots: DataFrame, least: int) -> np.ndarray:
    """The slots with at least `least`, as bits: 2 ** SLOT_BITS / 8 bytes at most, whatever the corpus."""
    place = F.col("slot") + 1
    found = (
        slots.where(F.col("slot").isNotNull() & (F.col("n") >= least))
        .groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    )
    table = np.zeros(1 << (SLOT_BITS - 3), dtype=np.uint8)
    for bucket, bits in found.toLocalIterator():
        start = (bucket - 1) * len(bits)
        table[start : start + len(bits)] = np.frombuffer(bytes(bits), dtype=np.uint8)
    return table


def _is_set(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


# --- the graph -----------------------------------------------------------------------------


def edges(texts: DataFrame, tables: tuple[np.ndarray, np.ndarray], hot: np.ndarray) -> DataFrame:
    """`key`, `gram`, `n`: windows of up to five words and their number in some chunks of a task.

    A gram is its language, a tab, and words with blanks between. All grams that begin with
    the same two words have one key, or where these are in a `hot` slot, the same three.
    """
    shared = texts.sparkSession.sparkContext.broadcast((tables, hot))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, hot = shared.value
        held: list[pa.Table] = []
        for words in _chunks(batches):
            held.append(_windows(words, tables, hot))
            if sum(t.num_rows for t in held) > HELD:
                held = [_merged(held)]
                if held[0].num_rows > HELD // 2:
                    yield from held.pop().to_batches(max_chunksize=20_000)
        if held:
            yield from _merged(held).to_batches(max_chunksize=20_000)

    ship_package(texts.sparkSession)
    return texts.mapInArrow(count, "key bigint, gram string, n bigint")


def _merged(tables: list[pa.Table]) -> pa.Table:
    """Equal windows of several chunks as one."""
    found = pa.concat_tables(tables).combine_chunks().group_by(["key", "gram"], use_threads=False)
    found = found.aggregate([("n", "sum")]).rename_columns(["key", "gram", "n"])
    return found.combine_chunks()


def _windows(words: Words, tables: tuple[np.ndarray, np.ndarray], hot: np.ndarray) -> pa.Table:
    tag, word, n = words.tag, words.word, len(words)
    able = _is_set(tables[0], _slots(words.hashed(tag, word)))
    goes_on = _going_on(words, tables[0])
    first = _triples(goes_on)
    triple = np.zeros(n, dtype=bool)
    triple[first] = _is_set(tables[1], _slots(words.in_a_row(first, 3)))
    columns, alive = {"tag": pa.array(tag[able])}, able
    for j in range(LONGEST):
        if j:
            # The last two words, and the last three, may lie beside each other.
            step = np.zeros(n, dtype=bool)
            last = goes_on if j == 1 else triple
            back = 1 if j == 1 else 2
            step[: n - j + back] = last[j - back :]
            alive = alive & step
        later = np.zeros(n, dtype=np.int64)
        later[: max(n - j, 0)] = word[j:]
        columns[f"w{j}"] = pa.array(later[able], mask=~alive[able])
    counted = pa.table(columns).group_by(list(columns), use_threads=False).aggregate([([], "count_all")])
    ids = [counted[f"w{j}"].combine_chunks() for j in range(LONGEST)]
    phrase = pc.binary_join_element_wise(*[words.names.take(i) for i in ids], " ", null_handling="skip")
    lang = pc.replace_substring(pc.replace_substring(words.langs, "\\", "\\\\"), "\t", "\\t")
    tags = counted["tag"].combine_chunks()
    gram = pc.binary_join_element_wise(lang.take(tags), phrase, "\t")
    number, tags = [pc.fill_null(i, 0).to_numpy(zero_copy_only=False) for i in ids], tags.to_numpy()
    longer = [i.is_valid().to_numpy(zero_copy_only=False) for i in ids]
    key = words.hashed(tags, number[0])
    pair = words.hashed(tags, number[0], number[1])
    key = np.where(longer[1], pair, key)
    split = longer[2] & np.isin(_slots(pair), hot)
    key[split] = words.hashed(tags[split], *[i[split] for i in number[:3]])
    return pa.table({"key": key.view(np.int64), "gram": gram, "n": counted["count_all"].cast(pa.int64())})


FLOWS = "lang string, words bigint, phrase string, n bigint"


def flows(windows: DataFrame, least: int) -> DataFrame:
    """`lang`, `words`, `phrase`, `n` of the phrases of one to five words that occur `least` times.

    Windows with one beginning meet in one partition, where they are sorted; a phrase's flow
    is the sum over the run of windows that begin with it. So all lengths come from one
    pass over the edges, row by row. Single words, and pairs that are dealt out by three words,
    have parts of their flow in several partitions, which are added up last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, path, sums, out = None, [], [], []

        def close(depth: int) -> None:
            while len(path) > depth:
                n = sums.pop()
                if n >= least or len(path) <= 2:
                    out.append((lang, len(path), " ".join(path), n))
                path.pop()
                if sums:
                    sums[-1] += n

        for batch in batches:
            for gram, n in zip(batch.column("gram").to_pylist(), batch.column("n").to_pylist()):
                tag, _, phrase = gram.rpartition("\t")
                words = phrase.split(" ")
                same = 0
                if tag == lang:
                    for a, b in zip(path, words):
                        if a != b:
                            break
                        same += 1
                close(same)
                lang = tag
                for word in words[same:]:
                    path.append(word)
                    sums.append(0)
                sums[-1] += n
            if out:
                yield _flow_batch(out)
                out.clear()
        close(0)
        if out:
            yield _flow_batch(out)

    ship_package(windows.sparkSession)
    dealt = windows.repartition("key").select("gram", "n").sortWithinPartitions("gram")
    parts = dealt.mapInArrow(run, FLOWS)
    return parts.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _flow_batch(rows: list[tuple]) -> pa.RecordBatch:
    lang, words, phrase, n = zip(*rows)
    plain = [t.replace("\\t", "\t").replace("\\\\", "\\") if "\\" in t else t for t in lang]
    return pa.RecordBatch.from_arrays(
        [pa.array(plain), pa.array(words, pa.int64()), pa.array(phrase), pa.array(n, pa.int64())],
        names=["lang", "words", "phrase", "n"],
    )


def compacted(frequent: DataFrame) -> DataFrame:
    """`frequent` without the nodes on unary paths: phrases through which no more flows than
    through one that is a word longer, at either end, and so no more than through any
    phrase that holds them up to the longest."""
    words = F.split("phrase", " ")
    ends = F.array(
        F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "),
        F.array_join(F.slice(words, F.lit(2), F.size(words) - 1), " "),
    )
    edge = frequent.where("words > 1").select("lang", F.explode(ends).alias("phrase"), "n")
    widest = edge.groupBy("lang", "phrase").agg(F.max("n").alias("widest"))
    joined = frequent.join(widest, ["lang", "phrase"], "left")
    return joined.where(F.col("widest").isNull() | (F.col("widest") < F.col("n"))).drop("widest")


def scored(phrases: DataFrame, frequent: DataFrame, sizes: DataFrame) -> DataFrame:
    """`lang`, `phrase`, `a`, `l`, `r`, `n`, `score` of the phrases, each cut where it scores least.

    The score of a cut is floor(1000 * a * n / (l * r)), in exact decimals.
    """
    words = F.split("phrase", " ")
    cuts = phrases.select(
        "lang", "phrase", F.col("n").alias("a"), words.alias("w"), F.explode(F.expr("sequence(1, size(split(phrase, ' ')) - 1)")).alias("k")
    ).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"),
    )
    known = frequent.select("lang", "phrase", "n")
    cuts = cuts.join(known.withColumnsRenamed({"phrase": "first", "n": "l"}), ["lang", "first"])
    cuts = cuts.join(known.withColumnsRenamed({"phrase": "rest", "n": "r"}), ["lang", "rest"])
    cuts = cuts.join(broadcast_if_small(sizes), "lang")
    wide = "cast({} as decimal(38,0))"
    score = F.expr(f"({wide.format(1000)} * {wide.format('a')} * {wide.format('n')}) div ({wide.format('l')} * {wide.format('r')})")
    best = F.min(F.struct(score.cast("bigint").alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "a", "n").agg(best).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )


def top_phrases(ranked: DataFrame, top: int) -> DataFrame:
    """The first `top` phrases of every language with their `rank`, from 1.

    They are cut in shares of a language first, so that no task sorts all of a language.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    ahead = ranked.withColumn("_share", share)
    ahead = ahead.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order)))
    ahead = ahead.where(F.col("_place") <= top)
    placed = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return placed.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine_phrases(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP
) -> DataFrame:
    """The first `top` collocations of each language: `lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`.

    Letters A-Z count as lower case; pieces end at `.,;:!?` and line ends, words at blanks and
    tabs. `a`, `l` and `r` are occurrences of the phrase and of its two parts within pieces, `n` the
    words of the language. Phrases have 2 to 5 words and occur at least `least` times. A NULL
    text has no words; a NULL language is `und`. Repeated rows count as often as they come;
    ties are in order of the phrase's bytes. Other columns of `docs` count for nothing,
    whatever their names. A text longer than a chunk is a chunk of its own.
    """
    texts = docs.select(
        F.coalesce(column_named(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), column_named(text).alias("text")
    )
    slots = slot_counts(texts)
    sizes = slots.where(F.col("slot").isNull()).select("lang", "n")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = F.col("n") * F.lit(SPREAD) >= F.lit(max(total, 1))
    hot = [row["slot"] for row in slots.where(F.col("slot").isNotNull() & share).select("slot").toLocalIterator()]
    pairs = possible(slots, least)
    tables = pairs, possible(triple_counts(texts, pairs), least)
    windows = edges(texts, tables, np.array(hot, dtype=np.int64))
    frequent = written(flows(windows, least))
    phrases = compacted(frequent).where("words > 1")
    return top_phrases(scored(phrases, frequent, sizes), top)


def mine_sql(least: int = LEAST, top: int = TOP) -> str:
    """The same in SQL: every length is counted for itself."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH pieces AS MATERIALIZED (
  SELECT lang, [x FOR x IN string_split_regex(piece, '{BETWEEN}') IF x <> ''] AS w
  FROM (
    SELECT coalesce(lang, '{UNKNOWN}') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '{PIECE_END}')) AS piece
    FROM documents
  )
), frequent AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f
  FROM (
    SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
    FROM pieces, (SELECT unnest(range(1, {LONGEST + 1})) AS k)
  )
  GROUP BY ALL HAVING count(*) >= {least}
), sizes AS (
  SELECT lang, CAST(sum(len(w)) AS bigint) AS n FROM pieces GROUP BY lang
), held AS (
  SELECT lang, phrase, max(f) AS widest
  FROM (
    SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, f
    FROM (
      SELECT lang, string_split(phrase, ' ') AS w, f, size, unnest(range(1, k - size + 2)) AS i
      FROM frequent JOIN (SELECT unnest(range(2, {LONGEST})) AS size) ON size < k
    )
  )
  GROUP BY ALL
), cuts AS (
  SELECT lang, phrase, f AS a, w, unnest(range(1, k)) AS cut
  FROM (
    SELECT c.lang, c.phrase, c.f, c.k, string_split(c.phrase, ' ') AS w
    FROM frequent c LEFT JOIN held i ON c.lang = i.lang AND c.phrase = i.phrase
    WHERE c.k > 1 AND (i.widest IS NULL OR 100 * i.widest < 100 * c.f)
  )
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, cut,
         CAST((CAST(1000 AS hugeint) * c.a * n) // (CAST(x.f AS hugeint) * y.f) AS bigint) AS score
  FROM cuts c
  JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')
  JOIN sizes s ON s.lang = c.lang
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, n, score
FROM least
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER best <= {top}
"""
