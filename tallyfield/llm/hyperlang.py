"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of a run of three letters
binds (multiplies) the letters' vectors, each shifted by its place in the run. A text is
the bundle (sum) of its runs, a language the bundle of its training texts. A text gets
the language whose vector has the highest cosine with its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.text import column_named

from .common import code_points, fold, map_batches, mix, only, ship_package, ticked

DIMENSIONS = 1024
FOLDS = 5
UNKNOWN = "und"
# Characters, texts and letter runs that are worked on at once: bounds the memory of a task.
_CHARS, _TEXTS, _GRAMS = 400_000, 128, 16_384


def predict_language(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """`key`, `held_out`, `lang_pred` and `score` of every row.

    Languages are learned from the texts outside fold 0 whose language is not NULL; a row
    without a key is never learned from. `score` is the cosine, at least 0. A text that is
    NULL or has no letter is `und` with score 0, and so is any if nothing could be
    learned. Ties go to the smaller name. A repeated row gives a row each time.
    """
    model = learn_profiles(docs, key, text, lang, dimensions)
    return apply_profiles(docs, model, key, text, dimensions)


def learn_profiles(
    docs: DataFrame, key: str, text: str, lang: str, dimensions: int = DIMENSIONS
) -> dict[str, np.ndarray]:
    """The vector of each language. Only these sums, one vector a language, are collected."""
    rows = only(docs, key=key, text=text, lang=lang)
    rows = rows.where((fold("key", FOLDS) != 0) & F.col("lang").isNotNull())
    rows = rows.where(F.col("text").isNotNull()).select("text", F.col("lang").cast("string"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, vectors, _ in bundled(batch.column("text").to_pylist(), dimensions):
                for i, vector in zip(at, vectors):
                    sums[langs[i]] = sums.get(langs[i], 0) + vector
        yield pa.record_batch(
            {
                "lang": pa.array(list(sums), pa.string()),
                "sums": pa.array(list(sums.values()), pa.list_(pa.float64())),
            }
        )

    ship_package(rows.sparkSession)
    parts = rows.mapInArrow(bundle, "lang string, sums array<double>")
    summed = (
        parts.select("lang", F.posexplode("sums").alias("at", "part"))
        .groupBy("lang", "at")
        .agg(F.sum("part").alias("total"))
    )
    model: dict[str, np.ndarray] = {}
    for row in summed.collect():
        model.setdefault(row["lang"], np.zeros(dimensions))[row["at"]] = row["total"]
    return model


def apply_profiles(
    docs: DataFrame,
    model: dict[str, np.ndarray],
    key: str = "doc_id",
    text: str = "text",
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    rows = only(docs, key=key, text=text)
    rows = rows.select("key", F.coalesce(fold("key", FOLDS) == 0, F.lit(True)).alias("held_out"), "text")
    nearest = _nearest(model, dimensions)

    def predict(batch: pa.RecordBatch) -> pa.Table:
        names, scores = nearest(batch.column("text").to_pylist())
        return pa.table(
            {
                key: batch.column("key"),
                "held_out": batch.column("held_out"),
                "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(scores),
            }
        )

    kind = rows.schema["key"].dataType.simpleString()
    return map_batches(
        rows, predict, f"{ticked(key)} {kind}, held_out boolean, lang_pred string, score double"
    )


def identified_stage(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The documents with a language, their columns as they were but for a NULL `lang`, which
    becomes the predicted one. Documents without a letter go. If nothing could be learned,
    all documents with a text stay."""
    model = learn_profiles(docs, key, text, lang)
    if not model:
        return docs.where(column_named(text).isNotNull())
    nearest = _nearest(model, DIMENSIONS)
    at_text, at_lang = docs.columns.index(text), docs.columns.index(lang)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, _ = nearest(batch.column(at_text).to_pylist())
        old = batch.column(at_lang).to_pylist()
        filled = pa.array([n if o is None else o for n, o in zip(names, old)], batch.column(at_lang).type)
        batch = batch.set_column(at_lang, batch.schema.field(at_lang), filled)
        return batch.filter(pa.array([n != UNKNOWN for n in names]))

    return map_batches(docs, keep, docs.schema)


def _nearest(model: dict[str, np.ndarray], dimensions: int):
    """A function from texts to the names of their languages and the scores."""
    names = sorted(name for name, vector in model.items() if vector.any())
    units = np.array([model[n] / np.linalg.norm(model[n]) for n in names]).reshape(-1, dimensions)

    def nearest(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        if names:
            for at, vectors, norms in bundled(texts, dimensions):
                cosines = vectors @ units.T / np.maximum(norms, 1e-9)[:, None]
                best[at] = cosines.round(12).argmax(axis=1)
                score[at] = cosines.max(axis=1)
        return [names[i] if i >= 0 else UNKNOWN for i in best], np.clip(score, 0.0, 1.0)

    return nearest


def bundled(
    texts: list[str | None], dimensions: int
) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Positions, vectors and their lengths of the texts that have a letter."""
    at, runs, size = [], [], 0
    for i, text in enumerate(texts):
        symbols = _symbols(text)
        if symbols is None:
            continue
        at.append(i)
        runs.append(symbols)
        size += len(symbols)
        if size >= _CHARS or len(at) >= _TEXTS:
            yield _bundle(at, runs, dimensions)
            at, runs, size = [], [], 0
    if at:
        yield _bundle(at, runs, dimensions)


def _symbols(text: str | None) -> np.ndarray | None:
    """Small letters, with one 0 for each run of other characters and at both ends."""
    if not text:
        return None
    points = code_points(text.lower())
    letters = np.where(_is_letter()[points], points, 0)
    if not letters.any():
        return None
    letters = np.concatenate(([0], letters, [0]))
    again = np.zeros(len(letters), dtype=bool)
    again[1:] = (letters[1:] == 0) & (letters[:-1] == 0)
    return letters[~again]


def _bundle(
    at: list[int], runs: list[np.ndarray], dimensions: int
) -> tuple[list[int], np.ndarray, np.ndarray]:
    letters = np.unique(np.concatenate([np.unique(r) for r in runs]))
    base = len(letters)
    vectors = np.stack([letter_vector(int(c), dimensions) for c in letters])
    first, second = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    out = np.zeros((len(runs), dimensions), dtype=np.float64)
    place = np.zeros(int(letters[-1]) + 1, dtype=np.int64)
    place[letters] = np.arange(base)
    for lo, hi in _pieces(runs):
        codes, owner = [], []
        for i, start, stop in hi:
            s = place[runs[i][start:stop]]
            codes.append((s[:-2] * base + s[1:-1]) * base + s[2:])
            owner.append(np.full(len(codes[-1]), i - lo))
        code, own = np.concatenate(codes), np.concatenate(owner)
        if base**3 <= 1 << 23:
            seen = np.zeros(base**3, dtype=bool)
            seen[code] = True
            grams = np.flatnonzero(seen)
            index = np.empty(base**3, dtype=np.int64)
            index[grams] = np.arange(len(grams))
            code = index[code]
        else:
            grams, code = np.unique(code, return_inverse=True)
        n = int(own.max()) + 1
        for start in range(0, len(grams), _GRAMS):
            block = grams[start : start + _GRAMS]
            here = slice(None) if len(grams) <= _GRAMS else (code >= start) & (code < start + _GRAMS)
            counts = np.bincount(
                own[here] * len(block) + code[here] - start, minlength=n * len(block)
            ).reshape(n, -1)
            bound = first[block // (base * base)] * second[block // base % base] * vectors[block % base]
            out[lo : lo + n] += counts.astype(np.float32) @ bound.astype(np.float32)
    return at, out, np.linalg.norm(out, axis=1)


def _pieces(runs: list[np.ndarray]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """All texts at once if they are short, and a very long one in overlapping pieces."""
    if sum(map(len, runs)) <= 2 * _CHARS:
        yield 0, [(i, 0, len(r)) for i, r in enumerate(runs)]
        return
    for i, run in enumerate(runs):
        for start in range(0, len(run) - 2, _CHARS):
            yield i, [(i, start, min(len(run), start + _CHARS + 2))]


@functools.lru_cache(maxsize=1 << 16)
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """+1 or -1 in each dimension, the same in every task."""
    bits = mix(np.arange(dimensions, dtype=np.uint64) + np.uint64(code << 20), seed=8)
    return np.where(bits >> np.uint64(63), 1, -1).astype(np.int8)


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
