"""Quality rules: a learned decision list over counts of each text.

Sequential covering: rules are learned one after the other, each on the rows that no
earlier rule has caught. Rules are grown, condition by condition, by information gain on two
thirds of the rows, a few of the best side by side. Pruning, on the remaining third, takes of
all that were grown, their beginnings and their forms with a tighter last threshold the one
of most worth that holds there too. Learning ends when none does, or when a rule costs more
to write down than it saves. The list is given back as one ordered CASE expression.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, only, written
from .text_stats import text_stats

_log = logging.getLogger(__name__)

# What the rules may look at: ratios of the counts.
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "letter_share": ("n_letters", "word_chars"),
    "capital_share": ("n_upper", "n_letters"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "distinct_word_share": ("n_distinct_words", "n_words"),
    "echo_word_share": ("n_echo_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}
# The list is fitted on at most so many labelled rows, those with the smallest hash.
MAX_LABELLED = 20_000
MAX_THRESHOLDS, MAX_CONDITIONS, MAX_RULES = 48, 4, 24
# Rules that are grown side by side, and tighter forms of the last threshold that pruning tries.
BEAM, TIGHTER = 6, 10


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.threshold if self.above else value < self.threshold

    def holds(self, features: dict[str, np.ndarray]) -> np.ndarray:
        value = features[self.feature]
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def with_ratios(stats: DataFrame) -> DataFrame:
    """Add the ratios; one over nothing is 0."""
    return stats.withColumns(
        {
            name: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
            for name, (a, b) in RATIOS.items()
        }
    )


def labelled_sample(
    stats: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", rows: int = MAX_LABELLED
) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Ratios and labels (0 or 1) of at most `rows` labelled keys, those of smallest hash.

    A key labelled both ways, or with NULL, is left out.
    """
    known = (
        only(labels, key=key, label=label)
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"), F.count("label").alias("n"))
        .where((F.col("label") == F.col("most")) & F.col("label").isin(0, 1))
        .select("key", "label")
    )
    names = list(RATIOS)
    sample = hashed_sample(with_ratios(stats.join(known, "key")), "key", rows, *names)
    found = sample.select("label", *names).toPandas()
    features = {name: found[name].to_numpy(dtype=np.float64) for name in names}
    return features, found["label"].to_numpy(dtype=np.int64)


def learn_rules(
    features: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.95, min_rows: int = 5
) -> list[Rule]:
    """Ordered rules that tell the `bad` rows from the others.

    A rule holds if, on the rows kept for pruning as on those it was grown on, at least
    `min_precision` of what it catches is bad, `min_rows` of the latter and one of the former
    at least. Its worth is the bad rows it catches, less the good ones times what
    `min_precision` says one costs. Without a rule that holds the list is empty, and a warning
    says so.
    """
    rules: list[Rule] = []
    n = len(bad)
    pruning = np.arange(n) % 3 == 2
    left = np.ones(n, dtype=bool)
    while len(rules) < MAX_RULES and (left & bad & ~pruning).sum() >= min_rows:
        best, best_worth, best_caught = None, (0.0, 0), left
        for rule in _pruned(_grown(features, bad, left & ~pruning), features, bad, left & ~pruning):
            caught = _caught(rule, features) & left
            parts = [(caught & part & bad).sum() for part in (~pruning, pruning)]
            sizes = [(caught & part).sum() for part in (~pruning, pruning)]
            holds = sizes[0] >= min_rows and sizes[1] >= 1
            if not holds or any(p < min_precision * size for p, size in zip(parts, sizes)):
                continue
            good = sum(sizes) - sum(parts)
            worth = (sum(parts) - good * min_precision / max(1 - min_precision, 1e-9), -len(rule))
            if worth > best_worth:
                best, best_worth, best_caught = rule, worth, caught
        if best is None or _saved(best_caught, left, bad) <= _cost(best, len(features)):
            break
        rules.append(best)
        left &= ~best_caught
    if not rules and bad.any():
        _log.warning("no rule holds for %d labelled rows, %d of them bad", n, int(bad.sum()))
    return rules


def _caught(rule: Rule, features: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(features) for c in rule])


def _cost(rule: Rule, features: int) -> float:
    """Bits that write down a rule: a feature, a side and a threshold for each condition."""
    return len(rule) * (math.log2(max(features, 2)) + 1 + math.log2(MAX_THRESHOLDS))


def _saved(caught: np.ndarray, left: np.ndarray, bad: np.ndarray) -> float:
    """Bits by which the labels of the rows left are told shorter once the rule is known."""

    def bits(rows: np.ndarray) -> float:
        n, k = int(rows.sum()), int((rows & bad).sum())
        return (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)) / math.log(2)

    return bits(left) - bits(left & caught) - bits(left & ~caught)


def _grown(features: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> list[Rule]:
    """The rules of a beam: at every length those of highest gain, until only bad rows are
    caught. Rules that catch the same rows count once."""
    found: list[Rule] = []
    beam: list[tuple[Rule, np.ndarray]] = [((), rows)]
    while beam and len(beam[0][0]) < MAX_CONDITIONS:
        longer = []
        for rule, held in beam:
            for gain, condition in _conditions(features, bad, held):
                longer.append((gain, rule + (condition,), held))
        longer.sort(key=lambda x: -x[0])
        beam, seen = [], set()
        for _, rule, held in longer:
            caught = held & rule[-1].holds(features)
            key = caught.tobytes()
            if key not in seen:
                seen.add(key)
                beam.append((rule, caught))
            if len(beam) == BEAM:
                break
        found += [rule for rule, _ in beam]
        beam = [(rule, held) for rule, held in beam if (held & ~bad).any()]
    return found


def _conditions(
    features: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray
) -> Iterator[tuple[float, Condition]]:
    """The best condition of every feature and side for a rule that holds for `rows`, with its gain."""
    is_bad = bad[rows]
    p0, n0 = int(is_bad.sum()), int((~is_bad).sum())
    if p0 == 0 or n0 == 0:
        return
    before = math.log2(p0 / (p0 + n0))
    for name, values in features.items():
        seen = values[rows]
        ours, theirs = np.sort(seen[is_bad]), np.sort(seen[~is_bad])
        cuts = np.unique(np.quantile(seen, np.linspace(0, 1, MAX_THRESHOLDS), method="nearest"))
        cuts = np.unique(np.concatenate([cuts, _borders(ours, theirs)]))
        below = np.searchsorted(ours, cuts), np.searchsorted(theirs, cuts)
        for above in (True, False):
            p, n = (p0 - below[0], n0 - below[1]) if above else below
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), 0.0)
            at = int(np.argmax(gain))
            if gain[at] > 1e-9:
                yield float(gain[at]), Condition(name, above, float(cuts[at]))


def _borders(bad: np.ndarray, good: np.ndarray) -> list[float]:
    """Half-way beyond the good rows on either side, both sorted: the most that a pure
    condition catches."""
    found = []
    low, high = np.searchsorted(bad, good[0]), np.searchsorted(bad, good[-1], side="right")
    if low > 0:
        found.append(float((bad[low - 1] + good[0]) / 2))
    if high < len(bad):
        found.append(float((bad[high] + good[-1]) / 2))
    return found


def _pruned(
    grown: list[Rule], features: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray
) -> Iterator[Rule]:
    """The grown rules, each also with its last threshold moved so that fewer of the bad rows it
    was grown on pass: a threshold just beyond the good rows of one part often lets through
    some of the other's. Beginnings of rules are in the beam themselves."""
    for rule in grown:
        yield rule
        last = rule[-1]
        values = features[last.feature][_caught(rule, features) & rows & bad]
        if not len(values):
            continue
        shares = np.arange(1, TIGHTER) / TIGHTER
        for cut in np.unique(np.quantile(values, shares if last.above else 1 - shares, method="nearest")):
            yield (*rule[:-1], Condition(last.feature, last.above, float(cut)))


def as_columns(rules: list[Rule]) -> tuple[Column, Column]:
    """The list as ordered conditional expressions: the number and the text of the first
    rule that holds, 0 and 'keep' if none does."""
    number, name = F.lit(None), F.lit(None)
    for i, rule in reversed(list(enumerate(rules, 1))):
        holds = F.lit(True)
        for condition in rule:
            holds = holds & condition.column()
        number = F.when(holds, F.lit(i)).otherwise(number)
        name = F.when(holds, F.lit(" and ".join(map(str, rule)))).otherwise(name)
    return F.coalesce(number.cast("int"), F.lit(0)), F.coalesce(name.cast("string"), F.lit("keep"))


def judge_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, base filter, first matching rule and verdict of every row of `docs`.

    A NULL or empty text fails the base filter. Without usable labels the list is empty
    and the base filter decides alone. A repeated row gives a row each time. The counts
    are written once: the rules are learned from them and then applied to them.
    """
    stats = written(text_stats(docs, key, text))
    features, label = labelled_sample(stats, labels, "quality", key)
    number, name = as_columns(learn_rules(features, label == 0) if len(label) else [])
    judged = with_ratios(stats).select(
        F.col("key").alias(key),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias(
            "base_failed"
        ),
        number.alias("rule"),
        name.alias("rule_text"),
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
