"""Phrase mining against counting every phrase by itself."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyfield.llm import collocations

from llm_cases import docs_of, odd_rows, prose  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _plain(rows, least, top=2000):
    """The contract's rows, from (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                f.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    out = {}
    frequent = {g: c for g, c in f.items() if c >= least}
    for (lang, *words), a in frequent.items():
        if len(words) < 2:
            continue
        held = any(
            g[0] == lang and len(g) > len(words) + 1 and c >= a
            and any(list(g[i : i + len(words)]) == words for i in range(1, len(g) - len(words) + 1))
            for g, c in frequent.items()
        )
        if held:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, *words[:k]], f[lang, *words[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def _mined(docs, **how):
    done = collocations.mine_phrases(docs, **how)
    assert done.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert set(dict(done.dtypes).values()) == {"string", "bigint"}
    return sorted(tuple(r) for r in done.collect())


def _pairs(docs):
    return [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]


def test_odd_rows(docs_of, odd_rows):
    docs = docs_of([*odd_rows, (30, "A b\tc. a B  c, a b; c a b c\r\na b c\x0ba b c " * 3), (31, "é É é É " * 9)])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") == 31, "x\ty\\").otherwise("en"))
    want = _plain(_pairs(docs), 3)
    assert want and {"und", "en", "x\ty\\"} == {row[0] for row in want}
    clashing = docs.withColumns({"words": F.lit(1), "n": F.lit(2), "gram": F.lit("g"), "a`b": F.lit(0)})
    assert _mined(clashing, least=3) == want


def test_random_texts_and_a_short_top(docs_of):
    rng = random.Random(5)
    words = ["ab", "cd", "é", "x-y", "Ab", "中", "(", "q"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n"]) for _ in range(300)) for _ in range(25)]
    passage = "one two three four five six seven eight nine"
    docs = docs_of([*texts, *[passage] * 12, *[f"five six {w}" for w in words]]).repartition(5)
    want = _plain(_pairs(docs), 10)
    assert _mined(docs, least=10) == want
    assert _mined(docs, least=10, top=7) == _plain(_pairs(docs), 10, 7)
    # The passage's words all flow along one path: only the longest phrases of it are left.
    assert {len(row[2].split()) for row in want if "three" in row[2]} == {5}


def test_a_pair_that_holds_most_windows_is_dealt_out(docs_of, monkeypatch):
    rng = random.Random(6)
    docs = docs_of([" ".join(f"so it w{rng.randrange(40)}" for _ in range(60)) for _ in range(20)])
    want = _plain(_pairs(docs), 20)
    assert _mined(docs, least=20) == want
    texts = docs.select("lang", "text")
    slots = collocations.slot_counts(texts)
    table = collocations.possible(slots, 20)
    hot = [r["slot"] for r in slots.where("slot is not null and n > 500").collect()]
    for given, most in ((np.array(hot), 60), (np.array([], dtype=np.int64), 1)):
        both = table, collocations.possible(collocations.triple_counts(texts, table), 1)
        keyed = collocations.edges(texts, both, given).where("gram like 'en\tso it w%'")
        keys = keyed.select("key").distinct().count()
        assert keys == 1 if most == 1 else 30 < keys <= most


def test_no_rows(docs_of):
    assert _mined(docs_of([])) == []
    assert _mined(docs_of([None, "", " .\n"])) == []


def test_scores_are_exact_beyond_64_bits(spark):
    n, a, left, right = 12_345_678_901_234, 9_876_543_210, 98_765_432_109, 76_543_210_987
    rows = [("en", 2, "p q", a), ("en", 1, "p", left), ("en", 1, "q", right)]
    frequent = spark.createDataFrame(rows, "lang string, words bigint, phrase string, n bigint")
    sizes = spark.createDataFrame([("en", n)], "lang string, n bigint")
    [row] = collocations.scored(frequent.where("words = 2"), frequent, sizes).collect()
    assert row["score"] == 1000 * a * n // (left * right) and 1000 * a * n > 2**64


def test_the_table_rules_out_what_is_rare(docs_of):
    rng = random.Random(8)
    docs = docs_of([prose(rng, 200, 10**9) + " often said" for _ in range(50)])
    texts = docs.select("lang", "text")
    slots = collocations.slot_counts(texts)
    assert slots.where("slot is null").collect()[0]["n"] == 50 * 202
    pairs = collocations.possible(slots, 50)
    triples = collocations.triple_counts(texts, pairs)
    assert triples.count() == 0
    none = np.array([], dtype=np.int64)
    kept = collocations.edges(texts, (pairs, collocations.possible(triples, 50)), none)
    assert {r["gram"] for r in kept.collect()} == {"en\toften said", "en\tsaid"}


def test_windows_end_where_three_words_are_too_rare(docs_of):
    docs = docs_of(["a b c d e"] * 30 + ["a b x", "b c y", "c d z"] * 30 + ["a b c"] * 10 + ["b c d"] * 20)
    texts = docs.select("lang", "text")
    pairs = collocations.possible(collocations.slot_counts(texts), 40)
    tables = pairs, collocations.possible(collocations.triple_counts(texts, pairs), 40)
    kept = collocations.edges(texts, tables, np.array([], dtype=np.int64))
    sums = {}
    for r in kept.collect():
        sums[r["gram"].split("\t")[1]] = sums.get(r["gram"].split("\t")[1], 0) + r["n"]
    # 'd e' occurs 30 times and 'c d e' too: windows end ahead of it.
    assert sums["a b c"] == 10 and sums["a b c d"] == 30 and "a b c d e" not in sums
    assert _mined(docs, least=40) == _plain(_pairs(docs), 40)
