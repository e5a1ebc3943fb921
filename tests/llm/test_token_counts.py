"""Token counts against the library on whole texts."""

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tallyfield.llm import token_counts
from tallyfield.llm.common import tokenizer_file

from llm_cases import docs_of, odd_rows, prose  # noqa: F401

MODEL = tokenizer_file("piece_bpe_32k.model")
ALPHABET = [*" \n\t\r▁aabcdeézß中文字　\x00\xa0\x85.,1🙂", "  ", "<s>", "</s>", "<unk>", "the", "ing", "▁▁"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    with open(MODEL, "rb") as file:
        return token_counts.Encoder(file.read())


def test_pre_tokens_add_up_to_the_whole_text(library, encoder):
    rng = random.Random(7)
    for _ in range(5_000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(30)))
        assert sum(map(encoder.length, token_counts.pre_tokens(text))) == len(library.encode(text)), repr(text)


def _counted(docs, **how):
    done = token_counts.count_tokens(docs, MODEL, **how)
    assert done.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    return sorted((tuple(r) for r in done.collect()), key=str)


def _plain(docs, library):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    full = [(k, len(t.encode()), len(library.encode(t))) for k, t in rows]
    return sorted(((*row, row[2] > 4096) for row in full), key=str)


def test_odd_rows(docs_of, odd_rows, library):
    docs = docs_of([*odd_rows, (20, "<s>a</s> <|endoftext|>"), (21, "中文" * 3_000), (22, "\n\n \n")])
    clashing = docs.withColumns({"key": F.lit("k"), "n_tokens": F.lit(1), "a`b": F.lit(0)})
    want = _plain(docs, library)
    assert _counted(clashing) == want
    assert any(row[3] for row in want)
    # Neither a table of two entries nor a cache of one changes anything.
    assert _counted(docs, share=1, cache=1) == want


def test_no_rows(docs_of):
    assert _counted(docs_of([])) == []


def test_frequent_pre_tokens_are_found_and_bounded(spark):
    rng = random.Random(2)
    texts = [(" ".join(["often"] * 5 + [f"r{rng.random()}" for _ in range(20)]),) for _ in range(200)]
    found = token_counts.frequent_pre_tokens(spark.createDataFrame(texts, "text string").repartition(7), share=10)
    rows = {r["pre_token"]: r["n"] for r in found.collect()}
    assert rows[" often"] == 1000 and len(rows) <= 20


def test_lowered_counters_keep_what_is_frequent(monkeypatch):
    monkeypatch.setattr(token_counts, "COUNTERS", 3)
    counts = token_counts.Counter({"a": 50, "b": 30, "c": 9, "d": 2, "e": 1, "f": 1, "g": 1})
    assert token_counts._lowered(counts) == {"a": 48, "b": 28, "c": 7}


def test_the_table_survives_its_packed_form():
    lengths = {" the": 1, "\n": 1, " \x00é": 3, " 中": 2}
    assert token_counts.unpack_table(token_counts.pack_table(lengths)) == lengths


def test_models_that_a_cut_would_change_are_refused(monkeypatch):
    class Crossing(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, i):
            return "a▁b" if i == 300 else super().id_to_piece(i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with open(MODEL, "rb") as file, pytest.raises(ValueError, match="across"):
        token_counts.Encoder(file.read())
