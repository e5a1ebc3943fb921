"""Audit, top-k, chats, mixing, the pipeline and the registered queries."""

import itertools
import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tallyfield.llm import chat_repair, fixity, queries, raking, topk
from tallyfield.sources import star

from llm_cases import docs_of, FOLDER, odd_rows  # noqa: F401

tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda row: [(v is not None, str(v)) for v in row])


@tables
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in star.TABLES:
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    mine = entry.queries()[name](spark, FOLDER)
    columns = sorted(mine.columns)
    expected = duck.sql(entry.oracle_sql()[name]).project(", ".join(f'"{c}"' for c in columns))
    assert _sorted(mine.select(*columns).collect()) == _sorted(expected.fetchall())


def test_every_operator_is_registered():
    numbers = {int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in entry.queries()


# Audit


def _records(spark, rows):
    df = spark.createDataFrame(rows, "archive string, offset bigint, digest string, extra string")
    return df.withColumn("length", F.lit(100).cast("bigint"))


def test_audit_finds_what_differs(spark):
    rows = [(a, i * 5000, f"{a}{i}", None) for a in "pq" for i in range(900)]
    originals = _records(spark, rows)
    damaged = [r for r in rows if r[:2] != ("p", 45_000)]
    damaged = [(a, o, "bad" if (a, o) == ("q", 4_000_000) else d, x) for a, o, d, x in damaged]
    damaged += [("p", 77, "new", None), rows[3]]
    copies = _records(spark, damaged).withColumn("replica", F.lit(1)).unionByName(
        originals.withColumn("replica", F.lit(2))
    )
    found = {(r["archive"], r["replica"], r["offset"], r["kind"]) for r in fixity.audit(originals, copies).collect()}
    assert found == {("p", 1, 45_000, "missing"), ("q", 1, 4_000_000, "altered"), ("p", 1, 77, "extra")}
    assert fixity.audit(originals.where("false"), copies.where("false")).count() == 0
    assert fixity.audit(originals.where("false"), copies.where("replica = 2")).count() == 1800


def test_audit_sees_a_replica_that_lost_all(spark):
    originals = _records(spark, [(a, i * 5000, f"{a}{i}", None) for a in "pq" for i in range(100)])
    copies = originals.where("archive = 'p'").withColumn("replica", F.lit(1))
    pairs = spark.createDataFrame([("p", 1), ("q", 1), ("p", 2)], "archive string, replica int")
    found = {(r["archive"], r["replica"], r["offset"], r["kind"]) for r in fixity.audit(originals, copies, pairs).collect()}
    assert found == {(a, n, i * 5000, "missing") for a, n in (("q", 1), ("p", 2)) for i in range(100)}


def test_offsets_follow_each_other(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("k"), (F.col("id") % 9 + 1).alias("length"))
    rows = fixity.with_offsets(df.repartition(6), ["k"]).orderBy("k").collect()
    at = 0
    for row in rows:
        assert row["offset"] == at
        at += row["length"]


def test_null_and_empty_contents_differ(spark):
    df = spark.createDataFrame([(None, ""), ("", None), ("", ""), (None, None)], "a string, b string")
    assert df.select(fixity.content(F.col("a"), F.col("b"))).distinct().count() == 4


# Top-k


def _best(rows, k, every):
    """The contract by brute force; rows are different (id, vector)."""
    out = []
    for at, (q, v) in enumerate(rows):
        if q % every == 0:
            scores = [(-sum(map(int.__mul__, v, w)), i) for j, (i, w) in enumerate(rows) if j != at and len(v) == len(w)]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("high", [3, 40, 10**9])
def test_top_k_equals_brute_force(spark, monkeypatch, high):
    monkeypatch.setattr(topk, "GROUP", 40)
    rng = np.random.default_rng(high % 97)
    n = 230 if high < 10**6 else 60
    values = rng.integers(-high, high, (n, 6)).tolist()
    values[5] = values[9] = values[10]
    rows = list(enumerate(values))
    # Ids with several vectors, a vector with very many ids, and another length.
    rows += [(10, values[3]), (10, values[10][::-1]), (20, values[20][::-1]), (7, values[8])]
    rows += [(1000 + i, values[10]) for i in range(60)] + [(30, [1, 2]), (31, [2, 1]), (60, [1, -2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, values array<bigint>, score string")
    clashing = df.unionByName(df.limit(20)).withColumns({"group": F.lit(1), "dims": F.lit(2), "chunk": F.lit(3), "v": F.lit(4)})
    found = topk.top_k(clashing, k=7, every=10)
    assert sorted(map(tuple, found.collect())) == _best(rows, 7, 10)


def test_bounds_in_slices_and_groups_that_are_not_asked(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 50)
    monkeypatch.setattr(topk, "BOUNDS_BYTES", 500)
    rng = np.random.default_rng(1)
    centres = rng.integers(-60, 60, (12, 8))
    rows = [(i, (centres[i % 12] + rng.integers(-3, 4, 8)).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, values array<bigint>")
    sent = []
    plain = topk._sent
    monkeypatch.setattr(topk, "_sent", lambda *a: sent.append(plain(*a)) or sent[-1])
    assert sorted(map(tuple, topk.top_k(df, k=5, every=20).collect())) == _best(rows, 5, 20)
    # 30 queries, 12 groups: few meet more than their own and one more.
    assert [x.count() <= limit for x, limit in zip(sent, (30 * 8, 100))] == [True, True]


def test_blocks_are_skipped_without_loss():
    rng = np.random.default_rng(0)
    centres = rng.integers(-50, 50, (30, 8))
    values = np.concatenate([c + rng.integers(-3, 4, (64, 8)) for c in centres])
    ids = np.arange(len(values))[::-1].copy()
    row, at, score = topk.search_blocks(ids, values, values[:40], 5, np.full(40, -np.inf))
    want = []
    for q in range(40):
        scores = sorted((-int(values[q] @ v), int(i)) for v, i in zip(values, ids))
        want += [(q, i, -s) for s, i in scores[:5]]
    assert sorted(zip(row.tolist(), ids[at].tolist(), score.tolist())) == sorted(want)


def test_unusable_vectors(spark):
    rows = [(0, [1.0, 0.5]), (20, [float("nan"), 1.0]), (2, None), (3, [1.0, None]), (4, []), (None, [1.0, 1.0])]
    rows += [(5, [float("inf"), 1.0]), (6, [2.0, 2.0]), (7, [-0.01, 0.0]), (40, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    ready = df.select("vec_id", topk.scaled("embedding").alias("values"))
    assert sorted(map(tuple, topk.top_k(ready).collect())) == [(0, 1, 6, 12288), (0, 2, 7, -64)]
    assert topk.top_k(ready.where("false")).count() == 0


# Chats


# What a change of a turn costs, as the operator's documentation has it.
PRICES = {
    ("user", "assistant"): 4, ("assistant", "user"): 4, ("user", "system"): 9, ("assistant", "system"): 9,
    ("system", "user"): 5, ("system", "assistant"): 7,
    (None, "user"): 3, (None, "assistant"): 3, (None, "system"): 5,
}


def _legal(messages):
    """How a conversation may begin: perhaps a system message, then user and assistant in turn."""
    rest = messages[1:] if messages[:1] == ("system",) else messages
    return all(x == ("user", "assistant")[i % 2] for i, x in enumerate(rest))


def _cheapest_by_hand(roles):
    """The least cost over all sequences of messages, turn by turn, without the operator's tables.

    A turn goes into the last message, at 2, or begins one, ahead of which there may be empty
    ones, at 6 each; giving it another role has its price.
    """
    found = {(): 0}
    for role in roles:
        after = {}
        for messages, cost in found.items():
            ways = [(messages, cost + 2, messages[-1])] if messages else []
            for n in range(3):
                for empty in itertools.product(chat_repair.ROLES, repeat=n):
                    ways += [(messages + empty + (x,), cost + 6 * n, x) for x in chat_repair.ROLES]
            for longer, price, name in ways:
                if _legal(longer):
                    price += 0 if name == role else PRICES[role, name]
                    after[longer] = min(after.get(longer, 10**9), price)
        found = after
    missing = {"system": 2, "user": 1, "assistant": 0}
    return min(cost + 6 * missing[messages[-1]] for messages, cost in found.items())


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_repairs_are_legal_and_cheapest(n):
    for roles in itertools.product((*chat_repair.ROLES, None), repeat=n):
        cost, steps, last = chat_repair.cheapest(list(roles))
        assert cost == _cheapest_by_hand(roles)
        out = chat_repair.repaired(list(roles), ["t"] * n, None, None)
        messages = [m.partition("\n") for m in "".join(r[4] for r in out).split("<|im_start|>")[1:]]
        assert all(body.endswith("<|im_end|>\n") for _, _, body in messages)
        names = tuple(name for name, _, _ in messages)
        assert _legal(names) and names[-1] == "assistant"
        # What was done costs what it should.
        said = ["" if r[0] == "keep" else r[0] for r in out]
        price = sum(2 * ("merge" in x) + (PRICES[a, r[1]] if "relabel" in x else 0) for x, r, a in zip(said, out, roles))
        begun = sum("merge" not in x for x in said)
        assert price + 6 * (len(names) - begun) == cost


def test_a_legal_conversation_stays(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "User ", "q"), (1, 2, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = chat_repair.repair(df.withColumn("action", F.lit(1))).orderBy("turn").collect()
    assert [r["action"] for r in found] == ["keep"] * 3
    assert "".join(r["rendered"] for r in found) == (
        "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    )
    assert chat_repair.repair(df.where("false")).count() == 0


def test_long_conversations_over_many_partitions(spark):
    import random

    rng = random.Random(2)
    kinds = ["user", "assistant", "system", "tool", None]
    rows = [(c if c != 3 else None, t, rng.choice(kinds), f"{c}-{t}") for c in range(5) for t in range(300 if c == 2 else 6)]
    rows.append((1, None, "user", "no number"))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = chat_repair.repair(df.repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(found) == len(rows)

    def order(x):
        return (x[1] is not None, x[1])

    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=order)
        mine = sorted((tuple(r) for r in found if r[0] == conv), key=order)
        # Of equally cheap mendings any will do: what counts is that they are the cheapest.
        cost = 0
        for _, _, role, action, new, put_in, closes, rendered in mine:
            plain = chat_repair._plain(role)
            cost += chat_repair.MERGE * ("merge" in action) + chat_repair.EMPTY * len(put_in)
            cost += 0 if plain == new else chat_repair.RELABEL[plain, new]
            if closes:
                cost += chat_repair.EMPTY * rendered.count("<|im_start|>assistant\n<|im_end|>\n") * (new != "assistant")
        messages = "".join(r[7] for r in mine).split("<|im_start|>")[1:]
        state = 0
        for message in messages:
            then = chat_repair.ROLES.index(message.partition("\n")[0]) + 1
            assert then in chat_repair._NEXT[state]
            state = then
        assert state == 3 and sum(r[6] for r in mine) == 1
        assert cost == chat_repair.cheapest([r[2] for r in own])[0]


def test_odd_turns(spark):
    rows = [("None", 0, "user", "a"), (None, 0, "user", "b"), (None, 1, "assistant", "c"), ("None", 1, None, None)]
    rows += [("x", None, "USER ", "d"), ("x", None, "USER ", "d"), ("x", 5, "tool", "e" * 200_000), ("x", 5, "tool", "")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    clashing = df.withColumns({c: F.lit(1) for c in ("mark", "part", "steps", "at", "late", "conversation", "a`b")})
    found = chat_repair.repair(clashing.withColumnRenamed("role", "ro`le"), role="ro`le").collect()
    assert sorted(map(str, (r[:3] for r in found))) == sorted(map(str, (r[:3] for r in rows)))
    ends = {}
    for r in found:
        ends.setdefault(r["conv_id"], []).append(r["closes"])
    assert {k: sum(v) for k, v in ends.items()} == {"None": 1, None: 1, "x": 1}
    own = sorted(r["rendered"] for r in found if r["conv_id"] is None)
    assert own == ["<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n", "<|im_start|>user\nb"]
    assert sum(len(r["rendered"]) for r in found if r["conv_id"] == "x") > 200_000


def test_steps_come_in_stretches(spark):
    rows = [(0, t, ("user", "assistant")[t % 2], f"{t} ") for t in range(20_000)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(3)
    found = chat_repair.repair(df).orderBy("turn").collect()
    assert {r["action"] for r in found} == {"keep"} and [r["closes"] for r in found].count(True) == 1
    whole = "".join(r["rendered"] for r in found)
    assert whole == "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, _, r, x in rows)


# Mixing


def _given(rows, name):
    """Tokens that are sampled by value of a dimension."""
    sums = {}
    for r in rows:
        sums[r[name]] = sums.get(r[name], 0) + r["tokens"] * r["rate"]
    return sums


def test_marginals_reach_their_targets(spark):
    cells = spark.createDataFrame(
        [("a", "x", 10), ("a", "y", 30), ("b", "x", 50), ("b", "y", 5), ("c", "y", 0)],
        "source string, lang string, tokens bigint",
    )
    targets = {
        "source": spark.createDataFrame([("a", 0.5), ("b", 0.4), ("c", 0.1)], "value string, share double"),
        "lang": spark.createDataFrame([("x", 0.25), ("y", 0.75)], "value string, share double"),
    }
    fitted = raking.fit(cells, targets, share=0.2).collect()
    for name, shares in (("source", {"a": 5 / 9, "b": 4 / 9}), ("lang", {"x": 0.25, "y": 0.75})):
        given = _given(fitted, name)
        assert given.keys() == shares.keys()
        for value, share in shares.items():
            assert math.isclose(given[value], 0.2 * 95 * share, rel_tol=1e-9)
    assert {r["off"] <= 1e-12 for r in fitted} == {True}
    # A value without a target is not sampled; all else is as before.
    some = {**targets, "lang": targets["lang"].where("value = 'y'")}
    assert {r["lang"] for r in raking.fit(cells, some, share=0.2).where("rate > 0").collect()} == {"y"}


def test_full_cells_and_values_are_made_up_for(spark):
    rng = np.random.default_rng(4)
    cells = [(f"s{i}", f"l{j}", int(rng.pareto(0.6) * 50) + 1) for i in range(12) for j in range(5)]
    cells.append(("rare", "l0", 3))
    df = spark.createDataFrame(cells, "source string, lang string, tokens bigint")
    targets = raking.tempered_targets(df, {"source": 0.3, "lang": 0.7})
    fitted = raking.fit(df, targets, share=0.6).collect()
    total = sum(c[2] for c in cells)
    assert math.isclose(sum(r["rate"] * r["tokens"] for r in fitted), 0.6 * total, rel_tol=1e-9)
    assert [r["rate"] for r in fitted if r["source"] == "rare"] == [1.0] and max(r["rate"] for r in fitted) == 1.0
    # Below 1 a rate is a product of one factor a dimension; a full cell's product is above 1.
    free = [r for r in fitted if r["rate"] < 1]
    names = sorted({r["source"] for r in free}), sorted({r["lang"] for r in free})
    rows = np.zeros((len(free), len(names[0]) + len(names[1])))
    for at, r in enumerate(free):
        rows[at, names[0].index(r["source"])] = rows[at, len(names[0]) + names[1].index(r["lang"])] = 1
    logs = np.log([r["rate"] for r in free])
    factors = np.linalg.lstsq(rows, logs, rcond=None)[0]
    assert np.abs(rows @ factors - logs).max() < 1e-9


def test_mixing_odd_rows(docs_of, odd_rows):
    docs = docs_of(odd_rows).withColumn("source", F.when(F.col("doc_id") > 5, F.col("source")))
    clashing = {c: F.lit("x") for c in ("tokens", "topic", "_rate", "_source_cell", "row", "rate", "_off", "a`b.c")}
    docs = docs.withColumns(clashing)
    mixed = raking.mix_sources(docs)
    assert set(mixed.columns) == {*docs.columns, "_topic", "_tokens", "_probability", "_sampled", "_off"}
    mixed = mixed.collect()
    assert len(mixed) == len(odd_rows) and {r["_rate"] for r in mixed} == {"x"} == {r["a`b.c"] for r in mixed}
    assert all(0 <= r["_probability"] <= 1 for r in mixed)
    wanted = sum(r["_tokens"] * r["_probability"] for r in mixed)
    assert math.isclose(wanted, 0.7 * sum(r["_tokens"] for r in mixed), rel_tol=0.05)
    kept = raking.sampled_stage(docs)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}
    assert raking.mix_sources(docs.where("false")).count() == 0


def test_sweeps_go_on_until_the_targets_hold_or_say_how_far_off_they_are(spark):
    hot = [8000, 1000, 1000]
    cells = [(f"s{i}", f"l{j}", hot[i] * (92 if i == j else 4)) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(cells, "source string, lang string, tokens bigint")
    targets = raking.tempered_targets(df, {"source": 0.8, "lang": 0.9})
    fitted = raking.fit(df, targets, share=0.5, tolerance=1e-5).collect()
    assert {r["off"] for r in fitted} == {fitted[0]["off"]} and fitted[0]["off"] <= 1e-5
    for n, target in targets.items():
        given, shares = _given(fitted, n), {r["value"]: r["share"] for r in target.collect()}
        for value, share in shares.items():
            wanted = 0.5 * 1_000_000 * share / sum(shares.values())
            assert math.isclose(given[value], wanted, rel_tol=1e-4)
    early = raking.fit(df, targets, share=0.5, max_sweeps=2).first()
    assert early["off"] > 1e-4
    # Each source in one language: the targets contradict each other.
    apart = df.where("substr(source, 2) = substr(lang, 2)")
    assert raking.fit(apart, targets, share=0.5, max_sweeps=32).first()["off"] > 1e-3


def test_a_rare_value_does_not_set_the_size_of_the_sample(spark):
    rows = [(i, "word " * (20 + i % 7), f"s{i % 10 // 6}", ("en", "de", "en")[i % 3]) for i in range(600)]
    rows.append((600, "five words of new source", "rare", "en"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    mixed = raking.mix_sources(docs).collect()
    total = sum(r["_tokens"] for r in mixed)
    wanted = sum(r["_tokens"] * r["_probability"] for r in mixed)
    assert math.isclose(wanted, 0.7 * total, rel_tol=1e-9)
    assert all(0 < r["_probability"] <= 1 for r in mixed)
    assert [r["_probability"] for r in mixed if r["source"] == "rare"] == [1.0]
    # The others have what is left of the budget, in the shares of their targets.
    tokens = {s: sum(r["_tokens"] for r in mixed if r["source"] == s) for s in ("s0", "s1")}
    found = {s: sum(r["_tokens"] * r["_probability"] for r in mixed if r["source"] == s) for s in tokens}
    assert math.isclose(found["s0"] / found["s1"], (tokens["s0"] / tokens["s1"]) ** 0.8, rel_tol=1e-9)
    assert raking.sampled_stage(docs).count() > 0.6 * 601


# Pipeline


@tables
def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = corpus_pipeline.written(stage(spark, docs, FOLDER))
        assert done.columns == docs.columns, name
        before = {r[0] for r in docs.select("doc_id").collect()}
        assert {r[0] for r in done.select("doc_id").collect()} <= before
        counts.append(done.count())
        docs = done
    assert counts[0] == counts[1] > counts[2] >= counts[3] > counts[4] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert pieces.select("doc_id").distinct().count() == counts[4]


def test_pipeline_of_nothing(spark, docs_of):
    docs = docs_of(["x"]).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
