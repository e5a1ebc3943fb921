import json
import random

import pytest
from pyspark.sql import types as T

from tallyfield.operators import messages as m

from row_helpers import rows_of


def _flat(spark, *documents):
    df = spark.createDataFrame([(json.dumps(d),) for d in documents], "document string")
    return [r.asDict() for r in m.flatten_messages(df).collect()]


def test_last_query_wins(spark):
    (row,) = _flat(
        spark,
        {
            "id": "m1",
            "conversation_id": "c1",
            "status": "COMPLETED",
            "attachments": [
                {"text": {"content": "one"}},
                {"attachment_id": "a1", "query": {"query": "Q1", "description": "D1"}},
                {"text": {"content": ""}},
                {"text": None, "attachment_id": "a2", "query": {"id": "q2", "query": "Q2"}},
                {"text": {"content": "two"}, "query": {}},
                {"query": None},
            ],
        },
    )
    assert row == {
        "message_id": "m1",
        "conversation_id": "c1",
        "status": "COMPLETED",
        "text_responses": ["one", "two"],
        "sql_query": "Q2",
        "query_description": None,
        "attachment_id": "q2",
        "error": None,
    }


def test_attachment_id_falls_back(spark):
    first, second, third = _flat(
        spark,
        {"attachments": [{"attachment_id": "a", "query": {"query": "Q"}}]},
        {"attachments": [{"attachment_id": "a", "query": {"id": "", "query": "Q"}}]},
        {"attachments": [{"attachment_id": "a", "query": {"other": 1}}]},
    )
    assert first["attachment_id"] == second["attachment_id"] == third["attachment_id"] == "a"
    assert (first["sql_query"], third["sql_query"]) == ("Q", None)


@pytest.mark.parametrize(
    "error, shown",
    [
        ({"message": "boom"}, "boom"),
        ("plain", "plain"),
        (5, "5"),
        ({"code": 7}, '{"code":7}'),
        (None, None),
        ("", None),
        ({}, None),
        ([], None),
        (0, None),
        (False, None),
        ("0", "0"),
        ("false", "false"),
        ("{}", "{}"),
        ('{"message":"x"}', '{"message":"x"}'),
        ([1], "[1]"),
    ],
)
def test_errors(spark, error, shown):
    (row,) = _flat(spark, {"status": "FAILED", "error": error, "attachments": None})
    assert (row["error"], row["status"], row["text_responses"]) == (shown, "FAILED", [])


def test_missing_parts(spark):
    empty, bare = _flat(spark, {}, {"attachments": [{"query": {}}, {}]})
    assert (empty["message_id"], empty["status"], empty["text_responses"]) == ("", "UNKNOWN", [])
    assert (bare["sql_query"], bare["attachment_id"]) == (None, None)


def test_known_conversation_and_other_columns(spark):
    df = spark.createDataFrame(
        [("why?", "c1", "{}"), ("how?", "c1", '{"conversation_id": "c2"}')],
        "question string, conversation_id string, document string",
    )
    flat = m.flatten_messages(df).select("question", "conversation_id")
    assert sorted(rows_of(flat)) == [("how?", "c1"), ("why?", "c1")]


def test_input_columns_of_the_same_names(spark):
    df = spark.createDataFrame(
        [(1, "old", "x", '{"id": "m", "status": "COMPLETED"}')],
        "id int, status string, `a.b` string, document string",
    )
    flat = m.flatten_messages(df)
    assert flat.columns == ["id", "a.b", *m.MESSAGE_COLUMNS]
    assert tuple(flat.first())[:5] == (1, "x", "m", None, "COMPLETED")


def _result(columns, rows):
    response = {"manifest": {"schema": {"columns": columns}}, "result": {}}
    if rows is not None:
        response["result"]["data_array"] = rows
    return json.dumps({"statement_response": response})


RESULTS = [
    (1, _result([{"name": "n"}, {}], [["1", "a"], ["x", None]])),
    (2, _result([{"name": "n"}, {}], None)),
    (3, _result([{}, {"name": "n"}], [["b", "2"], ["c"]])),
    (4, "{}"),
    (5, _result([{"name": "n"}], [])),
    (6, _result([], [["9"]])),
]


def test_result_rows(spark):
    df = spark.createDataFrame(RESULTS, "doc int, document string")
    wanted = T.StructType(
        [
            T.StructField("n", T.IntegerType()),
            T.StructField("col_0", T.StringType()),
            T.StructField("col_1", T.StringType()),
            T.StructField("nowhere", T.DateType()),
        ]
    )
    rows = m.rows_from_result_documents(df, wanted)
    assert rows.columns == ["doc", "row_no", "n", "col_0", "col_1", "nowhere"]
    assert rows_of(rows, 0, 1) == [
        (1, 0, 1, None, "a", None),
        (1, 1, None, None, None, None),
        (3, 0, 2, "b", None, None),
        (3, 1, None, "c", None, None),
        (6, 0, None, None, None, None),
    ]


def test_result_cells(spark):
    df = spark.createDataFrame(RESULTS, "doc int, document string")
    assert rows_of(m.result_cells(df), 0, 1, 2) == [
        (1, 0, 0, "n", "1"),
        (1, 0, 1, "col_1", "a"),
        (1, 1, 0, "n", "x"),
        (1, 1, 1, "col_1", None),
        (3, 0, 0, "col_0", "b"),
        (3, 0, 1, "n", "2"),
        (3, 1, 0, "col_0", "c"),
        (6, 0, 0, "col_0", "9"),
    ]


def test_no_documents_keep_the_columns(spark):
    df = spark.createDataFrame([], "doc int, document string")
    assert m.result_cells(df).columns == ["doc", "row_no", "position", "column", "value"]


def test_chat_history(spark):
    def query(attachment, **rest):
        return {"attachments": [{"attachment_id": attachment, "query": {"query": "Q"}}], **rest}

    asked = [
        ("found", query("a1", id="m1", conversation_id="c")),
        ("by message", query(None, id="m2", conversation_id="c")),
        ("failed fetch", query("a3", id="m3", conversation_id="c")),
        ("failed", query("a4", id="m4", conversation_id="c", error="boom")),
        ("text only", {"id": "m5", "attachments": [{"text": {"content": "t"}}]}),
        ("no result yet", query("a6", id="m6", conversation_id="c")),
        ("no id", query("a7", conversation_id="c")),
    ]
    messages = spark.createDataFrame(
        [(q, json.dumps(d)) for q, d in asked], "question string, document string"
    )
    rows = _result([{"name": "n"}], [["1"]])
    results = spark.createDataFrame(
        [
            ("m1", "c", "a1", rows, None),
            ("m1", "other", "a1", rows, None),
            ("m2", "c", None, _result([], None), None),
            ("m3", "c", "a3", None, "timed out"),
            ("m4", "c", "a4", rows, None),
            ("", "c", "a7", rows, None),
        ],
        "message_id string, conversation_id string, attachment_id string, document string, error string",
    )
    history = {r["question"]: r for r in m.chat_history(messages, results).collect()}
    assert len(history) == 7
    assert history["found"]["result_rows"] == [["1"]]
    assert history["found"]["result_columns"] == ["n"]
    assert history["by message"]["result_rows"] == []
    assert history["failed fetch"]["query_result_error"] == "timed out"
    assert history["failed fetch"]["result_rows"] is None
    assert (history["failed"]["error"], history["failed"]["result_rows"]) == ("boom", None)
    assert history["text only"]["text_responses"] == ["t"]
    assert history["no result yet"]["result_rows"] is None
    assert history["no id"]["result_rows"] is None


def _pairs(chats):
    expected = []
    for conv in {c[0] for c in chats}:
        turns = sorted(t for t in chats if t[0] == conv)
        for this, after in zip(turns, turns[1:] + [None]):
            if this[2] == "user":
                reply = after[3] if after and after[2] == "assistant" else None
                expected.append((conv, this[1], this[3], reply))
    return sorted(expected, key=lambda r: r[:2])


def test_question_answer_pairs(spark):
    rng = random.Random(3)
    chats = []
    # One conversation holds most turns; numbers have gaps, some are negative.
    for conv, length in [(1, 900), (2, 60), (3, 5), (4, 1)]:
        for turn in sorted(rng.sample(range(-20, 2000), length)):
            role = rng.choice(["user", "assistant", "system", "user", None])
            chats.append((conv, turn, role, None if rng.random() < 0.05 else f"{conv}/{turn}"))
    df = spark.createDataFrame(chats, "conv_id int, turn bigint, role string, text string")
    assert rows_of(m.question_answer_pairs(df), 0, 1) == _pairs(chats)


def test_unreadable_documents(spark):
    df = spark.createDataFrame([(1, '{"id": "m"'), (2, '{"id": "m"}'), (3, None)], "n int, document string")
    flat = m.flatten_messages(df).select("n", "error")
    assert rows_of(flat, 0) == [(1, m.UNREADABLE), (2, None), (3, None)]
    results = m.read_results(df).select("n", "unreadable")
    assert rows_of(results, 0) == [(1, True), (2, False), (3, False)]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        m.flatten_messages(df, "FAILFAST").collect()


def test_columns_that_share_a_name(spark):
    document = _result([{"name": "a"}, {"name": "b"}, {"name": "a"}], [["1", "2", "3"]])
    df = spark.createDataFrame([(document,)], "document string")
    columns = T.StructType([T.StructField(n, T.IntegerType()) for n in ("a", "a", "b", "a")])
    (row,) = m.rows_from_result_documents(df, columns).collect()
    assert tuple(row) == (0, 1, 3, 2, None)


def test_pairs_over_gaps_and_without_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(999)]
    rows += [(1, 10**12, "user", "late")]
    rows += [(None, t, "assistant" if t % 2 else "user", f"n{t}") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {(r[0], r[1]): (r[2], r[3]) for r in m.question_answer_pairs(df.repartition(5)).collect()}
    assert len(got) == 500 + 1 + 150
    assert got[1, 0] == ("t0", "t1")
    assert got[1, 998] == ("t998", None)
    assert got[1, 10**12] == ("late", None)
    assert all(got[None, t] == (f"n{t}", f"n{t + 1}") for t in range(0, 300, 2))


def test_rows_and_rejects_account_for_every_cell(spark):
    document = (
        '{"statement_response": {"manifest": {"schema": {"columns": [{"name": "n"}, {"name": "d"}, {"name": "n"}]}},'
        ' "result": {"data_array": [["1", "2024-01-01", "x"], ["1.5", null, "7"], [null, "soon", "9999999999"]]}}}'
    )
    df = spark.createDataFrame([(1, document), (2, "broken"), (3, None)], "doc int, document string")
    declared = T.StructType(
        [T.StructField("n", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("d", T.DateType())]
    )
    rows = m.rows_from_result_documents(df, declared)
    values = [tuple(r)[2:] for r in rows.orderBy("row_no").collect()]
    assert [[v is not None for v in r] for r in values] == [[True, False, True], [False, True, False], [False] * 3]
    rejects = rows_of(m.rejected_cells(df, declared), 1, 2)
    assert rejects == [
        (1, 0, 1, "n", "x", "int"),
        (1, 1, 0, "n", "1.5", "int"),
        (1, 2, 1, "n", "9999999999", "int"),
        (1, 2, 2, "d", "soon", "date"),
    ]
