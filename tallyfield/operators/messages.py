"""Stored chats: messages, the query results that belong to them, questions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import beside_ranges, column_named, or_null, ranged

# Parts that may come as an object or as something else are kept as text.
MESSAGE_DOCUMENT = (
    "id string, conversation_id string, status string, error variant, "
    "attachments array<struct<attachment_id: string, text: struct<content: string>, query: string>>, "
    "_unreadable string"
)
QUERY_PART = "id string, query string, description string"
RESULT_DOCUMENT = (
    "statement_response struct<"
    "manifest: struct<schema: struct<columns: array<struct<name: string>>>>, "
    "result: struct<data_array: array<array<string>>>>, _unreadable string"
)
UNREADABLE = "unreadable document"
MESSAGE_COLUMNS = (
    "message_id",
    "conversation_id",
    "status",
    "text_responses",
    "sql_query",
    "query_description",
    "attachment_id",
    "error",
)
# JSON texts of objects, lists, numbers and flags that count as "nothing there".
EMPTY_JSON = ["", "{}", "[]", "false", "0", "null"]


def flatten_messages(messages: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """One row per message `document` (JSON text), its parts as columns.

    The input's column `conversation_id`, where it has one, is the conversation the
    message was asked for in, and goes before the document's own. The query comes from
    the last attachment that carries one. An error that is text is kept as it is; of an
    object its message is, or else all of it. With mode FAILFAST an unreadable document
    stops the job; otherwise that is its error. Other input columns, such as the question,
    are kept.
    """
    kept = _besides(messages, "document", *MESSAGE_COLUMNS)
    known = F.col("conversation_id") if "conversation_id" in messages.columns else F.lit(None)
    parsed = messages.select(
        *kept,
        known.cast("string").alias("_known_conversation"),
        F.from_json("document", MESSAGE_DOCUMENT, _read_as(mode)).alias("_message"),
    )
    queries = F.filter("_message.attachments", lambda a: _present(a["query"]))
    error = F.col("_message.error")
    parts = parsed.select(
        "*",
        _error_text(error).alias("_error"),
        F.filter(
            F.transform("_message.attachments", lambda a: a["text"]["content"]), lambda t: t != ""
        ).alias("_texts"),
        F.try_element_at(queries, F.lit(-1)).alias("_last"),
    ).withColumn("_query", F.from_json("_last.query", QUERY_PART))
    return parts.select(
        *kept,
        F.coalesce("_message.id", F.lit("")).alias("message_id"),
        F.coalesce("_known_conversation", "_message.conversation_id").alias("conversation_id"),
        F.coalesce("_message.status", F.lit("UNKNOWN")).alias("status"),
        F.coalesce("_texts", F.array().cast("array<string>")).alias("text_responses"),
        F.col("_query.query").alias("sql_query"),
        F.col("_query.description").alias("query_description"),
        F.coalesce(or_null(F.col("_query.id")), F.col("_last.attachment_id")).alias("attachment_id"),
        F.when(F.col("_message._unreadable").isNotNull(), UNREADABLE)
        .otherwise(F.col("_error"))
        .alias("error"),
    )


def _read_as(mode: str) -> dict[str, str]:
    return {"mode": mode, "columnNameOfCorruptRecord": "_unreadable"}


def _error_text(error: Column) -> Column:
    """Text of an error that may be text, an object or any other JSON value."""
    as_json = F.to_json(error)
    kind = F.schema_of_variant(error)
    message = F.coalesce(F.try_variant_get(error, "$.message", "string"), as_json)
    text = F.try_variant_get(error, "$", "string")
    return (
        F.when(kind == "STRING", F.when(text != "", text))
        .when(as_json.isin(EMPTY_JSON), None)
        .when(kind.startswith("OBJECT"), message)
        .otherwise(as_json)
    )


def _besides(df: DataFrame, *names: str) -> list[Column]:
    return [column_named(name) for name in df.columns if name not in names]


def _present(part: Column) -> Column:
    return part.isNotNull() & ~part.isin(EMPTY_JSON)


def read_results(documents: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """Parse result documents: `document` gives way to `result_columns`, `result_rows` and
    `unreadable`.

    A column without a name is called col_0, col_1, ... by its position; a document
    without rows has an empty `result_rows`. With mode FAILFAST an unreadable document
    stops the job; otherwise it has no rows and `unreadable` is true.
    """
    kept = _besides(documents, "document")
    parsed = documents.select(
        *kept, F.from_json("document", RESULT_DOCUMENT, _read_as(mode)).alias("_read")
    ).select("*", F.col("_read.statement_response").alias("_response"))
    return parsed.select(
        *kept,
        F.col("_read._unreadable").isNotNull().alias("unreadable"),
        F.transform(
            F.coalesce("_response.manifest.schema.columns", F.array().cast("array<struct<name: string>>")),
            lambda c, i: F.coalesce(c["name"], F.concat(F.lit("col_"), i.cast("string"))),
        ).alias("result_columns"),
        F.coalesce("_response.result.data_array", F.array().cast("array<array<string>>")).alias(
            "result_rows"
        ),
    )


def rows_from_result_documents(documents: DataFrame, columns: T.StructType) -> DataFrame:
    """The rows of all result documents under the given columns, found by name in each document.

    Values arrive as text and are cast to the declared types; what cannot be cast, or is
    not in the document, is NULL. Columns that share a name are taken in their order, so a
    document with `a, a` fills two declared `a`. `row_no` counts from 0 within a document.
    """
    rows, kept = _found_values(documents, columns)
    values = [
        F.col(f"_text_{i}").try_cast(field.dataType).alias(field.name) for i, field in enumerate(columns.fields)
    ]
    return rows.select(*kept, "row_no", *values)


def rejected_cells(documents: DataFrame, columns: T.StructType) -> DataFrame:
    """The values that `rows_from_result_documents` cannot cast, one a line.

    The documents' other columns, `row_no`, `position` of the declared column (from 0), its
    name as `column`, the `text` that is there and the type `wanted`. Together with the rows these
    account for every cell: a NULL among the rows is a value that is not there, or is here.
    """
    rows, kept = _found_values(documents, columns)
    cells = [
        F.when(
            F.col(f"_text_{i}").isNotNull() & F.col(f"_text_{i}").try_cast(field.dataType).isNull(),
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("column"),
                F.col(f"_text_{i}").alias("text"),
                F.lit(field.dataType.simpleString()).alias("wanted"),
            ),
        )
        for i, field in enumerate(columns.fields)
    ]
    return rows.select(*kept, "row_no", F.inline(F.array_compact(F.array(*cells))))


def _found_values(documents: DataFrame, columns: T.StructType) -> tuple[DataFrame, list[Column]]:
    """The rows of all documents with the text of each declared column, `_text_0` and so on, and
    the documents' other columns. Where a column stands is looked up once a document."""
    results = read_results(documents)
    kept = _besides(results, "result_columns", "result_rows", "unreadable")
    names = columns.names

    def place(i: int) -> Column:
        numbered = F.transform("result_columns", lambda c, at: F.when(c == names[i], at))
        return F.get(F.filter(numbered, lambda at: at.isNotNull()), F.lit(names[:i].count(names[i])))

    placed = results.select(*kept, *[place(i).alias(f"_at_{i}") for i in range(len(names))], "result_rows")
    rows = _exploded(placed)
    texts = {
        f"_text_{i}": F.when(F.col(f"_at_{i}").isNotNull(), F.get("row", F.col(f"_at_{i}"))) for i in range(len(names))
    }
    return rows.withColumns(texts), kept


def result_cells(documents: DataFrame) -> DataFrame:
    """The same rows, one value per line and untyped, for documents of any columns."""
    results = read_results(documents)
    kept = _besides(results, "result_columns", "result_rows", "unreadable")
    rows = _exploded(results.select(*kept, "result_columns", "result_rows"))
    cells = rows.select(
        *kept, "row_no", "result_columns", F.posexplode("row").alias("position", "value")
    )
    named = F.coalesce(
        F.get("result_columns", F.col("position")),
        F.concat(F.lit("col_"), F.col("position").cast("string")),
    )
    return cells.select(*kept, "row_no", "position", named.alias("column"), "value")


def _exploded(results: DataFrame) -> DataFrame:
    """One line per result row. The outer form keeps Spark from parsing each document a
    second time, only to test for rows ahead of the explode."""
    kept = _besides(results, "result_rows")
    rows = results.select(*kept, F.posexplode_outer("result_rows").alias("row_no", "row"))
    return rows.where(F.col("row_no").isNotNull())


def chat_history(messages: DataFrame, results: DataFrame) -> DataFrame:
    """Each message with its question and the rows its query returned.

    `messages` as for `flatten_messages`, with a `question`. `results` has the message
    and conversation ids, an `attachment_id` (NULL where the result was asked for by
    message), the `document`, and an `error` where fetching it failed. A message that
    failed, or holds no query, has no result.
    """
    entries = flatten_messages(messages)
    failed = F.coalesce("error", F.when(F.col("unreadable"), UNREADABLE))
    fetched = read_results(results).select(
        F.col("message_id").alias("result_of"),
        F.col("conversation_id").alias("in_conversation"),
        F.col("attachment_id").alias("for_attachment"),
        F.when(failed.isNull(), F.col("result_columns")).alias("result_columns"),
        F.when(failed.isNull(), F.col("result_rows")).alias("result_rows"),
        failed.alias("query_result_error"),
    )
    # Messages without a result are spread by their id, not gathered under a NULL key.
    same = (
        entries.error.isNull()
        & (entries.sql_query != "")
        & (entries.message_id != "")
        & (entries.message_id == fetched.result_of)
        & (entries.conversation_id == fetched.in_conversation)
        & or_null(entries.attachment_id).eqNullSafe(or_null(fetched.for_attachment))
    )
    return entries.join(fetched, same, "left").select(
        "message_id",
        entries.conversation_id,
        "question",
        "text_responses",
        "sql_query",
        "query_description",
        entries.error,
        "result_columns",
        "result_rows",
        "query_result_error",
    )


def question_answer_pairs(chats: DataFrame) -> DataFrame:
    """Every user turn with its direct reply: `conv_id, turn, question, answer`.

    The answer is NULL if the next turn is not the assistant's. `turn` is a whole number,
    unique within a conversation, but may have gaps; turns without a `conv_id` are one
    conversation. All turns are put in order over range partitions, so that a conversation
    of any length is spread over many tasks; the last turn of a range is continued by the
    first one of the next, one row a range. The log goes through one exchange, which both
    the turns and the first ones are read from.
    """
    # Texts of other roles count for nothing, and need not be shuffled.
    said = F.when(F.col("role").isin("user", "assistant"), F.col("text"))
    turns = chats.select("conv_id", "turn", "role", said.alias("text"))
    parts = ranged(turns, [F.col("conv_id"), F.col("turn")], "part")
    row = F.struct("conv_id", "role", "text")
    firsts = parts.groupBy("part").agg(F.min_by(row, F.struct("conv_id", "turn")).alias("first"))
    later = Window.orderBy("part")
    firsts = firsts.select("part", F.lead("first").over(later).alias("opening"))
    within = Window.partitionBy("part").orderBy("conv_id", "turn")
    followed = parts.select("*", F.lead(row).over(within).alias("next"))
    # Partitioned alike, so that the turns stay where they are.
    joined = followed.join(beside_ranges(firsts, "part"), "part", "left")
    after = F.coalesce("next", "opening")
    replied = after["conv_id"].eqNullSafe(F.col("conv_id")) & (after["role"] == "assistant")
    return joined.where(F.col("role") == "user").select(
        "conv_id",
        "turn",
        F.col("text").alias("question"),
        F.when(after.isNotNull() & replied, after["text"]).alias("answer"),
    )
