import base64

from tallyfield.operators import preview as p

from row_helpers import rows_of

LONG = bytes(range(256))


def _mixed(spark):
    return spark.createDataFrame(
        [
            (1, bytearray(LONG), [bytearray(b"x")], (7, None), {"k": 1}, ["a"], ("n",)),
            (2, None, None, None, None, None, None),
        ],
        "id int, body binary, parts array<binary>, facts struct<a: int, b: string>, "
        "tags map<string, int>, words array<string>, odd struct<myBinaryName: string>",
    )


def test_binary_columns_are_left_out(spark):
    df = _mixed(spark)
    assert p.shown_columns(df.schema) == ["id", "facts", "tags", "words"]
    assert rows_of(p.preview(df, order_by=["id"])) == [
        (1, '{"a":7,"b":null}', '{"k":1}', ["a"]),
        (2, None, None, None),
    ]


def test_binary_columns_on_request(spark):
    df = _mixed(spark).select("id", "body", "parts")
    rows = rows_of(p.preview(df, exclude_binary=False, order_by=["id"]))
    assert rows[0][1] == base64.b64encode(LONG).decode()
    assert rows[0][2] == [b"x"]
    assert rows[1] == (2, None, None)


def test_table_of_binaries_is_shown_whole(spark):
    df = _mixed(spark).select("body", "parts")
    assert p.shown_columns(df.schema) == ["body", "parts"]
    assert p.preview(df).columns == ["body", "parts"]


def test_number_of_rows(spark):
    df = spark.range(1000).withColumnRenamed("id", "odd `name`.with dot")
    assert p.preview(df).count() == 100
    assert p.preview(df, 10).count() == 10
    assert p.preview(df, 5000).count() == 1000


def test_empty_result_keeps_its_columns(spark):
    assert p.preview(_mixed(spark).where("false")).columns == ["id", "facts", "tags", "words"]


def test_concat_batches(spark):
    a = spark.createDataFrame([(1, "x")], "n int, t string")
    b = spark.createDataFrame([("y", 1), ("x", 1)], "t string, n int")
    assert sorted(rows_of(p.concat_batches([a, b, a]))) == [(1, "x"), (1, "x"), (1, "x"), (1, "y")]
