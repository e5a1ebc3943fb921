"""Rows of a DataFrame in forms that tests compare."""


def rows_of(df, *order):
    found = [tuple(row) for row in df.collect()]
    return found if not order else sorted(found, key=lambda row: [row[i] for i in order])


def as_set(df):
    found = [tuple(row) for row in df.collect()]
    assert len(found) == len(set(found))
    return set(found)
