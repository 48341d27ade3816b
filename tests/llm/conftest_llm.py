"""Helpers of these tests."""


def rows_of(docs):
    """(doc_id, text) pairs on the driver, tests only."""
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
