import pytest


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def awkward(frame):
    """Nulls, empty and long texts, repeated rows, and columns with names that
    the operators use themselves."""
    long = " ".join(f"w{i % 997} x{i % 31}" for i in range(30_000))
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (None, "one two"),
            (None, None), (4, "  \t\n "), (5, long), (6, long), (7, "é" * 3000), (8, "a" * 2000), (9, "a " * 700),
            (10, "Mail a.b@example.org or +1 (555) 123-4567, 10.0.0.1"), (10, "other text of the same id")]
    schema = ("doc_id long, text string, id string, th string, key string, n string, node string, hits string, doc string, "
              "bucket string, own string, block string, item string, lang string, "
              "__id string, __good string, __th string, __key string, __log_importance string, __long string, __label_id string")
    return frame([(*r, *["x"] * 19) for r in rows], schema)
