import pytest

LONG = " ".join(f"w{i % 997}" for i in range(20_000))

#: Nulls, empty and blank texts, ties, copies, one very long text.
ROWS = [
    (1, "The cat sat on the mat. " * 4 + "\nA line\nA line\n", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, " \t\n ", "en", None),
    (5, LONG, "en", "a"),
    (6, LONG, "en", "b"),
    (7, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "de", None),
    (8, "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen", "de", None),
    (9, "Ümläut 漢字 ½ — end", "de", "c"),
    (None, "a row without an id", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with all the odd cases, a repeated row, and extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([*ROWS, ROWS[6]], SCHEMA)
    return rows.withColumns({c: F.lit(7) for c in ("key", "size", "ident", "n", "hash", "start", "label", "row", "u", "word", "score")})


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
