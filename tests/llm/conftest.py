import pytest

EXTRA = "doc_id long, text string, score double, rules string, dedup int, lang_pred string, hits int, row long, cls long, place int, dedup_spans int, dedup_row int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows and ids, one long text, and columns with names that operators use."""
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(40)) + "." for i in range(1500))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (None, "one two"), (5, long), (6, long),
            (7, "single"), (None, None), (8, "日本語 текст ßé 12")]
    return spark.createDataFrame([(i, t, 0.5, "r", 1, "xx", 2, 3, 4, 5, 6, 7) for i, t in rows], EXTRA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    """Labels of the larger table: the smallest one has too few to learn from."""
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="session")
def more(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
