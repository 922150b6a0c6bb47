import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, idx int, rank string, r long"

LONG = "\n".join(f"line {i} of a very long text that goes on and on {i * 7919 % 1013}" for i in range(3000))
PROSE = "The quick brown fox jumps over the lazy dog while seven wise owls watch the river flow past the old mill and count the boats that pass below the bridge each day"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, rows that repeat, extra columns with clashing names."""
    rows = [(1, PROSE), (2, PROSE), (2, PROSE), (3, PROSE + " today"), (4, None), (5, ""), (6, " \n\t "), (7, LONG), (8, LONG), (None, PROSE), (None, None), (9, "a"), (10, "A"), (11, "é è ñ"), (12, "12 34"), (13, "x" * 100_000)]
    return spark.createDataFrame([(i, t, None if (i or 0) % 3 == 0 else "en", None, len(t) if t else None, 7, 3, "x", None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 14)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
