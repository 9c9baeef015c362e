import pytest

from faultfold.llm.common import table


@pytest.fixture(scope="session")
def read(spark, data):
    return lambda name: table(spark, data, name)


@pytest.fixture
def frame(spark):
    """Documents from texts, with ids from 1 on and a column whose name clashes with results."""

    def make(texts, ids=None):
        rows = [
            (i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t), "own")
            for i, t in zip(ids or range(1, len(texts) + 1), texts)
        ]
        schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
        return spark.createDataFrame(rows, schema)

    return make
