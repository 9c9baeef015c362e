import pytest

from faultfold.session import materialize, shared_folder, use_shared_folder


class Fake:
    """Just enough of a session to ask for its folder."""

    def __init__(self, master, folder=None):
        self.sparkContext = self
        self.conf = self
        self.master = master
        self.folder = folder
        self.applicationId = f"{master}-{folder}"

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.folder or default


def test_folder_of_the_session_is_used():
    assert shared_folder(Fake("spark://x", "hdfs://y/z/")) == "hdfs://y/z"


def test_a_missing_folder_is_an_error():
    for master in ("local[2]", "yarn"):
        with pytest.raises(RuntimeError):
            shared_folder(Fake(master))


def test_a_folder_can_be_named():
    session = Fake("local[3]")
    use_shared_folder(session, "hdfs://a/b/")
    assert shared_folder(session) == "hdfs://a/b"
    assert shared_folder(Fake("local[3]", "hdfs://y")) == "hdfs://y"


def test_materialize_cuts_the_plan(spark):
    df = spark.range(10).selectExpr("id", "id % 3 as k").groupBy("k").count()
    stored = materialize(df, "test")
    assert sorted(stored.collect()) == sorted(df.collect())
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Aggregate" not in plan
