import types

import pytest

from arborinfo import lineage


class FakeSession:
    """A session with a chosen master and checkpoint setting."""

    def __init__(self, master, folder=None):
        self.sparkContext = types.SimpleNamespace(master=master, applicationId=f"app-{master}")
        self.conf = types.SimpleNamespace(get=lambda key, default=None: folder or default)


def test_shared_folder_comes_from_the_session():
    assert lineage.shared_dir(FakeSession("yarn", "hdfs:///tmp/cp")) == "hdfs:///tmp/cp"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_dir(FakeSession("yarn"))
    local = FakeSession("local[2]")
    assert lineage.shared_dir(local) == lineage.shared_dir(local)


def test_small_and_large_tables_settle_alike(spark):
    df = spark.range(100).selectExpr("id", "array(id, null) as a", "struct(id as x) as s", "'t' as t")
    small, large = lineage.settle(df), lineage.settle(df, rows=10)
    assert small.schema.simpleString() == large.schema.simpleString() == df.schema.simpleString()
    key = lambda d: sorted(map(str, d.collect()))
    assert key(small) == key(large) == key(df)
    assert len(large.inputFiles()) > 0 and not small.inputFiles()
