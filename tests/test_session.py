from types import SimpleNamespace

import pytest

from vigilake.session import cut_lineage, new_scratch_path, scratch_dir


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, configured=None):
    return SimpleNamespace(sparkContext=Context(master), conf=SimpleNamespace(get=lambda key, default: configured))


def test_the_cluster_names_the_shared_folder():
    assert scratch_dir(session("yarn", "hdfs://shared/x")) == "hdfs://shared/x"
    assert scratch_dir(session("local[2]", "/data/shared")) == "/data/shared"


def test_only_a_local_session_makes_its_own_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(session("yarn"))
    one = session("local[2]")
    assert scratch_dir(one) and scratch_dir(one) == scratch_dir(one)


def test_lineage_is_cut_on_reliable_storage(spark):
    df = cut_lineage(spark.range(10).selectExpr("id * 2 as x"))
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().toString()
    assert new_scratch_path(spark, "a") != new_scratch_path(spark, "a")
