from types import SimpleNamespace

import pytest

from vitalstrand.session import shared_dir, stage


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, named=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=Context(master))


def test_named_folder_is_used():
    assert shared_dir(session("yarn", "hdfs://shared/dir/")) == "hdfs://shared/dir"


def test_cluster_without_a_folder_is_an_error():
    with pytest.raises(RuntimeError):
        shared_dir(session("yarn"))


def test_local_master_gets_one_folder():
    s = session("local[2]")
    assert shared_dir(s) == shared_dir(s) == s.sparkContext.folder


def test_stage_cuts_lineage(spark):
    staged = stage(spark.range(10).where("id > 3"), "t")
    assert staged.count() == 6
    assert "Range" not in staged._jdf.queryExecution().optimizedPlan().toString()
