"""The shared folder: named by the session, made only where the master is local."""

from types import SimpleNamespace

import pytest

from skylattice import session


def fake(master, named=None, already=None):
    calls = []
    sc = SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": named} if named else {}, getCheckpointDir=lambda: already, setCheckpointDir=calls.append)
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: d)), calls


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_the_folder(master):
    for f in (session.ensure_checkpoint_dir, lambda s: session.shared_dir(s, "x")):
        with pytest.raises(RuntimeError):
            f(fake(master)[0])
        spark, calls = fake(master, "hdfs://shared/dir/")
        f(spark)
        assert calls == ["hdfs://shared/dir"]
    assert session.shared_dir(fake(master, "hdfs://shared/dir")[0], "x").startswith("hdfs://shared/dir/x-")


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4]"])
def test_a_local_session_gets_one(master):
    spark, calls = fake(master)
    session.ensure_checkpoint_dir(spark)
    assert calls[0].startswith("file:///")
