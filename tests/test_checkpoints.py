import types

import pytest

from trackloom.operators import checkpoints


def session(master, named):
    held = {"dir": None}
    context = types.SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: held["dir"],
        setCheckpointDir=lambda d: held.update(dir=d),
        getConf=lambda: {"spark.checkpoint.dir": named} if named else {},
    )
    return types.SimpleNamespace(sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            checkpoints.ensure_checkpoint_dir(session(master, None))
        assert checkpoints.ensure_checkpoint_dir(session(master, "hdfs:///c")) == "hdfs:///c"
    assert checkpoints.ensure_checkpoint_dir(session("local[4]", None))
    assert checkpoints.ensure_checkpoint_dir(session("local", "/shared")) == "/shared"
