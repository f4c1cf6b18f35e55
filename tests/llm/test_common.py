from types import SimpleNamespace

import pytest

from equiflow.llm import common as C


def session(master, named=None, already=None):
    state = {"dir": already}
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: state["dir"], setCheckpointDir=lambda x: state.update(dir=x))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: named))


def test_a_named_folder_is_used_everywhere():
    for master in ("local[8]", "yarn", "local-cluster[3,2,1024]"):
        s = session(master, "hdfs://x/shared/")
        assert C.shared_folder(s, "a").startswith("hdfs://x/shared/a-") and s.sparkContext.getCheckpointDir() == "hdfs://x/shared/"


def test_no_machine_local_folder_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            C.checkpoint_folder(session(master))
    assert C.checkpoint_folder(session("yarn", already="s3://set")) == "s3://set"
    for master in ("local", "local[*]", "local[8]"):
        assert C.checkpoint_folder(session(master))
