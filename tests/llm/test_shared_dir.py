"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from corpusloom.llm import common


def session(master, setting):
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)), setCheckpointDir=lambda path: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=context)


def test_a_cluster_names_its_shared_folder():
    assert common.shared_dir(session("spark://h:7077", "hdfs://h/c")) == "hdfs://h/c"
    assert common.shared_dir(session("local[2]", None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session("spark://h:7077", None))
