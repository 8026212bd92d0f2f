"""The shared folder."""

from types import SimpleNamespace

import pytest

from rostra.llm.common import shared_dir


def session(master, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d), set=lambda k, v: conf.update({k.replace(".", "_"): v})), sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["spark://a:7077", "yarn", "local-cluster[3,2,1024]", "k8s://a"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(RuntimeError):
        shared_dir(session(master))
    assert shared_dir(session(master, spark_checkpoint_dir="hdfs://a/b/")) == "hdfs://a/b"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4]"])
def test_one_process_makes_its_own_once(master):
    s = session(master)
    first = shared_dir(s)
    assert first.startswith("file:///") and shared_dir(s) == first


def test_the_driver_gives_memory_back_where_its_jvm_can(spark):
    from rostra.llm.common import trim_driver

    major, _, update = map(int, (spark._jvm.java.lang.System.getProperty("java.version").split(".") + ["0", "0"])[:3])
    on_linux = spark._jvm.java.lang.System.getProperty("os.name") == "Linux"
    assert trim_driver(spark) == (on_linux and (major, update) >= (17, 9))
    assert not trim_driver(spark, "noSuchCommand")
