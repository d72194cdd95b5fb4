from types import SimpleNamespace

import pytest

from quarry.llm.staging import folder


class Conf(dict):
    def set(self, key, value):
        self[key] = value


def session(master, **conf):
    return SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_must_name_the_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            folder(session(master))
        assert folder(session(master, **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"


def test_a_local_session_gets_one_folder():
    spark = session("local[4]")
    assert folder(spark).startswith("file://") and folder(spark) == folder(spark)
