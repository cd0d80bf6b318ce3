import pytest

from cuemill.llm import common


class Session:
    """A session's settings alone."""

    def __init__(self, **settings):
        self.settings = {k.replace("__", "."): v for k, v in settings.items()}
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value


def test_shared_folders():
    """The cluster's folder is taken, a local session gets one, and a cluster without one is refused."""
    given = Session(spark__master="spark://host:7077", spark__checkpoint__dir="hdfs://x/shared/")
    assert common.shared_dir(given).startswith("hdfs://x/shared/cuemill-") and common.shared_dir(given) != common.shared_dir(given)
    local = Session(spark__master="local[8]")
    assert common.shared_dir(local).startswith(local.settings["spark.checkpoint.dir"])
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(Session(spark__master=master))


def test_master_is_seen(spark):
    assert spark.conf.get("spark.master", "").startswith("local[")
