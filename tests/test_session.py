"""Checkpoint-folder rules and sizing (no cluster needed: stub session objects)."""

from __future__ import annotations

import pytest

from caseload.session import checkpoint_dir, scale_settings


class _Conf:
    def __init__(self, values):
        self.values = dict(values)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _SC:
    def __init__(self, master, ckpt=None):
        self.master, self.ckpt = master, ckpt

    def getCheckpointDir(self):
        return self.ckpt

    def setCheckpointDir(self, path):
        self.ckpt = path


class _Spark:
    def __init__(self, master, conf=(), ckpt=None):
        self.sparkContext = _SC(master, ckpt)
        self.conf = _Conf(conf)


def test_cluster_without_checkpoint_dir_raises():
    with pytest.raises(RuntimeError):
        checkpoint_dir(_Spark("yarn"))


def test_cluster_setting_is_used():
    spark = _Spark("k8s://api", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert checkpoint_dir(spark) == "hdfs:///shared/ckpt"


def test_local_gets_scratch_folder():
    spark = _Spark("local[8]")
    path = checkpoint_dir(spark)
    assert path and spark.sparkContext.getCheckpointDir() == path


def test_scale_settings_sizes_by_families():
    conf = scale_settings(10_000_000_000, 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) % 8000 == 0
    assert int(conf["spark.sql.shuffle.partitions"]) >= 10_000_000_000 * 256 // (128 << 20)
    assert scale_settings(100, 8)["spark.sql.shuffle.partitions"] == "16"
