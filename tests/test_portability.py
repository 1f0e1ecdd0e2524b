"""Where shared files go, what is removed, and how the library reaches workers."""

import builtins
import importlib
import os

import pytest

import __spark_entry__
from tessera import session
from tessera.sources.files import get_text


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Context:
    def __init__(self, master):
        self.master, self.where = master, None

    def getCheckpointDir(self):
        return self.where

    def setCheckpointDir(self, where):
        self.where = where


class Session:
    def __init__(self, master, **conf):
        self.conf, self.sparkContext = Conf(conf), Context(master)


def test_the_shared_folder():
    named = Session("yarn", **{"spark.checkpoint.dir": "hdfs://x/cp/"})
    assert session.checkpoint_dir(named) == "hdfs://x/cp"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session("spark://host:7077"))
    local = Session("local[4]")
    assert session.checkpoint_dir(local) == session.checkpoint_dir(local) and os.path.isdir(session.checkpoint_dir(local).removeprefix("file://"))


def test_intermediates_are_removed(spark):
    session.cleanup(spark)
    spark.range(3).write.parquet(kept := session.shared_path(spark, "a"))
    with session.scratch(spark):
        spark.range(3).write.parquet(gone := session.shared_path(spark, "b"))
        spark.range(3).write.parquet(forever := session.shared_path(spark, "c", keep=True))
        assert spark.read.parquet(gone).count() == 3
    assert spark.read.parquet(kept).count() == spark.read.parquet(forever).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(gone)
    assert session.cleanup(spark) == 1 and session.cleanup(spark) == 0
    assert get_text(spark, f"{kept}/_SUCCESS") is None


def test_other_missing_modules_are_not_hidden(monkeypatch):
    real = builtins.__import__

    def without(name):
        def fake(n, *a, **k):
            if n.split(".")[0] == name:
                raise ModuleNotFoundError(f"No module named '{name}'", name=name)
            return real(n, *a, **k)

        return fake

    monkeypatch.setattr(builtins, "__import__", without("corpus_pipeline"))
    assert importlib.reload(__spark_entry__).llm is None and "labels_zscore" in __spark_entry__.queries()
    monkeypatch.setattr(builtins, "__import__", without("zipfile"))
    with pytest.raises(ModuleNotFoundError):
        importlib.reload(__spark_entry__)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
