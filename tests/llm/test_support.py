"""Names, folders and memory that the operators share."""

from types import SimpleNamespace

import pytest

from redgreen.llm import support


def session(master, named=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            support.shared_dir(session(master))
        assert support.shared_dir(session(master, "s3://bucket/tmp/")) == "s3://bucket/tmp"
    assert support.shared_dir(session("local[8]"))


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "_k1 int, _K1_ int, x int")
    assert support.fresh(df, "_k1", "_k1", "X", "y") == ["_k1__", "_k1___", "X_", "y"]


def test_tidy_passes_batches_and_releases(monkeypatch):
    calls = []
    monkeypatch.setattr(support, "release", lambda: calls.append(1))

    @support.tidy
    def run(batches):
        for b in batches:
            yield b + 1

    got = run(iter([1, 2]))
    assert next(got) == 2 and calls == []
    assert list(got) == [3] and calls == [1]
