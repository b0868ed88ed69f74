"""Where intermediate tables lie."""

from types import SimpleNamespace

import pytest

from quernel import workspace


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda k: folder)
    none = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(applicationId=f"app-{master}-{folder}", master=master, getConf=lambda: conf, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    return SimpleNamespace(sparkContext=sc)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[3,2,1000]"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(ValueError, match="checkpoint"):
        workspace.shared_dir(fake(master))


def test_folders(spark):
    assert workspace.shared_dir(fake("yarn", "hdfs:///shared/")).startswith("hdfs:///shared/quernel-")
    assert workspace.shared_dir(fake("local[4]")).startswith("file:///")


def test_spread_follows_the_bytes(spark, monkeypatch):
    df = spark.range(100_000).selectExpr("id", "repeat('x', 100) AS t")
    few = workspace.spread(df).rdd.getNumPartitions()
    monkeypatch.setattr(workspace, "SPREAD_BYTES", 1 << 14)
    assert workspace.spread(df, "id").rdd.getNumPartitions() > few >= 3 * spark.sparkContext.defaultParallelism


def test_spread_of_rows_of_unknown_size(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string")
    assert workspace.spread(df, "i").rdd.getNumPartitions() < 1000
