"""Where intermediate tables are written, and when a scan is spread."""

import pytest

from quire.operators.skew import cut_lineage
from quire.session import shared_folder, spread


def test_the_shared_folder_of_the_cluster_is_used(spark, tmp_path, monkeypatch):
    settings = {"spark.checkpoint.dir": f"file:{tmp_path}/shared"}

    class Conf:
        def get(self, key, default=None):
            return settings.get(key, default)

    monkeypatch.setattr(type(spark), "conf", property(lambda self: Conf()))
    folder = shared_folder(spark, "x")
    assert folder.startswith(f"file:{tmp_path}/shared/x-")
    assert folder != shared_folder(spark, "x")
    assert cut_lineage(spark.range(5), "y").count() == 5
    assert [p.name[:2] for p in (tmp_path / "shared").iterdir()] == ["y-"]


def test_only_short_scans_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread(one, "id").rdd.getNumPartitions() == 4
    spark.range(100).repartition(8).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert spread(many, "id") is many


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr("quire.session.CHECKPOINT_CONF", "spark.not.set")
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://head:7077")
    with pytest.raises(RuntimeError, match="all machines share"):
        shared_folder(spark, "x")
