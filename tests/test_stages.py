import pytest

from pageloom.sources.pages import read_pages
from pageloom.sources.stages import SETTING, Stages, partitions_for, shared_folder


def test_partitions_follow_the_files(spark):
    pages = read_pages(spark, "/root/testdata/sf0.001/pages.parquet")
    assert partitions_for(pages) == spark.sparkContext.defaultParallelism
    unknown = spark.createDataFrame(spark.sparkContext.parallelize([(1, "a")]), "page_id long, html string")
    assert partitions_for(unknown) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_partitions_hold_few_bytes_of_pages(spark):
    # Up to 200 bytes of a task's memory for each byte of page files: 4 MB of them are well below the memory of a task.
    cores = spark.sparkContext.defaultParallelism
    pages = spark.range((cores + 3) * (4 << 20) // 8)
    assert partitions_for(pages) >= cores + 3


class Unset:
    """A session without the setting."""

    def __init__(self, spark, master="local[1]"):
        self.conf = self
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-test"})

    def get(self, key, default):
        return default


def test_shared_folder(spark):
    given = spark.conf.get(SETTING, None)
    assert given is None or shared_folder(spark) == given
    assert shared_folder(Unset(spark)) == shared_folder(Unset(spark))
    with pytest.raises(ValueError):
        shared_folder(Unset(spark, "yarn"))


def test_stage_keeps_rows_and_clustering(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("pageloom.sources.stages.shared_folder", lambda spark: str(tmp_path))
    stages = Stages(spark, 3)
    kept = stages.keep(spark.range(100).selectExpr("id as page_id", "id % 7 as v"), "some")
    counts = kept.groupBy("page_id").count()
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert counts.count() == 100
    assert len(list((tmp_path / "pageloom" / stages.run / "some").glob("*.parquet"))) == 3
    stages.release()
    assert not stages.tables
    assert not (tmp_path / "pageloom" / stages.run).exists()
