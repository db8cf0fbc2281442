"""Written tables: where they are, and that only they are deleted."""

import os
import shutil
import uuid

import pytest

from tickweave import workspace


def folders(spark):
    root = workspace.shared_root(spark).split(":", 1)[-1]
    return set(os.listdir(root))


def test_only_written_tables_are_deleted(spark):
    given_name = f"an-input-{uuid.uuid4().hex}"  # the folder may be one that other runs use too
    path = f"{workspace.shared_root(spark)}/{given_name}"
    spark.range(5).write.parquet(path)
    given = spark.read.parquet(path)
    written = workspace.materialise(given.join(workspace.materialise(spark.range(3), "small"), "id"), "joined")
    mine = written.inputFiles()[0].rsplit("/", 2)[1]
    assert {given_name, mine} <= folders(spark)
    workspace.drop_tables(given.join(written, "id"), None)
    assert mine not in folders(spark) and given_name in folders(spark)
    assert given.count() == 5
    shutil.rmtree(path.split(":", 1)[-1])


def test_shuffle_files_setting_is_given_back(spark):
    key = workspace._CLEANUP
    before = spark.conf.get(key, "false")
    with workspace.shuffles_removed(spark):
        with workspace.shuffles_removed(spark):
            assert spark.conf.get(key) == "true"
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return None

    class Undefined:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        class _jsc:
            @staticmethod
            def sc():
                class Inner:
                    def getCheckpointDir(self):
                        return Undefined()

                return Inner()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_root(Session())


def test_a_counted_table_is_written_by_few_tasks(spark, monkeypatch):
    parts = lambda df: len(df.inputFiles())
    many = spark.range(0, 3000, 1, 200)
    most = 2 * spark.sparkContext.defaultParallelism
    counted = workspace.materialise(many, "counted", rows=3000)
    assert parts(counted) == most and counted.count() == 3000
    monkeypatch.setattr(workspace, "FILE_ROWS", 100)
    longer = workspace.materialise(many, "longer", rows=3000)
    assert parts(longer) == max(most, 30) and sorted(r.id for r in longer.collect()) == list(range(3000))
    assert parts(workspace.materialise(spark.range(0, 10, 1, 3), "few", rows=3000)) == 3
    workspace.drop_tables(counted, longer)
