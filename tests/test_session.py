from types import SimpleNamespace

from cardlake import session


def fake_spark(conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)))


def test_shared_folder_of_the_cluster_is_used():
    conf = {"spark.checkpoint.dir": "s3a://bucket/shared/", "spark.sql.warehouse.dir": "/warehouse"}
    assert session._shared_dir(fake_spark(conf)) == "s3a://bucket/shared"


def test_without_it_scratch_lies_below_the_warehouse():
    assert session._shared_dir(fake_spark({"spark.sql.warehouse.dir": "file:/warehouse"})) == "file:/warehouse/_scratch"


def test_scratch_folders_are_new_and_below_the_shared_one(spark):
    first, second = session.scratch_dir(spark, "x"), session.scratch_dir(spark, "x")
    assert first != second
    assert first.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_checkpoints_work(spark):
    session.ensure_checkpoint_dir(spark)
    assert spark.range(3).checkpoint().count() == 3
