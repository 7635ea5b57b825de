import pytest

from sparkgrove import session
from sparkgrove.sources import store


def test_versions_replace_each_other(spark, tmp_path):
    path = f"{tmp_path}/catalog"
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)
    store.save(spark.range(3), path)
    store.save(store.load(spark, path).filter("id > 0"), path)  # reads what it replaces
    assert {r.id for r in store.load(spark, path).collect()} == {1, 2}
    assert store.clean(spark, path) == 1
    assert store.load(spark, path).count() == 2
    assert store.drop(spark, path) and not store.drop(spark, path)


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    path = f"{tmp_path}/catalog"
    store.save(spark.range(3), path)
    broken = spark.range(3).selectExpr("assert_true(id < 0) as x")
    with pytest.raises(Exception):
        store.save(broken, path)
    assert store.load(spark, path).count() == 3
    store.save(spark.range(5), path)
    assert store.load(spark, path).count() == 5 and store.clean(spark, path) == 2


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
