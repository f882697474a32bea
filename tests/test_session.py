import os

from proselake import session as S


def test_materialize_and_drop(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    kept = S.materialize(df)
    assert kept.count() == 10 and kept.dtypes == df.dtypes
    folder = S.app_folder(spark).replace("file://", "")
    assert os.path.isdir(folder)
    S.drop_materialized(spark)
    assert not os.path.exists(folder)


def test_broadcast_only_when_small(spark):
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(S.broadcast_if_small(spark.range(5), 5)).lower()
    assert "broadcast" not in plan(S.broadcast_if_small(spark.range(6), 5)).lower()


def test_spread(spark):
    assert S.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() >= 4
    many = spark.range(10, numPartitions=20)
    assert S.spread(many) is many
