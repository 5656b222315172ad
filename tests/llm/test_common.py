import os
import types

import pytest

from quire.llm import common


def test_a_cluster_must_name_its_shared_folder():
    conf = types.SimpleNamespace(get=lambda key, default: None)
    context = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(types.SimpleNamespace(conf=conf, sparkContext=context))


def test_staged_tables_go(spark):
    df = common.staged(spark.range(3), "some")
    path = df.staged_at.removeprefix("file://")
    assert os.path.isdir(path) and df.count() == 3
    common.release(df, spark.range(2))
    assert not os.path.exists(path)


def test_the_callers_batch_size_stays(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "1000000")
        assert common.mapped(spark.range(3), lambda batches: batches, "id long").count() == 3
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.set(key, before)


def test_tasks_follow_the_tables(spark, tmp_path):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.range(200_000).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").where("id > 3")
    assert common.tasks_for(df, 1 << 40) == least
    assert common.tasks_for(df, 10_000) > 10 * least
    assert common.tasks_for(df.join(df.withColumnRenamed("id", "k"), df.id == 1, "left"), 1) == least
    assert common.tasks_for(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a int"), 1 << 40) == least
