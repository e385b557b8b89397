import os

import pytest
from pyspark.sql import functions as F

from seqloom.operators.statistics import cumulative, picked
from seqloom.plans.spread import spread
from seqloom.plans.stages import Stages, shared_folder


def test_stage_tables_are_counted_read_back_and_deleted(spark):
    stages = Stages(spark, "test")
    assert stages.root.startswith(shared_folder(spark))
    table, n = stages.cut_counted(spark.range(10).withColumn("k", F.col("id") % 2), "ten", F.col("k") == 1)
    assert n == 5 and table.count() == 10
    path = table._stage_path
    assert os.path.isdir(path.removeprefix("file://"))
    stages.drop(table)
    assert not os.path.exists(path.removeprefix("file://"))
    empty, n = stages.cut_counted(spark.range(0), "none")
    assert n == 0 and empty.count() == 0


def test_a_cut_leaves_the_session_as_it_was(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with pytest.raises(Exception):
        Stages(spark, "test").cut(spark.range(1).select(F.raise_error(F.lit("no"))), "bad")
    assert spark.conf.get(key) == before


def test_spread_keeps_groups_together_in_many_tasks(spark):
    df = spread(spark.range(100).withColumn("g", F.col("id") % 20), 20, 2, "g")
    assert df.rdd.getNumPartitions() == 10
    assert df.withColumn("p", F.spark_partition_id()).groupBy("g").agg(F.count_distinct("p").alias("n")).where("n > 1").count() == 0


def test_cumulative_probabilities_and_draws(spark):
    v = spark.createDataFrame([(i, float(i % 4)) for i in range(40)], "id int, w double")
    c = cumulative(v, "w", "id")
    got = [(r.share, r.cumulative) for r in c.orderBy("id").collect()]
    total, run = sum(i % 4 for i in range(40)), 0
    for i, (share, cum) in enumerate(got):
        run += i % 4
        assert share == pytest.approx(i % 4 / total) and cum == pytest.approx(run / total)
    draws = spark.range(200).select(F.col("id").alias("d"), ((F.col("id") + 0.5) / 200).alias("u"))
    p = picked(c, draws, "id")
    assert p.count() == 200 and p.where("id % 4 = 0").count() == 0


def test_valves_and_cores(spark):
    from seqloom.plans.guards import Valve, usable_cores

    v = Valve(steps=3, unchanged=2)
    assert [v.step() for _ in range(3)] == [1, 2, 3]
    with pytest.raises(RuntimeError, match="more than 3 steps. here"):
        v.step("here")
    v = Valve(unchanged=2)
    for x in (1, 1, 2, 2):
        v.seen(x)
    with pytest.raises(RuntimeError, match="without a change"):
        v.seen(2)
    assert usable_cores(spark) == spark.sparkContext.defaultParallelism - 2  # local[4]


def test_scratch_is_gone_but_for_what_is_saved(spark, tmp_path):
    from seqloom.plans.stages import Scratch

    with Scratch(spark) as s:
        spark.range(3).write.parquet(s.file("three"))
        s.save("three", f"{tmp_path}/kept/three")
        with pytest.raises(FileExistsError):
            s.save("three", f"{tmp_path}/kept/three")
    assert not os.path.exists(s.path.removeprefix("file://"))
    assert spark.read.parquet(f"{tmp_path}/kept/three").count() == 3


def test_more_partitions_for_a_step_only(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    out = Stages(spark, "test").cut(spark.range(100).groupBy("id").count(), "many", partitions=int(before) * 3)
    assert spark.conf.get(key) == before and out.count() == 100
