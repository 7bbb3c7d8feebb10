"""What must hold at any size: results don't depend on partitioning, hot keys don't meet in one group, plans stay lean."""

import re
import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelspark.operators.grid import regular_grid
from panelspark.operators.rolling import trailing_totals
from panelspark.operators.spikes import flag_readings
from panelspark.plans.lineage import cut

TABLES = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_trailing", "p5_found", "p6_found", "p7_grid", "screen_top", "pbo", "cov_sample", "sig_ic"])
def test_results_do_not_depend_on_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = entry.queries()[name](spark, TABLES).collect()
            got.append(sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_a_hot_source_shrinks_before_the_shuffle(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.range(60_000).select(F.lit("HOT").alias("symbol"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 50).cast("int")).alias("date"), (F.col("id") % 50 + 1.0).alias("close"), F.lit(at).alias("loaded_at"))
    assert flag_readings(rows).count() == 50
    assert trailing_totals(rows).count() == 50
    for df in (flag_readings(rows), trailing_totals(rows)):
        plan = _plan(df)
        assert plan.rindex("Aggregate") > plan.rindex("Exchange"), "rows are to be combined before they are exchanged"
    marks = rows.select("symbol", F.lit(1).alias("feed_id"), F.col("date").cast("timestamp").alias("date"), "close")
    assert regular_grid(marks, spark.createDataFrame([(1, 60)], "feed_id int, grid_s int")).count() == 50


def test_only_needed_columns_are_read_and_filters_reach_the_scan(spark):
    plan = _plan(entry.queries()["p4_found"](spark, TABLES))
    scan = plan[plan.index("ReadSchema") :].splitlines()[0]
    assert "vendor" not in scan and "loaded_at" not in scan and "IsNotNull(date)" in plan
    assert "ArrowEvalPython" not in plan and "PythonUDF" not in plan


def test_checkpoints_are_reliable(spark):
    df = cut(spark.range(10).withColumn("x", F.col("id") * 2))
    assert spark.sparkContext.getCheckpointDir() and df.agg(F.sum("x")).first()[0] == 90
    assert "Scan ExistingRDD" in _plan(df)


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace as Any

    from panelspark.plans.lineage import ensure_checkpoint_dir

    made = []
    session = lambda master, folder: Any(conf=Any(get=lambda *_: folder), sparkContext=Any(master=master, getConf=lambda: {}, getCheckpointDir=lambda: None, setCheckpointDir=made.append))
    ensure_checkpoint_dir(session("spark://host:7077", "hdfs://shared"))
    ensure_checkpoint_dir(session("local[4]", None))
    assert made[0] == "hdfs://shared" and "panelspark-checkpoint-" in made[1]
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(session("spark://host:7077", None))


def test_building_the_pipeline_queries_starts_no_job(spark):
    import __spark_entry__

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "no job")
    try:
        for name, build in __spark_entry__.queries().items():
            if re.match(r"p\d+_", name):
                build(spark, "/root/testdata/sf0.001")
        jobs = tracker.getJobIdsForGroup("building")
        # reading the schema of a Parquet file is a job of its own
        assert all(tracker.getJobInfo(j) is None or len(tracker.getJobInfo(j).stageIds) == 1 for j in jobs)
        names = {tracker.getStageInfo(s).name.split(" at ")[0] for j in jobs if tracker.getJobInfo(j) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)}
        assert names <= {"parquet"}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
