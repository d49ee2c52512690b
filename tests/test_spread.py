"""No task holds more rows than its share, however few bytes they take in a shuffle."""

import re

import pytest
from pyspark.sql import functions as F

import huestrata as hs
from huestrata.catalog.days import QUERIES
from huestrata.operators import spread
from huestrata.operators.columns import long_histogram
from huestrata.operators.images import pick_first_image, pick_first_in_file
from huestrata.operators.windows import slide_days
from huestrata.sources import tables
from tests.helpers import green_row, histogram, hue_row

HOURS = {9: "0.5", 10: "0.5"}
DAYS, BINS = 60, 10
CELLS = {(0, 9): "0.5", (1, 10): "0.5"}


@pytest.fixture
def hist(spark):
    rows = [
        row(year, day, hour, b, day * b + hour, camera=f"c{camera}")
        for row in (hue_row, green_row)
        for camera in range(4)
        for year in (2011, 2012)
        for day in range(1, DAYS + 1)
        for hour in (9, 10)
        for b in range(BINS)
    ]
    return histogram(spark, rows).repartition(3)


JOBS = {
    "merge": lambda h: hs.weighted_day_merge(h, HOURS, attributes=()),
    "distance": lambda h: hs.hourly_distance(h, HOURS),
    "uncertainty": lambda h: hs.uncertainty(h, HOURS, require_hours=2),
    "hourly": lambda h: hs.hourly_cpm(h),
    "earliest": lambda h: hs.daily_cpm(h, pick="earliest"),
    "windows": lambda h: hs.multi_day_window(h, HOURS, [("0.5", "0.5")]),
    "kernels": lambda h: hs.kernel_windows(h, {"k": CELLS}),
}


def result(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("job", JOBS)
def test_tasks_follow_the_rows_and_results_stay(hist, monkeypatch, job):
    run, most = JOBS[job], 480
    few = result(run(hist))
    monkeypatch.setattr(spread, "TASK_ROWS", most)
    many = run(hist)
    rows = hist.filter("Metric_Type = 'HSV'").count() if job in ("windows", "kernels") else hist.count()
    assert many.rdd.getNumPartitions() == rows / most
    assert result(many) == few and few


def test_rows_of_a_task_stay_bounded(hist, monkeypatch):
    monkeypatch.setattr(spread, "TASK_ROWS", 480)
    long = long_histogram(hist)
    placed = long.withColumn("at", F.monotonically_increasing_id())
    days = long.filter("Metric_Type = 'HSV' AND Hour = 9").withColumnRenamed("Bin_Value", "Bin_Units")
    slid = slide_days(days, {"01": ["1"]})
    for df, rows in (
        (pick_first_image(long), long.count()),
        (pick_first_in_file(placed, place="at"), long.count()),
        (slid, slid.count()),
    ):
        per_task = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per_task) == rows
        assert df.rdd.getNumPartitions() >= days.count() / 480
        # Days (years of a camera) are dealt by their hash, so a task may get a few times its share.
        assert max(per_task) <= max(4 * 480, 4 * DAYS * BINS)


def test_years_of_a_day_are_dealt_by_number_too(hist, monkeypatch):
    def run():
        return hs.hourly_distance(hist, HOURS, require_hours=2, match_on=("Day",))

    few = result(run())
    monkeypatch.setattr(spread, "TASK_ROWS", 480)
    many = run()
    # A fourth of the tasks of the bins, as an image is one row; Spark would choose one or a few by the bytes.
    assert many.rdd.getNumPartitions() == hist.count() / 480 / 4
    per_task = [r["count"] for r in many.groupBy(F.spark_partition_id()).count().collect()]
    assert max(per_task) <= 4 * 480
    assert result(many) == few and len(few) == hist.count() / BINS


def test_few_rows_are_left_to_spark_and_a_refusal_waits_for_the_result(spark, hist):
    assert spread.tasks_for(hist) == 0
    twice = hs.daily_cpm(hist)
    with pytest.raises(Exception, match="several images of one day"):
        twice.collect()


def test_filled_bins_of_a_task_stay_bounded(spark, tmp_path, monkeypatch):
    spark.range(200).selectExpr(
        "id AS l_partkey", "id * 50 AS l_suppkey", "cast(id % 7 AS int) AS l_linenumber", "cast(id AS double) AS l_quantity",
        "cast(date_add(DATE '2011-01-01', cast(id % 50 AS int)) AS timestamp_ntz) AS l_shipdate",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    few = result(tables.lineitem_histogram(spark, str(tmp_path)))
    monkeypatch.setattr(tables, "_FILLED", 360)
    many = tables.lineitem_histogram(spark, str(tmp_path))
    # One more shuffle, by another key, would bring back the number that Spark chooses.
    assert many.rdd.getNumPartitions() == 20
    assert result(many) == few and len(few) == 200 * 36


#: Findings on `events` and `lineitem`, with the shuffles of a query: its table, its images, then years or windows.
NAMED = {
    "uncertainty_rel": 3, "uncertainty_unlisted": 2, "emd_fractions": 2, "emd_hourly": 2, "uncertainty_by_area": 2,
    "weighted_unlisted_hours": 2, "weighted_day_merge": 2, "weighted_fractions": 2, "window_kernels": 3, "weighted_attr_merge": 2,
}


@pytest.fixture
def stored(spark, tmp_path):
    # Half of the rows fall on one day of one camera, and rows repeat.
    spark.range(600).selectExpr(
        "id div 3 AS l_partkey", "if(id % 2 = 0, 7, id) AS l_suppkey", "cast(id % 7 AS int) AS l_linenumber",
        "cast(id div 3 AS double) AS l_quantity",
        "cast(date_add(DATE '2011-01-01', cast(if(id % 2 = 0, 3, id div 7 % 30) AS int)) AS timestamp_ntz) AS l_shipdate",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(600).selectExpr(
        "id div 3 AS event_id", "if(id % 2 = 0, 7, id) AS user_id", "cast(id div 3 AS double) AS value",
        "TIMESTAMP_NTZ '2024-01-01 00:10:00' + make_dt_interval(if(id % 2 = 0, 3, id div 24 % 20), id % 24) AS ts",
    ).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", NAMED)
def test_a_table_is_added_up_after_its_one_shuffle(spark, stored, monkeypatch, name):
    few = result(QUERIES[name](spark, stored))
    monkeypatch.setattr(tables, "_FILLED", 1360)
    monkeypatch.setattr(spread, "TASK_ROWS", 480)
    many = QUERIES[name](spark, stored)
    text = many._jdf.queryExecution().executedPlan().toString()
    # A hash table on the map side would be as large as the part of the file that a task reads.
    assert len(re.findall("Exchange hash", text)) == NAMED[name]
    assert "Aggregate" not in text[text.rindex("Exchange hash"):]
    assert result(many) == few
    # These two need whole days, which these rows do not make up; test_oracle has them.
    assert few or name in ("uncertainty_rel", "window_kernels")


@pytest.mark.parametrize("histogram_of", [tables.events_histogram, tables.lineitem_histogram])
def test_rows_that_fill_no_bins_are_dealt_by_number_too(spark, stored, monkeypatch, histogram_of):
    few = result(histogram_of(spark, stored, dense=False))
    monkeypatch.setattr(tables, "_ADDED", 30)
    many = histogram_of(spark, stored, dense=False)
    assert many.rdd.getNumPartitions() == 20
    assert result(many) == few and few
