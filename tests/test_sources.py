"""Text and Parquet inputs and outputs."""

import gzip

import pytest
from pyspark.sql import types as T

import huestrata as hs
from huestrata.schema import HISTOGRAM_SCHEMA, HOURS_9_TO_15
from huestrata.sources.files import inline_palette, read_typed_csv, weight_table
from tests.helpers import green_row, histogram, hue_row, rows_of


def _write(path, header, lines):
    text = "\n".join([header, *lines]) + "\n"
    if str(path).endswith(".gz"):
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        path.write_text(text)


def test_histogram_csv_is_matched_by_name(spark, tmp_path):
    names = [f.name for f in HISTOGRAM_SCHEMA.fields][::-1]  # any column order
    values = {
        "Dataset": "d", "Camera_ID": "c", "Year": "2016", "Day": "3", "Hour": "9", "Minute": "0",
        "Metric_Type": "HSV", "Considered_Pixels": "100", "HSV_Bin": "5", "HSV_H": "12",
        "HSV_SMean": "NaN", "HSV_VMean": "NA", "HSV_SMode": "", "HSV_VMode": "0.5",
        "Gcc_Bin": "-1", "Gcc_Value": "NA", "Gcc_Mean_R": "oops", "Gcc_Mean_G": "NA", "Gcc_Mean_B": "NA",
    }
    path = tmp_path / "h.csv.gz"
    _write(path, ",".join(names), [",".join(values[n] for n in names)])
    df = hs.read_histogram_csv(spark, str(path))
    assert df.schema.simpleString() == HISTOGRAM_SCHEMA.simpleString()
    row = df.first()
    assert (row.Dataset, row.Year, row.HSV_Bin, row.HSV_H, row.HSV_VMode) == ("d", 2016, 5, 12.0, 0.5)
    assert [row[c] for c in ("HSV_SMean", "HSV_VMean", "HSV_SMode", "Gcc_Value", "Gcc_Mean_R")] == [None] * 5


def test_files_with_other_column_orders_are_matched_by_name(spark, tmp_path):
    _write(tmp_path / "a.csv", "exectime,cores", ["5,1"])
    _write(tmp_path / "b.csv", "cores,exectime", ["2,6", "3,7"])
    _write(tmp_path / "c.csv", "cores", ["4"])
    got = hs.read_timing_csv(spark, str(tmp_path / "*.csv"))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 5.0), (2, 6.0), (3, 7.0), (4, None)]


def test_stored_histograms_hold_no_copies(spark, tmp_path):
    path = str(tmp_path / "copies")
    hs.write_histograms(histogram(spark, [hue_row(2016, 1, 9, 0, 4)] * 30), path)
    assert hs.read_histograms(spark, path).count() == 1


def test_parquet_layout_round_trip_and_pruning(spark, tmp_path):
    rows = [hue_row(y, d, 9, b, 10 * b + d, HSV_SMean=0.25) for y in (2015, 2016) for d in (1, 2) for b in (0, 1)]
    rows += [green_row(2016, 1, 9, 3, 4, dataset="007")]
    hist = histogram(spark, rows)
    path = str(tmp_path / "hist")
    hs.write_histograms(hist, path)
    back = hs.read_histograms(spark, path)
    assert back.schema.simpleString() == HISTOGRAM_SCHEMA.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, hist.collect()))
    plan = back.filter("Year = 2016 AND Day = 1").select("HSV_H")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "Year" in plan.split("PartitionFilters")[1]
    assert "EqualTo(Day,1)" in plan


def test_wide_share_csv(spark, tmp_path):
    path = tmp_path / "wide.csv"
    _write(path, "database,sequence,year,X29,X30,X31,X50",
           ["db,001,2015,9,1.9,3,7", "db,002,2015,1,0,0,5", "db,bad,2015,1,NA,2,3"])
    long = hs.read_share_csv(spark, str(path))
    assert long.count() == 12
    got = hs.share_cpm(long, low=30, high=50)
    values = {(r.sequence, r.variable): (r.value, r.Y_min, r.Y_max) for r in got.collect()}
    assert values[(1, 0.3)] == (1, 0.0, 0.25) and values[(1, 0.31)] == (3, 0.25, 1.0)
    assert values[(2, 0.3)] == (0, None, None)
    assert values[(None, 0.31)] == (2, None, None)
    coloured = hs.with_palette(got, inline_palette(spark, ["#aa0000", "#bb0000"]))
    assert rows_of(coloured.filter("sequence = 1"), "variable", "color") == [
        (0.3, "#AA0000"), (0.31, "#BB0000"),
    ]


def test_palette(spark, tmp_path):
    path = tmp_path / "colors.palette"
    path.write_text("?comment\n\n#99540f\n#b26f2c ?trailing\n\n#0f6b99\n")
    assert rows_of(hs.read_palette(spark, str(path)), "pos", "color") == [
        (1, "#99540F"), (2, "#B26F2C"), (3, "#0F6B99"),
    ]


def test_timing_and_plain_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    _write(path, "exectime,cores", ["671171,40", "649947.5,32"])
    assert rows_of(hs.read_timing_csv(spark, str(path)), "cores", "exectime") == [
        (32, 649947.5), (40, 671171.0),
    ]
    assert dict(hs.read_plain_csv(spark, str(path)).dtypes) == {"exectime": "double", "cores": "int"}
    schema = T.StructType([T.StructField("cores", T.IntegerType())])
    assert read_typed_csv(spark, str(path), schema).columns == ["cores"]


def test_mean_coefficient_files(spark, tmp_path):
    _write(tmp_path / "g.csv", "Name,MeanGcc", ["p/dc_2006_165_1210+09_s__c.jpg,0.41"])
    _write(tmp_path / "r.csv", "Name,MeanRcc", ["p/dc_2006_165_1210+09_s__c.jpg,0.33"])
    green = hs.read_plain_csv(spark, str(tmp_path / "g.csv"))
    red = hs.read_plain_csv(spark, str(tmp_path / "r.csv"))
    row = hs.mean_coefficients(green, red).first()
    assert (row.MeanGcc, row.MeanRcc, row.Year, row.Day, row.Hour, row.Minute) == (0.41, 0.33, 2006, 165, 12, 10)


def test_weight_table_and_sink(spark, tmp_path):
    df = weight_table(spark, HOURS_9_TO_15)
    assert dict(df.dtypes) == {"Hour": "int", "Weight": "decimal(6,4)"}
    path = str(tmp_path / "out")
    hs.write_table(df.withColumn("Year", df.Hour * 0 + 2016), path, by=["Year"])
    assert spark.read.parquet(path).count() == 7
    sorted_path = str(tmp_path / "sorted")
    hs.write_table(df.repartition(3), sorted_path, order=["Hour"])
    hours = [[r.Hour for r in spark.read.parquet(str(f)).collect()]
             for f in sorted((tmp_path / "sorted").glob("part-*.parquet"))]
    assert sorted(h for file in hours for h in file) == sorted(HOURS_9_TO_15)
    assert all(file == sorted(file) for file in hours)
    with pytest.raises(Exception):
        hs.write_table(df, path, mode="errorifexists")
