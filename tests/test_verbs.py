"""Colours, names, reshaping and group predicates."""

import math

import pytest
from pyspark.sql import functions as F

import huestrata as hs
from huestrata.functions import paste, rgb_to_hex, with_hsv_hex
from huestrata.operators.columns import drop_containing, keep_containing, move_first
from huestrata.operators.groups import (
    keep_complete_days,
    keep_groups_by_size,
    keep_groups_by_sum,
    keep_matching,
)
from huestrata.operators.reshape import (
    calendar_grid,
    complete_grid,
    ordered_keys,
    pivot_bins,
    union_tagged,
    unpivot_columns,
    with_row_index,
    zip_rows,
)
from tests.helpers import histogram, hue_row, rows_of


@pytest.mark.parametrize(
    "hsv, want",
    [
        ((0, 1, 1), "#FF0000"), ((60, 1, 1), "#FFFF00"), ((120, 1, 1), "#00FF00"),
        ((180, 1, 1), "#00FFFF"), ((240, 1, 1), "#0000FF"), ((300, 1, 1), "#FF00FF"),
        ((360, 1, 1), "#FF0000"), ((30, 1, 0.5), "#804000"), ((210, 0.5, 0.8), "#6699CC"),
        ((90, 0, 0.2), "#333333"), ((90, 1.1, 0.5), None), ((90, 0.5, -0.1), None),
        ((None, 1, 1), None), ((90, None, 1), None),
    ],
)
def test_hsv_to_hex(spark, hsv, want):
    df = spark.createDataFrame([tuple(None if x is None else float(x) for x in hsv)],
                               "h double, s double, v double")
    assert with_hsv_hex(df, "h", {"c": ("s", "v")}).first().c == want


def _srgb_byte(c):
    c = 12.92 * c if c <= 0.0031308 else 1.055 * c ** (1 / 2.4) - 0.055
    return math.floor(255 * c + 0.5)


@pytest.mark.parametrize(
    "rgb, want",
    [
        ((0, 0, 0), "#000000"), ((1, 1, 1), "#FFFFFF"), ((0.5, 0.2, 0), "#BC7C00"),
        ((1.2, 0, 0), None), ((0.5, None, 0.5), None), ((0.001, 0.002, 0.003), "#03070A"),
    ],
)
def test_rgb_to_hex(spark, rgb, want):
    df = spark.createDataFrame([tuple(None if x is None else float(x) for x in rgb)],
                               "r double, g double, b double")
    assert df.select(rgb_to_hex("r", "g", "b").alias("c")).first().c == want
    if want:
        assert want == "#" + "".join(f"{_srgb_byte(x):02X}" for x in rgb)


def test_paste_writes_missing_values(spark):
    df = spark.createDataFrame([(2016, None, "H")], "y int, d int, s string")
    assert df.select(paste("y", "d", "s").alias("k")).first().k == "2016_NA_H"


def test_names(spark):
    names = [
        "/a/b.c/dc_2006_12_0930+0900_site__cam-1.jpg",
        "dc_2006_12.jpg",
        "dc_2006_x_1205_site_extra__cam__more.jpg",
        "",
    ]
    got = hs.parse_image_name(spark.createDataFrame([(n,) for n in names], "Name string"))
    rows = {r.Name: (r.Year, r.Day, r.Hour, r.Minute, r.Dataset, r.Camera_ID) for r in got.collect()}
    assert rows[names[0]] == (2006, 12, 9, 30, "site", "cam-1")
    assert rows[names[1]] == (2006, 12, None, None, None, None)
    assert rows[names[2]] == (2006, None, 12, 5, "site", "cam")
    assert rows[names[3]] == (None,) * 6


def test_coefficients_of_repeated_names_do_not_multiply(spark):
    green = spark.createDataFrame([("dc_2006_1_0900_s__c.jpg", 0.4)] * 30, "Name string, MeanGcc double")
    red = spark.createDataFrame([("dc_2006_1_0900_s__c.jpg", 0.3)] * 30, "Name string, MeanRcc double")
    got = hs.mean_coefficients(green, red)
    assert got.count() == 30
    assert got.select("MeanGcc", "MeanRcc", "Year", "Hour").distinct().collect() == [(0.4, 0.3, 2006, 9)]


def test_unequal_coefficients_of_one_name_are_refused(spark):
    green = spark.createDataFrame([("dc_2006_1_0900_s__c.jpg", 0.4)], "Name string, MeanGcc double")
    red = spark.createDataFrame(
        [("dc_2006_1_0900_s__c.jpg", 0.3), ("dc_2006_1_0900_s__c.jpg", 0.2)], "Name string, MeanRcc double"
    )
    with pytest.raises(Exception, match="unequal red values"):
        hs.mean_coefficients(green, red).collect()
    other = spark.createDataFrame([("dc_2006_2_0900_s__c.jpg", 0.2)], "Name string, MeanRcc double")
    got = hs.mean_coefficients(green, other)
    assert sorted((r.Day, r.MeanGcc, r.MeanRcc) for r in got.collect()) == [(1, 0.4, None), (2, None, 0.2)]


def test_column_choices_ignore_case(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "Day int, Gcc_Bin int, HSV_H int, HSV_SMean int")
    assert drop_containing(df, "gcc", "mean").columns == ["Day", "HSV_H"]
    assert keep_containing(df, "hsv", also=("Day",)).columns == ["Day", "HSV_H", "HSV_SMean"]
    assert move_first(df, "HSV_H", "Day").columns == ["HSV_H", "Day", "Gcc_Bin", "HSV_SMean"]


def test_pivot_and_unpivot_are_inverse(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 2, 3), ("b", 1, 5)], "k string, Bin int, Bin_Value int")
    wide = pivot_bins(df, ["k"], range(3))
    assert rows_of(wide.fillna(-1), "k", "X0", "X1", "X2") == [("a", 1, -1, 3), ("b", -1, 5, -1)]
    long = unpivot_columns(wide, ["X0", "X1", "X2"], "Bin", "Bin_Value", strip="X").filter("Bin_Value > 0")
    assert rows_of(long, "k", "Bin", "Bin_Value") == [("a", "0", 1), ("a", "2", 3), ("b", "1", 5)]


@pytest.mark.parametrize("rows", [[("a", 0, 5), ("a", 0, 9)], [("a", 0, 5), ("a", 7, 1)], [("a", None, 5)]])
def test_pivot_refuses_what_it_would_lose(spark, rows):
    df = spark.createDataFrame(rows, "k string, Bin int, Bin_Value int")
    with pytest.raises(Exception, match="a bin twice for one key, or a bin that is not listed"):
        pivot_bins(df, ["k"], range(3)).collect()


def test_pivot_of_many_bins(spark):
    df = spark.createDataFrame([("a", b, b) for b in range(0, 200, 3)], "k string, Bin int, Bin_Value int")
    row = pivot_bins(df, ["k"], range(200)).first()
    assert [row[f"X{b}"] for b in range(200)] == [b if b % 3 == 0 else None for b in range(200)]


def test_union_matches_by_name_and_keeps_copies(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 2.0)], "cores int, exectime double")
    b = spark.createDataFrame([(9.0, 4)], "exectime double, cores int")
    got = union_tagged({"A": a, "B": b})
    assert rows_of(got, "dataset", "cores", "exectime") == [("A", 1, 2.0), ("A", 1, 2.0), ("B", 4, 9.0)]


def test_timing_summary(spark):
    rows = [("A", 4, 60000.0), ("A", 4, 120000.0), ("A", 4, 180000.0), ("A", 8, 60000.0)]
    df = spark.createDataFrame(rows, "dataset string, cores int, exectime double")
    got = {r.cores: (r.avgMinutes, r.errorMinutes) for r in hs.timing_summary(df).collect()}
    assert got[4] == pytest.approx((2.0, 3 / math.sqrt(3)))
    assert got[8] == (1.0, None)
    gap = spark.createDataFrame([("A", 4, 60000.0), ("A", 4, None)], df.schema)
    assert [(r.avgMinutes, r.errorMinutes) for r in hs.timing_summary(gap).collect()] == [(None, None)]


def test_listed_hours_without_images_stay_in_the_profile(spark):
    hist = histogram(spark, [hue_row(2016, d, h, 0, 4) for d in (1, 2) for h in (9, 10)])
    got = hs.weight_profile(hist, {9: "0.25", 10: "0.25", 11: "0.5"})
    assert rows_of(got, "Hour", "Level", "Weight", "Days") == [(9, 1, 0.25, 2), (10, 2, 0.25, 2), (11, 3, 0.5, 0)]


def test_ordinals_of_unique_keys(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1)], "k string, n int")
    assert rows_of(ordered_keys(df, ["k", "n"]), "Ordinal", "k", "n") == [(1, "a", 1), (2, "a", 2), (3, "b", 1)]
    with pytest.raises(ValueError, match="2 rows for"):
        ordered_keys(df, ["k"])


def test_row_index_is_gapless_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 13).alias("k"), "id").repartition(8)
    got = with_row_index(df, ["k"]).orderBy("Index").collect()
    assert [r.Index for r in got] == list(range(1, 1001))
    assert [r.k for r in got] == sorted(r.k for r in got)
    assert sorted(r.id for r in got) == list(range(1000))


def test_row_index_spreads_copies_of_one_key(spark):
    df = spark.range(20000).select(F.lit(1).alias("k"), "id")
    got = with_row_index(df, ["k"])
    assert got.agg(F.countDistinct("Index"), F.min("Index"), F.max("Index")).first() == (20000, 1, 20000)


def test_zip_rows(spark):
    a = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "x int, l string")
    b = spark.createDataFrame([(20, "q"), (10, "p"), (30, "r")], "y int, m string")
    assert rows_of(zip_rows(a, b, ["x"], ["y"]), "Index", "l", "m") == [
        (1, "a", "p"), (2, "b", "q"), (3, "c", "r"),
    ]
    with pytest.raises(ValueError, match="3 and 2 rows"):
        zip_rows(a, b.filter("y < 30"), ["x"], ["y"])
    with pytest.raises(ValueError):
        zip_rows(a, a, ["x"], ["x"])


def test_grid_and_completion(spark):
    years = spark.createDataFrame([("s", 2012), ("s", 2013)], "Dataset string, Year int")
    grid = calendar_grid(years, [10, 11], days=3)
    assert grid.count() == 12
    seen = spark.createDataFrame([(2012, 2, 11, "x")], "Year int, Day int, Hour int, img string")
    year = calendar_grid(years, [10])
    assert year.groupBy("Year").count().orderBy("Year").collect() == [(2012, 366), (2013, 365)]
    got = complete_grid(grid, seen, ["Year", "Day", "Hour"])
    assert got.count() == 12 and got.filter("img is not null").count() == 1


def test_group_predicates(spark):
    df = spark.createDataFrame(
        [(1, 9, 5), (1, 10, 5), (2, 9, 10), (3, 9, 4), (3, 10, None)], "Day int, Hour int, w int"
    )
    assert rows_of(keep_groups_by_size(df, ["Day"], exactly=2), "Day", "Hour") == [
        (1, 9), (1, 10), (3, 9), (3, 10),
    ]
    assert rows_of(keep_groups_by_size(df, ["Day"], at_least=2).select("Day").distinct(), "Day") == [(1,), (3,)]
    assert rows_of(keep_groups_by_sum(df, ["Day"], "w", 10), "Day") == [(1,), (1,), (2,)]
    assert rows_of(keep_complete_days(df, 1, keys=["Day"]), "Day") == [(2,)]
    other = spark.createDataFrame([(1,), (1,), (7,)], "Day int")
    assert rows_of(keep_matching(df, other, ["Day"]), "Day") == [(1,), (1,)]
