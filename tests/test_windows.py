"""Sliding windows against a plain positional simulation."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import huestrata as hs
from huestrata import schema as S
from huestrata.operators.windows import window_members
from tests.helpers import histogram, hue_row, rows_of

KERNELS = {
    2: (S.KERNEL_HOURS_8_TO_18, S.KERNEL_LAGS_2),
    3: (S.KERNEL_HOURS_10_TO_14, S.KERNEL_LAGS_3),
    5: (S.KERNEL_HOURS_8_TO_18, S.KERNEL_LAGS_5),
    7: (S.KERNEL_HOURS_8_TO_18, S.KERNEL_LAGS_7),
    10: (S.KERNEL_HOURS_8_TO_18, S.KERNEL_LAGS_10),
}


def simulate(cells, hours, lags, days, bins, last_group):
    """Walk every window cell by cell with exact decimals."""
    out = {}
    years = {year for year, *_ in cells}
    for year in years:
        for group in range(1, last_group + 1):
            for b in bins:
                total, weight, known = Decimal(0), Decimal(0), True
                for lag, lag_weight in enumerate(lags):
                    for hour, hour_weight in hours.items():
                        day = group - lag
                        if not 1 <= day <= days:
                            continue
                        w = Decimal(lag_weight) * Decimal(hour_weight)
                        weight += w
                        value = cells.get((year, day, hour, b))
                        if value is None:
                            known = False
                        else:
                            total += w * value
                if weight == 1 and known:
                    out[(year, group, b)] = int(total)
    return out


@pytest.mark.parametrize("width", sorted(KERNELS))
def test_windows_equal_the_simulation(spark, width):
    hours, lags = KERNELS[width]
    rng = random.Random(width)
    bins = (0, 10)
    cells = {}
    for year in (2015, 2016):
        missing = {rng.randint(1, 30) for _ in range(1)}
        for day in range(1, 31):
            for hour in hours:
                if day in missing and hour == 12:
                    continue
                for b in bins:
                    cells[(year, day, hour, b)] = rng.randint(0, 5000)
    rows = [hue_row(y, d, h, b, v) for (y, d, h, b), v in cells.items()]
    rng.shuffle(rows)
    got = hs.multi_day_window(histogram(spark, rows).repartition(5), hours, [lags], last_group=25)
    want = simulate(cells, hours, lags, 365, bins, 25)
    assert {(r.Year, r.Group, r.Bin): r.Bin_Value for r in got.collect()} == want
    assert want and len(want) < 2 * 25 * len(bins)


def test_all_widths_in_one_pass_equal_each_on_its_own(spark):
    rng = random.Random(1)
    rows = [hue_row(2016, d, h, 0, rng.randint(0, 900)) for d in range(1, 21) for h in range(8, 19)
            if (d, h) != (9, 13)]
    hist = histogram(spark, rows)
    lags = [S.KERNEL_LAGS_2, S.KERNEL_LAGS_5, S.KERNEL_LAGS_7, S.KERNEL_LAGS_10]
    together = hs.multi_day_window(hist, S.KERNEL_HOURS_8_TO_18, lags)
    apart = []
    for lag in lags:
        apart += rows_of(hs.multi_day_window(hist, S.KERNEL_HOURS_8_TO_18, [lag]),
                         "Mode", "Group", "Bin", "Bin_Value")
    assert rows_of(together, "Mode", "Group", "Bin", "Bin_Value") == sorted(apart)
    with pytest.raises(ValueError):
        hs.multi_day_window(hist, S.KERNEL_HOURS_8_TO_18, [S.KERNEL_LAGS_5, S.KERNEL_LAGS_5])


def test_width_one_is_the_weighted_day_merge(spark):
    rng = random.Random(2)
    rows = [hue_row(2016, d, h, b, rng.randint(0, 900)) for d in (4, 5) for h in range(10, 15)
            for b in (0, 10)]
    hist = histogram(spark, rows)
    window = hs.multi_day_window(hist, S.KERNEL_HOURS_10_TO_14, [("1",)])
    merge = hs.weighted_day_merge(hist, S.KERNEL_HOURS_10_TO_14, attributes=())
    assert rows_of(window, "Group", "Bin", "Bin_Value") == rows_of(merge, "Day", "Bin", "Bin_Value")


def _full_year(year=2016):
    return [hue_row(year, d, h, 0, 10) for d in range(1, 367) for h in range(10, 15)]


def test_windows_end_with_the_year_and_do_not_cross_it(spark):
    rows = _full_year(2015) + _full_year(2016)
    got = hs.multi_day_window(histogram(spark, rows), S.KERNEL_HOURS_10_TO_14, [S.KERNEL_LAGS_3])
    groups = {}
    for r in got.collect():
        groups.setdefault(r.Year, []).append(r.Group)
        assert r.Bin_Value == 10
    assert {y: (min(g), max(g)) for y, g in groups.items()} == {2015: (3, 366), 2016: (3, 366)}
    cut = hs.multi_day_window(
        histogram(spark, rows), S.KERNEL_HOURS_10_TO_14, [S.KERNEL_LAGS_3],
        days=S.FIGURE_DAYS, last_group=S.FIGURE_LAST_GROUP,
    )
    assert max(r.Group for r in cut.collect()) == 357


def test_the_last_days_of_a_year_have_windows(spark):
    rows = [hue_row(2016, d, h, 0, 10) for d in range(355, 367) for h in range(10, 15)]
    got = hs.multi_day_window(histogram(spark, rows), S.KERNEL_HOURS_10_TO_14, [S.KERNEL_LAGS_3])
    assert [g for (g,) in rows_of(got, "Group")] == list(range(357, 367))
    profile = hs.kernel_profile(histogram(spark, rows))
    assert profile.agg(F.max("Group"), F.max("Day")).first() == (366, 366)
    assert profile.filter("Group = 366 AND Imaged").count() == 15
    per_window = profile.groupBy("Group").agg(F.sum("Weight").alias("w")).collect()
    assert {round(r.w, 9) for r in per_window} == {1.0} and len(per_window) == 364


def test_windows_cut_after_weighting(spark):
    rows = [hue_row(2016, d, h, 0, 1.9) for d in range(1, 4) for h in range(10, 15)]
    rows += [hue_row(2016, d, h, 10, 0.5) for d in range(1, 4) for h in range(10, 15)]
    got = hs.multi_day_window(histogram(spark, rows), S.KERNEL_HOURS_10_TO_14, [S.KERNEL_LAGS_3])
    assert rows_of(got, "Bin", "Bin_Value") == [(0, 1), (10, 0)]


def test_days_need_enough_images_of_any_hour_and_minute_zero(spark):
    rows = [hue_row(2016, d, h, 0, 10) for d in (1, 2, 3) for h in range(9, 16)]
    rows += [hue_row(2016, 4, h, 0, 10) for h in range(10, 15)]  # five images only
    rows += [hue_row(2016, 5, h, 0, 10, minute=0 if h != 12 else 5) for h in range(9, 16)]
    hist = histogram(spark, rows)

    def groups(**gate):
        got = hs.multi_day_window(hist, S.KERNEL_HOURS_10_TO_14, [("1",)], **gate)
        return [g for (g,) in rows_of(got, "Group")]

    assert groups(min_images=7) == [1, 2, 3]
    assert groups() == [1, 2, 3, 4]
    assert groups(exact_images=7) == [1, 2, 3]
    assert groups(exact_images=5) == [4]


def test_unknown_size_removes_the_bin_from_its_windows(spark):
    rows = [hue_row(2016, d, h, b, None if (d, h, b) == (3, 12, 0) else 10)
            for d in range(1, 7) for h in range(10, 15) for b in (0, 10)]
    got = hs.multi_day_window(histogram(spark, rows), S.KERNEL_HOURS_10_TO_14, [S.KERNEL_LAGS_3])
    assert rows_of(got, "Group", "Bin") == [(3, 10), (4, 10), (5, 10), (6, 0), (6, 10)]


def test_members_number_the_cells_from_the_oldest_day(spark):
    days = spark.createDataFrame(
        [("d", "c", 2016, d, h) for d in (1, 2, 3) for h in range(10, 15)],
        "Dataset string, Camera_ID string, Year int, Day int, Hour int",
    )
    got = window_members(days, S.KERNEL_HOURS_10_TO_14, S.KERNEL_LAGS_3).filter('Group = 3')
    found = rows_of(got, "Index", "Day", "Hour", "Weight")
    assert [i for i, *_ in found] == list(range(1, 16))
    assert found[0] == (1, 1, 10, 2500000) and found[-1] == (15, 3, 14, 8000000)
    assert sum(w for *_, w in found) == 10**8


def test_every_weight_list_adds_up_to_one():
    for weights in (S.HOURS_9_TO_15, S.HOURS_7_TO_16, S.HOURS_8_TO_18, S.KERNEL_HOURS_10_TO_14,
                    S.KERNEL_HOURS_8_TO_18):
        assert sum(S.hour_units(weights).values()) == S.WEIGHT_UNITS
    for lags in (S.KERNEL_LAGS_2, S.KERNEL_LAGS_3, S.KERNEL_LAGS_5, S.KERNEL_LAGS_7, S.KERNEL_LAGS_10):
        assert sum(S.lag_units(lags)) == S.WEIGHT_UNITS


def test_window_stack_is_gapless(spark):
    rows = [hue_row(2016, d, h, b, 10 + b) for d in range(1, 5) for h in range(10, 15) for b in (0, 10, 20)]
    cpm = hs.window_cpm(histogram(spark, rows), S.KERNEL_HOURS_10_TO_14, [S.KERNEL_LAGS_3])
    assert rows_of(cpm.filter("Group = 4"), "Bin", "Y_min", "Y_max", "Color", "Key") == [
        (0, 0, 10, "#FF0000", "2016_4_0_H"),
        (10, 10, 30, "#FF2A00", "2016_4_10_H"),
        (20, 30, 60, "#FF5500", "2016_4_20_H"),
    ]
