"""Windows under any weight function, against a walk over every cell."""

import random
from decimal import Decimal

import pytest

import huestrata as hs
from huestrata import schema as S
from huestrata.operators.kernels import kernel_of, kernel_units, kernel_windows
from tests.helpers import histogram, hue_row
from tests.test_plans import plan, shuffles


def walk(cells, kernels, bins, last):
    """Every window of every kernel, cell by cell, in exact decimals."""
    out = {}
    for name, kernel in kernels.items():
        weights = {cell: Decimal(str(w)) for cell, w in kernel.items() if Decimal(str(w))}
        for year in {y for y, *_ in cells}:
            for group in range(1, last + 1):
                for b in bins:
                    values = [cells.get((year, group - lag, hour, b)) for lag, hour in weights]
                    if None not in values:
                        out[name, year, group, b] = int(sum(w * v for w, v in zip(weights.values(), values)))
    return out


def image_rows(rng, days, hours, gaps, bins=(0, 10)):
    cells = {
        (year, day, hour, b): rng.randint(0, 5000)
        for year in (2015, 2016)
        for day in days
        for hour in hours
        if rng.random() > gaps
        for b in bins
    }
    rows = [hue_row(y, d, h, b, v) for (y, d, h, b), v in cells.items()]
    rng.shuffle(rows)
    return cells, rows


def found(df):
    return {(r.Mode, r.Year, r.Group, r.Bin): r.Bin_Value for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_random_kernels_equal_the_walk(spark, seed):
    """Gaps in days and hours, kernels of one width, weights below zero, days without a weight."""
    rng = random.Random(seed)
    cells, rows = image_rows(rng, range(1, 25), range(9, 14), 0.08)
    kernels = {
        f"k{i}": {
            (rng.randrange(4), rng.randrange(9, 14)): Decimal(rng.randrange(-(10**7), 10**8)) / 10**8
            for _ in range(rng.randrange(1, 5))
        }
        for i in range(5)
    }
    kernels["late"] = {(3, 9): "1"}
    got = found(kernel_windows(histogram(spark, rows).repartition(3), kernels))
    want = walk(cells, kernels, (0, 10), 366)
    assert got == want and len(want) > 100


def test_a_product_kernel_equals_the_window_of_its_parts(spark):
    _, rows = image_rows(random.Random(8), range(1, 20), range(8, 19), 0.01)
    hist = histogram(spark, rows)
    cells = {
        (lag, hour): Decimal(a) * Decimal(b)
        for lag, a in enumerate(S.KERNEL_LAGS_5)
        for hour, b in S.KERNEL_HOURS_8_TO_18.items()
    }
    parts = hs.multi_day_window(hist, S.KERNEL_HOURS_8_TO_18, [S.KERNEL_LAGS_5])
    whole = kernel_windows(hist, {"05-day window": cells})
    assert found(whole) == found(parts) != {}
    assert sorted(whole.columns) == sorted(parts.columns)


def test_days_in_one_ratio_share_a_partial_sum(spark):
    _, rows = image_rows(random.Random(1), range(1, 6), range(10, 13), 0)
    kernels = {"a": {(0, 10): "0.2", (0, 11): "0.4", (1, 10): "0.1", (1, 11): "0.2"}, "b": {(0, 12): "1", (3, 12): "0.5"}}
    text = plan(kernel_windows(histogram(spark, rows), kernels))
    assert "_part_1" in text and "_part_2" not in text


def test_no_row_is_copied_for_a_lag(spark, tmp_path):
    """One shuffle for the images, one for the windows; nothing is exploded or joined before the sums."""
    _, rows = image_rows(random.Random(1), range(1, 12), range(10, 15), 0)
    path = str(tmp_path / "hist")
    hs.write_histograms(histogram(spark, rows), path)
    kernels = {"a": kernel_of(lambda lag, hour: f"0.0{lag + hour % 5}", 10, range(10, 15))}
    df = kernel_windows(hs.read_histograms(spark, path), kernels)
    text = plan(df)
    assert shuffles(df) <= 2, text
    assert "Join" not in text and "Python" not in text
    assert text.count("Generate") == 1 and text.index("Generate") < text.index("Window")


def test_windows_end_within_the_year(spark):
    rows = [hue_row(y, d, 12, 0, 7) for y in (2015, 2016) for d in (364, 365, 366) if d <= 365 + (y == 2016)]
    got = found(kernel_windows(histogram(spark, rows), {"eve": {(1, 12): "1"}}))
    assert sorted(got) == [("eve", 2015, 365, 0), ("eve", 2016, 365, 0), ("eve", 2016, 366, 0)]
    cut = found(kernel_windows(histogram(spark, rows), {"eve": {(1, 12): "1"}}, last_group=365))
    assert ("eve", 2016, 366, 0) not in cut


def test_stacked_kernels(spark):
    rows = [hue_row(2016, 1, 12, 0, 6), hue_row(2016, 1, 12, 120, 4), hue_row(2016, 1, 12, 240, 0)]
    got = hs.kernel_cpm(histogram(spark, rows), {"half": {(0, 12): "0.5"}}).orderBy("Bin").collect()
    assert [(r.Mode, r.Bin, r.Bin_Value, r.Y_min, r.Y_max, r.Color) for r in got] == [
        ("half", 0, 3, 0, 3, "#FF0000"), ("half", 120, 2, 3, 5, "#00FF00"),
    ]


def test_kernels_from_functions_and_what_is_refused(spark):
    cells = hs.kernel_of(lambda lag, hour: None if hour == 11 else 0.25 * lag, 2, (10, 11))
    assert cells == {(0, 10): Decimal("0.00"), (1, 10): Decimal("0.25")}
    assert kernel_units(cells) == {1: {10: 25_000_000}}
    for bad in ({}, {(0, 12): 0}, {(-1, 12): 1}, {(0, 24): 1}, {(0, 12): "0.000000001"}, {(0, 12): 6, (1, 12): -5}):
        with pytest.raises(ValueError):
            kernel_units(bad)
