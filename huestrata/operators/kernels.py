"""Sliding windows under any weight function of (lag in days, hour)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from decimal import Decimal
from functools import reduce
from math import gcd
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huestrata.functions import case_of, whole_div, year_days
from huestrata.operators.spread import spread
from huestrata.operators.windows import window_images, window_tasks
from huestrata.schema import SERIES, SIZE_UNITS

#: Cells of a window: weight by (lag in days, hour).
Cells = Mapping[tuple[int, int], str | Decimal]

#: Kernel weights are whole parts of 1e-8, so that sums are exact BIGINT arithmetic.
KERNEL_UNITS = 10**8

#: Weights of a kernel may add up to this (without signs), which keeps sums of sizes within BIGINT.
MOST_WEIGHT = 10


def kernel_of(
    weight: Callable[[int, int], str | float | Decimal | None], days: int, hours: Iterable[int]
) -> dict[tuple[int, int], Decimal]:
    """Cells of a weight function ``weight(lag, hour)`` over ``days`` days; lag 0 is the last day of a window.

    A cell without a weight, or with weight 0, needs no image.
    """
    cells = {(lag, hour): weight(lag, hour) for lag in range(days) for hour in hours}
    return {cell: Decimal(str(w)) for cell, w in cells.items() if w is not None}


def kernel_units(cells: Cells) -> dict[int, dict[int, int]]:
    """Whole weights by lag and hour, without the cells of weight 0."""
    units: dict[int, dict[int, int]] = {}
    for (lag, hour), weight in cells.items():
        scaled = Decimal(str(weight)) * KERNEL_UNITS
        if scaled != scaled.to_integral_value():
            raise ValueError(f"weight {weight} has more than eight decimals")
        if lag < 0 or not 0 <= hour <= 23:
            raise ValueError(f"no cell of a window: lag {lag}, hour {hour}")
        if scaled:
            units.setdefault(lag, {})[hour] = int(scaled)
    if not units:
        raise ValueError("a kernel needs a weight that is not 0")
    if sum(abs(w) for by_hour in units.values() for w in by_hour.values()) > MOST_WEIGHT * KERNEL_UNITS:
        raise ValueError(f"the weights of a kernel add up to more than {MOST_WEIGHT}")
    return units


def _ratio(by_hour: Mapping[int, int]) -> tuple[tuple[tuple[int, int], ...], int]:
    """The weights of a day in lowest terms, and their common factor."""
    factor = gcd(*by_hour.values())
    return tuple(sorted((hour, w // factor) for hour, w in by_hour.items())), factor


def kernel_windows(
    hist: DataFrame,
    kernels: Mapping[str, Cells],
    *,
    series: Sequence[str] = SERIES,
    last_group: int | None = None,
    **day_options,
) -> DataFrame:
    """Trailing windows under kernels that need not be a product of an hour and a day part.

    ``Mode`` is the caller's name of a kernel, so several of one width can stand
    side by side; ``Group`` is the day of lag 0. A window is there if every cell
    with a weight has an image whose bin is known, and its size is the weighted
    sum, cut to whole pixels. Windows stay within a year. ``day_options`` choose
    the images, as for ``multi_day_window``.

    The days of a kernel whose hours are weighted in the same ratio share one
    partial sum, so each (day, bin) becomes one row with a column for each ratio
    (one for a kernel that is a product), and the windows are weighted sums of
    these columns at the days of their lags: no row is copied for a lag.
    """
    units = {name: kernel_units(cells) for name, cells in kernels.items()}
    ratios: dict[tuple[tuple[int, int], ...], str] = {}
    for by_lag in units.values():
        for by_hour in by_lag.values():
            ratios.setdefault(_ratio(by_hour)[0], f"_part_{len(ratios)}")
    hours = sorted({hour for ratio in ratios for hour, _ in ratio})
    tasks = window_tasks(hist, **day_options)
    images = window_images(hist, series=series, tasks=tasks, **day_options)
    images = images.filter(F.col("Hour").isin(hours))
    parts = images.groupBy(*series, "Year", "Day", "Bin").agg(
        *[_part(dict(ratio)).alias(name) for ratio, name in ratios.items()]
    )
    known = parts.filter(F.coalesce(*ratios.values()).isNotNull())
    along = Window.partitionBy(*series, "Year", "Bin").orderBy("Day")
    first = {name: min(by_lag) for name, by_lag in units.items()}
    # Seen from the row of the first lag with a weight: column and days back.
    wanted = {
        (ratios[_ratio(by_hour)[0]], lag - first[name])
        for name, by_lag in units.items()
        for lag, by_hour in by_lag.items()
    }
    back = {
        f"{part}_{days}": F.first(part).over(along.rangeBetween(-days, -days))
        for part, days in sorted(wanted)
        if days
    }

    def at(part: str, days: int) -> Column:
        return F.col(f"{part}_{days}" if days else part)

    merged = []
    for name, by_lag in units.items():
        terms = []
        for lag, by_hour in by_lag.items():
            ratio, factor = _ratio(by_hour)
            terms.append(at(ratios[ratio], lag - first[name]) * F.lit(factor).cast("bigint"))
        size = whole_div(reduce(add, terms), KERNEL_UNITS * SIZE_UNITS)
        group = F.col("Day") + first[name]
        merged.append(F.struct(F.lit(name).alias("Mode"), group.alias("Group"), size.alias("Bin_Value")))
    last = year_days() if last_group is None else F.lit(last_group)
    slid = spread(known, [*series, "Year"], tasks).withColumns(back)
    return (
        slid.select(*series, "Year", "Bin", F.inline(F.array(*merged)))
        .filter(F.col("Bin_Value").isNotNull() & (F.col("Group") <= last))
        .select(*series, "Year", "Group", "Bin", "Mode", "Bin_Value")
    )


def _part(weights: Mapping[int, int]) -> Column:
    """Weighted sum over the hours of a day; NULL unless each of them has a known bin."""
    of_hours = F.col("Hour").isin(list(weights))
    value = F.when(of_hours, F.col("Bin_Value"))
    return F.when(F.count(value) == len(weights), F.sum(case_of("Hour", weights) * F.col("Bin_Value")))
