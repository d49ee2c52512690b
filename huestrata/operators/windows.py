"""Weighted sliding windows over several days."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huestrata.functions import case_of, hour_weight, whole_div, window_label, year_days
from huestrata.operators.columns import long_histogram
from huestrata.operators.images import only_complete_days, pick_first_image
from huestrata.operators.spread import spread, tasks_for
from huestrata.schema import (
    HSV,
    SERIES,
    SIZE_UNITS,
    WEIGHT_UNITS,
    hour_units,
    lag_units,
)


def window_images(
    hist: DataFrame,
    *,
    series: Sequence[str] = SERIES,
    metric: str = HSV,
    exact_images: int | None = None,
    min_images: int | None = None,
    minute: int = 0,
    minute_first: bool = False,
    days: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Bins of the images that windows are made of: one image an hour, on days with enough of them.

    Sizes are whole thousandths of a pixel. ``minute_first`` keeps the images of
    the minute before one is chosen, else after. ``days`` leaves out later days
    of a year. ``tasks`` is the one of ``pick_first_image``.
    """
    if minute_first:
        hist = hist.filter(F.col("Minute") == minute)
    picked = pick_first_image(
        long_histogram(hist, series=series, metrics=(metric,), units=SIZE_UNITS),
        series=series,
        tasks=tasks,
    )
    if exact_images is not None or min_images is not None:
        picked = only_complete_days(
            picked, series=series, exactly=exact_images, at_least=min_images
        )
    if days is not None:
        picked = picked.filter(F.col("Day") <= days)
    return picked.filter(F.col("Minute") == minute)


def whole_days(
    hist: DataFrame, hours: Mapping[int, str], *, series: Sequence[str] = SERIES, **image_options
) -> DataFrame:
    """Hour-weighted bins of the days that have an image at every kernel hour.

    The kernel is a product of an hour part and a day part, so the hours can be
    summed up before any window is formed. ``Bin_Units`` is a size in thousandths
    times a weight in ten-thousandths. ``image_options`` are those of
    ``window_images``. A bin that is missing or unknown at one of the hours
    leaves its day out.
    """
    weight = hour_weight(hours)
    return (
        window_images(hist, series=series, **image_options)
        .filter(weight.isNotNull())
        .groupBy(*series, "Year", "Day", "Bin")
        .agg(
            F.sum(weight * F.col("Bin_Value")).alias("Bin_Units"),
            F.count("Bin_Value").alias("_known"),
        )
        .filter(F.col("_known") == len(hour_units(hours)))
        .drop("_known")
    )


def window_tasks(hist: DataFrame, *, metric: str = HSV, **_) -> int:
    """Tasks for the images of windows; enough for their days too, which have fewer rows."""
    return tasks_for(hist.filter(F.col("Metric_Type") == metric))


def slide_days(
    daily: DataFrame,
    kernels: Mapping[str, Sequence[str]],
    *,
    series: Sequence[str] = SERIES,
    last_group: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Trailing windows of any number of kernels in one pass over the days.

    ``Group`` is the last day of a window. Only whole days come in, so a window
    is complete exactly when the row ``width - 1`` places back lies
    ``width - 1`` days back; the days in between are then present too. Rows are
    neither copied per lag nor joined: each kernel is a weighted sum of
    ``lag`` columns, and windows stay within a year. ``last_group`` leaves out
    windows that end later in the year. ``tasks`` is how many tasks the rows
    need; they are counted if it is not given.
    """
    along = Window.partitionBy(*series, "Year", "Bin").orderBy("Day")
    widest = max(len(k) for k in kernels.values())
    back = {f"_units_{k}": F.lag("Bin_Units", k).over(along) for k in range(1, widest)}
    first_day = {
        f"_day_{len(k)}": F.lag("Day", len(k) - 1).over(along)
        for k in kernels.values()
        if len(k) > 1
    }
    merged = []
    for name, kernel in kernels.items():
        width = len(kernel)
        units = sum(
            F.col(f"_units_{k}" if k else "Bin_Units") * weight
            for k, weight in enumerate(lag_units(kernel))
        )
        whole = (
            F.col(f"_day_{width}") == F.col("Day") - (width - 1) if width > 1 else F.lit(True)
        )
        size = F.when(whole, whole_div(units, WEIGHT_UNITS * WEIGHT_UNITS * SIZE_UNITS))
        merged.append(F.struct(F.lit(name).alias("Mode"), size.alias("Bin_Value")))
    tasks = tasks_for(daily) if tasks is None else tasks
    slid = spread(daily, [*series, "Year"], tasks).withColumns({**back, **first_day})
    if last_group is not None:
        slid = slid.filter(F.col("Day") <= last_group)
    return (
        slid.select(
            *series, "Year", F.col("Day").alias("Group"), "Bin", F.inline(F.array(*merged))
        )
        .filter(F.col("Bin_Value").isNotNull())
    )


def multi_day_window(
    hist: DataFrame,
    hours: Mapping[int, str],
    lags: Sequence[Sequence[str]],
    *,
    series: Sequence[str] = SERIES,
    last_group: int | None = None,
    **day_options,
) -> DataFrame:
    """Multi-day merged histograms for one or more day kernels (lag 0 first)."""
    kernels = {window_label(len(kernel)): kernel for kernel in lags}
    if len(kernels) != len(lags):
        raise ValueError("two kernels have the same width")
    tasks = window_tasks(hist, **day_options)
    daily = whole_days(hist, hours, series=series, tasks=tasks, **day_options)
    return slide_days(daily, kernels, series=series, last_group=last_group, tasks=tasks)


def window_members(
    days: DataFrame,
    hours: Mapping[int, str],
    lags: Sequence[str],
    *,
    series: Sequence[str] = SERIES,
    last_group: int | None = None,
) -> DataFrame:
    """The (day, hour) cells that belong to each window, with their weights.

    ``days`` holds calendar cells with (Year, Day, Hour). ``Weight`` is the
    kernel product in units of 1e-8 and ``Index`` numbers the cells of a window
    from its oldest day on. Windows end within the year, or on ``last_group``.
    """
    width, per_day = len(lags), sorted(hours)
    lag_weight = case_of("Lag", dict(enumerate(lag_units(lags))))
    position = case_of("Hour", {hour: place for place, hour in enumerate(per_day, start=1)})
    return (
        days.filter(F.col("Hour").isin(per_day))
        .withColumn("Lag", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
        .withColumn("Group", F.col("Day") + F.col("Lag"))
        .filter(F.col("Group") <= (year_days() if last_group is None else last_group))
        .withColumn("Weight", hour_weight(hours) * lag_weight)
        .withColumn("Index", (width - 1 - F.col("Lag")) * len(per_day) + position)
    )
