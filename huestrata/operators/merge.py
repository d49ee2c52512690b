"""Weighting the hours of a day into one histogram."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huestrata.functions import hour_weight, lenient_sum, strict_sum, whole_div
from huestrata.operators.columns import long_histogram
from huestrata.operators.images import only_complete_days, pick_first_image
from huestrata.schema import (
    ATTRIBUTE_UNITS,
    ATTRIBUTES,
    GCC,
    HSV,
    SERIES,
    SIZE_UNITS,
    WEIGHT_UNITS,
    hour_units,
)


def listed_hours(df: DataFrame, weights: Mapping[int, str]) -> DataFrame:
    """Rows of the hours that carry a weight other than 0; reaches the scan."""
    return df.filter(F.col("Hour").isin([h for h, w in hour_units(weights).items() if w]))


def hourly_images(
    hist: DataFrame,
    weights: Mapping[int, str],
    *,
    series: Sequence[str] = SERIES,
    attributes: Sequence[str] = (),
    metrics: Sequence[str] = (HSV, GCC),
    extra: Sequence[str] = (),
    listed_hours_only: bool = True,
    tasks: int | None = None,
) -> DataFrame:
    """One image per hour in long form with its ``Weight`` in ten-thousandths.

    Sizes are in thousandths of a pixel. Rows of metrics not asked for have no
    bin; they take part in the choice of the image and in the hours of a day.
    Hours outside the list are dropped, or kept with a NULL weight. ``tasks`` is
    the one of ``pick_first_image``.
    """
    if listed_hours_only:
        hist = listed_hours(hist, weights)
    long = long_histogram(
        hist,
        series=series,
        attributes=attributes,
        metrics=metrics,
        extra=extra,
        units=SIZE_UNITS,
        other_rows=True,
    )
    picked = pick_first_image(long, series=series, tasks=tasks)
    return picked.withColumn("Weight", hour_weight(weights))


def weighted_size(size: str = "Bin_Value") -> Column:
    """Weighted bin size out of thousandths, truncated to whole pixels; NULL if any part is unknown."""
    return whole_div(strict_sum(F.col("Weight") * F.col(size)), WEIGHT_UNITS * SIZE_UNITS)


def weighted_attribute(name: str) -> Column:
    """Weighted colour attribute over its known values, not renormalised."""
    billionths = F.floor(F.col(name) * ATTRIBUTE_UNITS + 0.5).cast("bigint")
    units = lenient_sum(F.col("Weight") * billionths)
    return units.cast("double") / float(ATTRIBUTE_UNITS * WEIGHT_UNITS)


def merge_hours(
    images: DataFrame,
    *,
    series: Sequence[str] = SERIES,
    attributes: Sequence[str] = (),
    extra: Sequence[str] = (),
) -> DataFrame:
    return images.groupBy(*series, "Year", "Day", *extra, "Metric_Type", "Bin").agg(
        weighted_size().alias("Bin_Value"),
        *[weighted_attribute(a).alias(a) for a in attributes],
    )


def weighted_day_merge(
    hist: DataFrame,
    weights: Mapping[int, str],
    *,
    series: Sequence[str] = SERIES,
    require_hours: int | None = None,
    attributes: Sequence[str] = ATTRIBUTES,
    metrics: Sequence[str] = (HSV, GCC),
    extra: Sequence[str] = (),
    listed_hours_only: bool = True,
) -> DataFrame:
    """One weighted histogram per day, out of one image per hour.

    ``require_hours`` keeps only days on which that many hours were imaged.
    ``extra`` adds grouping columns, such as ``Considered_Pixels``.
    """
    images = hourly_images(
        hist,
        weights,
        series=series,
        attributes=attributes,
        metrics=metrics,
        extra=extra,
        listed_hours_only=listed_hours_only,
    )
    if require_hours is not None:
        images = only_complete_days(images, series=series, exactly=require_hours)
    images = images.filter(F.col("Metric_Type").isin(list(metrics)))
    return merge_hours(images, series=series, attributes=attributes, extra=extra)
