"""Uncertainty level of a day: how far its images lie from their weighted merge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huestrata.functions import strict_max_over
from huestrata.operators.distance import day_uncertainty, earth_movers_distance, pair_with_day
from huestrata.operators.images import mark_hours
from huestrata.operators.merge import hourly_images, listed_hours
from huestrata.operators.spread import spread, tasks_for
from huestrata.schema import SERIES

#: An image is one row here and is sorted once, so a task takes so many times the rows that it takes of bins.
_IMAGES = 4


def hourly_distance(
    hist: DataFrame,
    weights: Mapping[int, str],
    *,
    series: Sequence[str] = SERIES,
    require_hours: int | None = None,
    match_on: Sequence[str] = ("Year", "Day"),
    listed_hours_only: bool = True,
    skip_first_bin: bool = True,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Distance of every hourly image from its merged day.

    ``require_hours`` leaves out days without that many imaged hours. With
    ``match_on=("Day",)`` a day of the year that is complete in any year keeps
    its images in all years, and images of incomplete days get distance 0.
    ``extra`` splits a day, by ``Considered_Pixels`` for instance.
    """
    if tuple(match_on) not in {("Year", "Day"), ("Day",)}:
        raise ValueError("match_on is ('Year', 'Day') or ('Day',)")
    tasks = tasks_for(listed_hours(hist, weights) if listed_hours_only else hist)
    images = hourly_images(
        hist,
        weights,
        series=series,
        listed_hours_only=listed_hours_only,
        extra=extra,
        tasks=tasks,
    )
    images = images.select(
        *series, "Year", "Day", "Hour", *extra, "Metric_Type", "Bin", "Bin_Value", "Weight"
    )
    keep = ["Weight"]
    by_day_only = require_hours is not None and tuple(match_on) == ("Day",)
    if require_hours is not None:
        images = mark_hours(images, series=series).withColumn(
            "_complete", F.col("_hours") == require_hours
        ).drop("_hours")
        if by_day_only:
            keep.append("_complete")
        else:
            images = images.filter("_complete").drop("_complete")
    pairs = pair_with_day(images, series=series, extra=extra)
    if by_day_only:
        pairs = pairs.withColumn("Q", F.when(F.col("_complete"), F.col("Q")))
    distances = earth_movers_distance(
        pairs, series=series, keep=keep, extra=extra, skip_first_bin=skip_first_bin
    )
    if by_day_only:
        same_day = Window.partitionBy(*series, "Day")
        # Images are no more than the bins that were counted.
        distances = (
            spread(distances, [*series, "Day"], -(-tasks // _IMAGES))
            .withColumn("_any", F.max("_complete").over(same_day))
            .filter("_any")
            .drop("_any", "_complete")
        )
    return distances


def uncertainty(
    hist: DataFrame,
    weights: Mapping[int, str],
    *,
    series: Sequence[str] = SERIES,
    extra: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Absolute uncertainty ``Q`` per day and metric."""
    distances = hourly_distance(hist, weights, series=series, extra=extra, **options)
    return day_uncertainty(distances, series=series, extra=extra)


def relative_uncertainty(
    daily: DataFrame, *, series: Sequence[str] = SERIES, ignore_unknown: bool = False
) -> DataFrame:
    """``Q`` divided by the largest ``Q`` of its year and metric.

    One unknown day makes the whole year unknown unless ``ignore_unknown``.
    """
    year = Window.partitionBy(*series, "Year", "Metric_Type")
    largest = F.max("Q").over(year) if ignore_unknown else strict_max_over("Q", year)
    return daily.withColumn("Q", F.try_divide(F.col("Q"), largest))
