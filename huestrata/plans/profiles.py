"""Image names, mean coefficients, bin distributions, timings and weight profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huestrata.functions import as_integer, case_of, hour_weight
from huestrata.operators.columns import long_histogram
from huestrata.operators.images import pick_first_image
from huestrata.operators.merge import listed_hours
from huestrata.operators.reshape import calendar_grid, complete_grid, refuse_unless
from huestrata.operators.windows import window_members
from huestrata.schema import (
    GCC,
    KERNEL_HOURS_10_TO_14,
    KERNEL_LAGS_3,
    SERIES,
    WEIGHT_UNITS,
)
from huestrata.sources.files import weight_table


def parse_image_name(df: DataFrame, name: str = "Name") -> DataFrame:
    """Year, Day, Dataset, Camera_ID, Hour and Minute out of an image name.

    Names look like ``<folder>/dc_<Year>_<Day>_<HHMM>+<rest>_<Dataset>__<Camera>.jpg``.
    A piece that is missing or malformed gives NULL.
    """
    base = F.regexp_replace(F.substring_index(F.col(name), "/", -1), ".jpg|dc_", "")
    halves = F.split(base, "__")
    pieces = F.split(F.get(halves, F.lit(0)), "_")
    clock = F.regexp_replace(F.get(pieces, F.lit(2)), r"\+.*", "")
    return df.select(
        "*",
        as_integer(F.get(pieces, F.lit(0))).alias("Year"),
        as_integer(F.get(pieces, F.lit(1))).alias("Day"),
        F.get(pieces, F.lit(3)).alias("Dataset"),
        F.get(halves, F.lit(1)).alias("Camera_ID"),
        as_integer(F.substring(clock, 1, 2)).alias("Hour"),
        as_integer(F.substring(clock, 3, 2)).alias("Minute"),
    )


def mean_coefficients(green: DataFrame, red: DataFrame) -> DataFrame:
    """Mean green and red coefficient per image, matched by image name.

    A coefficient depends on the image alone, so equal copies of a name on the
    red side are folded into one row before the join, and unequal ones are
    refused. Names found on one side only stay, without the other coefficient.
    """
    one_red = (
        red.groupBy("Name")
        .agg(
            F.min("MeanRcc").alias("MeanRcc"),
            F.min("MeanRcc").eqNullSafe(F.max("MeanRcc")).alias("_equal"),
        )
        .filter(refuse_unless("_equal", "mean_coefficients: unequal red values for one name"))
        .drop("_equal")
    )
    return parse_image_name(green.select("Name", "MeanGcc").join(one_red, "Name", "full"))


def bin_distribution(
    hist: DataFrame,
    weights: Mapping[int, str],
    *,
    days: Sequence[int] | None = None,
    series: Sequence[str] = SERIES,
) -> DataFrame:
    """Green bins of a day, added up over one image per listed hour."""
    hist = listed_hours(hist, weights)
    if days is not None:
        hist = hist.filter(F.col("Day").isin(list(days)))
    return (
        pick_first_image(long_histogram(hist, series=series, metrics=(GCC,)), series=series)
        .filter(F.col("Bin_Value") != 0)
        .groupBy(*series, "Year", "Day", F.col("Bin").alias("Gcc_Bin"))
        .agg(F.sum("Bin_Value").alias("Gcc_Value"))
        .withColumn("Label", F.concat(F.lit("Day "), F.col("Day").cast("string")))
    )


def timing_summary(samples: DataFrame, keys: Sequence[str] = ("cores", "dataset")) -> DataFrame:
    """Mean run time in minutes and three standard errors, from milliseconds.

    One unknown sample makes both unknown.
    """
    minutes = F.col("exectime") / 1000 / 60
    error = F.stddev_samp(minutes) * 3 / F.sqrt(F.count(F.lit(1)))
    known = F.count("exectime") == F.count(F.lit(1))
    return samples.groupBy(*keys).agg(
        F.when(known, F.avg(minutes)).alias("avgMinutes"), F.when(known, error).alias("errorMinutes")
    )


def weight_profile(
    hist: DataFrame, weights: Mapping[int, str], *, series: Sequence[str] = SERIES
) -> DataFrame:
    """Weight of each listed hour, its place in the list and the days imaged then, 0 included."""
    hours = sorted(weights)
    level = case_of("Hour", {hour: place for place, hour in enumerate(hours, start=1)})
    images = hist.filter(F.col("Hour").isin(hours)).select(*series, "Year", "Day", "Hour").distinct()
    days = images.groupBy("Hour").agg(F.count(F.lit(1)).alias("Days"))
    listed = weight_table(hist.sparkSession, weights).select("Hour")
    return listed.join(days, "Hour", "left").select(
        "Hour",
        level.alias("Level"),
        (hour_weight(weights) / float(WEIGHT_UNITS)).alias("Weight"),
        F.coalesce("Days", F.lit(0)).alias("Days"),
    )


def kernel_profile(
    hist: DataFrame,
    hours: Mapping[int, str] = KERNEL_HOURS_10_TO_14,
    lags: Sequence[str] = KERNEL_LAGS_3,
    *,
    series: Sequence[str] = SERIES,
    minute: int = 0,
    days: int | None = None,
    last_group: int | None = None,
) -> DataFrame:
    """Weight of every cell of every full window and whether it was imaged.

    Windows cut off by the start of the year are left out: their weights do not
    add up to 1. The calendar holds every cell, so a window is full when it ends
    as many days into the year as it is wide.
    """
    images = hist.filter(F.col("Minute") == minute).select(
        *series, "Year", "Day", "Hour", "Minute"
    ).distinct()
    grid = calendar_grid(hist.select(*series, "Year").distinct(), sorted(hours), days)
    cells = complete_grid(
        grid, images.withColumn("_seen", F.lit(1)), [*series, "Year", "Day", "Hour", "Minute"]
    )
    members = window_members(cells, hours, lags, series=series, last_group=last_group)
    return members.filter(F.col("Group") >= len(lags)).select(
        *series,
        "Year",
        "Group",
        "Index",
        "Day",
        "Hour",
        (F.col("Weight") / float(WEIGHT_UNITS * WEIGHT_UNITS)).alias("Weight"),
        F.col("_seen").isNotNull().alias("Imaged"),
    )
