"""Distance between each image and the merged day it belongs to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huestrata.functions import strict_sum, strict_sum_over, whole_div
from huestrata.schema import BIN_COUNT, GCC, HSV, SERIES, SIZE_UNITS, WEIGHT_UNITS


def pair_with_day(
    images: DataFrame, *, series: Sequence[str] = SERIES, extra: Sequence[str] = ()
) -> DataFrame:
    """Each hourly bin size ``P`` next to the merged size ``Q`` of its day.

    Both are in thousandths of a pixel; the merged size is whole pixels, the
    hourly one is never cut.

    The merged size is a window sum over the rows that are already together,
    in place of a join of the images with their own aggregate.
    """
    same_bin = Window.partitionBy(*series, "Year", "Day", *extra, "Metric_Type", "Bin")
    merged = strict_sum_over(F.col("Weight") * F.col("Bin_Value"), same_bin)
    pixels = whole_div(merged, WEIGHT_UNITS * SIZE_UNITS)
    return images.withColumn("Q", pixels * SIZE_UNITS).withColumnRenamed("Bin_Value", "P")


def earth_movers_distance(
    pairs: DataFrame,
    *,
    series: Sequence[str] = SERIES,
    keep: Sequence[str] = ("Weight",),
    extra: Sequence[str] = (),
    skip_first_bin: bool = True,
) -> DataFrame:
    """Sum of the absolute running differences of ``P`` and ``Q`` along the bins, in pixels.

    The first bin of an image does not contribute unless ``skip_first_bin`` is
    off, and an unknown difference counts as 0. ``keep`` names columns that are
    constant within an image.
    """
    image = [*series, "Year", "Day", "Hour", *extra, "Metric_Type"]
    along = Window.partitionBy(*image).orderBy("Bin")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = F.sum("_step").over(upto)
    if skip_first_bin:
        moved = moved - F.first("_step").over(upto)
    return (
        pairs.withColumn("_step", F.coalesce(F.col("P") - F.col("Q"), F.lit(0).cast("bigint")))
        .withColumn("_moved", F.abs(moved))
        .groupBy(*image, *keep)
        .agg((F.sum("_moved") / F.lit(float(SIZE_UNITS))).alias("Distance"))
    )


def day_uncertainty(
    distances: DataFrame, *, series: Sequence[str] = SERIES, extra: Sequence[str] = ()
) -> DataFrame:
    """Weighted distance of a day divided by the bin count of its metric."""
    # Whole thousandths again, so that the sum does not depend on its order.
    thousandths = F.round(F.col("Distance") * SIZE_UNITS).cast("bigint")
    total = strict_sum(thousandths * F.col("Weight")).cast("double") / float(WEIGHT_UNITS * SIZE_UNITS)
    metric = F.col("Metric_Type")
    return (
        distances.groupBy(*series, "Year", "Day", *extra, "Metric_Type")
        .agg(total.alias("Q"))
        .withColumn(
            "Q",
            F.when(metric == GCC, F.col("Q") / BIN_COUNT[GCC]).when(
                metric == HSV, F.col("Q") / BIN_COUNT[HSV]
            ),
        )
    )
