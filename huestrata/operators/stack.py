"""Bins as stacked intervals and their colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huestrata.functions import rgb_to_hex, strict_sum_over, with_hsv_hex
from huestrata.schema import GCC, HSV


def stack_bins(
    df: DataFrame, keys: Sequence[str], *, order: str = "Bin", value: str = "Bin_Value"
) -> DataFrame:
    """Lay the non-empty bins of each group end to end: ``Y_min`` to ``Y_max``.

    Expects one row per bin in a group, as every job here hands over, so a
    group never holds more rows than there are bins.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.filter(F.col(value) != 0)
        .withColumn("Y_max", F.sum(value).over(upto))
        .withColumn("Y_min", F.col("Y_max") - F.col(value))
    )


def stack_shares(
    df: DataFrame, keys: Sequence[str], *, order: str, value: str = "value"
) -> DataFrame:
    """Cumulative share of the group total; NULL for an empty or incomplete group."""
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = strict_sum_over(value, whole)
    return df.withColumn("Y_max", F.try_divide(F.sum(value).over(upto), total)).withColumn(
        "Y_min", F.col("Y_max") - F.try_divide(F.col(value), total)
    ).withColumn("Y_max", F.when(F.col("Y_min").isNotNull(), F.col("Y_max")))


def colour_styles(df: DataFrame, metrics: Sequence[str] = (HSV, GCC)) -> DataFrame:
    """One row per bin and colour style.

    Hue rows get the styles H, Mean and Mode, green rows get Gcc. Only the
    styles that belong to a metric are built, and only after stacking, because
    the interval of a bin is the same for all its styles.
    """

    metric = F.col("Metric_Type")
    styles = {}
    if HSV in metrics:
        df = with_hsv_hex(
            df,
            F.when(metric == HSV, F.col("Bin")),
            {"_H": (1, 1), "_Mean": ("HSV_SMean", "HSV_VMean"), "_Mode": ("HSV_SMode", "HSV_VMode")},
        )
        styles[HSV] = ["H", "Mean", "Mode"]
    if GCC in metrics:
        df = df.withColumn("_Gcc", rgb_to_hex("Gcc_Mean_R", "Gcc_Mean_G", "Gcc_Mean_B"))
        styles[GCC] = ["Gcc"]

    def pairs(names: Sequence[str]) -> Column:
        return F.array(
            *[F.struct(F.lit(n).alias("Style"), F.col(f"_{n}").alias("Color")) for n in names]
        )

    first, *rest = metrics
    of_row = F.when(metric == first, pairs(styles[first]))
    for other in rest:
        of_row = of_row.when(metric == other, pairs(styles[other]))
    computed = [f"_{n}" for names in styles.values() for n in names]
    return df.select("*", F.inline(of_row)).drop(*computed)
