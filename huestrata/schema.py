"""Column contracts and fixed weighting values.

A histogram table holds one row per image, metric and bin. An image is
identified by (Dataset, Camera_ID, Year, Day, Hour, Minute), where ``Day`` is
the day of the year. ``Metric_Type`` says which half of the columns is in use;
the bin column of the other half holds the sentinel -1.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import types as T

HSV = "HSV"
GCC = "Gcc"

#: One time series per camera. Jobs that pool cameras pass ("Dataset",).
SERIES = ("Dataset", "Camera_ID")

TIMING_SCHEMA = T.StructType(
    [T.StructField("cores", T.IntegerType()), T.StructField("exectime", T.DoubleType())]
)

HSV_ATTRIBUTES = ("HSV_SMean", "HSV_VMean", "HSV_SMode", "HSV_VMode")
GCC_ATTRIBUTES = ("Gcc_Mean_R", "Gcc_Mean_G", "Gcc_Mean_B")
ATTRIBUTES = HSV_ATTRIBUTES + GCC_ATTRIBUTES

# ---------------------------------------------------------------------------
# Columns of the histogram files, bin counts, weights per hour and
# weights per day lag. Every weight list sums to 1.
# ---------------------------------------------------------------------------
HISTOGRAM_SCHEMA = T.StructType(
    [
        T.StructField("Dataset", T.StringType()),
        T.StructField("Camera_ID", T.StringType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Day", T.IntegerType()),
        T.StructField("Hour", T.IntegerType()),
        T.StructField("Minute", T.IntegerType()),
        T.StructField("Metric_Type", T.StringType()),
        T.StructField("Considered_Pixels", T.IntegerType()),
        T.StructField("HSV_Bin", T.IntegerType()),
        T.StructField("HSV_H", T.DoubleType()),
        T.StructField("HSV_SMean", T.DoubleType()),
        T.StructField("HSV_VMean", T.DoubleType()),
        T.StructField("HSV_SMode", T.DoubleType()),
        T.StructField("HSV_VMode", T.DoubleType()),
        T.StructField("Gcc_Bin", T.IntegerType()),
        T.StructField("Gcc_Value", T.DoubleType()),
        T.StructField("Gcc_Mean_R", T.DoubleType()),
        T.StructField("Gcc_Mean_G", T.DoubleType()),
        T.StructField("Gcc_Mean_B", T.DoubleType()),
    ]
)

BIN_COUNT = {HSV: 360, GCC: 100}

HOURS_9_TO_15 = {9: "0.05", 10: "0.05", 11: "0.1", 12: "0.3", 13: "0.3", 14: "0.15", 15: "0.05"}
HOURS_7_TO_16 = {7: "0.05", 9: "0.075", 10: "0.075", 12: "0.3", 13: "0.3", 15: "0.15", 16: "0.05"}
HOURS_8_TO_18 = {
    8: "0.025", 9: "0.05", 10: "0.05", 11: "0.1", 12: "0.15", 13: "0.25",
    14: "0.15", 15: "0.1", 16: "0.05", 17: "0.05", 18: "0.025",
}

#: Hour part and day-lag part (lag 0 first) of the three-day window.
KERNEL_HOURS_10_TO_14 = {10: "0.1", 11: "0.15", 12: "0.25", 13: "0.3", 14: "0.2"}
KERNEL_LAGS_3 = ("0.4", "0.35", "0.25")

#: Hour part shared by the 2, 5, 7 and 10 day windows, and their day-lag parts.
KERNEL_HOURS_8_TO_18 = {
    8: "0.025", 9: "0.025", 10: "0.05", 11: "0.1", 12: "0.175", 13: "0.25",
    14: "0.175", 15: "0.1", 16: "0.05", 17: "0.025", 18: "0.025",
}
KERNEL_LAGS_2 = ("0.7", "0.3")
KERNEL_LAGS_5 = ("0.2", "0.2", "0.2", "0.2", "0.2")
KERNEL_LAGS_7 = ("0.2", "0.15", "0.15", "0.15", "0.15", "0.1", "0.1")
KERNEL_LAGS_10 = ("0.15", "0.1", "0.1", "0.1", "0.1", "0.1", "0.1", "0.1", "0.1", "0.05")

#: The published window figures end on days 1..357 of a 365-day year. Nothing else is cut there.
FIGURE_LAST_GROUP = 357
FIGURE_DAYS = 365
# ---------------------------------------------------------------------------

#: Weights are kept as whole numbers of ten-thousandths, so that weighted sums
#: of pixel counts are exact BIGINT arithmetic and truncate the same way under
#: any partitioning.
WEIGHT_UNITS = 10_000

#: Sizes are weighted as whole thousandths of a pixel, and truncated after that.
SIZE_UNITS = 1_000

#: Colour attributes are summed as whole billionths, for the same reason.
ATTRIBUTE_UNITS = 1_000_000_000


def to_units(weight: str | float | Decimal) -> int:
    """A weight as a whole number of ten-thousandths; finer weights are refused."""
    scaled = Decimal(str(weight)) * WEIGHT_UNITS
    if scaled != scaled.to_integral_value():
        raise ValueError(f"weight {weight} has more than four decimals")
    return int(scaled)


def hour_units(weights: Mapping[int, str]) -> dict[int, int]:
    for hour in weights:
        if not 0 <= hour <= 23:
            raise ValueError(f"hour {hour} is outside 0..23")
    return {hour: to_units(weight) for hour, weight in weights.items()}


def lag_units(weights: Sequence[str]) -> list[int]:
    return [to_units(weight) for weight in weights]
