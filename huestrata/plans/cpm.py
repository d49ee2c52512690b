"""Tables of stacked, coloured bins: one column of intervals per day or image."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huestrata.functions import hour_label, paste, with_hsv_hex
from huestrata.operators.columns import long_histogram, move_first
from huestrata.operators.images import pick_first_image
from huestrata.operators.kernels import Cells, kernel_windows
from huestrata.operators.merge import weighted_day_merge
from huestrata.operators.reshape import refuse_unless
from huestrata.operators.spread import spread, tasks_for
from huestrata.operators.stack import colour_styles, stack_bins, stack_shares
from huestrata.operators.windows import multi_day_window
from huestrata.schema import GCC, GCC_ATTRIBUTES, HSV, HSV_ATTRIBUTES, SERIES


def _long(hist: DataFrame, series: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """All rows of the images: which image is chosen does not depend on the metrics asked for."""
    return long_histogram(
        hist, series=series, attributes=_attributes(metrics), metrics=metrics, other_rows=True
    )


def _attributes(metrics: Sequence[str]) -> tuple[str, ...]:
    return (HSV_ATTRIBUTES if HSV in metrics else ()) + (GCC_ATTRIBUTES if GCC in metrics else ())


def _stacked(
    df: DataFrame, when: Sequence[str], series: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    of_metrics = df.filter(F.col("Metric_Type").isin(list(metrics)))
    stacked = stack_bins(of_metrics, [*series, *when, "Metric_Type"])
    coloured = colour_styles(stacked, metrics).withColumn("Key", paste(*when, "Bin", "Style"))
    return coloured.select(
        *series, "Style", *when, "Bin", "Metric_Type", "Bin_Value", "Color", "Key", "Y_min", "Y_max"
    )


def facet_style(cpm: DataFrame) -> DataFrame:
    """Write the styles as facet titles: ``HSV_H``, ``HSV_Mean``, ``Gcc_Mean``, ..."""
    style = F.col("Style")
    return cpm.withColumn(
        "Style", F.when(style == GCC, "Gcc_Mean").otherwise(F.concat(F.lit("HSV_"), style))
    )


def daily_cpm(
    hist: DataFrame,
    *,
    series: Sequence[str] = SERIES,
    metrics: Sequence[str] = (HSV, GCC),
    pick: str | None = None,
) -> DataFrame:
    """One column per day, from the one image of the day.

    Several images of a day have the same keys, so they are refused when the
    result is computed. ``pick="earliest"`` takes the earliest of them instead.
    """
    if pick not in (None, "earliest"):
        raise ValueError("pick is None or 'earliest'")
    long, day = _long(hist, series, metrics), ("Year", "Day")
    tasks = tasks_for(long)
    order = [c for c in ("Hour", "Minute", "Camera_ID") if c not in series]
    if pick is None:
        image, key = F.struct(*order), Window.partitionBy(*series, *day)
        one = F.min(image).over(key).eqNullSafe(F.max(image).over(key))
        long = (
            spread(long, [*series, *day], tasks)
            .withColumn("_one", one)
            .filter(refuse_unless("_one", "daily_cpm: several images of one day"))
            .drop("_one")
        )
    picked = pick_first_image(long, day, series=series, order=order, tasks=tasks)
    return _stacked(picked, day, series, metrics)


def noon_cpm(
    hist: DataFrame, *, hour: int = 12, series: Sequence[str] = SERIES,
    metrics: Sequence[str] = (HSV, GCC),
) -> DataFrame:
    """One column per day from the earliest image of a single hour."""
    noon = daily_cpm(
        hist.filter(F.col("Hour") == hour), series=series, metrics=metrics, pick="earliest"
    )
    return facet_style(noon)


def hourly_cpm(
    hist: DataFrame, *, series: Sequence[str] = SERIES, metrics: Sequence[str] = (HSV, GCC)
) -> DataFrame:
    """One column per day and hour, with a facet label for the hour."""
    picked = pick_first_image(_long(hist, series, metrics), series=series)
    stacked = _stacked(picked, ("Year", "Day", "Hour"), series, metrics)
    return stacked.withColumn("Fct", hour_label("Hour"))


def weighted_cpm(
    hist: DataFrame,
    weights: Mapping[int, str],
    *,
    series: Sequence[str] = SERIES,
    metrics: Sequence[str] = (HSV, GCC),
    require_hours: int | None = None,
    listed_hours_only: bool = True,
) -> DataFrame:
    """One column per day from the weighted hours of the day."""
    merged = weighted_day_merge(
        hist,
        weights,
        series=series,
        require_hours=require_hours,
        attributes=_attributes(metrics),
        metrics=metrics,
        listed_hours_only=listed_hours_only,
    )
    return _stacked(merged, ("Year", "Day"), series, metrics)


def window_cpm(
    hist: DataFrame,
    hours: Mapping[int, str],
    lags: Sequence[Sequence[str]],
    *,
    series: Sequence[str] = SERIES,
    **options,
) -> DataFrame:
    """One column per sliding window and window width, coloured by hue."""
    return _window_stack(multi_day_window(hist, hours, lags, series=series, **options), series)


def kernel_cpm(
    hist: DataFrame, kernels: Mapping[str, Cells], *, series: Sequence[str] = SERIES, **options
) -> DataFrame:
    """One column per sliding window and kernel, coloured by hue; see ``kernel_windows``."""
    return _window_stack(kernel_windows(hist, kernels, series=series, **options), series)


def _window_stack(merged: DataFrame, series: Sequence[str]) -> DataFrame:
    stacked = stack_bins(merged, [*series, "Year", "Mode", "Group"])
    keyed = (
        with_hsv_hex(stacked, "Bin", {"Color": (1, 1)})
        .withColumn("Style", F.lit("H"))
        .withColumn("Key", paste("Year", "Group", "Bin", "Style"))
    )
    return move_first(keyed, "Style", *series, "Year", "Group", "Bin")


def share_cpm(
    shares: DataFrame, *, low: int, high: int,
    keys: Sequence[str] = ("database", "year", "sequence"),
) -> DataFrame:
    """Cumulative shares of the bins ``low <= variable < high`` of each day.

    Expects (database, year, sequence, variable, value). Rows of one bin are
    added up first, with a map-side stage, so a stack is bounded by its bins.
    """
    per_bin = (
        shares.filter((F.col("variable") >= low) & (F.col("variable") < high))
        .groupBy(*keys, "variable")
        .agg(F.when(F.count("value") == F.count(F.lit(1)), F.sum("value")).alias("value"))
    )
    stacked = stack_shares(per_bin, keys, order="variable")
    return stacked.withColumn("variable", F.col("variable") / 100)


def with_palette(
    cpm: DataFrame, palette: DataFrame, *, first: int = 30, variable: str = "variable"
) -> DataFrame:
    """Give the bins the palette colours in order, the first bin the first colour."""
    pos = (F.round(F.col(variable) * 100).cast("int") - first + 1).alias("pos")
    return cpm.select("*", pos).join(palette, "pos", "left").drop("pos")


