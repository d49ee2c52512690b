"""Choosing, ordering, renaming and collapsing columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huestrata.functions import as_integer, clean_nan
from huestrata.schema import ATTRIBUTES, GCC, HSV, SERIES


def keep_containing(df: DataFrame, *texts: str, also: Sequence[str] = ()) -> DataFrame:
    """Keep columns whose name contains one of the texts, in any letter case."""
    return df.select(
        [c for c in df.columns if c in also or any(t.lower() in c.lower() for t in texts)]
    )


def drop_containing(df: DataFrame, *texts: str) -> DataFrame:
    """Drop columns whose name contains one of the texts, in any letter case."""
    return df.select(
        [c for c in df.columns if not any(t.lower() in c.lower() for t in texts)]
    )


def move_first(df: DataFrame, *first: str) -> DataFrame:
    """Put the named columns first and keep the rest in their order."""
    return df.select(*first, *[c for c in df.columns if c not in first])


def clean_histograms(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating-point column."""
    floating = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: clean_nan(c) for c in floating})


def metric_from_sentinel(df: DataFrame) -> DataFrame:
    """Work out the metric of a row from the -1 left in the unused bin column."""
    return df.withColumn(
        "Metric_Type", F.when(F.col("HSV_Bin") == -1, GCC).when(F.col("Gcc_Bin") == -1, HSV)
    )


def collapse_metric(
    df: DataFrame,
    attributes: Sequence[str] = ATTRIBUTES,
    metrics: Sequence[str] = (HSV, GCC),
    units: int = 1,
) -> DataFrame:
    """Merge the two halves of a histogram row into ``Bin`` and ``Bin_Value``.

    Sizes become BIGINT: pixels cut to whole ones, or parts of a pixel rounded
    to whole ``units``, for jobs that weight them before they cut. Only the colour attributes and
    the halves asked for are carried on, so the scan reads no more than the
    job needs. Rows of another metric get no bin.
    """
    halves = {HSV: ("HSV_Bin", "HSV_H"), GCC: ("Gcc_Bin", "Gcc_Value")}
    dropped = {*halves[HSV], *halves[GCC], "Metric_Type", *ATTRIBUTES}

    def of_metric(place: int) -> Column:
        first, *rest = metrics
        value = F.when(F.col("Metric_Type") == first, F.col(halves[first][place]))
        for metric in rest:
            value = value.when(F.col("Metric_Type") == metric, F.col(halves[metric][place]))
        return value

    return df.select(
        *[c for c in df.columns if c not in dropped],
        "Metric_Type",
        of_metric(0).alias("Bin"),
        as_integer(
            of_metric(1) if units == 1 else F.round(of_metric(1) * units), "bigint"
        ).alias("Bin_Value"),
        *[clean_nan(c).alias(c) for c in attributes],
    )


def long_histogram(
    hist: DataFrame,
    *,
    series: Sequence[str] = SERIES,
    attributes: Sequence[str] = (),
    metrics: Sequence[str] = (HSV, GCC),
    extra: Sequence[str] = (),
    units: int = 1,
    other_rows: bool = False,
) -> DataFrame:
    """The image key, bin, size and chosen attributes of the chosen metrics.

    With ``other_rows`` the rows of other metrics stay, without a bin: an image
    is then chosen by all its rows, whatever metrics are asked for.
    """
    keys = dict.fromkeys([*SERIES, *series, "Year", "Day", "Hour", "Minute", *extra])
    if set(metrics) != {HSV, GCC} and not other_rows:
        hist = hist.filter(F.col("Metric_Type").isin(list(metrics)))
    return collapse_metric(hist, attributes, metrics, units).select(
        *keys, "Metric_Type", "Bin", "Bin_Value", *attributes
    )
