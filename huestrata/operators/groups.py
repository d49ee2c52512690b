"""Keeping rows by what holds for their group.

Group figures are aggregated first, with a map-side partial stage, and the
fact rows are then matched by a left semi join. A group of any size therefore
never sits in one task: Spark broadcasts the group table when its measured
size allows and otherwise splits skewed join partitions at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huestrata.functions import strict_sum


def keep_matching(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key also occurs in ``other`` (a membership test on a table).

    The keys are made distinct first, so a key that fills ``other`` costs one
    row per map task.
    """
    return df.join(other.select(*on).distinct(), list(on), "left_semi")


def keep_groups(df: DataFrame, keys: Sequence[str], figure: Column, holds) -> DataFrame:
    """Rows of the groups whose aggregate ``figure`` satisfies ``holds``."""
    groups = df.groupBy(*keys).agg(figure.alias("_figure")).filter(holds(F.col("_figure")))
    return df.join(groups.select(*keys), list(keys), "left_semi")


def keep_groups_by_size(
    df: DataFrame, keys: Sequence[str], *, exactly: int | None = None, at_least: int | None = None
) -> DataFrame:
    def holds(n: Column) -> Column:
        return n == exactly if exactly is not None else n >= at_least

    return keep_groups(df, keys, F.count(F.lit(1)), holds)


def keep_groups_by_sum(df: DataFrame, keys: Sequence[str], amount: str, total: int) -> DataFrame:
    """Rows of the groups whose ``amount`` adds up to ``total``, with no gap in it."""
    return keep_groups(df, keys, strict_sum(amount), lambda s: s == total)


def hours_seen(hour: str = "Hour") -> Column:
    """Aggregate with one bit per hour of the day; plain hash aggregation."""
    return F.bit_or(F.expr(f"shiftleft(1, `{hour}`)"))


def keep_complete_days(
    df: DataFrame, hours: int, keys: Sequence[str] = ("Dataset", "Camera_ID", "Year", "Day")
) -> DataFrame:
    """Rows of the days on which exactly ``hours`` distinct hours were seen."""
    return keep_groups(df, keys, F.bit_count(hours_seen()), lambda n: n == hours)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("Rows")).filter("Rows > 1")
