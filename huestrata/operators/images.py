"""Choosing one image per hour (or per day) out of several."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huestrata.operators.groups import hours_seen
from huestrata.operators.spread import spread, tasks_for
from huestrata.schema import SERIES


def pick_first_image(
    df: DataFrame,
    grain: Sequence[str] = ("Year", "Day", "Hour"),
    *,
    series: Sequence[str] = SERIES,
    order: Sequence[str] = ("Minute", "Camera_ID"),
    bin_keys: Sequence[str] = ("Metric_Type", "Bin"),
    cluster: Sequence[str] = ("Year", "Day"),
    tasks: int | None = None,
) -> DataFrame:
    """Keep the bins of the earliest image of every group of ``grain``.

    One shuffle brings a day together. A running minimum of the image key finds
    the earliest image (an unknown place in the order comes last), and only its
    rows stay, so bins of two images never mix. Copies are then folded within
    the day, so a copy never counts twice; of unequal rows of one bin the same
    one stays in every run. The output stays partitioned by ``series`` and
    ``cluster`` and later day-level steps need no further shuffle. The rows are
    counted first, and dealt to so many tasks that none has to hold more than
    fit its memory; ``tasks`` gives the number instead.

    An hour has at most 60 images by camera and minute, so a day is bounded by
    its distinct rows. ``write_histograms`` folds copies, with a map-side stage,
    before they are stored.
    """
    keys = [*series, *grain]
    order = [c for c in order if c not in keys]
    values = [c for c in df.columns if c not in {*keys, *order, *bin_keys}]
    place = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])
    earliest = F.min("_place").over(Window.partitionBy(*keys))
    kept = (
        spread(df, [*series, *cluster], tasks_for(df) if tasks is None else tasks)
        .withColumn("_place", place)
        .withColumn("_first", earliest)
        .filter("_place <=> _first")
    )
    one = kept.withColumn("_hash", F.xxhash64(*values)).groupBy(*keys, *order, *bin_keys)
    return one.agg(*[F.min_by(c, "_hash").alias(c) for c in values]).select(*df.columns)


def pick_first_in_file(
    df: DataFrame,
    grain: Sequence[str] = ("Year", "Day", "Hour"),
    *,
    place: str,
    series: Sequence[str] = SERIES,
    image: Sequence[str] = ("Minute", "Camera_ID"),
    bin_keys: Sequence[str] = ("Metric_Type", "Bin"),
    cluster: Sequence[str] = ("Year", "Day"),
) -> DataFrame:
    """Keep the bins of the image of every group of ``grain`` that comes first in the files.

    ``place`` is the place of a row in its files, as the readers add it. An image
    counts as where its first row stands, so bins of two images never mix; of
    repeated rows of one bin the first stays. One shuffle brings a day together,
    as in ``pick_first_image``, and a day is bounded in the same way.
    """
    keys = [*series, *grain]
    of_image = [*keys, *[c for c in image if c not in keys]]
    values = [c for c in df.columns if c not in {*of_image, *bin_keys, place}]
    kept = (
        spread(df, [*series, *cluster], tasks_for(df))
        .withColumn("_own", F.min(place).over(Window.partitionBy(*of_image)))
        .withColumn("_first", F.min("_own").over(Window.partitionBy(*keys)))
        .filter("_own = _first")
    )
    one = kept.groupBy(*of_image, *bin_keys)
    first = [F.min_by(c, place).alias(c) for c in values]
    return one.agg(*first, F.min(place).alias(place)).select(*df.columns)


def only_complete_days(
    picked: DataFrame,
    *,
    series: Sequence[str] = SERIES,
    exactly: int | None = None,
    at_least: int | None = None,
) -> DataFrame:
    """Keep days by their number of imaged hours.

    For the output of :func:`pick_first_image`: a day is bounded there and the
    rows are already together, so a window costs no shuffle.
    """
    return mark_hours(picked, series=series).filter(
        F.col("_hours") == exactly if exactly is not None else F.col("_hours") >= at_least
    ).drop("_hours")


def mark_hours(picked: DataFrame, *, series: Sequence[str] = SERIES) -> DataFrame:
    day = Window.partitionBy(*series, "Year", "Day")
    return picked.withColumn("_hours", F.bit_count(hours_seen().over(day)))
