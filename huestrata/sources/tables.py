"""Histogram tables derived from the given tables.

Cameras are groups of 75 users (events) or 100 suppliers (line items), so the
number of cameras and images grows with the data while each camera keeps about
the same number of rows. A hundred cameras make a dataset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huestrata.operators.spread import spread, tasks_for
from huestrata.schema import GCC, HISTOGRAM_SCHEMA, HSV

#: Narrow keys of an image; names and calendar columns are written out at the end.
_IMAGE = ["_camera", "_date", "Hour", "Minute", "Metric_Type"]
_VALUES = ["Size", "MeanA", "MeanB", "MaxA", "MaxB"]

#: Bins of the images that a row of a table is in, and how many bins one task fills up at most.
_EVENT_BINS, _ITEM_BINS, _FILLED = 136, 36, 8_000_000

#: Rows that one task adds up where no bins are filled up; a row of events is in two bins.
_ADDED = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_histogram(
    spark: SparkSession, sf_dir: str, *, dense: bool = False, hours: str = "all"
) -> DataFrame:
    """Both metrics, one year, two images per camera and hour.

    With ``dense`` every image has all its bins, the empty ones with size 0 and
    unknown colours. ``hours="noon"`` puts all events of a day into one image at
    12:00. ``hours="day"`` puts them into the hours 8 to 18, but for every
    fourteenth day, which keeps its images at night.
    """
    hour = {
        "all": F.hour("ts"),
        "noon": F.lit(12),
        "day": F.when(F.dayofyear("ts") % 14 == 13, F.hour("ts")).otherwise(F.hour("ts") % 11 + 8),
    }[hours]
    minute = F.when(F.minute("ts") < 45, 0).otherwise(45)
    source = table(spark, sf_dir, "events")
    events = source.select(
        F.expr("user_id div 75").alias("_camera"),
        F.to_date("ts").alias("_date"),
        hour.alias("Hour"),
        (F.lit(0) if hours == "noon" else minute).alias("Minute"),
        (F.expr("(user_id * 37 + event_id) % 36") * 10).cast("int").alias("hue"),
        (F.floor("value") % 100).cast("int").alias("green"),
        (F.col("event_id") * 31 % 401 + 100).alias("pixels"),
        F.expr("user_id % 101").alias("a"),
        F.expr("event_id % 101").alias("b"),
    )
    both = F.array(
        F.struct(F.lit(HSV).alias("Metric_Type"), F.col("hue").alias("Bin")),
        F.struct(F.lit(GCC).alias("Metric_Type"), F.col("green").alias("Bin")),
    )
    days = _by_day(events, tasks_for(source, _FILLED // _EVENT_BINS if dense else _ADDED))
    bins = days.select(*events.columns, F.inline(both)).groupBy(*_IMAGE, "Bin").agg(
        F.sum("pixels").cast("double").alias("Size"),
        (F.sum("a") / (F.count("a") * 100.0)).alias("MeanA"),
        (F.sum("b") / (F.count("b") * 100.0)).alias("MeanB"),
        F.max("a").alias("MaxA"),
        F.max("b").alias("MaxB"),
    )
    return _as_histogram(_all_bins(bins) if dense else bins, "evt_")


def lineitem_histogram(spark: SparkSession, sf_dir: str, *, dense: bool = True) -> DataFrame:
    """Hue metric only, several years, one image per camera and hour 8..14."""
    source = table(spark, sf_dir, "lineitem")
    items = source.select(
        F.expr("l_suppkey div 100").alias("_camera"),
        F.to_date("l_shipdate").alias("_date"),
        (F.col("l_linenumber") + 7).alias("Hour"),
        F.lit(0).alias("Minute"),
        F.lit(HSV).alias("Metric_Type"),
        (F.expr("l_partkey % 36") * 10).cast("int").alias("Bin"),
        (F.col("l_quantity") * 100).cast("bigint").alias("pixels"),
    )
    days = _by_day(items, tasks_for(source, _FILLED // _ITEM_BINS if dense else _ADDED))
    bins = days.groupBy(*_IMAGE, "Bin").agg(
        F.sum("pixels").cast("double").alias("Size"),
        *[F.lit(None).cast("double").alias(c) for c in ("MeanA", "MeanB")],
        *[F.lit(None).cast("bigint").alias(c) for c in ("MaxA", "MaxB")],
    )
    return _as_histogram(_all_bins(bins) if dense else bins, "lin_")


def _by_day(rows: DataFrame, tasks: int) -> DataFrame:
    """The rows of a camera and day together, as the one shuffle of a table.

    Bins are added up after it: a row is in a bin that few others share, so
    adding up before would hold a hash table over a whole part of the file and
    hand over as many rows. The other keys of an image can be constants, which
    Spark drops from the grouping and would shuffle for again.
    """
    return spread(rows, ["_camera", "_date"], tasks)


def _all_bins(bins: DataFrame) -> DataFrame:
    """Every bin of every image present; an image holds at most 100 bins.

    The days are together already. A task hands over many more bins than it
    reads, and the next shuffle keeps them in its memory until they are written,
    which is why the days come in so many tasks.
    """
    images = bins.groupBy(*_IMAGE).agg(
        F.map_from_entries(F.collect_list(F.struct("Bin", F.struct(*_VALUES)))).alias("_found")
    )
    domain = F.when(
        F.col("Metric_Type") == HSV, F.sequence(F.lit(0), F.lit(350), F.lit(10))
    ).otherwise(F.sequence(F.lit(0), F.lit(99)))
    rows = images.withColumn("Bin", F.explode(domain)).withColumn(
        "_at", F.try_element_at("_found", F.col("Bin"))
    )
    return rows.select(
        *_IMAGE,
        "Bin",
        F.coalesce("_at.Size", F.lit(0.0)).alias("Size"),
        *[F.col(f"_at.{v}").alias(v) for v in _VALUES[1:]],
    )


def _as_histogram(bins: DataFrame, dataset: str) -> DataFrame:
    hue, green = F.col("Metric_Type") == HSV, F.col("Metric_Type") == GCC
    columns = {
        "Dataset": F.concat(F.lit(dataset), F.expr("_camera div 100").cast("string")),
        "Camera_ID": F.concat(F.lit("cam_"), F.col("_camera").cast("string")),
        "Year": F.year("_date"),
        "Day": F.dayofyear("_date"),
        "Considered_Pixels": F.lit(1_000_000),
        "HSV_Bin": F.when(hue, F.col("Bin")).otherwise(-1),
        "HSV_H": F.when(hue, F.col("Size")),
        "HSV_SMean": F.when(hue, F.col("MeanA")),
        "HSV_VMean": F.when(hue, F.col("MeanB")),
        "HSV_SMode": F.when(hue, F.col("MaxA") / 100.0),
        "HSV_VMode": F.when(hue, F.col("MaxB") / 100.0),
        "Gcc_Bin": F.when(green, F.col("Bin")).otherwise(-1),
        "Gcc_Value": F.when(green, F.col("Size")),
        "Gcc_Mean_R": F.when(green, F.col("MeanA")),
        "Gcc_Mean_G": F.when(green, F.col("MeanB")),
        "Gcc_Mean_B": F.when(green, F.col("MaxA") / 100.0),
    }
    return bins.select(
        *[columns.get(f.name, F.col(f.name)).alias(f.name) for f in HISTOGRAM_SCHEMA.fields]
    )
