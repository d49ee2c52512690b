"""Registered queries that pass the derived tables through files."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

import huestrata as hs
from huestrata.catalog import cpm, verbs
from huestrata.catalog import oracle_parts as sql
from huestrata.operators.columns import long_histogram
from huestrata.operators.images import pick_first_in_file
from huestrata.sources.files import FILE_PLACE
from huestrata.sources.shared import shared_folder
from huestrata.sources.tables import events_histogram, table


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def _through_csv(df, name):
    """Write with the columns in reverse, so that only their names can match."""
    path = _folder(df.sparkSession, name)
    df.select(*df.columns[::-1]).write.csv(path, header=True, compression="gzip")
    return path


def _histogram_csv(spark, sf):
    """Two groups of files, each with the columns in another order."""
    hist = events_histogram(spark, sf)
    path = _through_csv(hist.filter("Metric_Type = 'HSV'"), "histogram")
    order = sorted(hist.columns)
    green = hist.filter("Metric_Type = 'Gcc'").select(*order)
    green.write.mode("append").csv(path, header=True, compression="gzip")
    return hs.read_histogram_csv(spark, path)


def _coefficient_csv(spark, sf):
    """Coefficient tables with inferred column types, bound by image name."""
    green, red = verbs.coefficient_tables(spark, sf)
    return hs.mean_coefficients(
        hs.read_plain_csv(spark, _through_csv(green, "green")),
        hs.read_plain_csv(spark, _through_csv(red, "red")),
    )


def _histogram_parquet(spark, sf):
    path = _folder(spark, "layout")
    hs.write_histograms(events_histogram(spark, sf), path)
    return hs.read_histograms(spark, path)


def _share_csv(spark, sf):
    path = _through_csv(cpm.wide_shares(spark, sf), "shares")
    return hs.share_cpm(hs.read_share_csv(spark, path, 30, 50), low=30, high=50)


def _timing_csv(spark, sf):
    path = _through_csv(verbs.samples(spark, sf).filter(F.col("dataset") == "items"), "timing")
    return hs.read_timing_csv(spark, path)


def _figure_table(spark, sf):
    path = _folder(spark, "figure")
    table = hs.daily_cpm(events_histogram(spark, sf, hours="noon"), metrics=("HSV",))
    hs.write_table(table, path, by=["Year"], order=["Style", "Year", "Day", "Bin"])
    return spark.read.parquet(path)


def _ordered_sink(spark, sf):
    """The orders written in total order and numbered as their files, read by name, hold them."""
    path = _folder(spark, "ordered")
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_orderdate", "o_orderkey", "o_totalprice")
    hs.write_table(orders, path, order=["o_orderstatus", "o_orderdate", "o_orderkey"], total_order=True)
    return hs.read_numbered(spark, path)


def _ordered_folders(spark, sf):
    """The same with a folder for each year, ordered by price within it."""
    path = _folder(spark, "folders")
    orders = table(spark, sf, "orders").select(F.year("o_orderdate").alias("Year"), "o_orderkey", "o_totalprice")
    hs.write_table(orders, path, by=["Year"], order=["o_totalprice", "o_orderkey"], total_order=True)
    return hs.read_numbered(spark, path)


def _file_order(spark, sf):
    """The image of an hour that comes first in files written by later minutes and later cameras first."""
    path = _folder(spark, "backwards")
    hist = events_histogram(spark, sf).withColumn("Later", -F.col("Minute"))
    number = F.regexp_extract("Camera_ID", r"(\d+)", 1).cast("int")
    hist = hist.withColumn("Camera", -number)
    hs.write_table(hist, path, order=["Dataset", "Year", "Day", "Hour", "Later", "Camera"], total_order=True)
    stored = long_histogram(hs.read_histograms(spark, path, place=FILE_PLACE), extra=(FILE_PLACE,))
    return pick_first_in_file(stored, place=FILE_PLACE, series=("Dataset",)).drop(FILE_PLACE)


def _inferred_csv(spark, sf):
    """Types found by column name in files of three headers, one of them without two of the columns."""
    path = _folder(spark, "inferred")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("Key"),
        F.col("o_orderdate").cast("date").alias("Day"),
        F.col("o_totalprice").alias("Price"),
        (F.col("o_totalprice") > 100_000).alias("Dear"),
        F.col("o_orderstatus").alias("Status"),
        (F.col("o_orderkey").cast("bigint") * 3_000_000_000).alias("Long"),
    )
    names = orders.columns
    for rest, columns in enumerate([names, names[::-1], ["Status", "Key", "Price", "Dear"]]):
        part = orders.filter(F.col("Key") % 3 == rest).select(*columns)
        part.write.mode("append").csv(path, header=True, compression="gzip")
    return hs.read_plain_csv(spark, path).withColumn("Day", F.dayofyear("Day"))


QUERIES = {
    "ordered_sink": _ordered_sink,
    "ordered_sink_folders": _ordered_folders,
    "dedup_file_order": _file_order,
    "inferred_csv_scan": _inferred_csv,
    "histogram_csv_scan": _histogram_csv,
    "histogram_parquet_layout": _histogram_parquet,
    "share_csv_scan": _share_csv,
    "timing_csv_scan": _timing_csv,
    "figure_table_sink": _figure_table,
    "coefficient_csv_scan": _coefficient_csv,
}

_HISTOGRAM = f"""WITH {sql.EVENT_BINS}
SELECT {sql.SERIES}, Year, Day, Hour, Minute, Metric_Type, 1000000 AS Considered_Pixels,
       CASE WHEN Metric_Type = 'HSV' THEN Bin ELSE -1 END AS HSV_Bin,
       CASE WHEN Metric_Type = 'HSV' THEN CAST(Bin_Value AS DOUBLE) END AS HSV_H,
       CASE WHEN Metric_Type = 'HSV' THEN MeanA END AS HSV_SMean,
       CASE WHEN Metric_Type = 'HSV' THEN MeanB END AS HSV_VMean,
       CASE WHEN Metric_Type = 'HSV' THEN MaxA END AS HSV_SMode,
       CASE WHEN Metric_Type = 'HSV' THEN MaxB END AS HSV_VMode,
       CASE WHEN Metric_Type = 'Gcc' THEN Bin ELSE -1 END AS Gcc_Bin,
       CASE WHEN Metric_Type = 'Gcc' THEN CAST(Bin_Value AS DOUBLE) END AS Gcc_Value,
       CASE WHEN Metric_Type = 'Gcc' THEN MeanA END AS Gcc_Mean_R,
       CASE WHEN Metric_Type = 'Gcc' THEN MeanB END AS Gcc_Mean_G,
       CASE WHEN Metric_Type = 'Gcc' THEN MaxA END AS Gcc_Mean_B
FROM hist"""

ORACLE = {
    "ordered_sink": """
SELECT o_orderstatus, o_orderdate, o_orderkey, o_totalprice,
       row_number() OVER (ORDER BY o_orderstatus, o_orderdate, o_orderkey) AS "Row" FROM orders""",
    "ordered_sink_folders": """
SELECT CAST(year(o_orderdate) AS INTEGER) AS Year, o_orderkey, o_totalprice,
       row_number() OVER (ORDER BY year(o_orderdate), o_totalprice, o_orderkey) AS "Row" FROM orders""",
    "dedup_file_order": f"""WITH {sql.EVENT_BINS},
ranked AS (
  SELECT *, rank() OVER (PARTITION BY Dataset, Year, Day, Hour
                         ORDER BY Minute DESC, CAST(regexp_extract(Camera_ID, '[0-9]+') AS INTEGER) DESC) AS r
  FROM hist)
SELECT {sql.SERIES}, Year, Day, Hour, Minute, Metric_Type, Bin, Bin_Value FROM ranked WHERE r = 1""",
    "inferred_csv_scan": """
SELECT CAST(o_orderkey AS INTEGER) AS "Key", CASE WHEN o_orderkey % 3 < 2 THEN CAST(dayofyear(o_orderdate) AS INTEGER) END AS "Day",
       o_totalprice AS Price, o_totalprice > 100000 AS Dear, o_orderstatus AS Status,
       CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderkey AS BIGINT) * 3000000000 END AS "Long"
FROM orders""",
    "histogram_csv_scan": _HISTOGRAM,
    "histogram_parquet_layout": _HISTOGRAM,
    "share_csv_scan": cpm.ORACLE["share_cpm"],
    "timing_csv_scan": "SELECT l_linenumber AS cores, l_extendedprice AS exectime FROM lineitem",
    "figure_table_sink": cpm.ORACLE["daily_cpm_hsv"],
    "coefficient_csv_scan": verbs.ORACLE["mean_coefficients"],
}
