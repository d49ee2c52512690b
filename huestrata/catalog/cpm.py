"""Registered queries on stacked, coloured bins, with their check SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

import huestrata as hs
from huestrata.catalog import oracle_parts as sql
from huestrata.operators.reshape import pivot_bins
from huestrata.schema import GCC, HOURS_7_TO_16, HOURS_9_TO_15, HSV
from huestrata.sources.files import inline_palette, melt_shares
from huestrata.sources.shared import shared_folder
from huestrata.sources.tables import events_histogram

# The colours of the share picture, first bin first.
PALETTE = (
    "#99540f", "#b26f2c", "#cc8e51", "#e5b17e", "#ffd8b2",
    "#6b990f", "#85b22c", "#a3cc51", "#c3e57e", "#e5ffb2",
    "#0f6b99", "#2c85b2", "#51a3cc", "#7ec3e5", "#b2e5ff",
    "#260f99", "#422cb2", "#6551cc", "#8f7ee5", "#bfb2ff",
)


def _daily(metrics):
    return lambda spark, sf: hs.daily_cpm(events_histogram(spark, sf, hours="noon"), metrics=metrics)


def _daily_earliest(spark, sf):
    """Days with many images, of which the earliest is asked for."""
    return hs.daily_cpm(events_histogram(spark, sf), metrics=(HSV,), pick="earliest")


def _hourly(spark, sf):
    return hs.hourly_cpm(events_histogram(spark, sf))


def _noon(spark, sf):
    return hs.noon_cpm(events_histogram(spark, sf))


def _weighted_hsv(spark, sf):
    return hs.weighted_cpm(events_histogram(spark, sf), HOURS_9_TO_15, metrics=(HSV,))


def _weighted_gcc(spark, sf):
    return hs.weighted_cpm(
        events_histogram(spark, sf), HOURS_7_TO_16, metrics=(GCC,), require_hours=7
    )


def wide_shares(spark, sf):
    """The wide share table (database, sequence, year, X0..X99) of each camera's days."""
    hist = events_histogram(spark, sf).filter(F.col("Metric_Type") == GCC)
    days = hist.groupBy(
        F.concat_ws("_", "Dataset", "Camera_ID").alias("database"),
        F.col("Day").cast("string").alias("sequence"),
        F.col("Year").cast("double").alias("year"),
        F.col("Gcc_Bin").alias("Bin"),
    ).agg(F.sum("Gcc_Value").alias("Bin_Value"))
    return pivot_bins(days, ["database", "sequence", "year"], range(100)).fillna(0.0)


def _shares(spark, sf):
    return hs.share_cpm(melt_shares(wide_shares(spark, sf), 30, 50), low=30, high=50)


def _palette(spark, sf):
    return hs.with_palette(_shares(spark, sf), inline_palette(spark, PALETTE))


def _palette_file(spark, sf):
    """The same colours out of a palette file with comments and blank lines."""
    path = f"{shared_folder(spark)}/palette-{uuid4().hex}"
    lines = ["? colours of the share picture", "", *(f"{c} ? bin" for c in PALETTE), ""]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return hs.with_palette(_shares(spark, sf), hs.read_palette(spark, path))


QUERIES = {
    "daily_cpm_hsv": _daily((HSV,)),
    "daily_cpm_gcc": _daily((GCC,)),
    "hourly_cpm": _hourly,
    "noon_cpm": _noon,
    "weighted_cpm_hsv": _weighted_hsv,
    "weighted_cpm_gcc": _weighted_gcc,
    "share_cpm": _shares,
    "palette_lookup": _palette,
    "palette_file_scan": _palette_file,
    "daily_cpm_earliest": _daily_earliest,
}


def _day_picked(where: str = "true") -> str:
    return f"""
ranked AS (
  SELECT *, rank() OVER (PARTITION BY {sql.SERIES}, Year, Day ORDER BY Hour, Minute) AS r
  FROM hist WHERE {where}),
picked AS (SELECT * FROM ranked WHERE r = 1)"""


def _merged(weights, require: int | None) -> str:
    complete = (
        f"""
complete AS (SELECT {sql.SERIES}, Year, Day FROM picked GROUP BY ALL
             HAVING count(DISTINCT Hour) = {require}),"""
        if require
        else f"""
complete AS (SELECT DISTINCT {sql.SERIES}, Year, Day FROM picked),"""
    )

    def attribute(c: str) -> str:
        units = f"CAST(floor({c} * 1e9 + 0.5) AS BIGINT)"
        return f"CAST(coalesce(sum(W * {units}), 0) AS DOUBLE) / 1e13 AS {c}"

    columns = ", ".join(attribute(c) for c in ("MeanA", "MeanB", "MaxA", "MaxB"))
    return f"""{sql.hour_table(weights)},{sql.first_image("hist", where=sql.listed(weights))},{complete}
merged AS (
  SELECT {sql.SERIES}, Year, Day, Metric_Type, Bin,
         CAST(sum(W * Bin_Value) AS BIGINT) // 10000 AS Bin_Value, {columns}
  FROM picked JOIN complete USING ({sql.SERIES}, Year, Day) JOIN weights USING (Hour)
  GROUP BY ALL)"""


_NOON_STYLE = "CASE WHEN Style = 'Gcc' THEN 'Gcc_Mean' ELSE 'HSV_' || Style END AS Style"

_SHARE_STACK = f"""
SELECT database, CAST(sequence AS INTEGER) AS sequence, CAST(Year AS DOUBLE) AS year,
       CAST(variable AS DOUBLE) / 100 AS variable, value,
       sum(value) OVER w / CAST(sum(value) OVER g AS DOUBLE) AS Y_max,
       sum(value) OVER w / CAST(sum(value) OVER g AS DOUBLE)
         - value / CAST(sum(value) OVER g AS DOUBLE) AS Y_min
FROM cells
WINDOW g AS (PARTITION BY database, Year, sequence),
       w AS (PARTITION BY database, Year, sequence ORDER BY variable ROWS UNBOUNDED PRECEDING)"""

_SHARE_CELLS = f"""WITH {sql.EVENT_BINS},
days AS (
  SELECT Dataset || '_' || Camera_ID AS database, Day AS sequence, Year, Bin,
         CAST(sum(Bin_Value) AS BIGINT) AS value
  FROM hist WHERE Metric_Type = 'Gcc' GROUP BY ALL),
raw_cells AS (
  SELECT d.database, d.sequence, d.Year, v.variable, coalesce(days.value, 0) AS value
  FROM (SELECT DISTINCT database, sequence, Year FROM days) d,
       (SELECT CAST(unnest(range(30, 50)) AS INTEGER) AS variable) v
  LEFT JOIN days ON days.database = d.database AND days.sequence = d.sequence
    AND days.Year = d.Year AND days.Bin = v.variable),
cells AS (
  SELECT database, sequence, Year, variable, value,
         sum(value) OVER (PARTITION BY database, sequence, Year) AS total FROM raw_cells)"""

_SHARES_SQL = _SHARE_CELLS + _SHARE_STACK.replace(
    "CAST(sum(value) OVER g AS DOUBLE)", "nullif(CAST(sum(value) OVER g AS DOUBLE), 0)"
)

ORACLE = {
    "daily_cpm_hsv": f"WITH {sql.EVENT_NOON}"
    + sql.stacked("hist", ("Year", "Day"), ("HSV",)),
    "daily_cpm_gcc": f"WITH {sql.EVENT_NOON}"
    + sql.stacked("hist", ("Year", "Day"), ("Gcc",)),
    "daily_cpm_earliest": f"WITH {sql.EVENT_BINS}, {_day_picked()}"
    + sql.stacked("picked", ("Year", "Day"), ("HSV",)),
    "hourly_cpm": f"WITH {sql.EVENT_BINS}, {sql.first_image('hist')}"
    + sql.stacked(
        "picked", ("Year", "Day", "Hour"), extra=", printf('Hour %02d', Hour) AS Fct"
    ),
    "noon_cpm": f"WITH {sql.EVENT_BINS}, {_day_picked('Hour = 12')}, cpm AS ("
    + sql.stacked("picked", ("Year", "Day"))
    + f") SELECT * REPLACE ({_NOON_STYLE}) FROM cpm",
    "weighted_cpm_hsv": f"WITH {sql.EVENT_BINS}, {_merged(sql.HOURS_9_TO_15, None)}"
    + sql.stacked("merged", ("Year", "Day"), ("HSV",)),
    "weighted_cpm_gcc": f"WITH {sql.EVENT_BINS}, {_merged(sql.HOURS_7_TO_16, 7)}"
    + sql.stacked("merged", ("Year", "Day"), ("Gcc",)),
    "share_cpm": _SHARES_SQL,
    "palette_lookup": f"SELECT s.*, p.color FROM ({_SHARES_SQL}) s LEFT JOIN (VALUES "
    + ", ".join(f"({30 + i}, '{c.upper()}')" for i, c in enumerate(PALETTE))
    + ") p(bin, color) ON p.bin = CAST(round(s.variable * 100) AS INTEGER)",
}
ORACLE["palette_file_scan"] = ORACLE["palette_lookup"]
