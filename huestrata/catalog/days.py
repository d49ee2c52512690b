"""Registered queries on merged days, distances and sliding windows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

import huestrata as hs
from huestrata.catalog import oracle_parts as sql
from huestrata.functions import window_label
from huestrata.operators.columns import long_histogram
from huestrata.operators.groups import keep_complete_days
from huestrata.operators.images import pick_first_image
from huestrata.operators.kernels import kernel_of
from huestrata.schema import (
    FIGURE_DAYS,
    FIGURE_LAST_GROUP,
    HOURS_7_TO_16,
    HOURS_8_TO_18,
    HOURS_9_TO_15,
    HSV_ATTRIBUTES,
    KERNEL_HOURS_8_TO_18,
    KERNEL_HOURS_10_TO_14,
    KERNEL_LAGS_2,
    KERNEL_LAGS_3,
    KERNEL_LAGS_5,
    KERNEL_LAGS_7,
    KERNEL_LAGS_10,
)
from huestrata.sources.tables import events_histogram, lineitem_histogram

_ATTRIBUTE_OF = {"HSV_SMean": "MeanA", "HSV_VMean": "MeanB", "HSV_SMode": "MaxA", "HSV_VMode": "MaxB"}


def _first(spark, sf):
    return pick_first_image(long_histogram(events_histogram(spark, sf)))


def _first_pooled(spark, sf):
    return pick_first_image(long_histogram(events_histogram(spark, sf)), series=("Dataset",))


def _complete_days(spark, sf):
    hist = lineitem_histogram(spark, sf, dense=False)
    return keep_complete_days(long_histogram(hist), 7)


def _merge(spark, sf):
    return hs.weighted_day_merge(
        events_histogram(spark, sf, dense=True), HOURS_9_TO_15, attributes=()
    )


def _merge_attributes(spark, sf):
    hist = events_histogram(spark, sf, dense=True)
    return hs.weighted_day_merge(
        hist, HOURS_8_TO_18, attributes=HSV_ATTRIBUTES, metrics=("HSV",)
    )


def _merge_unlisted(spark, sf):
    return hs.weighted_day_merge(
        lineitem_histogram(spark, sf), HOURS_9_TO_15, attributes=(), listed_hours_only=False
    )


def _emd(spark, sf):
    return hs.hourly_distance(events_histogram(spark, sf, dense=True), HOURS_9_TO_15).drop("Weight")


def _uncertainty(spark, sf):
    return hs.uncertainty(
        events_histogram(spark, sf, dense=True), HOURS_7_TO_16, require_hours=7
    )


def _relative(spark, sf):
    return hs.relative_uncertainty(_uncertainty(spark, sf))


def _uncertainty_years(spark, sf):
    return hs.uncertainty(lineitem_histogram(spark, sf), KERNEL_HOURS_10_TO_14, require_hours=5)


def _uncertainty_day_only(spark, sf):
    return hs.uncertainty(
        lineitem_histogram(spark, sf), KERNEL_HOURS_10_TO_14, require_hours=5, match_on=("Day",)
    )


def _emd_fractions(spark, sf):
    return hs.hourly_distance(_quarters(spark, sf), HOURS_9_TO_15).drop("Weight")


def _merge_fractions(spark, sf):
    return hs.weighted_day_merge(_quarters(spark, sf), HOURS_9_TO_15, attributes=())


def _quarters(spark, sf):
    """Sizes in quarters of a pixel."""
    hist = events_histogram(spark, sf, dense=True)
    return hist.withColumns({c: F.col(c) / 4 for c in ("HSV_H", "Gcc_Value")})


def _uncertainty_unlisted(spark, sf):
    """Hours outside the list stay; their days have no known level."""
    return hs.uncertainty(
        lineitem_histogram(spark, sf), HOURS_9_TO_15, listed_hours_only=False
    )


def _uncertainty_by_area(spark, sf):
    """Days split by the masked area, which varies from hour to hour here."""
    hist = events_histogram(spark, sf, dense=True)
    area = (1_000_000 - F.col("Hour") % 2).cast("int")
    return hs.uncertainty(
        hist.withColumn("Considered_Pixels", area), HOURS_9_TO_15, extra=("Considered_Pixels",)
    )


def _daylight(spark, sf):
    return events_histogram(spark, sf, dense=True, hours="day")


_DAY_GATE = {"exact_images": 11, "minute_first": True}

#: The published figures leave out the end of the year.
_FIGURE = {"days": FIGURE_DAYS, "last_group": FIGURE_LAST_GROUP}


def _window(lags):
    return lambda spark, sf: hs.multi_day_window(
        _daylight(spark, sf), KERNEL_HOURS_8_TO_18, [lags], **_DAY_GATE
    )


def _window_three(spark, sf):
    return hs.multi_day_window(
        lineitem_histogram(spark, sf), KERNEL_HOURS_10_TO_14, [KERNEL_LAGS_3]
    )


_FOUR = (KERNEL_LAGS_2, KERNEL_LAGS_5, KERNEL_LAGS_7, KERNEL_LAGS_10)


def _window_compare(spark, sf):
    return hs.window_cpm(
        _daylight(spark, sf), KERNEL_HOURS_8_TO_18, _FOUR, **_DAY_GATE, **_FIGURE
    )


def _drift(lag: int, hour: int) -> Decimal | None:
    """Later hours weigh more on earlier days; the second day back has its noon alone."""
    if lag == 2:
        return Decimal("0.2") if hour == 12 else None
    return Decimal(hour - 9 if lag else 15 - hour) / 100 * (2 if lag else 3)


#: Not products of an hour and a day part; two of one width, one without its last day.
KERNELS = {
    "drift": kernel_of(_drift, 3, range(10, 15)),
    "noon and after": {(0, 12): "0.5", (1, 12): "0.25", (1, 13): "0.15", (2, 14): "0.1"},
    "eve": {(1, 10): "0.12345678", (1, 11): "0.37654322", (2, 12): "0.5"},
    "edge": {(0, 10): "1.5", (3, 14): "-0.5"},
}


def _window_kernels(spark, sf):
    return hs.kernel_windows(lineitem_histogram(spark, sf), KERNELS)


def _window_kernel_stacks(spark, sf):
    return hs.kernel_cpm(
        events_histogram(spark, sf, dense=True, hours="day"), KERNELS, minute_first=True, exact_images=11
    )


def _window_years(spark, sf):
    return hs.window_cpm(
        lineitem_histogram(spark, sf),
        KERNEL_HOURS_10_TO_14,
        [KERNEL_LAGS_3],
        min_images=7,
        **_FIGURE,
    )


def _distribution(spark, sf):
    return hs.bin_distribution(events_histogram(spark, sf), HOURS_7_TO_16)


def _distribution_days(spark, sf):
    return hs.bin_distribution(events_histogram(spark, sf), HOURS_7_TO_16, days=(2, 3, 5))


QUERIES = {
    "dedup_first_image": _first,
    "dedup_pooled_cameras": _first_pooled,
    "complete_days": _complete_days,
    "weighted_day_merge": _merge,
    "weighted_attr_merge": _merge_attributes,
    "weighted_unlisted_hours": _merge_unlisted,
    "emd_hourly": _emd,
    "uncertainty_abs": _uncertainty,
    "uncertainty_rel": _relative,
    "uncertainty_multi_year": _uncertainty_years,
    "uncertainty_dayonly_compat": _uncertainty_day_only,
    "window_02": _window(KERNEL_LAGS_2),
    "window_03": _window_three,
    "window_05": _window(KERNEL_LAGS_5),
    "window_07": _window(KERNEL_LAGS_7),
    "window_10": _window(KERNEL_LAGS_10),
    "window_compare": _window_compare,
    "window_kernels": _window_kernels,
    "window_kernel_stacks": _window_kernel_stacks,
    "window_multi_year": _window_years,
    "bin_distribution": _distribution,
    "bin_distribution_days": _distribution_days,
    "weighted_fractions": _merge_fractions,
    "emd_fractions": _emd_fractions,
    "uncertainty_unlisted": _uncertainty_unlisted,
    "uncertainty_by_area": _uncertainty_by_area,
}


def _distances(
    dense: str, weights, require: int | None = None, by_day_only: bool = False, extra: str = "", all_hours: bool = False
) -> str:
    """CTEs up to ``distances``: merge, join back, shift twice, run along the bins."""
    hours = "true" if all_hours else sql.listed(weights)
    more, same = (f", {extra}", f" AND m.{extra} = i.{extra}") if extra else ("", "")
    gate = f"HAVING count(DISTINCT Hour) = {require}" if require else ""
    days = "Day" if by_day_only else "Year, Day"
    return f"""WITH {dense}, {sql.hour_table(weights)},
{sql.first_image("dense", where=hours)},
images AS (SELECT * FROM picked {"LEFT" if all_hours else ""} JOIN weights USING (Hour)),
complete AS (SELECT {sql.SERIES}, Year, Day FROM images GROUP BY ALL {gate}),
merged AS (
  SELECT {sql.SERIES}, Year, Day{more}, Metric_Type, Bin,
         CASE WHEN count(W) = count(*) THEN CAST(floor(sum(W * Bin_Value) / 10000) AS BIGINT) END AS Q
  FROM images JOIN complete USING ({sql.SERIES}, Year, Day) GROUP BY ALL),
pairs AS (
  SELECT i.*, i.Bin_Value AS P, m.Q FROM images i
  SEMI JOIN complete USING ({sql.SERIES}, {days})
  LEFT JOIN merged m ON m.Dataset = i.Dataset AND m.Camera_ID = i.Camera_ID
   AND m.Year = i.Year AND m.Day = i.Day AND m.Metric_Type = i.Metric_Type AND m.Bin = i.Bin{same}),
ahead AS (SELECT *, lead(coalesce(P - Q, 0)) OVER image AS next_step FROM pairs
  WINDOW image AS (PARTITION BY {sql.SERIES}, Year, Day, Hour{more}, Metric_Type ORDER BY Bin)),
steps AS (SELECT *, coalesce(lag(next_step) OVER image, 0) AS step FROM ahead
  WINDOW image AS (PARTITION BY {sql.SERIES}, Year, Day, Hour{more}, Metric_Type ORDER BY Bin)),
moved AS (SELECT *, abs(sum(step) OVER (PARTITION BY {sql.SERIES}, Year, Day, Hour{more}, Metric_Type
  ORDER BY Bin ROWS UNBOUNDED PRECEDING)) AS amount FROM steps),
distances AS (
  SELECT {sql.SERIES}, Year, Day, Hour{more}, Metric_Type, CAST(sum(amount) AS DOUBLE) AS Distance
  FROM moved GROUP BY ALL),
levels AS (
  SELECT {sql.SERIES}, Year, Day{more}, Metric_Type,
         CASE WHEN count(W) = count(*) THEN sum(Distance * W) / 10000
           / CASE Metric_Type WHEN 'HSV' THEN 360 ELSE 100 END END AS Q
  FROM distances {"LEFT" if all_hours else ""} JOIN weights USING (Hour)
  GROUP BY {sql.SERIES}, Year, Day{more}, Metric_Type)
"""


def _windows(
    dense: str, hours, kernels, where: str = "true", gate: str = "", figure: bool = False
) -> str:
    """CTEs up to ``windows``: days copied to every window they belong to."""
    expected = len(hours)
    days, ends = ("AND Day <= 365", "WHERE Day + Lag <= 357") if figure else ("", "")
    return f"""WITH {dense}, {sql.hour_table(hours)},
{sql.lag_table({window_label(len(k)): k for k in kernels})},
source AS (SELECT * FROM dense WHERE Metric_Type = 'HSV' AND {where}),
{sql.first_image("source")},
gated AS (SELECT {sql.SERIES}, Year, Day FROM picked GROUP BY ALL {gate}),
images AS (
  SELECT p.* FROM picked p SEMI JOIN gated USING ({sql.SERIES}, Year, Day)
  WHERE Minute = 0 {days}),
windows AS (
  SELECT {sql.SERIES}, Year, Day + Lag AS "Group", Bin, Mode,
         CAST(sum(W * L * Bin_Value) AS BIGINT) // 100000000 AS Bin_Value
  FROM images JOIN weights USING (Hour), lags
  {ends}
  GROUP BY {sql.SERIES}, Year, Day + Lag, Bin, Mode, Width
  HAVING count(*) = Width * {expected})
"""


#: Weights of the kernels in parts of 1e-8, written out apart from their functions.
_CELLS_SQL = {
    "drift": [(0, h, (15 - h) * 3_000_000) for h in range(10, 15)]
    + [(1, h, (h - 9) * 2_000_000) for h in range(10, 15)]
    + [(2, 12, 20_000_000)],
    "noon and after": [(0, 12, 50_000_000), (1, 12, 25_000_000), (1, 13, 15_000_000), (2, 14, 10_000_000)],
    "eve": [(1, 10, 12_345_678), (1, 11, 37_654_322), (2, 12, 50_000_000)],
    "edge": [(0, 10, 150_000_000), (3, 14, -50_000_000)],
}


def _kernels(dense: str, where: str = "true", gate: str = "") -> str:
    """CTEs up to ``windows``: every cell copied to each window it belongs to."""
    cells = ", ".join(f"('{m}', {lag}, {h}, {w})" for m, c in _CELLS_SQL.items() for lag, h, w in c)
    sizes = ", ".join(f"('{m}', {len(c)})" for m, c in _CELLS_SQL.items())
    return f"""WITH {dense}, cells(Mode, Lag, Hour, W) AS (VALUES {cells}), sizes(Mode, N) AS (VALUES {sizes}),
source AS (SELECT * FROM dense WHERE Metric_Type = 'HSV' AND {where}),
{sql.first_image("source")},
gated AS (SELECT {sql.SERIES}, Year, Day FROM picked GROUP BY ALL {gate}),
images AS (SELECT p.* FROM picked p SEMI JOIN gated USING ({sql.SERIES}, Year, Day) WHERE Minute = 0),
windows AS (
  SELECT {sql.SERIES}, Year, Day + Lag AS "Group", Bin, Mode,
         CAST(sum(W * Bin_Value) AS BIGINT) // 100000000 AS Bin_Value
  FROM images JOIN cells USING (Hour) JOIN sizes USING (Mode)
  WHERE Day + Lag <= dayofyear(make_date(Year, 12, 31))
  GROUP BY {sql.SERIES}, Year, Day + Lag, Bin, Mode, N
  HAVING count(*) = N)
"""


_WINDOW_STACK = f"""
SELECT 'H' AS Style, {sql.SERIES}, Year, "Group", Bin, Mode, Bin_Value,
       CAST(sum(Bin_Value) OVER w AS BIGINT) AS Y_max,
       CAST(sum(Bin_Value) OVER w AS BIGINT) - Bin_Value AS Y_min,
       {sql.hsv_hex("Bin")} AS Color, concat_ws('_', Year, "Group", Bin, 'H') AS Key
FROM windows WHERE Bin_Value <> 0
WINDOW w AS (PARTITION BY {sql.SERIES}, Year, "Group", Mode ORDER BY Bin ROWS UNBOUNDED PRECEDING)"""

_ELEVEN = "HAVING count(DISTINCT Hour) = 11"


_FOUR_SQL = (sql.KERNEL_LAGS_2, sql.KERNEL_LAGS_5, sql.KERNEL_LAGS_7, sql.KERNEL_LAGS_10)


def _event_window(*kernels, figure: bool = False) -> str:
    return _windows(
        sql.EVENT_DAY_DENSE, sql.KERNEL_HOURS_8_TO_18, kernels, "Minute = 0", _ELEVEN, figure
    )


def _attribute(name: str, source: str) -> str:
    units = f"CAST(floor({source} * 1e9 + 0.5) AS BIGINT)"
    return f"CAST(coalesce(sum(W * {units}), 0) AS DOUBLE) / 1e13 AS {name}"


_LONG = f"{sql.SERIES}, Year, Day, Hour, Minute, Metric_Type, Bin, Bin_Value"
_MERGED = "CAST(sum(W * Bin_Value) AS BIGINT) // 10000 AS Bin_Value"

ORACLE = {
    "dedup_first_image": f"WITH {sql.EVENT_BINS}, {sql.first_image('hist')} SELECT {_LONG} FROM picked",
    "dedup_pooled_cameras": f"""WITH {sql.EVENT_BINS},
ranked AS (SELECT *, rank() OVER (PARTITION BY Dataset, Year, Day, Hour ORDER BY Minute, Camera_ID) AS r
           FROM hist)
SELECT {_LONG} FROM ranked WHERE r = 1""",
    "complete_days": f"""WITH {sql.LINEITEM_BINS},
complete AS (SELECT {sql.SERIES}, Year, Day FROM hist GROUP BY ALL HAVING count(DISTINCT Hour) = 7)
SELECT {_LONG} FROM hist SEMI JOIN complete USING ({sql.SERIES}, Year, Day)""",
    "weighted_day_merge": f"""WITH {sql.EVENT_DENSE}, {sql.hour_table(sql.HOURS_9_TO_15)},
{sql.first_image("dense", where=sql.listed(sql.HOURS_9_TO_15))}
SELECT {sql.SERIES}, Year, Day, Metric_Type, Bin, {_MERGED}
FROM picked JOIN weights USING (Hour) GROUP BY {sql.SERIES}, Year, Day, Metric_Type, Bin""",
    "weighted_attr_merge": f"""WITH {sql.EVENT_DENSE}, {sql.hour_table(sql.HOURS_8_TO_18)},
{sql.first_image("dense", where=sql.listed(sql.HOURS_8_TO_18))}
SELECT {sql.SERIES}, Year, Day, Metric_Type, Bin, {_MERGED},
       {", ".join(_attribute(n, c) for n, c in _ATTRIBUTE_OF.items())}
FROM picked JOIN weights USING (Hour) WHERE Metric_Type = 'HSV'
GROUP BY {sql.SERIES}, Year, Day, Metric_Type, Bin""",
    "weighted_unlisted_hours": f"""WITH {sql.LINEITEM_DENSE}, {sql.hour_table(sql.HOURS_9_TO_15)}
SELECT {sql.SERIES}, Year, Day, Metric_Type, Bin,
       CASE WHEN count(W) = count(*) THEN CAST(sum(W * Bin_Value) AS BIGINT) // 10000 END AS Bin_Value
FROM dense LEFT JOIN weights USING (Hour) GROUP BY {sql.SERIES}, Year, Day, Metric_Type, Bin""",
    "emd_hourly": _distances(sql.EVENT_DENSE, sql.HOURS_9_TO_15) + "SELECT * FROM distances",
    "uncertainty_abs": _distances(sql.EVENT_DENSE, sql.HOURS_7_TO_16, 7) + "SELECT * FROM levels",
    "uncertainty_rel": _distances(sql.EVENT_DENSE, sql.HOURS_7_TO_16, 7)
    + f"""SELECT * REPLACE (
  Q / nullif(max(Q) OVER (PARTITION BY {sql.SERIES}, Year, Metric_Type), 0) AS Q) FROM levels""",
    "uncertainty_multi_year": _distances(sql.LINEITEM_DENSE, sql.KERNEL_HOURS_10_TO_14, 5)
    + "SELECT * FROM levels",
    "uncertainty_dayonly_compat": _distances(
        sql.LINEITEM_DENSE, sql.KERNEL_HOURS_10_TO_14, 5, by_day_only=True
    )
    + "SELECT * FROM levels",
    "window_02": _event_window(sql.KERNEL_LAGS_2) + "SELECT * FROM windows",
    "window_03": _windows(sql.LINEITEM_DENSE, sql.KERNEL_HOURS_10_TO_14, [sql.KERNEL_LAGS_3])
    + "SELECT * FROM windows",
    "window_05": _event_window(sql.KERNEL_LAGS_5) + "SELECT * FROM windows",
    "window_07": _event_window(sql.KERNEL_LAGS_7) + "SELECT * FROM windows",
    "window_10": _event_window(sql.KERNEL_LAGS_10) + "SELECT * FROM windows",
    "window_compare": _event_window(*_FOUR_SQL, figure=True) + _WINDOW_STACK,
    "window_kernels": _kernels(sql.LINEITEM_DENSE) + "SELECT * FROM windows",
    "window_kernel_stacks": _kernels(sql.EVENT_DAY_DENSE, "Minute = 0", _ELEVEN) + _WINDOW_STACK,
    "window_multi_year": _windows(
        sql.LINEITEM_DENSE, sql.KERNEL_HOURS_10_TO_14, [sql.KERNEL_LAGS_3],
        gate="HAVING count(DISTINCT Hour) >= 7", figure=True,
    )
    + _WINDOW_STACK,
    "bin_distribution": f"""WITH {sql.EVENT_BINS},
green AS (SELECT * FROM hist WHERE Metric_Type = 'Gcc' AND {sql.listed(sql.HOURS_7_TO_16)}),
{sql.first_image("green")}
SELECT {sql.SERIES}, Year, Day, Bin AS Gcc_Bin, CAST(sum(Bin_Value) AS BIGINT) AS Gcc_Value,
       'Day ' || CAST(Day AS VARCHAR) AS Label
FROM picked WHERE Bin_Value <> 0 GROUP BY {sql.SERIES}, Year, Day, Bin""",
    "weighted_fractions": f"""WITH {sql.EVENT_QUARTERS}, {sql.hour_table(sql.HOURS_9_TO_15)},
{sql.first_image("dense", where=sql.listed(sql.HOURS_9_TO_15))}
SELECT {sql.SERIES}, Year, Day, Metric_Type, Bin,
       CAST(floor(sum(W * Bin_Value) / 10000) AS BIGINT) AS Bin_Value
FROM picked JOIN weights USING (Hour) GROUP BY {sql.SERIES}, Year, Day, Metric_Type, Bin""",
    "emd_fractions": _distances(sql.EVENT_QUARTERS, sql.HOURS_9_TO_15) + "SELECT * FROM distances",
    "uncertainty_unlisted": _distances(sql.LINEITEM_DENSE, sql.HOURS_9_TO_15, all_hours=True)
    + "SELECT * FROM levels",
    "uncertainty_by_area": _distances(
        sql.EVENT_DENSE.replace("SELECT i.*, bins.Bin", "SELECT i.*, CAST(1000000 - i.Hour % 2 AS INTEGER) AS Considered_Pixels, bins.Bin"),
        sql.HOURS_9_TO_15, extra="Considered_Pixels",
    )
    + "SELECT * FROM levels",
}
ORACLE["bin_distribution_days"] = f"SELECT * FROM ({ORACLE['bin_distribution']}) WHERE Day IN (2, 3, 5)"
