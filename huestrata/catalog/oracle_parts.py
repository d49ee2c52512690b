"""Pieces of the check SQL: the derived histograms and the colour formulas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

# Weights in ten-thousandths, written out apart from huestrata.schema.
HOURS_9_TO_15 = {9: 500, 10: 500, 11: 1000, 12: 3000, 13: 3000, 14: 1500, 15: 500}
HOURS_7_TO_16 = {7: 500, 9: 750, 10: 750, 12: 3000, 13: 3000, 15: 1500, 16: 500}
HOURS_8_TO_18 = {
    8: 250, 9: 500, 10: 500, 11: 1000, 12: 1500, 13: 2500, 14: 1500, 15: 1000, 16: 500, 17: 500, 18: 250,
}
KERNEL_HOURS_10_TO_14 = {10: 1000, 11: 1500, 12: 2500, 13: 3000, 14: 2000}
KERNEL_HOURS_8_TO_18 = {
    8: 250, 9: 250, 10: 500, 11: 1000, 12: 1750, 13: 2500, 14: 1750, 15: 1000, 16: 500, 17: 250, 18: 250,
}
KERNEL_LAGS_2 = (7000, 3000)
KERNEL_LAGS_3 = (4000, 3500, 2500)
KERNEL_LAGS_5 = (2000, 2000, 2000, 2000, 2000)
KERNEL_LAGS_7 = (2000, 1500, 1500, 1500, 1500, 1000, 1000)
KERNEL_LAGS_10 = (1500, 1000, 1000, 1000, 1000, 1000, 1000, 1000, 1000, 500)

SERIES = "Dataset, Camera_ID"

EVENT_BINS = f"""
event_pixels AS (
  SELECT 'evt_' || CAST(user_id // 7500 AS VARCHAR) AS Dataset,
         'cam_' || CAST(user_id // 75 AS VARCHAR) AS Camera_ID,
         CAST(year(ts) AS INTEGER) AS Year, CAST(dayofyear(ts) AS INTEGER) AS Day,
         CAST(hour(ts) AS INTEGER) AS Hour,
         CASE WHEN minute(ts) < 45 THEN 0 ELSE 45 END AS Minute,
         CAST(10 * ((user_id * 37 + event_id) % 36) AS INTEGER) AS hue,
         CAST(CAST(floor(value) AS BIGINT) % 100 AS INTEGER) AS green,
         event_id * 31 % 401 + 100 AS pixels, user_id % 101 AS a, event_id % 101 AS b
  FROM events),
event_rows AS (
  SELECT {SERIES}, Year, Day, Hour, Minute, 'HSV' AS Metric_Type, hue AS Bin, pixels, a, b
  FROM event_pixels
  UNION ALL
  SELECT {SERIES}, Year, Day, Hour, Minute, 'Gcc', green, pixels, a, b FROM event_pixels),
hist AS (
  SELECT {SERIES}, Year, Day, Hour, Minute, Metric_Type, Bin,
         CAST(sum(pixels) AS BIGINT) AS Bin_Value,
         CAST(sum(a) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * 100) AS MeanA,
         CAST(sum(b) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * 100) AS MeanB,
         CAST(max(a) AS DOUBLE) / 100 AS MaxA, CAST(max(b) AS DOUBLE) / 100 AS MaxB
  FROM event_rows GROUP BY ALL)"""

_HOUR, _MINUTE = "CAST(hour(ts) AS INTEGER)", "CASE WHEN minute(ts) < 45 THEN 0 ELSE 45 END"

#: One image a day, at noon.
EVENT_NOON = EVENT_BINS.replace(f"{_HOUR} AS Hour", "12 AS Hour").replace(_MINUTE, "0")

#: Images from 8 to 18 h, and at night on every fourteenth day.
EVENT_DAY = EVENT_BINS.replace(
    f"{_HOUR} AS Hour",
    f"CASE WHEN dayofyear(ts) % 14 = 13 THEN {_HOUR} ELSE CAST(hour(ts) % 11 + 8 AS INTEGER) END AS Hour",
)

LINEITEM_BINS = f"""
hist AS (
  SELECT 'lin_' || CAST(l_suppkey // 10000 AS VARCHAR) AS Dataset,
         'cam_' || CAST(l_suppkey // 100 AS VARCHAR) AS Camera_ID,
         CAST(year(l_shipdate) AS INTEGER) AS Year, CAST(dayofyear(l_shipdate) AS INTEGER) AS Day,
         CAST(l_linenumber + 7 AS INTEGER) AS Hour, 0 AS Minute, 'HSV' AS Metric_Type,
         CAST(10 * (l_partkey % 36) AS INTEGER) AS Bin,
         CAST(sum(CAST(l_quantity * 100 AS BIGINT)) AS BIGINT) AS Bin_Value
  FROM lineitem GROUP BY ALL)"""

_DOMAIN = """
bins AS (
  SELECT 'HSV' AS Metric_Type, CAST(unnest(range(0, 360, 10)) AS INTEGER) AS Bin
  UNION ALL SELECT 'Gcc', CAST(unnest(range(100)) AS INTEGER))"""

_ALL_BINS = (
    ","
    + _DOMAIN
    + f""",
dense AS (
  SELECT i.*, bins.Bin, coalesce(h.Bin_Value, 0) AS Bin_Value, h.MeanA, h.MeanB, h.MaxA, h.MaxB
  FROM (SELECT DISTINCT {SERIES}, Year, Day, Hour, Minute, Metric_Type FROM hist) i
  JOIN bins ON bins.Metric_Type = i.Metric_Type
  LEFT JOIN hist h ON h.Dataset = i.Dataset AND h.Camera_ID = i.Camera_ID AND h.Year = i.Year
   AND h.Day = i.Day AND h.Hour = i.Hour AND h.Minute = i.Minute
   AND h.Metric_Type = i.Metric_Type AND h.Bin = bins.Bin)"""
)

EVENT_DENSE = EVENT_BINS + _ALL_BINS
EVENT_DAY_DENSE = EVENT_DAY + _ALL_BINS

#: Quarters of a pixel: sizes that are not whole.
EVENT_QUARTERS = EVENT_DENSE.replace("dense AS (", "whole_sizes AS (") + """,
dense AS (SELECT * REPLACE (CAST(Bin_Value AS DOUBLE) / 4 AS Bin_Value) FROM whole_sizes)"""

LINEITEM_DENSE = (
    LINEITEM_BINS
    + ","
    + _DOMAIN
    + f""",
dense AS (
  SELECT i.*, bins.Bin, coalesce(h.Bin_Value, 0) AS Bin_Value
  FROM (SELECT DISTINCT {SERIES}, Year, Day, Hour, Minute, Metric_Type FROM hist) i
  JOIN bins ON bins.Metric_Type = i.Metric_Type
  LEFT JOIN hist h ON h.Dataset = i.Dataset AND h.Camera_ID = i.Camera_ID AND h.Year = i.Year
   AND h.Day = i.Day AND h.Hour = i.Hour AND h.Minute = i.Minute
   AND h.Metric_Type = i.Metric_Type AND h.Bin = bins.Bin)"""
)


def first_image(source: str, name: str = "picked", where: str = "true") -> str:
    """CTE: the rows of the earliest image of each hour."""
    return f"""
{name} AS (
  SELECT h.* FROM {source} h
  JOIN (SELECT {SERIES}, Year, Day, Hour, min(Minute) AS Minute
        FROM {source} WHERE {where} GROUP BY ALL) f
  USING ({SERIES}, Year, Day, Hour, Minute))"""


def hour_table(weights: Mapping[int, int], name: str = "weights") -> str:
    """CTE: (Hour, W) with weights in ten-thousandths."""
    rows = ", ".join(f"({h}, {u})" for h, u in weights.items())
    return f"\n{name}(Hour, W) AS (VALUES {rows})"


def lag_table(kernels: Mapping[str, Sequence[int]], name: str = "lags") -> str:
    """CTE: (Mode, Width, Lag, L) with weights in ten-thousandths."""
    rows = ", ".join(
        f"('{mode}', {len(kernel)}, {lag}, {u})"
        for mode, kernel in kernels.items()
        for lag, u in enumerate(kernel)
    )
    return f"\n{name}(Mode, Width, Lag, L) AS (VALUES {rows})"


def listed(weights: Mapping[int, int]) -> str:
    return "Hour IN (" + ", ".join(str(h) for h in weights) + ")"


def _packed(red: str, green: str, blue: str, known: str) -> str:
    def byte(c: str) -> str:
        return f"CAST(floor(({c}) * 255 + 0.5) AS BIGINT)"

    return (
        f"CASE WHEN {known} THEN printf('#%06X', "
        f"{byte(red)} * 65536 + {byte(green)} * 256 + {byte(blue)}) END"
    )


def hsv_hex(hue: str, saturation: str = "1e0", value: str = "1e0") -> str:
    h, s, v = (f"CAST({c} AS DOUBLE)" for c in (hue, saturation, value))
    turn = f"({h} % 360 / 60)"
    sextant = f"floor({turn})"
    part = f"({turn} - {sextant})"
    slope = f"(CASE WHEN {sextant} % 2 = 0 THEN 1 - {part} ELSE {part} END)"
    mid = f"({v} * (1 - {s} * {slope}))"
    low = f"({v} * (1 - {s}))"

    def channel(top: str, middle: str) -> str:
        return (
            f"CASE WHEN {sextant} IN ({top}) THEN {v} "
            f"WHEN {sextant} IN ({middle}) THEN {mid} ELSE {low} END"
        )

    known = f"{h} IS NOT NULL AND {s} BETWEEN 0 AND 1 AND {v} BETWEEN 0 AND 1"
    return _packed(channel("0, 5", "1, 4"), channel("1, 2", "0, 3"), channel("3, 4", "2, 5"), known)


def rgb_hex(red: str, green: str, blue: str) -> str:
    def encode(c: str) -> str:
        return (
            f"CASE WHEN {c} <= 0.0031308e0 THEN {c} * 12.92e0 "
            f"ELSE pow({c}, 1e0 / 2.4e0) * 1.055e0 - 0.055e0 END"
        )

    known = " AND ".join(f"{c} BETWEEN 0 AND 1" for c in (red, green, blue))
    return _packed(encode(red), encode(green), encode(blue), known)


HUE_STYLES = {
    "H": hsv_hex("Bin"),
    "Mean": hsv_hex("Bin", "MeanA", "MeanB"),
    "Mode": hsv_hex("Bin", "MaxA", "MaxB"),
}
GREEN_STYLES = {"Gcc": rgb_hex("MeanA", "MeanB", "MaxA")}


def stacked(
    source: str, when: Sequence[str], metrics: Sequence[str] = ("HSV", "Gcc"), extra: str = ""
) -> str:
    """SELECT: styles unpivoted first, then stacked per style, as the long way round."""
    parts = []
    for metric, styles in (("HSV", HUE_STYLES), ("Gcc", GREEN_STYLES)):
        if metric in metrics:
            parts += [
                f"SELECT *, '{style}' AS Style, {colour} AS Color FROM {source} "
                f"WHERE Metric_Type = '{metric}'"
                for style, colour in styles.items()
            ]
    keys = ", ".join(when)
    window = f"(PARTITION BY {SERIES}, Style, {keys} ORDER BY Bin ROWS UNBOUNDED PRECEDING)"
    key = "concat_ws('_', " + ", ".join([*when, "Bin", "Style"]) + ")"
    return f"""
SELECT {SERIES}, Style, {keys}, Bin, Metric_Type, Bin_Value, Color, {key} AS Key,
       CAST(sum(Bin_Value) OVER {window} AS BIGINT) - Bin_Value AS Y_min,
       CAST(sum(Bin_Value) OVER {window} AS BIGINT) AS Y_max{extra}
FROM ({" UNION ALL ".join(parts)}) WHERE Bin_Value <> 0"""
