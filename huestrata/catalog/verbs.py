"""Registered queries on table verbs, names, colours and profiles, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

import huestrata as hs
from huestrata.catalog import oracle_parts as sql
from huestrata.functions import paste, rgb_to_hex, with_hsv_hex
from huestrata.operators.columns import (
    collapse_metric,
    drop_containing,
    keep_containing,
    long_histogram,
    metric_from_sentinel,
    move_first,
)
from huestrata.operators.groups import (
    duplicate_keys,
    keep_groups_by_size,
    keep_groups_by_sum,
    keep_matching,
)
from huestrata.operators.reshape import (
    calendar_grid,
    complete_grid,
    ordered_keys,
    pivot_bins,
    union_tagged,
    unpivot_columns,
    zip_rows,
)
from huestrata.operators.positions import as_factor, expand_grid, gather_rows
from huestrata.operators.windows import window_members
from huestrata.schema import (
    HOURS_8_TO_18,
    HOURS_9_TO_15,
    HSV_ATTRIBUTES,
    KERNEL_HOURS_10_TO_14,
    KERNEL_LAGS_3,
)
from huestrata.sources.files import weight_table
from huestrata.sources.tables import events_histogram, lineitem_histogram, table

_CELL = ["Dataset", "Camera_ID", "Year", "Day", "Hour"]
HUES = range(0, 360, 10)


def _collapse(spark, sf):
    hist = events_histogram(spark, sf).drop("Metric_Type")
    return collapse_metric(metric_from_sentinel(hist), HSV_ATTRIBUTES)


def _select_hue(spark, sf):
    return drop_containing(events_histogram(spark, sf), "gcc", "mode", "pixels").filter(
        F.col("Metric_Type") == "HSV"
    )


def _select_green(spark, sf):
    hist = events_histogram(spark, sf).filter(F.col("Metric_Type") == "Gcc")
    green = keep_containing(hist, "gcc", also=("Dataset", "Camera_ID", "Year", "Day", "Hour", "Minute"))
    return move_first(green, "Gcc_Bin", "Gcc_Value").withColumnsRenamed(
        {"Gcc_Bin": "Bin", "Gcc_Value": "Bin_Value"}
    )


def _names(spark, sf):
    """One image name per event."""
    clock = F.concat(F.date_format("ts", "HHmm"), F.lit("+0000"))
    name = F.concat_ws(
        "_",
        F.concat(F.lit("img/"), F.col("event_type"), F.lit("/dc")),
        F.year("ts"),
        F.dayofyear("ts"),
        clock,
        F.col("event_type"),
        F.concat(F.lit("_cam"), F.col("user_id").cast("string"), F.lit(".jpg")),
    )
    return table(spark, sf, "events").select("event_id", name.alias("Name"))


def _parse_names(spark, sf):
    return hs.parse_image_name(_names(spark, sf))


def coefficient_tables(spark, sf):
    """Two coefficient tables with one row per image."""
    hist = events_histogram(spark, sf).filter(F.col("Metric_Type") == "Gcc")
    name = F.concat(
        F.lit("img/dc_"),
        paste("Year", "Day"),
        F.lit("_"),
        F.format_string("%02d%02d", "Hour", "Minute"),
        F.lit("+00_"),
        F.regexp_replace("Dataset", "_", "-"),
        F.lit("__"),
        F.col("Camera_ID"),
        F.lit(".jpg"),
    ).alias("Name")
    green = hist.groupBy(name).agg(
        (F.sum(F.col("Gcc_Bin") * F.col("Gcc_Value").cast("bigint")) / F.sum("Gcc_Value") / 100).alias(
            "MeanGcc"
        )
    )
    red = hist.groupBy(name).agg((F.max("Gcc_Bin") / 100.0).alias("MeanRcc"))
    return green, red


def _coefficients(spark, sf):
    return hs.mean_coefficients(*coefficient_tables(spark, sf))


def _pivot(spark, sf):
    hist = long_histogram(events_histogram(spark, sf), metrics=("HSV",))
    return pivot_bins(hist, [*_CELL, "Minute"], HUES)


def _unpivot(spark, sf):
    hist = events_histogram(spark, sf).filter(F.col("Metric_Type") == "HSV")
    ids = with_hsv_hex(
        hist,
        "HSV_Bin",
        {
            "Color_Code_H": (1, 1),
            "Color_Code_Mean": ("HSV_SMean", "HSV_VMean"),
            "Color_Code_Mode": ("HSV_SMode", "HSV_VMode"),
        },
    ).select(
        *_CELL,
        "Minute",
        F.col("HSV_Bin").alias("Bin"),
        "Color_Code_H",
        "Color_Code_Mean",
        "Color_Code_Mode",
    )
    codes = ["Color_Code_H", "Color_Code_Mean", "Color_Code_Mode"]
    return unpivot_columns(ids, codes, "Style", "Color", strip="Color_Code_")


def samples(spark, sf):
    """Timing samples (cores, exectime in ms) of three sources."""
    return union_tagged(
        {
            "items": table(spark, sf, "lineitem").select(
                F.col("l_linenumber").alias("cores"), F.col("l_extendedprice").alias("exectime")
            ),
            "parts": table(spark, sf, "part").select(
                F.col("p_size").alias("cores"), F.col("p_retailprice").alias("exectime")
            ),
            "orders": table(spark, sf, "orders").select(
                F.month("o_orderdate").alias("cores"), F.col("o_totalprice").alias("exectime")
            ),
        }
    )


def _timing(spark, sf):
    summary = hs.timing_summary(samples(spark, sf))
    return summary.withColumn("avgMinutes", F.round("avgMinutes", 6)).withColumn(
        "errorMinutes", F.round("errorMinutes", 6)
    )


def _zip(spark, sf):
    """The orders by date next to the orders by price."""
    orders = table(spark, sf, "orders")
    dated = orders.select("o_orderdate", "o_orderkey")
    priced = orders.select(F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("key"))
    return zip_rows(dated, priced, ["o_orderdate", "o_orderkey"], ["price", "key"])


def _ordinals(spark, sf):
    """Keys of the hour columns in their order, as levels of a categorical."""
    cells = _images(events_histogram(spark, sf)).withColumn("Key", paste(*_CELL[2:], "Minute"))
    return ordered_keys(cells, [*_CELL, "Minute"])


def _timing_unknown(spark, sf):
    """Samples without a time make the figures of their group unknown."""
    unknown = F.when(F.col("cores") % 3 != 0, F.col("exectime"))
    summary = hs.timing_summary(samples(spark, sf).withColumn("exectime", unknown))
    return summary.withColumns({c: F.round(c, 6) for c in ("avgMinutes", "errorMinutes")})


def _images(hist):
    return hist.select(*_CELL, "Minute").distinct()


def _scaffold(spark, sf):
    hist = lineitem_histogram(spark, sf, dense=False)
    grid = calendar_grid(hist.select("Dataset", "Camera_ID", "Year").distinct(), range(10, 15))
    images = hist.groupBy(*_CELL, "Minute").agg(F.sum("HSV_H").cast("bigint").alias("Pixels"))
    return complete_grid(grid, images, [*_CELL, "Minute"])


def _members(spark, sf):
    hist = lineitem_histogram(spark, sf, dense=False)
    return window_members(_images(hist), KERNEL_HOURS_10_TO_14, KERNEL_LAGS_3)


def _group_size(spark, sf):
    return keep_groups_by_size(
        _images(lineitem_histogram(spark, sf, dense=False)), _CELL[:4], at_least=6
    )


def _group_sum(spark, sf):
    return keep_groups_by_sum(
        _members(spark, sf), ["Dataset", "Camera_ID", "Year", "Group"], "Weight", 10**8
    )


def _semi_join(spark, sf):
    """Line items shipped on a day of the year on which an event happened."""
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.dayofyear("l_shipdate").alias("Day")
    )
    days = table(spark, sf, "events").select(F.dayofyear("ts").alias("Day"))
    return keep_matching(items, days, ["Day"])


def _weights_joined(spark, sf):
    """Weight table looked up per image; hours not listed have none."""
    images = _images(events_histogram(spark, sf))
    joined = images.join(F.broadcast(weight_table(spark, HOURS_9_TO_15)), "Hour", "left")
    return joined.withColumn("Weight", F.col("Weight").cast("double"))


def _hsv_hex(spark, sf):
    hist = events_histogram(spark, sf).filter(F.col("Metric_Type") == "HSV")
    colours = {"Hue": (1, 1), "Mean": ("HSV_SMean", "HSV_VMean")}
    return with_hsv_hex(hist, "HSV_Bin", colours).select(
        *_CELL, "Minute", "HSV_Bin", "Hue", "Mean"
    )


def _rgb_hex(spark, sf):
    return events_histogram(spark, sf).filter(F.col("Metric_Type") == "Gcc").select(
        *_CELL,
        "Minute",
        "Gcc_Bin",
        rgb_to_hex("Gcc_Mean_R", "Gcc_Mean_G", "Gcc_Mean_B").alias("Color"),
    )


def _uniqueness(spark, sf):
    """Keys that two images of one hour share."""
    hist = long_histogram(events_histogram(spark, sf))
    keyed = hist.withColumn("Key", paste("Year", "Day", "Hour", "Bin", "Metric_Type"))
    return duplicate_keys(keyed, ["Dataset", "Camera_ID", "Key"])


def _weight_profile(spark, sf):
    """Hour 8 is listed and never imaged."""
    return hs.weight_profile(events_histogram(spark, sf).filter("Hour <> 8"), HOURS_8_TO_18)


def _kernel_profile(spark, sf):
    return hs.kernel_profile(lineitem_histogram(spark, sf, dense=False))


def _factor(spark, sf):
    """Level codes of a column in which one value holds over a third of the rows, and of one with given levels."""
    kind = F.when(F.col("l_linenumber") <= 2, "bulk").otherwise(
        F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    )
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"), "l_returnflag")
    coded = as_factor(items, "kind", code="kind_code")
    return as_factor(coded, "l_returnflag", code="flag_code", levels=["R", "A"])


STYLES = ["H", "Mean", "Mode"]


def _grid(spark, sf):
    """A grid of a range, the years of a table, a list and a range with a step."""
    years = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("Year")).distinct()
    return expand_grid(spark, {"Hour": range(8, 19), "Year": years, "Style": STYLES, "Day": range(365, 0, -30)})


def _gather(spark, sf):
    """Orders by date at positions that line items ask for; many ask for the first, some for none there is."""
    orders = table(spark, sf, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    position = (
        F.when(F.col("l_linenumber") <= 2, F.lit(1).cast("bigint"))
        .when(F.col("l_linenumber") == 3, -F.col("l_orderkey").cast("bigint"))
        .when(F.col("l_linenumber") == 4, F.lit(None))
        .otherwise(F.col("l_partkey").cast("bigint") * 7 + 1)
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    asked = table(spark, sf, "lineitem").select(*keys, position.alias("Index")).distinct()
    return gather_rows(orders, ["o_orderdate", "o_orderkey"], asked, outside="null", request_order=keys)


QUERIES = {
    "factor_codes": _factor,
    "general_grid": _grid,
    "gather_rows": _gather,
    "collapse_metric": _collapse,
    "select_hue_columns": _select_hue,
    "select_green_columns": _select_green,
    "parse_image_name": _parse_names,
    "mean_coefficients": _coefficients,
    "pivot_bins": _pivot,
    "unpivot_styles": _unpivot,
    "union_tagged": samples,
    "timing_summary": _timing,
    "timing_unknown": _timing_unknown,
    "zip_rows": _zip,
    "key_ordinals": _ordinals,
    "grid_scaffold": _scaffold,
    "window_members": _members,
    "filter_group_size": _group_size,
    "filter_group_sum": _group_sum,
    "semi_join_days": _semi_join,
    "weight_lookup": _weights_joined,
    "hsv_to_hex": _hsv_hex,
    "rgb_to_hex": _rgb_hex,
    "key_uniqueness": _uniqueness,
    "weight_profile": _weight_profile,
    "kernel_profile": _kernel_profile,
}

_CELL_SQL = ", ".join(_CELL)

_SAMPLES_SQL = """
SELECT 'items' AS dataset, l_linenumber AS cores, l_extendedprice AS exectime FROM lineitem
UNION ALL SELECT 'parts', p_size, p_retailprice FROM part
UNION ALL SELECT 'orders', CAST(month(o_orderdate) AS INTEGER), o_totalprice FROM orders"""

_MEMBERS_SQL = f"""WITH {sql.LINEITEM_BINS}, {sql.hour_table(sql.KERNEL_HOURS_10_TO_14)},
{sql.lag_table({"three": sql.KERNEL_LAGS_3})},
places AS (SELECT Hour, W, row_number() OVER (ORDER BY Hour) AS place FROM weights),
members AS (
  SELECT {_CELL_SQL}, Minute, CAST(Lag AS INTEGER) AS Lag, Day + CAST(Lag AS INTEGER) AS "Group",
         CAST(W * L AS BIGINT) AS Weight,
         CAST((2 - Lag) * 5 + place AS BIGINT) AS "Index"
  FROM (SELECT DISTINCT {_CELL_SQL}, Minute FROM hist) JOIN places USING (Hour), lags
  WHERE Day + Lag <= dayofyear(make_date(Year, 12, 31)))
"""

ORACLE = {
    "factor_codes": """
SELECT l_orderkey, l_linenumber, kind, l_returnflag, dense_rank() OVER (ORDER BY kind) AS kind_code,
       CAST(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 END AS BIGINT) AS flag_code
FROM (SELECT *, CASE WHEN l_linenumber <= 2 THEN 'bulk' ELSE 'part ' || l_partkey END AS kind FROM lineitem)""",
    "general_grid": """
SELECT row_number() OVER (ORDER BY Day DESC, place, Year, Hour) AS "Index", Hour, Year, Style, Day
FROM (SELECT CAST(unnest(range(8, 19)) AS INTEGER) AS Hour),
     (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS Year FROM lineitem),
     (VALUES (1, 'H'), (2, 'Mean'), (3, 'Mode')) s(place, Style),
     (SELECT CAST(unnest(range(365, 0, -30)) AS INTEGER) AS Day)""",
    "gather_rows": """
WITH numbered AS (
  SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n, o_orderdate, o_orderkey, o_totalprice FROM orders),
asked AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) AS Place,
         CAST(CASE WHEN l_linenumber <= 2 THEN 1 WHEN l_linenumber = 3 THEN -l_orderkey
              WHEN l_linenumber = 4 THEN NULL ELSE l_partkey * 7 + 1 END AS BIGINT) AS "Index"
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem))
SELECT asked.*, o_orderdate, o_orderkey, o_totalprice FROM asked LEFT JOIN numbered ON n = "Index" """,
    "collapse_metric": f"""WITH {sql.EVENT_BINS}
SELECT {_CELL_SQL}, Minute, 1000000 AS Considered_Pixels, Metric_Type, Bin, Bin_Value,
       CASE WHEN Metric_Type = 'HSV' THEN MeanA END AS HSV_SMean,
       CASE WHEN Metric_Type = 'HSV' THEN MeanB END AS HSV_VMean,
       CASE WHEN Metric_Type = 'HSV' THEN MaxA END AS HSV_SMode,
       CASE WHEN Metric_Type = 'HSV' THEN MaxB END AS HSV_VMode FROM hist""",
    "select_hue_columns": f"""WITH {sql.EVENT_BINS}
SELECT {_CELL_SQL}, Minute, Metric_Type, Bin AS HSV_Bin, CAST(Bin_Value AS DOUBLE) AS HSV_H,
       MeanA AS HSV_SMean, MeanB AS HSV_VMean
FROM hist WHERE Metric_Type = 'HSV'""",
    "select_green_columns": f"""WITH {sql.EVENT_BINS}
SELECT Bin, CAST(Bin_Value AS DOUBLE) AS Bin_Value, {_CELL_SQL}, Minute,
       MeanA AS Gcc_Mean_R, MeanB AS Gcc_Mean_G, MaxA AS Gcc_Mean_B
FROM hist WHERE Metric_Type = 'Gcc'""",
    "parse_image_name": """
SELECT event_id,
       'img/' || event_type || '/dc_' || year(ts) || '_' || dayofyear(ts) || '_'
         || strftime(ts, '%H%M') || '+0000_' || event_type || '__cam' || user_id || '.jpg' AS Name,
       CAST(year(ts) AS INTEGER) AS Year, CAST(dayofyear(ts) AS INTEGER) AS Day,
       event_type AS Dataset, 'cam' || user_id AS Camera_ID,
       CAST(hour(ts) AS INTEGER) AS Hour, CAST(minute(ts) AS INTEGER) AS Minute
FROM events""",
    "mean_coefficients": f"""WITH {sql.EVENT_BINS}
SELECT 'img/dc_' || Year || '_' || Day || '_' || printf('%02d%02d', Hour, Minute) || '+00_'
         || replace(Dataset, '_', '-') || '__' || Camera_ID || '.jpg' AS Name,
       CAST(sum(Bin * Bin_Value) AS DOUBLE) / CAST(sum(Bin_Value) AS DOUBLE) / 100 AS MeanGcc,
       CAST(max(Bin) AS DOUBLE) / 100 AS MeanRcc,
       Year, Day, replace(Dataset, '_', '-') AS Dataset, Camera_ID, Hour, Minute
FROM hist h WHERE Metric_Type = 'Gcc'
GROUP BY h.Dataset, h.Camera_ID, h.Year, h.Day, h.Hour, h.Minute""",
    "pivot_bins": f"""WITH {sql.EVENT_BINS}
SELECT {_CELL_SQL}, Minute, """
    + ", ".join(f"any_value(Bin_Value) FILTER (WHERE Bin = {b}) AS X{b}" for b in HUES)
    + f" FROM hist WHERE Metric_Type = 'HSV' GROUP BY {_CELL_SQL}, Minute",
    "unpivot_styles": f"WITH {sql.EVENT_BINS} "
    + " UNION ALL ".join(
        f"SELECT {_CELL_SQL}, Minute, Bin, '{style}' AS Style, {colour} AS Color "
        "FROM hist WHERE Metric_Type = 'HSV'"
        for style, colour in sql.HUE_STYLES.items()
    ),
    "union_tagged": _SAMPLES_SQL,
    "timing_summary": f"""
SELECT cores, dataset, round(avg(exectime / 1000 / 60), 6) AS avgMinutes,
       round(3 * stddev_samp(exectime / 1000 / 60) / sqrt(count(*)), 6) AS errorMinutes
FROM ({_SAMPLES_SQL}) GROUP BY cores, dataset""",
    "timing_unknown": f"""
SELECT cores, dataset, CASE WHEN count(e) = count(*) THEN round(avg(e / 1000 / 60), 6) END AS avgMinutes,
       CASE WHEN count(e) = count(*) THEN round(3 * stddev_samp(e / 1000 / 60) / sqrt(count(*)), 6) END AS errorMinutes
FROM (SELECT *, CASE WHEN cores % 3 <> 0 THEN exectime END AS e FROM ({_SAMPLES_SQL})) GROUP BY cores, dataset""",
    "zip_rows": """
SELECT CAST(coalesce(a.i, b.i) AS BIGINT) AS "Index", o_orderdate, a.o_orderkey, price, key
FROM (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i, * FROM orders) a
FULL JOIN (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i,
                  o_totalprice AS price, o_orderkey AS key FROM orders) b ON a.i = b.i""",
    "key_ordinals": f"""WITH {sql.EVENT_BINS}
SELECT {_CELL_SQL}, Minute, concat_ws('_', Year, Day, Hour, Minute) AS Key,
       row_number() OVER (ORDER BY {_CELL_SQL}, Minute) AS Ordinal
FROM (SELECT DISTINCT {_CELL_SQL}, Minute FROM hist)""",
    "grid_scaffold": f"""WITH {sql.LINEITEM_BINS},
grid AS (
  SELECT y.*, d.Day, h.Hour, 0 AS Minute
  FROM (SELECT DISTINCT {sql.SERIES}, Year FROM hist) y,
       (SELECT CAST(unnest(range(1, 367)) AS INTEGER) AS Day) d,
       (SELECT CAST(unnest(range(10, 15)) AS INTEGER) AS Hour) h
  WHERE d.Day <= dayofyear(make_date(y.Year, 12, 31))),
images AS (
  SELECT {_CELL_SQL}, Minute, CAST(sum(Bin_Value) AS BIGINT) AS Pixels FROM hist GROUP BY ALL)
SELECT * FROM grid LEFT JOIN images USING ({_CELL_SQL}, Minute)""",
    "window_members": _MEMBERS_SQL + "SELECT * FROM members",
    "filter_group_size": f"""WITH {sql.LINEITEM_BINS},
images AS (SELECT DISTINCT {_CELL_SQL}, Minute FROM hist)
SELECT * FROM images
QUALIFY count(*) OVER (PARTITION BY {sql.SERIES}, Year, Day) >= 6""",
    "filter_group_sum": _MEMBERS_SQL
    + f"""SELECT * FROM members
QUALIFY sum(Weight) OVER (PARTITION BY {sql.SERIES}, Year, "Group") = 100000000""",
    "semi_join_days": """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(dayofyear(l_shipdate) AS INTEGER) AS Day
FROM lineitem WHERE dayofyear(l_shipdate) IN (SELECT dayofyear(ts) FROM events)""",
    "weight_lookup": f"""WITH {sql.EVENT_BINS}, {sql.hour_table(sql.HOURS_9_TO_15)}
SELECT {_CELL_SQL}, Minute, CAST(W AS DOUBLE) / 10000 AS Weight
FROM (SELECT DISTINCT {_CELL_SQL}, Minute FROM hist) LEFT JOIN weights USING (Hour)""",
    "hsv_to_hex": f"""WITH {sql.EVENT_BINS}
SELECT {_CELL_SQL}, Minute, Bin AS HSV_Bin, {sql.HUE_STYLES["H"]} AS Hue,
       {sql.HUE_STYLES["Mean"]} AS Mean FROM hist WHERE Metric_Type = 'HSV'""",
    "rgb_to_hex": f"""WITH {sql.EVENT_BINS}
SELECT {_CELL_SQL}, Minute, Bin AS Gcc_Bin, {sql.GREEN_STYLES["Gcc"]} AS Color
FROM hist WHERE Metric_Type = 'Gcc'""",
    "key_uniqueness": f"""WITH {sql.EVENT_BINS}
SELECT {sql.SERIES}, concat_ws('_', Year, Day, Hour, Bin, Metric_Type) AS Key,
       count(*) AS "Rows" FROM hist
GROUP BY {sql.SERIES}, Year, Day, Hour, Bin, Metric_Type HAVING count(*) > 1""",
    "weight_profile": f"""WITH {sql.EVENT_BINS}, {sql.hour_table(sql.HOURS_8_TO_18)},
levels AS (SELECT Hour, W, row_number() OVER (ORDER BY Hour) AS Level FROM weights)
SELECT levels.Hour, CAST(Level AS BIGINT) AS Level, CAST(W AS DOUBLE) / 10000 AS Weight,
       count(seen.Hour) AS Days
FROM levels LEFT JOIN (SELECT DISTINCT {sql.SERIES}, Year, Day, Hour FROM hist WHERE Hour <> 8) seen
  ON seen.Hour = levels.Hour
GROUP BY levels.Hour, Level, W""",
    "kernel_profile": f"""WITH {sql.LINEITEM_BINS}, {sql.hour_table(sql.KERNEL_HOURS_10_TO_14)},
{sql.lag_table({"three": sql.KERNEL_LAGS_3})},
places AS (SELECT Hour, W, row_number() OVER (ORDER BY Hour) AS place FROM weights),
cells AS (
  SELECT y.*, d.Day, places.*
  FROM (SELECT DISTINCT {sql.SERIES}, Year FROM hist) y,
       (SELECT CAST(unnest(range(1, 367)) AS INTEGER) AS Day) d, places
  WHERE d.Day <= dayofyear(make_date(y.Year, 12, 31))),
images AS (SELECT DISTINCT {_CELL_SQL}, true AS seen FROM hist)
SELECT {sql.SERIES}, Year, Day + CAST(Lag AS INTEGER) AS "Group",
       CAST((2 - Lag) * 5 + place AS BIGINT) AS "Index", Day, CAST(Hour AS INTEGER) AS Hour,
       CAST(W * L AS DOUBLE) / 1e8 AS Weight, coalesce(seen, false) AS Imaged
FROM cells LEFT JOIN images USING ({_CELL_SQL}), lags
WHERE Day + Lag BETWEEN 3 AND dayofyear(make_date(Year, 12, 31))""",
}
