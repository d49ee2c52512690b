"""Codes of categorical columns, grids of any columns, and rows gathered by position."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huestrata.operators.reshape import refuse_unless, with_row_index
from huestrata.sources.shared import broadcast_if_small, shared_folder

#: A longer list of grid values becomes a table.
INLINE_VALUES = 1000

#: Positions asked for by more than one in so many requests are looked up apart. There are fewer of them than this.
HOT_SHARE = 1000

_BIGGEST = 2**63 - 1


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def level_table(df: DataFrame, column: str, *, value: str = "Level", code: str = "Code") -> DataFrame:
    """The levels of a categorical column: its distinct values in ascending order, numbered 1, 2, ...

    Values are made distinct with a map-side stage and numbered by range, so
    neither a frequent value nor many values meet in one task. A missing value
    is no level.
    """
    levels = df.select(F.col(column).alias(value)).filter(F.col(value).isNotNull()).distinct()
    return with_row_index(levels, [value], code)


def as_factor(
    df: DataFrame, column: str, *, code: str = "Code", levels: Sequence[Any] | None = None
) -> DataFrame:
    """``df`` with the level code of every row; rows keep their number.

    Codes follow the ascending order of the distinct values, or the order of
    ``levels``. A missing value, and one that is not in ``levels``, has no code.
    The level table is broadcast if its measured size allows; else it is joined
    by a shuffle, in which Spark splits the partition of a frequent value. An
    existing column ``code`` is replaced.
    """
    rows = df.drop(code) if code != column else df
    level, number = unused("_level", rows), unused("_code", rows)
    if levels is None:
        found = level_table(df, column, value=level, code=number)
    else:
        found = _given_levels(df, column, levels, level, number)
    coded = rows.join(broadcast_if_small(found), F.col(column) == F.col(level), "left").drop(level)
    return (coded.drop(code) if code == column else coded).withColumnRenamed(number, code)


def _given_levels(
    df: DataFrame, column: str, levels: Sequence[Any], level: str, number: str
) -> DataFrame:
    if len(set(levels)) != len(levels) or None in levels:
        raise ValueError("levels are distinct and not missing")
    schema = T.StructType(
        [T.StructField(level, df.schema[column].dataType), T.StructField(number, T.LongType())]
    )
    rows = [(value, place) for place, value in enumerate(levels, start=1)]
    return df.sparkSession.createDataFrame(rows, schema)


def expand_grid(
    spark: SparkSession, axes: Mapping[str, Sequence[Any] | range | DataFrame], *, index: str = "Index"
) -> DataFrame:
    """Every combination of the values of any number of columns; the first column varies fastest.

    ``index`` numbers the rows 1, 2, ... in that order. A row's number, read in a
    mixed radix, gives the place of its value on each axis, so the grid is one
    ``spark.range`` and there is no cross join. An axis is a ``range`` (worked
    out from the place), a list (looked up in the expression, or in a table if it
    is long) or a table of one column, whose rows count in ascending order. Such
    tables are joined by the place, broadcast if their measured size allows.
    Repeated values stay; an empty axis gives no rows.
    """
    if not axes or index in axes:
        raise ValueError("a grid has columns, and none called like its index")
    tables = {name: _axis_table(spark, name, axis) for name, axis in axes.items()}
    sizes = {
        name: len(axis) if tables[name] is None else tables[name].count() for name, axis in axes.items()
    }
    if prod(sizes.values()) > _BIGGEST:
        raise ValueError("the grid has more rows than a BIGINT can number")
    grid = spark.range(prod(sizes.values())).select(F.col("id").alias("_row"))
    stride = 1
    for name, axis in axes.items():
        if sizes[name]:
            place = F.expr(f"`_row` div {stride} % {sizes[name]}")
            grid = _with_axis(grid, name, axis, tables[name], place)
            stride *= sizes[name]
        else:
            grid = grid.withColumn(name, F.lit(None))
    return grid.select((F.col("_row") + 1).alias(index), *[F.col(f"`{name}`") for name in axes])


def _axis_table(spark: SparkSession, name: str, axis) -> DataFrame | None:
    """Places (from 1) and values of an axis that needs a table."""
    if isinstance(axis, DataFrame):
        (column,) = axis.columns
        return with_row_index(axis.select(F.col(column).alias("_value")), ["_value"], "_digit")
    if isinstance(axis, range) or len(axis) <= INLINE_VALUES:
        return None
    values = spark.createDataFrame([(i, v) for i, v in enumerate(axis, start=1)], ["_digit", "_value"])
    return values


def _with_axis(grid: DataFrame, name: str, axis, table: DataFrame | None, place: Column) -> DataFrame:
    if table is not None:
        placed = grid.withColumn("_digit", place + 1)
        joined = placed.join(broadcast_if_small(table), "_digit").drop("_digit")
        return joined.withColumnRenamed("_value", name)
    if isinstance(axis, range):
        value = place * axis.step + axis.start
        ints = all(abs(x) < 2**31 for x in (axis.start, axis[-1]))
        return grid.withColumn(name, value.cast("int") if ints else value)
    return grid.withColumn(name, F.element_at(F.array(*[F.lit(v) for v in axis]), (place + 1).cast("int")))


def gather_rows(
    df: DataFrame,
    order: Sequence[str],
    requests: DataFrame,
    *,
    at: str = "Index",
    outside: str = "drop",
    request_order: Sequence[str] | None = None,
    place: str = "Place",
) -> DataFrame:
    """The rows of ``df`` at the positions that ``requests`` asks for, as often as it asks.

    Positions count from 1 in the explicit ``order`` of ``df`` (ties keep the
    order of the input). Each request becomes one row with its own columns and
    those of the row found. ``outside`` says what becomes of a position that is
    missing, below 1 or beyond the last row: ``"drop"`` leaves the request out,
    ``"null"`` keeps it with empty columns, ``"refuse"`` fails the job. With
    ``request_order`` the column ``place`` numbers the requests 1, 2, ... in that
    order, before any is dropped.

    Rows are numbered by range and met by a join on the position. Positions that
    more than one in ``HOT_SHARE`` requests ask for are fewer than ``HOT_SHARE``;
    their rows are joined by broadcast, so a request repeated millions of times
    is spread over all tasks.
    """
    if outside not in ("drop", "null", "refuse"):
        raise ValueError("outside is 'drop', 'null' or 'refuse'")
    shared = set(df.columns) & set(requests.columns)
    if shared:
        raise ValueError(f"both sides have {sorted(shared)}")
    shared_folder(df.sparkSession)
    asked = with_row_index(requests, request_order, place) if request_order else requests
    asked = asked.checkpoint()
    number, met = unused("_number", df, asked), unused("_met", df, asked)
    rows = with_row_index(df, order, number).withColumn(met, F.lit(True))
    total = asked.count()
    often = asked.groupBy(at).count().filter(F.col("count") * HOT_SHARE > total)
    hot = [r[at] for r in often.filter(F.col(at).isNotNull()).collect()]
    is_hot = F.coalesce(F.col(at).isin(hot), F.lit(False)) if hot else F.lit(False)
    same = F.col(at) == F.col(number)
    how = "inner" if outside == "drop" else "left"
    found = asked.filter(~is_hot).join(rows, same, how)
    if hot:
        few = F.broadcast(rows.filter(F.col(number).isin(hot)))
        found = found.unionByName(asked.filter(is_hot).join(few, same, how))
    if outside == "refuse":
        found = found.filter(refuse_unless(met, "gather_rows: a position without a row"))
    return found.drop(number, met)
