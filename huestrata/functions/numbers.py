"""Integer casts, exact integer division and weights as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from huestrata.functions.nulls import _col
from huestrata.schema import hour_units


def as_integer(c: Column | str, to: str = "int") -> Column:
    """Truncate towards zero; text or values that do not fit become NULL."""
    return _col(c).try_cast("double").try_cast(to)


def whole_div(c: Column | str, by: int) -> Column:
    """Integer quotient, truncated towards zero, without leaving BIGINT."""
    return F.call_function("div", _col(c), F.lit(by).cast("bigint"))


def case_of(c: Column | str, values: Mapping[int, int]) -> Column:
    """``CASE`` expression from a short list of whole numbers; NULL otherwise."""
    c = _col(c)
    (first, value), *rest = values.items()
    case = F.when(c == first, F.lit(value).cast("bigint"))
    for key, value in rest:
        case = case.when(c == key, F.lit(value).cast("bigint"))
    return case


def year_days(year: Column | str = "Year") -> Column:
    """Days of a calendar year."""
    return F.dayofyear(F.make_date(_col(year), F.lit(12), F.lit(31)))


def hour_weight(weights: Mapping[int, str], hour: Column | str = "Hour") -> Column:
    """Weight of an hour in ten-thousandths; NULL for hours not listed.

    The table has at most 24 entries, so it travels inside the expression and
    needs neither a join nor a broadcast.
    """
    return case_of(hour, hour_units(weights))
