"""Labels and pasted keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from huestrata.functions.nulls import _col


def paste(*cols: Column | str, sep: str = "_") -> Column:
    """Join values as text; a missing value is written as ``NA``."""
    return F.concat_ws(
        sep, *[F.coalesce(_col(c).cast("string"), F.lit("NA")) for c in cols]
    )


def hour_label(hour: Column | str = "Hour") -> Column:
    """``Hour 07``, ``Hour 12``, ..."""
    return F.format_string("Hour %02d", _col(hour))


def window_label(days: int) -> str:
    """``02-day window``, ``10-day window``, ..."""
    return f"{days:02d}-day window"
