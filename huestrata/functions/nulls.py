"""Missing-value rules: sums that give NULL on any gap, sums that skip gaps."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_nan(c: Column | str) -> Column:
    """NaN becomes NULL, so that one missing marker is left."""
    return F.nanvl(_col(c), F.lit(None).cast("double"))


def strict_sum(c: Column | str) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def lenient_sum(c: Column | str) -> Column:
    """Sum over the known inputs; 0 when there is none."""
    return F.coalesce(F.sum(_col(c)), F.lit(0))


def strict_sum_over(c: Column | str, window: WindowSpec) -> Column:
    c = _col(c)
    return F.when(
        F.count(c).over(window) == F.count(F.lit(1)).over(window), F.sum(c).over(window)
    )


def strict_max_over(c: Column | str, window: WindowSpec) -> Column:
    c = _col(c)
    return F.when(
        F.count(c).over(window) == F.count(F.lit(1)).over(window), F.max(c).over(window)
    )
