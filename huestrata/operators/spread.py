"""Dealing rows to tasks by a key, with a bound on the rows of a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

#: Rows that one task sorts and hashes at a time. A step holds some 100 to 250 bytes a row.
TASK_ROWS = 500_000


def tasks_for(df: DataFrame, rows: int | None = None) -> int:
    """Tasks that the rows of ``df`` need; 0 if one is enough.

    ``rows`` is what one task takes, ``TASK_ROWS`` if it is not given.

    The rows are counted, because neither the input nor the shuffle tells: an
    image of few events has all its bins, which take a few bytes in a shuffle
    and over a hundred in a sort. Partitions made by the bytes of the shuffle
    therefore hold ten times the rows that fit.
    """
    tasks = -(-df.count() // (rows or TASK_ROWS))
    return max(tasks, df.sparkSession.sparkContext.defaultParallelism) if tasks > 1 else 0


def spread(df: DataFrame, keys: Sequence[str], tasks: int) -> DataFrame:
    """Rows of one key together, over that many tasks, or as many as Spark chooses if 0."""
    return df.repartition(tasks, *keys) if tasks else df.repartition(*keys)
