"""Long and wide forms, tagged unions, grids and row-by-row binding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huestrata.functions import year_days
from huestrata.operators.groups import duplicate_keys
from huestrata.sources.shared import shared_folder

#: Bins that are marked in one whole number.
_BITS = 62


def unpivot_columns(
    df: DataFrame, values: Sequence[str], name: str, value: str, strip: str = ""
) -> DataFrame:
    """Columns to rows; ``strip`` is removed from the front of the new names."""
    ids = [c for c in df.columns if c not in values]
    long = df.unpivot(ids, list(values), name, value)
    if strip:
        long = long.withColumn(name, F.regexp_replace(name, "^" + strip, ""))
    return long


def pivot_bins(
    df: DataFrame, keys: Sequence[str], bins: Sequence[int], *, value: str = "Bin_Value",
    prefix: str = "X",
) -> DataFrame:
    """One column per bin; a missing bin is NULL.

    The bin list is given, so no extra job looks for it. A key with two rows of
    one bin, and a bin that is not in the list, are refused when the result is
    computed: a cell holds one value, and no row is left out.
    """
    bins = list(bins)
    # Place of a bin in the list, from 0; one lookup for all bins, whose bits are kept in words.
    place = (F.array_position(F.array(*[F.lit(b) for b in bins]), F.col("Bin")) - 1).cast("int")
    df = df.withColumn("_place", place)
    seen = [
        F.bit_or(
            F.when(F.expr(f"_place >= 0 AND _place div {_BITS} = {word}"), F.expr(f"shiftleft(1L, _place % {_BITS})")).otherwise(0)
        )
        for word in range(-(-len(bins) // _BITS))
    ]
    found = sum((F.bit_count(bits) for bits in seen), F.lit(0))
    wide = df.groupBy(*keys).agg(
        *[F.min(F.when(F.col("Bin") == b, F.col(value))).alias(f"{prefix}{b}") for b in bins],
        (F.count(F.lit(1)) == found).alias("_fits"),
    )
    return wide.filter(
        refuse_unless("_fits", "pivot_bins: a bin twice for one key, or a bin that is not listed")
    ).drop("_fits")


def refuse_unless(holds: str, message: str) -> Column:
    """Filter that keeps every row, and fails the job at a row for which ``holds`` is not true."""
    return F.when(F.col(holds), True).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def union_tagged(sources: Mapping[str, DataFrame], tag: str = "dataset") -> DataFrame:
    """All rows of all sources, matched by column name, each with its tag."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def calendar_grid(
    years: DataFrame, hours: Sequence[int], days: int | None = None, minute: int = 0
) -> DataFrame:
    """Every expected (Day, Hour) cell for each row of ``years``, to the last day of the year or ``days``.

    The cells are generated from two sequences inside the row: no join. The
    few short input rows are spread over a fixed number of tasks first, because
    each of them grows by a factor of days times hours.
    """
    last = year_days() if days is None else F.lit(days)
    tasks = int(years.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        years.repartition(tasks, *years.columns)
        .withColumn("Day", F.explode(F.sequence(F.lit(1), last)))
        .withColumn("Hour", F.explode(F.array(*[F.lit(h) for h in hours])))
        .withColumn("Minute", F.lit(minute))
    )


def complete_grid(grid: DataFrame, observed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Expected cells with what was observed there, or NULL."""
    return grid.join(observed, list(on), "left")


def with_row_index(df: DataFrame, order: Sequence[str], name: str = "Index") -> DataFrame:
    """Number the rows 1, 2, ... by an explicit order, without one big sort task.

    Rows are range partitioned by the order (ties fall back on their place in
    the input, so copies of one key can spread over partitions) and sorted
    within each partition. Two checkpoints keep this right when an executor is
    lost: the first fixes the places in the input, the second the partition
    borders. Only the row count of each partition goes through the driver, and
    comes back as one row for each.
    """
    shared_folder(df.sparkSession)
    placed = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .checkpoint()
        .repartitionByRange(*order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .drop("_tie")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        .checkpoint()
    )
    sizes = sorted(tuple(r) for r in placed.groupBy("_part").count().collect())
    starts = [0, *accumulate(size for _, size in sizes)]
    offsets = df.sparkSession.createDataFrame(
        [(part, start) for (part, _), start in zip(sizes, starts)], "_part int, _before bigint"
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_place") + 1)
        .drop("_part", "_place", "_before")
    )


def zip_rows(
    left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]
) -> DataFrame:
    """Bind row i of one table to row i of the other, by explicit orders.

    Tables of unequal lengths are refused, so no row is lost.
    """
    shared = set(left.columns) & set(right.columns)
    if shared:
        raise ValueError(f"both sides have {sorted(shared)}")
    one, other = with_row_index(left, left_order), with_row_index(right, right_order)
    lengths = one.count(), other.count()
    if lengths[0] != lengths[1]:
        raise ValueError(f"zip_rows: {lengths[0]} and {lengths[1]} rows")
    return one.join(other, "Index")


def ordered_keys(df: DataFrame, keys: Sequence[str], name: str = "Ordinal") -> DataFrame:
    """Rows numbered in the order of ``keys``, which must be unique: the levels of a categorical key."""
    repeated = duplicate_keys(df, keys).first()
    if repeated is not None:
        raise ValueError(f"ordered_keys: {repeated['Rows']} rows for {tuple(repeated[:-1])}")
    return with_row_index(df, keys, name)
