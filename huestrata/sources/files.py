"""CSV and text inputs, and the Parquet layout they are converted to."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huestrata.functions import as_integer, clean_nan
from huestrata.operators.columns import clean_histograms
from huestrata.operators.positions import unused
from huestrata.operators.reshape import unpivot_columns
from huestrata.schema import HISTOGRAM_SCHEMA, TIMING_SCHEMA
from huestrata.sources.shared import broadcast_if_small, shared_folder


#: Files from this size on are not read to their end for a header.
LONG_FILE = 64 << 20

#: Settings of a scan that gives each of these files a task, and hands on one line at a time.
_ONE_FILE = {
    "spark.sql.files.maxPartitionBytes": str(1 << 36),
    "spark.sql.files.openCostInBytes": str(1 << 36),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1",
}


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """``file, header`` of every CSV file with a line that is not blank; ``header`` lists the column names.

    The first lines are found in tasks, and no path goes through the driver. Of
    the many short files Spark puts several into a task and keeps the first line
    of each by a partial aggregate. Long files are picked by their size in the
    listing; each is a task of its own, which ends after that line. As in
    Spark's reader an unnamed column is called ``_c`` and its place, and a
    repeated name gets its place behind it.
    """
    size = F.col("_metadata.file_size")
    numbered = _lines(spark, path, size < LONG_FILE).withColumn("at", F.monotonically_increasing_id())
    short = numbered.groupBy("file").agg(F.min_by("value", "at").alias("value"))
    target = f"{shared_folder(spark)}/headers-{uuid.uuid4().hex}"
    short.select("file", _names(F.col("value")).alias("header")).write.parquet(target)
    own = spark.newSession()
    for key, value in _ONE_FILE.items():
        own.conf.set(key, value)
    alone = all(own.conf.get(key) == value for key, value in _ONE_FILE.items())

    def first_lines(batches):
        import pyarrow as pa

        seen = set()
        for batch in batches:
            for file, line in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
                if file not in seen:
                    seen.add(file)
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([line])], ["file", "value"])
            if alone:
                return

    found = _lines(own, path, size >= LONG_FILE).mapInArrow(first_lines, "file string, value string")
    found.select("file", _names(F.col("value")).alias("header")).write.mode("append").parquet(target)
    return spark.read.schema("file string, header array<string>").parquet(target)


def _lines(spark: SparkSession, path: str, which: Column) -> DataFrame:
    """Lines that are not blank, of the first part of every file that is asked for."""
    at, value = F.col("_metadata"), F.regexp_replace("value", "^\ufeff", "")
    first = spark.read.text(path).filter(which & (at["file_block_start"] == 0))
    return first.select(at["file_path"].alias("file"), value.alias("value")).filter(F.trim("value") != "")


def _names(line: Column) -> Column:
    """Column names of a header line."""

    @F.pandas_udf("array<string>")
    def names(lines: pd.Series) -> pd.Series:
        import csv

        found = []
        for cells in csv.reader(lines.tolist()):
            lower = [c.lower() for c in cells]
            found.append(
                [f"_c{i}" if not c else f"{c}{i}" if lower.count(c.lower()) > 1 else c for i, c in enumerate(cells)]
            )
        return pd.Series(found)

    return names(line)


def _text_csv(
    spark: SparkSession, path: str, names: Sequence[str] | None = None, place: str | None = None
) -> DataFrame:
    """The named columns (all, if none are named) as text; empty and ``NA`` are NULL.

    Columns are matched by name, in any letter case, whatever their order in a
    file; a column that a file does not have is NULL there. ``place`` adds the
    place of a row, see ``FILE_PLACE``. Files are read in one scan. With one
    header for all files it reads the named columns alone. Else it reads by
    position, and the places of the names come by a join on the file; that table
    is broadcast if its measured size allows.
    """
    files = csv_headers(spark, path)
    facts = files.agg(
        F.count("*").alias("files"), F.max(F.size("header")).alias("width"),
        F.min("header").alias("least"), F.max("header").alias("most"),
    ).first()
    if not facts["files"]:
        raise ValueError(f"no file in {path}")
    read = spark.read.option("header", True)
    if facts["least"] == facts["most"]:
        header = {c.lower(): c for c in facts["least"]}
        rows = _placed(read.schema(_texts(facts["least"])).csv(path), place)
        wanted = facts["least"] if names is None else names
        cells = {c: F.col(f"`{header[c.lower()]}`") if c.lower() in header else F.lit(None).cast("string") for c in wanted}
    else:
        wanted = _all_names(files) if names is None else names
        by_position = [f"_{i}" for i in range(facts["width"])]
        scan = read.schema(_texts(by_position)).csv(path)
        rows = _placed(scan, place, F.col("_metadata.file_path").alias("_file"))
        lower = F.transform("header", F.lower)
        places = F.array(*[F.array_position(lower, F.lit(c.lower())).cast("int") - 1 for c in wanted])
        found = files.select(F.col("file").alias("_file"), places.alias("_places"))
        rows = rows.join(broadcast_if_small(found), "_file").withColumn("_cells", F.array(*by_position))
        # The name of a column that the file does not have is at place -1, which ``get`` reads as NULL.
        cells = {c: F.get("_cells", F.col("_places")[i]) for i, c in enumerate(wanted)}
    known = [F.when(~F.trim(cell).isin("", "NA"), cell).alias(c) for c, cell in cells.items()]
    return rows.select(*known, *([place] if place else []))


def _placed(scan: DataFrame, place: str | None, *more: Column) -> DataFrame:
    """All columns of a text scan with the places of its rows, taken before any other step."""
    if place is None:
        return scan.select("*", *more)
    at = F.col("_metadata")
    parts = {"file": at["file_path"], "start": at["file_block_start"], "row": F.monotonically_increasing_id()}
    return scan.select("*", *more, F.struct(*[c.alias(name) for name, c in parts.items()]).alias(place))


def _all_names(files: DataFrame) -> list[str]:
    """Names of all headers, in any letter case, by their first place in a header and then by name."""
    names = files.select(F.posexplode("header").alias("at", "name"))
    each = names.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("at", "name")).alias("first"))
    return [r["name"] for r in each.select("first.*").orderBy("at", "name").collect()]


#: Place of a row in the files it was read from: file, start of the part of the file, row within the part.
#: Rows compare by it as they stand in the files, file by file in the order of their paths.
FILE_PLACE = "File_Place"


def _texts(header: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in header])


def _typed(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.IntegerType):
        return as_integer(field.name).alias(field.name)
    return F.col(f"`{field.name}`").try_cast(field.dataType).alias(field.name)


def read_typed_csv(
    spark: SparkSession, path: str, schema: T.StructType, place: str | None = None
) -> DataFrame:
    """CSV columns picked by name and cast; text that does not fit becomes NULL."""
    texts = _text_csv(spark, path, [f.name for f in schema.fields], place)
    return texts.select(*[_typed(f) for f in schema.fields], *([place] if place else []))


def read_histogram_csv(spark: SparkSession, path: str, place: str | None = None) -> DataFrame:
    """Histogram CSV, plain or gzip, in any column order, which may differ from file to file.

    A gzip file is one scan task; convert it once with ``write_histograms``.
    ``place`` names a column for the place of each row in the files.
    """
    return clean_histograms(read_typed_csv(spark, path, HISTOGRAM_SCHEMA, place))


def write_histograms(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by Dataset and Year, sorted within files by image and bin.

    Copies of a row are folded first, with a map-side stage. The rebalance hint lets Spark split a large year over several files and
    join small ones, so one busy camera does not become one task.
    """
    (
        df.distinct()
        .hint("rebalance", "Dataset", "Year")
        .sortWithinPartitions("Dataset", "Year", "Camera_ID", "Day", "Hour", "Minute")
        .write.mode(mode)
        .partitionBy("Dataset", "Year")
        .parquet(path)
    )


def read_histograms(spark: SparkSession, path: str, place: str | None = None) -> DataFrame:
    """The layout of ``write_histograms``, with the declared column types and order.

    Parquet columns are matched by name; the schema also keeps a dataset called
    ``007`` from being read as a number. ``place`` names a column for the place
    of each row in the files.
    """
    names = [f.name for f in HISTOGRAM_SCHEMA.fields]
    at = F.col("_metadata")
    parts = {"file": at["file_path"], "start": F.lit(0).cast("bigint"), "row": at["row_index"]}
    places = [F.struct(*[c.alias(name) for name, c in parts.items()]).alias(place)] if place else []
    return clean_histograms(spark.read.schema(HISTOGRAM_SCHEMA).parquet(path).select(*names, *places))


def read_share_csv(
    spark: SparkSession, path: str, low: int | None = None, high: int | None = None
) -> DataFrame:
    """Wide share file to rows of (database, sequence, year, variable, value)."""
    return melt_shares(_text_csv(spark, path), low, high)


def melt_shares(wide: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Columns X0, X1, ... to rows; sizes are truncated to whole numbers.

    With ``low`` and ``high`` only the columns of ``low <= bin < high`` are read.
    """
    bins = [
        c
        for c in wide.columns
        if c[:1] == "X"
        and c[1:].isdigit()
        and (low is None or int(c[1:]) >= low)
        and (high is None or int(c[1:]) < high)
    ]
    numbers = wide.select(
        F.col("database").cast("string").alias("database"),
        as_integer("sequence").alias("sequence"),
        F.col("year").try_cast("double").alias("year"),
        *[clean_nan(F.col(c).try_cast("double")).alias(c) for c in bins],
    )
    long = unpivot_columns(numbers, bins, "variable", "value", strip="X")
    return long.withColumn("variable", as_integer("variable")).withColumn(
        "value", as_integer("value", "bigint")
    )


def read_timing_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_typed_csv(spark, path, TIMING_SCHEMA)


def read_plain_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """CSV with inferred column types, or with the given ones; columns are matched by name.

    One pass over the values finds the first of whole number (32 or 64 bits),
    number, truth value, date and time that every known value of a column reads
    as; other columns, and those without any value, stay text.
    """
    if schema is not None:
        return read_typed_csv(spark, path, schema)
    texts = _text_csv(spark, path)
    tests = [
        F.bool_and(F.when(F.col(f"`{c}`").isNotNull(), _reads_as(c, kind, pattern))).alias(f"{i} {kind}")
        for i, c in enumerate(texts.columns)
        for kind, pattern in _KINDS.items()
    ]
    holds = texts.agg(*tests).first()
    kinds = [
        next((kind for kind in _KINDS if holds[f"{i} {kind}"]), "string") for i in range(len(texts.columns))
    ]
    return texts.select(
        *[F.trim(F.col(f"`{c}`")).try_cast(k).alias(c) if k != "string" else F.col(f"`{c}`")
          for c, k in zip(texts.columns, kinds)]
    )


#: Types that a column of texts is tried for, in this order, and how such a value is written.
_KINDS = {
    "int": r"[+-]?\d+",
    "bigint": r"[+-]?\d+",
    "double": r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|NaN|[+-]?Inf(inity)?",
    "boolean": r"(?i)true|false",
    "date": r"\d{4}-\d{2}-\d{2}",
    "timestamp": r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?",
}


def _reads_as(column: str, kind: str, pattern: str) -> Column:
    value = F.trim(F.col(f"`{column}`"))
    return value.rlike(f"^({pattern})$") & value.try_cast(kind).isNotNull()


def read_palette(spark: SparkSession, path: str) -> DataFrame:
    """Colours of a palette file in file order: (pos, color).

    One colour per line; a question mark starts a comment and blank lines do
    not count. A palette file is a short list and is read as one text.
    """
    text = spark.read.text(path, wholetext=True)
    lines = F.transform(
        F.split("value", r"\r?\n"), lambda line: F.upper(F.trim(F.regexp_replace(line, r"\?.*", "")))
    )
    return text.select(F.posexplode(F.filter(lines, lambda line: line != ""))).select(
        (F.col("pos") + 1).alias("pos"), F.col("col").alias("color")
    )


def inline_palette(spark: SparkSession, colors: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(
        [(i, c.upper()) for i, c in enumerate(colors, start=1)], "pos int, color string"
    )


def weight_table(spark: SparkSession, weights: Mapping[int, str]) -> DataFrame:
    """Inline (Hour, Weight) table; weights are exact decimals."""
    rows = [(hour, str(weight)) for hour, weight in weights.items()]
    return spark.createDataFrame(rows, "Hour int, Weight string").withColumn(
        "Weight", F.col("Weight").cast("decimal(6,4)")
    )


def write_table(
    df: DataFrame,
    path: str,
    *,
    by: Sequence[str] = (),
    order: Sequence[str] = (),
    total_order: bool = False,
    mode: str = "overwrite",
) -> None:
    """Sink of a figure-ready table, one folder for each value of ``by``.

    Rows with the same ``by`` are brought together, large groups in several
    files, and each file is sorted by ``order``. With ``total_order`` the files,
    read in the order of their names, hold the rows in the order of ``by`` and
    ``order``; see ``read_numbered``.
    """
    if total_order:
        df = _in_total_order(df, [*by, *order])
    elif by:
        df = df.hint("rebalance", *by)
    if order and not total_order:
        df = df.sortWithinPartitions(*by, *order)
    df.write.mode(mode).partitionBy(*by).parquet(path)


#: Spark numbers the files of a write with five digits, so more would not sort by name.
MOST_FILES = 99_999


def _in_total_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows dealt to ranges, so that the number of a task is its place in the order.

    Copies of one key spread over several ranges by their place in the input,
    which a checkpoint fixes for the case that an executor is lost.
    """
    if not order:
        raise ValueError("a total order needs columns")
    spark = df.sparkSession
    shared_folder(spark)
    ranges = min(MOST_FILES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tie = unused("_tie", df)
    return (
        df.withColumn(tie, F.monotonically_increasing_id())
        .checkpoint()
        .repartitionByRange(ranges, *order, tie)
        .sortWithinPartitions(*order, tie)
        .drop(tie)
    )


def read_numbered(spark: SparkSession, path: str, name: str = "Row") -> DataFrame:
    """A Parquet table with its rows numbered 1, 2, ... as they stand in the files, by the files' paths.

    For a table written with ``total_order`` this is its order. Row counts by
    file make the offsets: one row for each file, added up in one task and
    broadcast if their measured size allows.
    """
    at = F.col("_metadata")
    rows = spark.read.parquet(path).select("*", at["file_path"].alias("_file"), at["row_index"].alias("_at"))
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_file")) - F.col("_rows")
    offsets = sizes.select("_file", before.alias("_before"))
    numbered = rows.join(broadcast_if_small(offsets), "_file")
    return numbered.withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_file", "_at", "_before")
