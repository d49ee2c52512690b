"""The folder that every executor can reach."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables of up to this many bytes are broadcast; a row counts with this much beside its values.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 32


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session in its shared storage, removed when the driver ends.

    It lies in ``spark.checkpoint.dir``; where that is unset, in the warehouse.
    On a cluster a warehouse in the file system of one machine is refused: the
    executors would not find there what others have written.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            base = spark.conf.get("spark.sql.warehouse.dir")
            if base.startswith("file:") and not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{base.rstrip('/')}/shared-{uuid.uuid4().hex}"
        context.setCheckpointDir(folder)
        atexit.register(_remove, context, folder)
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read from there; cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, stored once and measured, with a broadcast hint if it is small enough.

    Beyond ``most`` bytes it comes back without a hint, for a join by shuffle.
    """
    kept = stored(df)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    fixed = ROW_BYTES + 8 * (len(df.columns) - len(texts))
    size = sum((F.coalesce(F.sum(F.octet_length(f"`{c}`")), F.lit(0)) for c in texts), F.count(F.lit(1)) * fixed)
    return F.broadcast(kept) if kept.agg(size).first()[0] <= most else kept


def _remove(context, folder: str) -> None:
    """Remove a folder made here; a session that has ended already keeps it."""
    if context._jsc is not None:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
