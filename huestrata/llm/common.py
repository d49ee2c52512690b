"""What several operators share: tables, stored intermediate results, samples, memos."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huestrata.sources.shared import shared_folder

#: Entries after which a worker forgets what it has memorised. Bounds its memory, never its results.
MEMO_ENTRIES = 300_000

#: The same for vectors by key.
VECTOR_ENTRIES = 150_000

#: Rows that are added up at once.
PART = 1 << 14

#: A classifier with more classes than this is refused.
MOST_LABELS = 1000

#: Share of hash space used when rows are drawn by a hash of their id.
HASH_STEPS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if it is not installed there."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    own = spark.sparkContext.environment
    paths = own.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        own["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read from there.

    Cuts the lineage: a lost executor costs a reread, not the work before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of the documents that no model learns from (a null id counts as empty text)."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 3 == 1


def draw(df: DataFrame, doc_id: str, label: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of every label (all, if there are fewer), picked by a hash of the id.

    Only one count for each label reaches the driver, and the same rows come
    out whatever the partitioning. Rows without a label are left out.
    """
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).count().take(MOST_LABELS + 1)
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in {label}")
    if not counts:
        return df.filter(F.lit(False))
    # Bounds of the hash by label; a label is a key of this map, so it is bounded as above.
    bound = F.create_map(
        *[F.lit(x) for r in counts for x in (r[0], int(min(1, per_label / r[1]) * HASH_STEPS))]
    )
    place = F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(HASH_STEPS))
    return df.filter(place < bound[F.col(label)])


class Memo(dict):
    """Results by key, worked out on first use; ``trim`` forgets all once there are too many."""

    def __init__(self, work: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.work, self.entries = work, entries

    def __missing__(self, key):
        value = self[key] = self.work(key)
        return value

    def trim(self) -> None:
        if len(self) > self.entries:
            self.clear()


class VectorMemo(dict):
    """Row number in ``rows`` of every key's vector, worked out on first use."""

    def __init__(self, work: Callable[[str], np.ndarray], width: int, entries: int = VECTOR_ENTRIES):
        super().__init__()
        self.work, self.entries = work, entries
        self.rows = np.zeros((1024, width))

    def __missing__(self, key):
        place = len(self)
        if place == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[place] = self.work(key)
        self[key] = place
        return place

    def total(self, keys: Iterable[str]) -> np.ndarray:
        """Sum of the vectors of all keys, repeats included."""
        if len(self) > self.entries:
            self.clear()
        places = np.fromiter(map(self.__getitem__, keys), dtype=np.int64)
        # Long texts in parts, so that no row is gathered for every word at once.
        parts = (self.rows[places[i : i + PART]].sum(axis=0) for i in range(0, len(places), PART))
        return sum(parts, np.zeros(self.rows.shape[1]))


#: The one large object that a worker keeps from task to task, by its name.
_kept: dict[tuple, object] = {}


def keep_one(name: tuple, make: Callable[[], object]):
    """The object of that name, made on first use. A worker keeps one, so that operators that follow
    each other in a reused worker do not add up their vocabularies."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


@contextmanager
def task_memory(*, keeps: bool = False) -> Iterator[None]:
    """Gives back to the system, before and after a task, what earlier work in this worker has left.

    Freed memory otherwise stays with the allocators of a reused worker. Without
    ``keeps`` the object of ``keep_one`` goes too: the task has no use for it.
    """
    if not keeps:
        _kept.clear()
    _give_back()
    try:
        yield
    finally:
        _give_back()


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # another C library


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    columns: list[str],
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    draw_by: str,
    per_label: int,
    most_chars: int,
) -> pd.DataFrame:
    """Texts and labels of a bounded sample, for a model that is fitted on the driver.

    About ``per_label`` rows of each value of ``draw_by`` and never more than
    twice that in all (by the number of columns). Rows are drawn whatever their
    length; of a text over ``most_chars`` characters the sample has a piece of
    that length from anywhere in it, by a hash of the id. So the driver gets
    rows times ``most_chars`` characters at most. Rows with a null text, id or
    label, and ids with unequal labels, are left out. The order depends on the
    texts alone. Only ids are broadcast.
    """
    agreed = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id"))
    each = agreed.agg(
        *[F.min(c).alias(c) for c in columns], *[F.max(c).alias(f"_{c}") for c in columns]
    )
    for c in columns:
        each = each.filter(F.col(c) == F.col(f"_{c}"))
    drawn = draw(each.select("_id", *columns), "_id", draw_by, per_label)
    most = 2 * per_label * max(2, len(columns))
    rest = F.greatest(F.length(text) - most_chars, F.lit(0))
    start = F.pmod(F.xxhash64(F.col(doc_id).cast("string")), rest + 1).cast("int") + 1
    piece = F.when(rest > 0, F.substr(F.col(text), start, F.lit(most_chars))).otherwise(F.col(text))
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), piece.alias("text"))
    found = rows.join(F.broadcast(drawn.limit(most)), "_id").select("text", *columns).limit(most)
    return found.toPandas().sort_values(["text", *columns]).sample(frac=1, random_state=7)


def base_rates(labels: DataFrame, columns: list[str]) -> dict[str, tuple[int, int]]:
    """Rows of label 0 and of label 1, by column."""
    counts = labels.agg(*[F.sum((F.col(c) == v).cast("bigint")).alias(f"{c} {v}") for c in columns for v in (0, 1)]).first()
    return {c: (counts[f"{c} 0"] or 0, counts[f"{c} 1"] or 0) for c in columns}


def text_fold(texts: Iterable[str], folds: int) -> np.ndarray:
    """Fold of every text; equal texts are in one fold, so none is predicted by a model that has seen it."""
    return np.array([zlib.crc32(t.encode("utf-8", "replace")) % folds for t in texts], dtype=np.int64)


def logistic(inputs: np.ndarray, target: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last one is the intercept."""
    x = np.c_[inputs, np.ones(len(inputs))]
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    weights = np.zeros(x.shape[1])
    for _ in range(40):
        p = sigmoid(x @ weights)
        slope = x.T @ (p - target) + penalty * weights
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
