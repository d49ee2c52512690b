"""Centroid clustering whose nearest centroids are found by the threshold algorithm."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huestrata.llm.common import stored

#: Vectors that are walked together in a task.
WALK_ROWS = 1024

#: Whole components beyond this are refused, so that squared distances of up to 128 components fit 64 bits.
MOST = 1 << 26

_FAR = np.iinfo(np.int64).max


def whole(vector: Column, scale: int, size: int) -> Column:
    """Integer components ``floor(scale * x)``; null unless there are exactly ``size`` finite ones.

    Components beyond ``MOST`` fail the job: their distances would not be exact.
    """
    fits = F.size(vector) == size
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    far = F.raise_error(F.lit(f"a component is beyond {MOST}")).cast("int")

    def part(x: Column) -> Column:
        scaled = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < MOST, scaled.cast("int")).otherwise(far)

    return F.when(fits & finite, F.transform(vector, part))


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of, and squared distance to, the nearest centroid of every point; ties go to the smaller number.

    Every dimension has its centroids in a sorted list. From the point's value
    each list is walked outward, nearest value first. A centroid met for the
    first time gets its exact distance. The squared gaps at the frontiers of all
    lists add up to a lower bound for every centroid not met yet; the walk ends
    when that strictly exceeds the best exact distance, so no tie is missed.
    """
    owner = np.argsort(centroids, axis=0, kind="stable")
    ranked = np.take_along_axis(centroids, owner, axis=0)
    parts = [_walk(points[i : i + WALK_ROWS], centroids, owner, ranked) for i in range(0, len(points), WALK_ROWS)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _walk(
    points: np.ndarray, centroids: np.ndarray, owner: np.ndarray, ranked: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    count, size = centroids.shape
    dims = np.arange(size)[None, :]
    exact = np.full((len(points), count), _FAR)
    above = np.stack([np.searchsorted(ranked[:, d], points[:, d]) for d in range(size)], axis=1)
    below = above - 1
    live = np.arange(len(points))
    while len(live):
        x, low, high = points[live], below[live], above[live]
        down = np.where(low >= 0, x - ranked[np.maximum(low, 0), dims], _FAR)
        up = np.where(high < count, ranked[np.minimum(high, count - 1), dims] - x, _FAR)
        downward = down <= up
        gap = np.where(downward, down, up)
        met = np.zeros((len(live), count), bool)
        met[np.arange(len(live))[:, None], owner[np.where(downward, low, high), dims]] = True
        rows, numbers = np.nonzero(met & (exact[live] == _FAR))
        exact[live[rows], numbers] = ((x[rows] - centroids[numbers]) ** 2).sum(axis=1)
        below[live] = low - downward
        above[live] = high + ~downward
        frontier = (gap**2).sum(axis=1)
        best = exact[live]
        # A list that has come to its end has met every centroid.
        more = (frontier <= best.min(axis=1)) & (best == _FAR).any(axis=1)
        live = live[more]
    return exact.argmin(axis=1), exact.min(axis=1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    vectors = batch.column("vector")
    return vectors.flatten().to_numpy().astype(np.int64).reshape(len(vectors), -1)


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``; a null id comes last, ties go by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select(key.alias("key"), "vector").orderBy(F.asc_nulls_last("key"), "vector").limit(k)
    return np.array([r["vector"] for r in first.collect()], np.int64)


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every row of ``vec_id, vector``; no shuffle."""
    schema = rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).schema

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(_matrix(batch), centroids)
            columns = [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "vector").mapInArrow(assigned, schema)


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round. Tasks hand on one sum for each cluster and dimension; so many rows reach the driver."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            points = _matrix(batch)
            cluster, _ = nearest(points, centroids)
            np.add.at(totals, cluster, points)
            counts += np.bincount(cluster, minlength=len(centroids))
        cluster, dim = np.indices(totals.shape).reshape(2, -1)
        columns = [cluster.astype(np.int32), dim.astype(np.int32), totals.ravel(), np.repeat(counts, totals.shape[1])]
        used = columns[3] > 0
        yield pa.RecordBatch.from_arrays([pa.array(c[used]) for c in columns], ["cluster", "dim", "total", "n"])

    sums = rows.select("vector").mapInArrow(summed, "cluster int, dim int, total bigint, n bigint")
    whole_sums = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("total", "n")]
    moved = centroids.copy()
    for r in sums.groupBy("cluster", "dim").agg(*whole_sums).collect():
        moved[r["cluster"], r["dim"]] = int(r["total"]) // int(r["n"])
    return moved


def cluster(rows: DataFrame, *, k: int, rounds: int, seed: int) -> DataFrame:
    """Lloyd's rounds over ``vec_id`` and ``vector``, an array of whole numbers of one length.

    Centroids start as ``first_centroids``. Every round assigns all vectors and
    moves each centroid that has any to the componentwise ``floor(sum / count)``;
    after the last one all vectors are assigned once more. Rounds that would
    change nothing are left out. Returns a row for each vector: ``vec_id,
    cluster, distance, cluster_inertia, inertia, centroid`` (squared distances;
    inertia is their sum over the cluster and over all).

    The vectors are stored once in the shared folder, and each round reads them
    without a shuffle; ``k`` times the dimensions rows go to the driver a round.
    Null vectors take no part. A null id is an id like any other; repeated rows
    each count and each get a row, and fewer vectors than ``k`` make fewer
    clusters. Ties go to the smaller number. An empty table gives no rows. Other
    columns of ``rows`` are not returned.
    """
    kept = stored(rows.select("vec_id", "vector").filter(F.col("vector").isNotNull()))
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return _empty(kept)
    for _ in range(rounds):
        before, centroids = centroids, _moved(kept, centroids)
        if np.array_equal(before, centroids):
            break
    final = stored(assign(kept, centroids))
    inertia = final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("sum")).collect()
    total = sum(int(r["sum"]) for r in inertia)
    facts = [(r["cluster"], int(r["sum"]), total, centroids[r["cluster"]].tolist()) for r in inertia]
    facts_of = kept.sparkSession.createDataFrame(
        facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
    )
    # At most k rows.
    return final.join(F.broadcast(facts_of), "cluster").select("vec_id", *_RESULT)


_RESULT = ("cluster", "distance", "cluster_inertia", "inertia", "centroid")


def _empty(rows: DataFrame) -> DataFrame:
    none = {"cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint"}
    return rows.select(
        "vec_id",
        *[F.lit(0).cast(kind).alias(c) for c, kind in none.items()],
        F.array().cast("array<bigint>").alias("centroid"),
    ).filter(F.lit(False))


def digest(centroid: Sequence[int]) -> str:
    """SHA-256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
