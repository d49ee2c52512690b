"""Centroid clustering against Lloyd's rounds over all distances."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from huestrata.llm import catalog, threshold
from tests.llm.helpers import SMALL, table


def plain(rows, k=8, rounds=10, seed=3):
    """Rows of the query for ``(vec_id, components)``, in exact arithmetic."""
    hashed = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centroids = [list(v) for _, v in sorted(rows, key=lambda r: (hashed(r[0]), r[1]))[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))

    def assign():
        return [min((away(v, c), i) for i, c in enumerate(centroids)) for _, v in rows]

    for _ in range(rounds):
        found = assign()
        for i in range(len(centroids)):
            own = [v for (_, v), (_, j) in zip(rows, found) if i == j]
            if own:
                centroids[i] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    inertia = sum(d for d, _ in found)
    return sorted(
        (vec_id, j, d, sum(e for e, i in found if i == j), inertia, threshold.digest(centroids[j]))
        for (vec_id, _), (d, j) in zip(rows, found)
    )


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_nearest_equals_all_distances(spread):
    """Few values make many ties, between centroids and in the lists."""
    rng = np.random.default_rng(spread)
    for count in (1, 2, 8, 17):
        for size in (1, 5, 64):
            points = rng.integers(-spread, spread + 1, (1500, size))
            centroids = rng.integers(-spread, spread + 1, (count, size))
            all_of_them = ((points[:, None] - centroids[None]) ** 2).sum(axis=2)
            cluster, distance = threshold.nearest(points, centroids)
            assert (cluster == all_of_them.argmin(axis=1)).all()
            assert (distance == all_of_them.min(axis=1)).all()


def test_the_walk_leaves_far_centroids_alone(monkeypatch):
    """Centroids beyond the frontier never get an exact distance."""
    centroids = np.array([[0, 0], [10, 10], [10**6, 10**6], [-(10**6), 10**6]])
    points = np.array([[1, 1]] * 10)
    asked = []
    real = np.nonzero
    monkeypatch.setattr(threshold.np, "nonzero", lambda met: asked.append(met.sum()) or real(met))
    assert threshold.nearest(points, centroids)[0].tolist() == [0] * 10
    assert sum(asked) < points.shape[0] * len(centroids)


def test_query_equals_exact_rounds(spark):
    rows = [
        (r["vec_id"], [int(np.floor(np.float64(x) * 1024)) for x in r["embedding"]])
        for r in table(spark, "embeddings").select("vec_id", "embedding").collect()
    ]
    assert sorted(map(tuple, catalog.QUERIES["op13_threshold"](spark, SMALL).collect())) == plain(rows)


def test_odd_vectors(spark, tmp_path):
    rng = random.Random(2)
    good = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.5]) for _ in range(64)]) for i in range(40)]
    good += [(3, good[3][1]), (4, good[5][1])]
    bad = [
        (50, None), (51, [0.1] * 63), (52, [0.1] * 65), (53, [None] + [0.1] * 63), (54, [float("nan")] + [0.1] * 63),
        (55, [float("-inf")] + [0.1] * 63), (56, []),
    ]
    spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, catalog.QUERIES["op13_threshold"](spark, str(tmp_path)).collect()))
    assert got == plain([(i, [int(np.floor(x * 1024)) for x in v]) for i, v in good])


def test_few_rows_null_ids_clashes_and_no_rows(spark):
    rows = spark.createDataFrame(
        [(None, [1, 2], 7, "x"), (5, [1, 2], 7, "x"), (5, None, 7, "x"), (6, [9, 9], 7, "x")],
        "vec_id long, vector array<int>, cluster int, distance string",
    )
    got = [tuple(r)[:3] for r in threshold.cluster(rows, k=8, rounds=3, seed=1).collect()]
    # Centroids are 5, 6 and the null id in the order of their hashes; 5 and the null id are equal.
    assert len(got) == 3 and {d for _, _, d in got} == {0}
    clusters = dict((i, c) for i, c, _ in got)
    assert clusters[None] == clusters[5] != clusters[6]
    none = threshold.cluster(rows.limit(0), k=8, rounds=3, seed=1)
    assert none.count() == 0
    assert none.columns == threshold.cluster(rows, k=2, rounds=1, seed=1).columns


def test_components_whose_distances_are_not_exact_are_refused(spark):
    rows = spark.createDataFrame([(1, [1e30] * 2)], "vec_id long, vector array<double>")
    with pytest.raises(PySparkException):
        rows.select(threshold.whole(rows["vector"], 1024, 2)).collect()
