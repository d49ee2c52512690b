"""Exact top-k by inner product: MaxScore over shards of postings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huestrata.llm.common import stored

#: Vectors of a shard, and queries that meet a shard together.
SHARD_ROWS, QUERY_ROWS = 8192, 512

#: Postings of a block, which is read or skipped as a whole, and terms whose first blocks give the first scores.
BLOCK_POSTINGS, FIRST_TERMS = 64, 16

#: Non-essential terms that are probed together before candidates are checked again.
PROBE_TERMS = 8

#: Sums of products stay exact in double precision below this.
_EXACT = 2.0**53


def whole(vector: Column) -> Column:
    """Integer components ``floor(256 x)``; null unless all components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    return F.when(finite, scaled)


class Shard:
    """Posting lists of a block of vectors.

    A component is a term by its place and sign, and its size is the impact. A
    list holds the vectors with that term, highest impact first, in blocks; the
    first impact of a block bounds the block, the first of all bounds the term.
    Only terms of the query's own signs raise a score, so their bounds add up to
    a bound of the score; components of the other sign lower it.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        #: Postings read, and vectors looked up, since the shard was made.
        self.read = self.probed = 0
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []
        for column in self.vectors.T:
            for impact in (column, -column):
                places = np.flatnonzero(impact > 0)
                places = places[np.argsort(-impact[places], kind="stable")]
                self.lists.append((places, impact[places]))

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors but the query's own, ties to the smaller id."""
        dims = np.flatnonzero(query)
        lists = [self.lists[2 * d + (query[d] < 0)] for d in dims]
        weight = np.abs(query[dims])
        bound = np.array([w * impact[0] if len(impact) else w * 0 for w, (_, impact) in zip(weight, lists)], query.dtype)
        order = np.argsort(-bound, kind="stable")
        dims, weight, bound, lists = dims[order], weight[order], bound[order], [lists[i] for i in order]
        # rest[i]: the most that terms from place i on can add.
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0)
        other = self.ids != own
        firsts = [places[:BLOCK_POSTINGS] for places, _ in lists[:FIRST_TERMS]]
        ids, scores = self._first(np.unique(np.concatenate([*firsts, np.zeros(0, np.int64)])).astype(np.int64), other, query, k)
        if len(scores) < k or scores[-1] <= 0:
            # A vector without any of the terms could be among the best.
            return self._first(np.arange(len(self.ids)), other, query, k)
        least = scores[-1]
        # Non-essential: terms that together cannot lift a vector to the least score kept.
        essential = int(np.argmax(rest < least))
        reached = np.zeros(len(self.ids), self.vectors.dtype)
        met, possible = np.zeros(len(self.ids), bool), other.copy()
        for i in range(essential):
            places, impact = lists[i]
            # Below this impact even the bounds of all other terms do not lift a vector to the least score.
            needed = least - (rest[0] - bound[i])
            blocks = int(np.searchsorted(-(weight[i] * impact[::BLOCK_POSTINGS]), -needed, side="right"))
            stop = min(len(places), blocks * BLOCK_POSTINGS)
            self.read += stop
            places = places[:stop]
            reached[places] += weight[i] * impact[:stop]
            met[places] = True
            if needed > 0:
                in_list = np.zeros(len(self.ids), bool)
                in_list[places] = True
                possible &= in_list
        left = np.flatnonzero(met & possible)
        left = left[reached[left] + rest[essential] >= least]
        self.probed += len(left)
        sums = reached[left]
        for place in [*range(0, essential, PROBE_TERMS)]:
            at = slice(place, min(essential, place + PROBE_TERMS))
            # What lies on the other side of an essential term.
            sums = sums + np.minimum(self.vectors[np.ix_(left, dims[at])] * query[dims[at]], 0).sum(axis=1)
            left, sums = self._competitive(left, sums, rest[essential], least)
        for place in range(essential, len(dims), PROBE_TERMS):
            at = slice(place, place + PROBE_TERMS)
            sums = sums + self.vectors[np.ix_(left, dims[at])] @ query[dims[at]]
            left, sums = self._competitive(left, sums, rest[min(len(dims), place + PROBE_TERMS)], least)
        return self._cut(self.ids[left], sums, k)

    @staticmethod
    def _competitive(left: np.ndarray, sums: np.ndarray, rest, least) -> tuple[np.ndarray, np.ndarray]:
        keep = sums + rest >= least
        return left[keep], sums[keep]

    def _first(self, places: np.ndarray, other: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of some vectors, by exact scores."""
        places = places[other[places]]
        self.probed += len(places)
        return self._cut(self.ids[places], self.vectors[places] @ query, k)

    @staticmethod
    def _cut(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.lexsort((ids, -scores))[:k]
        return ids[first], scores[first]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of highest integer inner product for each query.

    Both tables have ``vec_id`` and integer ``vector``, and other columns are not
    looked at; null ids and vectors take
    no part, a row repeated with the same id and vector counts once, and a row
    with the query's id is not its candidate. Shorter vectors end in zeros. Rows
    are dealt to shards and queries to blocks by a hash; each pair of a shard and
    a block is one bounded group, and only k rows of it leave the task. The
    shards' lists are merged by a window over those.
    """
    rows, queries = (
        stored(
            x.select(F.col("vec_id").cast("bigint").alias("vec_id"), "vector")
            .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
            .distinct()
        )
        for x in (rows, queries)
    )
    n, m = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // QUERY_ROWS))

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        place = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)).cast("int")
        return df.select("vec_id", "vector", place.alias(own)).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            width = max(max(map(len, left["vector"])), max(map(len, right["vector"])))
            q, v = _matrix(left["vector"], width), _matrix(right["vector"], width)
            if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, width) * 4 >= _EXACT:
                q, v = (np.array([[int(x) for x in r] + [0] * (width - len(r)) for r in s], dtype=object) for s in (left["vector"], right["vector"]))
            shard = Shard(right["vec_id"].to_numpy(), v)
            for own, query in zip(left["vec_id"], q):
                ids, scores = shard.best(own, query, k)
                out += [(own, int(i), int(s)) for i, s in zip(ids, scores)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = (
        dealt(queries, "block", blocks, "shard", shards)
        .groupBy("block", "shard")
        .cogroup(dealt(rows, "shard", shards, "block", blocks).groupBy("block", "shard"))
        .applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    )
    # A row found twice (one id with several vectors) counts with each of its scores.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
