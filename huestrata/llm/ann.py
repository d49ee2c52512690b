"""Nearest neighbours by NN-descent: a neighbour graph from neighbours of neighbours, searched greedily."""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from huestrata.llm.common import stored
from huestrata.sources.shared import broadcast_if_small

#: Neighbours of a node, and reverse neighbours that take part in a round.
NEIGHBOURS, REVERSE = 20, 16

#: Candidates that a node passes on to each of its reverse neighbours.
PASSED = 6

#: Projection trees that give the first lists, nodes of a leaf, neighbours taken from one leaf.
TREES, LEAF, FROM_LEAF = 6, 1024, 10

#: The share of list places that must change for another round. Rounds are bounded by twice the binary digits of the
#: number of nodes.
LEAST_CHANGE = 0.01

#: Further planes that a leaf of more than ``2 * LEAF`` nodes is split by, through the middle of its nodes.
MORE_PLANES = 24

#: Nodes a query keeps during the search, entry nodes it takes from each tree, hops at most.
BEAM, ENTRIES, HOPS = 256, 12, 40

#: Differences of components that are held at once.
DIFFERENCES = 1 << 16

SEED = 20


def usable(vector: Column) -> Column:
    """True unless a vector is null, empty, zero or holds a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


@dataclass
class Index:
    """``nodes``: one row for each distinct vector. ``graph``: its neighbours. ``kind``: the number type of codes."""

    nodes: DataFrame
    graph: DataFrame
    planes: np.ndarray
    width: int
    kind: str


def _code(vectors: np.ndarray, kind: str) -> list[bytes]:
    return [v.tobytes() for v in vectors.astype(kind)]


def _vectors(codes: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), kind).reshape(len(codes), width).astype(float)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances, by differences: squares less products would cancel where vectors are close."""
    out = np.empty((len(a), len(b)))
    step = max(1, DIFFERENCES // max(1, b.size))
    for i in range(0, len(a), step):
        far = a[i : i + step, None] - b[None]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", far, far))
    return out


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : min(width, len(v))] = v[:width]
    return out


def _coded(df: DataFrame, planes: np.ndarray, width: int, kind: str) -> DataFrame:
    """``df`` with ``code`` and the leaf of every tree; columns ``id`` and ``vector`` are needed."""
    trees, depth = planes.shape[:2]

    @F.pandas_udf("code binary, leaves array<bigint>")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        powers = 1 << np.arange(depth)
        for batch in batches:
            own = _matrix(batch.tolist(), width)
            sides = np.einsum("tdw,nw->ntd", planes, own) > 0 if depth else np.zeros((len(own), trees, 0), bool)
            yield pd.DataFrame({"code": _code(own, kind), "leaves": list((sides @ powers).astype(np.int64))})

    return df.withColumn("_c", coded("vector")).withColumns({"code": F.col("_c.code"), "leaves": F.col("_c.leaves")}).drop("_c")


def _leaf_lists(nodes: DataFrame, width: int, kind: str) -> DataFrame:
    """First candidates: the nearest nodes within each leaf.

    A leaf that is too full, such as one of near copies, is split by further
    planes through the middle of its nodes, as many as its size asks for. What
    planes cannot part is split by a hash.
    """
    spots = nodes.select("node", "code", F.posexplode("leaves").alias("tree", "leaf"))
    planes = np.random.default_rng(SEED + 1).standard_normal((MORE_PLANES, width))

    @F.pandas_udf("array<double>")
    def along(codes: pd.Series) -> pd.Series:
        return pd.Series(list(_vectors(pa.array(codes, pa.binary()), width, kind).astype(float) @ planes.T))

    times = F.count("*") / F.lit(2.0 * LEAF)
    sizes = spots.groupBy("tree", "leaf").agg(F.ceil(F.log2(F.greatest(times, F.lit(1.0)))).cast("int").alias("splits"))
    sized = spots.join(sizes, ["tree", "leaf"])
    crowded = stored(sized.filter("splits > 0").withColumn("along", along("code")))
    middles = crowded.groupBy("tree", "leaf").agg(
        F.array(*[F.avg(F.col("along")[i]) for i in range(MORE_PLANES)]).alias("middle")
    )
    # Each tree begins with other planes.
    first = F.col("tree") * 4 % MORE_PLANES
    turned = F.zip_with("along", "middle", lambda x, m: F.when(x > m, "1").otherwise("0"))
    sides = F.slice(F.concat(turned, turned), first + 1, F.least(F.col("splits"), F.lit(MORE_PLANES)))
    parted = crowded.join(middles, ["tree", "leaf"]).withColumn("side", F.array_join(sides, ""))
    columns = ["tree", "leaf", "side", "node", "code"]
    cells = sized.filter("splits = 0").withColumn("side", F.lit("")).select(*columns).unionByName(parted.select(*columns))
    parts = cells.groupBy("tree", "leaf", "side").agg(F.ceil(F.count("*") / F.lit(2.0 * LEAF)).cast("int").alias("parts"))
    placed = cells.join(parts, ["tree", "leaf", "side"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        own, n = group["node"].to_numpy(), len(group)
        k = min(FROM_LEAF, n - 1)
        if k < 1:
            return pd.DataFrame({"node": [], "id": [], "d": []})
        vectors = _vectors(pa.array(group["code"], pa.binary()), width, kind)
        d = _distances(vectors, vectors)
        np.fill_diagonal(d, np.inf)
        best = np.argpartition(d, k - 1, axis=1)[:, :k]
        return pd.DataFrame({"node": np.repeat(own, k), "id": own[best].ravel(), "d": np.take_along_axis(d, best, 1).ravel()})

    return placed.groupBy("tree", "leaf", "side", "part").applyInPandas(nearest, "node bigint, id bigint, d double")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a list column."""
    return column.offsets.to_numpy() - column.offsets[0].as_py(), column.flatten()


_LISTS = "node bigint, ids array<bigint>, ds array<double>, fresh array<boolean>"


def _merged(lists: DataFrame, found: DataFrame, keep: int) -> DataFrame:
    """``lists`` with the ``keep`` nearest of the old and the found neighbours; ``fresh`` marks the found.

    A node is found by a bounded number of others, so its list of candidates is short.
    """
    own = found.groupBy("node").agg(F.collect_list(F.struct("id", "d")).alias("f"))
    both = lists.join(own, "node", "left").select(
        *lists.columns,
        F.coalesce("f.id", F.array().cast("array<bigint>")).alias("f_ids"),
        F.coalesce("f.d", F.array().cast("array<double>")).alias("f_ds"),
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids = _flat(batch["ids"])
            f_at, f_ids = _flat(batch["f_ids"])
            ids, f_ids = ids.to_numpy(), f_ids.to_numpy()
            ds, f_ds = _flat(batch["ds"])[1].to_numpy(), _flat(batch["f_ds"])[1].to_numpy()
            out: list[tuple] = []
            for i in range(batch.num_rows):
                old, new = slice(at[i], at[i + 1]), slice(f_at[i], f_at[i + 1])
                own = np.concatenate([ids[old], f_ids[new]])
                far = np.concatenate([ds[old], f_ds[new]])
                first = np.sort(np.unique(own, return_index=True)[1])
                first = first[np.lexsort((own[first], far[first]))][:keep]
                out.append((own[first], far[first], first >= len(ids[old])))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["node"], pa.array(columns[0], pa.list_(pa.int64())),
                    pa.array(columns[1], pa.list_(pa.float64())), pa.array(columns[2], pa.list_(pa.bool_())),
                ],
                names=["node", "ids", "ds", "fresh"],
            )

    return both.mapInArrow(lambda batches: merge(b for b in batches if b.num_rows), _LISTS)


def _worst() -> Column:
    """The distance a new neighbour must fall below."""
    return F.when(F.size("ids") >= NEIGHBOURS, F.element_at("ds", -1)).otherwise(float("inf"))


def _messages(lists: DataFrame, most: int) -> DataFrame:
    """What each node tells its neighbours: itself and its farthest distance. The fresh go first.

    A node listens to ``most`` others at most; a popular one hears a random choice of them.
    """
    sent = lists.select(
        F.col("node").alias("id"), _worst().alias("worst"), F.explode(F.arrays_zip("ids", "ds", "fresh")).alias("e")
    ).select(F.col("e.ids").alias("node"), F.col("e.ds").alias("d"), F.col("e.fresh").alias("fresh"), "id", "worst")
    order = Window.partitionBy("node").orderBy(F.desc("fresh"), F.xxhash64("id", "node"))
    return sent.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")


#: What a node compares: those who list it, its own list, itself.
_HEARD, _LISTED, _SELF = 0, 1, 2


def _by_node(batches: Iterator[pa.RecordBatch], width: int, kind: str) -> Iterator[tuple]:
    """Node, ids, roles, fresh, worst and vectors of every node; its rows come one after the other."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch[c].to_numpy(zero_copy_only=False) for c in ("node", "id", "role", "fresh", "worst")]
        own.append(_vectors(batch["code"], width, kind))
        if held is not None:
            own = [np.concatenate(x) for x in zip(held, own)]
        edge = [0, *(np.flatnonzero(own[0][1:] != own[0][:-1]) + 1)]
        for start, end in zip(edge, edge[1:]):
            yield own[0][start], *(x[start:end] for x in own[1:])
        held = [x[edge[-1] :] for x in own]
    if held is not None:
        yield held[0][0], *held[1:]


def _round(lists: DataFrame, nodes: DataFrame, width: int, kind: str) -> DataFrame:
    """Neighbours of neighbours: every node compares those who list it with its own list, and passes on what is near.

    Lists hold ids; the vectors come from ``nodes`` by a join on the id.
    """
    heard = _messages(lists, REVERSE).select("node", "id", F.lit(_HEARD).alias("role"), "fresh", "worst")
    listed = lists.select("node", F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select(
        "node", F.col("e.ids").alias("id"), F.lit(_LISTED).alias("role"), F.col("e.fresh").alias("fresh"),
        F.lit(None).cast("double").alias("worst"),
    )
    itself = lists.select("node", F.col("node").alias("id"), F.lit(_SELF).alias("role"), F.lit(True).alias("fresh"), _worst().alias("worst"))
    # Nothing is new to a node that neither has nor hears a fresh neighbour.
    busy = heard.unionByName(listed).filter("fresh").select("node").distinct()
    edges = heard.unionByName(listed).unionByName(itself).join(busy, "node", "left_semi")
    vectors = nodes.select(F.col("node").alias("id"), "code")
    rows = edges.join(vectors, "id").repartition("node").sortWithinPartitions("node", "role", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])

        def found() -> pa.RecordBatch:
            arrays = [pa.array(np.concatenate(x), t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))]
            for x in out:
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["node", "id", "d"])

        for _, ids, role, fresh, worst, vectors in _by_node(batches, width, kind):
            n = int((role == _HEARD).sum())
            asking = np.append(np.arange(n), len(ids) - 1)
            a_ids, b_ids = ids[asking], ids[:-1]
            if not len(b_ids):
                continue
            d = _distances(vectors[asking], vectors[:-1])
            d[~(fresh[asking][:, None] | fresh[None, :-1])] = np.inf
            d[a_ids[:, None] == b_ids[None]] = np.inf
            d[-1, n:] = np.inf  # its own list is known to the node
            k = min(PASSED, d.shape[1])
            best = np.argpartition(d, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(d, best, 1)
            a, place = np.nonzero(near < worst[asking][:, None])
            out[0].append(a_ids[a])
            out[1].append(b_ids[best[a, place]])
            out[2].append(near[a, place])
            if len(out[0]) >= 1000:
                yield found()
        if out[0]:
            yield found()

    return rows.mapInArrow(compare, "node bigint, id bigint, d double")


def _forget(spark: SparkSession) -> None:
    """Shuffle files of finished steps go only when the driver's JVM finds that nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def build(rows: DataFrame, *, members: int) -> Index:
    """Index of every usable row of ``vec_id, vector``.

    Equal vectors are one node, named by their smallest id, with their
    ``members`` smallest ids: a large group of copies is a single node. The
    first lists come from the leaves of random projection trees, then rounds of
    NN-descent replace them until few places of the lists change. Each round is a few joins on the node; lists,
    messages and leaves have a fixed length, whatever the data. Lists are ordered
    by exact distances of the given numbers, so vectors may lie as close as
    their type can tell. Shorter vectors end in zeros. Intermediate tables lie in
    the shared folder.
    """
    given = rows.schema["vector"].dataType
    kind = "<f4" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "<f8"
    valid = (
        rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
        .filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
        .distinct()
    )
    order = Window.partitionBy("vector").orderBy("vec_id")
    classes = (
        valid.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= members)
        .groupBy("vector")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
        .select(F.col("members")[0].alias("node"), "vector", "members")
    )
    # One id with several vectors names several nodes; the later ones are told apart by a hash.
    several = Window.partitionBy("node").orderBy("vector")
    classes = stored(
        classes.withColumn("nth", F.row_number().over(several)).select(
            F.when(F.col("nth") == 1, F.col("node")).otherwise(F.xxhash64("node", "nth", "vector")).alias("node"),
            "vector",
            "members",
        )
    )
    n, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    depth = max(0, math.ceil(math.log2(max(1, n) / LEAF)))
    planes = np.random.default_rng(SEED).standard_normal((TREES, depth, width))
    nodes = stored(_coded(classes, planes, width, kind))
    empty = nodes.select(
        "node", F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<double>").alias("ds"),
        F.array().cast("array<boolean>").alias("fresh"),
    )
    lists = stored(_merged(empty, _leaf_lists(nodes, width, kind), NEIGHBOURS))
    for _ in range(2 * max(1, n).bit_length()):
        lists = stored(_merged(lists, _round(lists, nodes, width, kind), NEIGHBOURS))
        _forget(rows.sparkSession)
        changed = lists.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] or 0
        if changed < LEAST_CHANGE * NEIGHBOURS * n:
            break
    back = _messages(lists, NEIGHBOURS).select("node", "id", "d")
    graph = stored(_merged(lists, back, 2 * NEIGHBOURS).select("node", "ids"))
    return Index(nodes, graph, planes, width, kind)


def search(index: Index, queries: DataFrame, k: int, *, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found, none of them the query's own.

    Greedy search for all queries at once. A query starts from some nodes of its
    leaf in every tree and from the node of its own vector, if there is one.
    Each hop expands all nodes of its beam that are not expanded yet, by a join
    with the graph, and keeps the nearest ``beam`` nodes; it ends when nothing
    new comes near. The beam, the scores and the order go by exact Euclidean
    distances of the original vectors, ties to the smaller id. Queries
    that are not usable, or have a null id, take no part.
    """
    width = index.width
    valid = (
        queries.select(F.col("vec_id").cast("bigint").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
        .filter(F.col("query_id").isNotNull() & usable(F.col("vector")))
        .distinct()
    )
    # Queries of equal vectors are searched once.
    asked = _coded(valid.groupBy("vector").agg(F.min("query_id").alias("q")), index.planes, width, "<f8")
    asked = stored(asked.select("q", "vector", F.col("code").alias("q_code"), "leaves"))

    leaf = index.nodes.select("node", F.posexplode("leaves").alias("tree", "leaf"))
    order = Window.partitionBy("tree", "leaf").orderBy(F.xxhash64("node"))
    entries = leaf.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= ENTRIES)
    starts = asked.select("q", F.posexplode("leaves").alias("tree", "leaf")).join(
        entries.select("tree", "leaf", "node"), ["tree", "leaf"]
    )
    same = asked.join(index.nodes.select("vector", "node"), "vector").select("q", "node")

    parts = max(1, int(index.graph.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    graph = index.graph.repartition(parts, "node").persist(StorageLevel.MEMORY_AND_DISK)
    vectors = index.nodes.select("node", "code").repartition(parts, "node").persist(StorageLevel.MEMORY_AND_DISK)

    kind = index.kind
    # Where they are few the query vectors go to all tasks once, and only pairs of ids are dealt in a hop.
    q_codes = broadcast_if_small(asked.select("q", "q_code"))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _vectors(batch["q_code"], width, "<f8"), _vectors(batch["code"], width, kind)
                d = np.sqrt(((a - b) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch["q"], batch["node"], pa.array(d, pa.float64())], names=["q", "node", "d"])

    def measured(pairs: DataFrame) -> DataFrame:
        """``q, node`` with their distance and ``done`` false."""
        both = pairs.distinct().join(vectors, "node").join(q_codes, "q").select("q", "node", "q_code", "code")
        return both.mapInArrow(far, "q bigint, node bigint, d double").withColumn("done", F.lit(False))

    def kept(found: DataFrame) -> DataFrame:
        each = found.groupBy("q", "node").agg(F.min("d").alias("d"), F.max("done").alias("done"))
        near = Window.partitionBy("q").orderBy("d", "node")
        return stored(each.withColumn("place", F.row_number().over(near)).filter(F.col("place") <= beam))

    state = kept(measured(starts.select("q", "node").unionByName(same)))
    for _ in range(HOPS):
        if state.filter(~F.col("done")).isEmpty():
            break
        reached = state.filter(~F.col("done")).select("q", "node").join(graph, "node").select("q", F.explode("ids").alias("node"))
        found = measured(reached.join(state.select("q", "node"), ["q", "node"], "left_anti"))
        state = kept(state.select("q", "node", "d").withColumn("done", F.lit(True)).unionByName(found))
    graph.unpersist()
    vectors.unpersist()

    pairs = (
        state.select("q", "node")
        .join(asked.select("q", F.col("vector").alias("q_vector")), "q")
        .join(index.nodes.select("node", "vector", "members"), "node")
    )

    @F.pandas_udf("double")
    def exact(left: pd.Series, right: pd.Series) -> pd.Series:
        own = max(max(map(len, left), default=1), max(map(len, right), default=1))
        return pd.Series(np.sqrt(((_matrix(left.tolist(), own) - _matrix(right.tolist(), own)) ** 2).sum(axis=1)))

    scored = pairs.select("q", "members", exact("q_vector", "vector").alias("score"))
    nearest = Window.partitionBy("q").orderBy("score", F.col("members")[0])
    # k + 1 nodes hold k rows besides the query's own.
    few = scored.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= k + 1)
    named = valid.join(asked.select("q", "vector"), "vector").select("query_id", "q")
    rows = (
        few.join(named, "q")
        .select("query_id", "score", F.explode("members").alias("vec_id"))
        .filter("vec_id != query_id")
    )
    last = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
