"""SimHash near-duplicates: a grid over bit counts of segments finds what may be close."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huestrata.llm.common import stored, task_memory
from huestrata.llm.components import connected

#: Words of a shingle, seed of its hash, and bits by which linked fingerprints may differ.
SHINGLE, SEED, DISTANCE = 3, 42, 3

#: Segments of the embedding are two bits wide. Their counts are kept in unary (0, 1, 3), so that
#: the Manhattan distance of two embeddings is the number of bits in which they differ.
_LOW = 0x5555555555555555

#: Segments by slab; a cell of the grid fixes the counts in ``SLABS - DISTANCE`` slabs.
_SLABS = (5, 5, 5, 5, 6, 6)

#: Fingerprints of a cell that one task compares. Fuller cells are compared by pairs of blocks.
CELL = 20_000

#: Words whose hashes are held at once while a text is read.
WINDOW = 1 << 16


def fingerprint(text: str | None) -> int:
    """64 bits, signed: a bit is set if it is set in over half of the shingles' hashes.

    Words are what lies between ASCII white space after A-Z are lower-cased. A
    text with fewer words than a shingle is one shingle; without words it is 0.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    counts, total = np.zeros(64, dtype=np.int64), 0
    digest = xxhash.xxh64_intdigest
    for at in range(0, max(1, len(words) - SHINGLE + 1), WINDOW):
        part = words[at : at + WINDOW + SHINGLE - 1]
        if len(part) <= SHINGLE:
            hashes = [digest(b" ".join(part), SEED)]
        else:
            joined = map(b" ".join, zip(*(part[i:] for i in range(SHINGLE))))
            hashes = [digest(x, SEED) for x in joined]
        raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    bits = np.packbits(counts * 2 > total, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(text: str = "text"):
    """Column with the fingerprint of every whole text, as a signed 64-bit integer."""

    @F.pandas_udf("bigint")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with task_memory():
            for texts in batches:
                yield pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return found(F.col(text))


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit count of each two-bit segment, in unary."""
    low, high = fp & np.uint64(_LOW), (fp >> np.uint64(1)) & np.uint64(_LOW)
    return (low | high) | ((low & high) << np.uint64(1))


def _cells() -> list[int]:
    """Masks of the embedding: all choices of as many slabs as must be equal.

    Embeddings at a Manhattan distance of ``DISTANCE`` or less differ in no more
    slabs than that, so they agree in the rest: the cells of a point cover the
    whole range around it, and none is lost.
    """
    slabs, at = [], 0
    for width in _SLABS:
        slabs.append(((1 << 2 * width) - 1) << at)
        at += 2 * width
    return [sum(chosen) for chosen in combinations(slabs, len(slabs) - DISTANCE)]


def _spanning(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is connected within a cell: at most one for each fingerprint.

    The Manhattan distance is a lower bound; only what passes it is verified on
    the bits. Each step looks at the fingerprints not reached yet, so a cell full
    of near copies is done after a few steps instead of after all pairs.
    """
    at = embed(fp)
    left = np.arange(len(fp))
    ends, roots = [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            x = queue.pop()
            hit = np.bitwise_count(at[left] ^ at[x]) <= DISTANCE
            hit[hit] = np.bitwise_count(fp[left[hit]] ^ fp[x]) <= DISTANCE
            if hit.any():
                queue.extend(left[hit])
                ends.append(left[hit])
                roots.append(np.full(int(hit.sum()), root))
                left = left[~hit]
    if not ends:
        return fp[:0], fp[:0]
    return fp[np.concatenate(roots)], fp[np.concatenate(ends)]


def near_links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints at most ``DISTANCE`` bits apart.

    A grid range-join: every fingerprint goes to its cells, and a task walks
    through its cells in order, holding one at a time. Cells over ``CELL`` go on
    as they are; they are split into blocks, and all pairs of blocks are
    compared by as many tasks. Not every close pair is returned, but every two
    are connected by the links that are.
    """
    masks = _cells()
    value = F.col(fp).cast("bigint")
    low = value.bitwiseAND(F.lit(_LOW))
    high = F.shiftrightunsigned(value, 1).bitwiseAND(F.lit(_LOW))
    unary = low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    cells = F.array(*[F.struct(F.lit(i).alias("grid"), F.col("_e").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(signed)])
    keyed = (
        distinct.select(value.alias("fp"), unary.alias("_e"))
        .select("fp", F.inline(cells))
        .repartition("grid", "cell")
        .sortWithinPartitions("grid", "cell")
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a: np.ndarray, b: np.ndarray, key: tuple[int, int] | None = None) -> pa.RecordBatch:
            n = len(a)
            grid, cell = key or (None, None)
            return pa.RecordBatch.from_pydict(
                {
                    "a": pa.array(a.view(np.int64)),
                    "b": pa.array(b.view(np.int64)),
                    "grid": pa.array([grid] * n, pa.int32()),
                    "cell": pa.array([cell] * n, pa.int64()),
                }
            )

        key, held, size, full = None, [], 0, False
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> None:
            if not full and size > 1:
                a, b = _spanning(np.concatenate(held))
                if len(a):
                    found.append((a, b))

        for batch in batches:
            fps = batch["fp"].to_numpy().view(np.uint64)
            grids, places = batch["grid"].to_numpy(), batch["cell"].to_numpy()
            edge = np.flatnonzero((grids[1:] != grids[:-1]) | (places[1:] != places[:-1])) + 1
            for start, end in zip([0, *edge], [*edge, len(fps)]):
                if start == end:
                    continue
                own = (int(grids[start]), int(places[start]))
                if own != key:
                    close()
                    key, held, size, full = own, [], 0, False
                held.append(fps[start:end])
                size += end - start
                if size > CELL or full:  # passed on, not held
                    full = True
                    part = np.concatenate(held)
                    held = []
                    yield rows(part, part, key)
            if found:
                yield rows(*map(np.concatenate, zip(*found)))
                found = []
        close()
        if found:
            yield rows(*map(np.concatenate, zip(*found)))

    walked = stored(keyed.mapInArrow(walk, "a bigint, b bigint, grid int, cell bigint"))
    links = walked.filter("grid is null").select("a", "b")
    hot = walked.filter("grid is not null").select("grid", "cell", F.col("a").alias("fp"))
    blocks = hot.groupBy("grid", "cell").agg(F.ceil(F.count("*") / F.lit(CELL / 2)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    paired = (
        hot.join(blocks, ["grid", "cell"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("grid", "cell", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a, b = _spanning(group["fp"].to_numpy().view(np.uint64))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return links.unionByName(paired.groupBy("grid", "cell", "i", "j").applyInPandas(compare, "a bigint, b bigint"))


def components(rows: DataFrame) -> DataFrame:
    """``fp, root, component_id`` for every distinct fingerprint of ``doc_id, fp``.

    ``root`` tells components apart; ``component_id`` is the smallest id in one,
    null if all its ids are.
    """
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    roots = connected(near_links(distinct), "a", "b")
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "smallest", F.coalesce("root", "fp").alias("root")
    )
    names = classes.groupBy("root").agg(F.min("smallest").alias("component_id"))
    return classes.join(names, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row, repeats included.

    Copies are folded to one fingerprint before anything is compared, and only
    fingerprints travel, so a large group of copies costs one row for each task.
    The component is named by its smallest id; null ids name none. Null texts
    count as empty.
    """
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(text).alias("fp")))
    return rows.join(components(rows), "fp").select("doc_id", "fp", "component_id")
