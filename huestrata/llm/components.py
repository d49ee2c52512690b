"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huestrata.llm.common import stored


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node of a link; the root is the smallest node that can be reached.

    Rounds of two steps: a node's larger neighbours are linked to its smallest
    neighbour, then its smaller ones are. Each step is a grouped minimum and a
    join, so a node with very many links is pre-aggregated and never collected.
    The links of a round are written to the shared folder. Links with a null end
    and links of a node with itself say nothing and are left out.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    ends = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    edges = stored(links.filter(ends).select(high.alias("u"), low.alias("v")).distinct())
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(smallest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(hashed), F.sum(hashed % 1_000_003)).first())
