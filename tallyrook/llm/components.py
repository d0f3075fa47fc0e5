"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, written

#: Links that one task joins by itself before the steps over all links begin.
PART = 500_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars around the smallest nodes that these reach."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        at = x
        while (up := root.get(at, at)) != at:
            at = up
        while (up := root.get(x, x)) != at:
            root[x] = at
            x = up
        return at

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(u), find(v)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = list(root)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], names=["u", "v"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each end of a link the smallest node that links reach.

    Parts of the links, of at most about PART each, are joined first; then large-star and
    small-star steps follow in turn, each written to the shared folder: every step keeps a
    table of at most as many links as nodes and links before it, so that a node with very
    many links never becomes many pairs. Null ends, links of a node to itself and repeated
    links are left out; without links the result is empty.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    edges = written(edges, "links")
    parts = -(-edges.count() // PART)
    if parts:
        edges = written(edges.repartition(parts).mapInArrow(lean(_stars), "u long, v long").distinct(), "links")
    sign = _signature(edges)
    while sign[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _signature(edges)
        if now == sign:
            break
        sign = now
    # the last table is a star around each component's smallest node
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
