"""Connected components of an edge table, by alternating large and small stars.

Every step is a pre-aggregated minimum and a join of two written tables, so a node with any number of
edges is split like any skewed join; labels and edges never leave the executors. A graph of at most SMALL edges, to
begin with or after some steps, is closed by one task, by union and find.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


SMALL = 1 << 16


def least_of(edges: Iterator[tuple]) -> dict:
    """The least node of each node's component."""
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _closed(edges: DataFrame) -> DataFrame:
    """(node, comp) of a small graph, by one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = least_of(e for b in batches for e in zip(b.column("a").to_pylist(), b.column("b").to_pylist()))
        of = {"binary": pa.binary(), "bigint": pa.int64()}[kind]
        yield pa.record_batch([pa.array(list(x), of) for x in (found.keys(), found.values())], names=["node", "comp"])

    return edges.select("a", "b").repartition(1).mapInArrow(close, f"node {kind}, comp {kind}")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (a, b) with a > b, each pair once. Large: a node's larger neighbours move to its least
    neighbour or itself; small: a node and its smaller neighbours move to the least of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        moved = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = settle(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = settle(moved.distinct(), "star")
    discard(least, edges)
    return out


def _facts(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b), written; comp is the component's least node."""
    turned = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = settle(turned, "edges")
    if stars.count() <= SMALL:
        out = settle(_closed(stars), "components")
        discard(stars)
        return out
    before = _facts(stars)
    while True:
        stars = _star(_star(stars, large=True), large=False)
        after = _facts(stars)
        if after == before:
            break
        before = after
    out = settle(stars.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()), "components")
    discard(stars)
    return out


def merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``labels`` (node, comp) after more ``edges`` (a, b): only the graph of components is worked on. The
    labels given are gone afterwards."""
    if labels is None:
        return components(edges)
    named = edges
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_comp"))
        named = named.join(own, end, "left").withColumn(end, F.coalesce(f"{end}_comp", end)).drop(f"{end}_comp")
    between = settle(named.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "between")
    if between.isEmpty():
        return labels
    graph = components(between)
    moved = graph.select(F.col("node").alias("old"), F.col("comp").alias("new"))
    known = labels.join(moved, F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp"))
    fresh = moved.join(labels, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("comp"))
    out = settle(known.unionByName(fresh), "labels")
    discard(labels, graph, between)
    return out
