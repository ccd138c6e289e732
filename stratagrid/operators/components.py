"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.staging import discard, stage


def components(edges: DataFrame, most_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """``id, component`` (the least id reachable) for every id in ``edges(a, b)``.

    Alternates two steps until the edges stay as they are: every larger neighbour of a node is tied
    to the least of its neighbourhood, then every smaller one. Each step is a minimum by key, which
    combines before the shuffle, and a join; neighbour lists are never gathered. It is an error if ``most_rounds`` do not
    settle the edges. Each round costs the driver two plans; where no more than ``at_once`` edges are left (ids are longs then),
    one task settles these instead, with the same result.
    """
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _mark(now)
    for _ in range(most_rounds):
        if seen[0] <= at_once:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        tied = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b")))
        nxt = stage(tied.filter("a <> b").distinct(), "edges")
        mark = _mark(nxt)
        discard(now)
        now, done = nxt, mark == seen
        seen = mark
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    if 0 < seen[0] <= at_once:
        return now.coalesce(1).mapInArrow(_settle, "id long, component long")
    ends = now.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionByName(now.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component")))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, component`` of all the edges of a task."""
    held = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    if held:
        ends = np.concatenate([a for a, _ in held] + [b for _, b in held])
        ids, at = np.unique(ends, return_inverse=True)
        yield pa.record_batch([pa.array(ids), pa.array(ids[_roots(at[: len(at) // 2], at[len(at) // 2 :], len(ids))])], names=["id", "component"])


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches: of two roots that an edge joins the greater is hung under its least neighbour."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def _mark(edges: DataFrame) -> tuple[int, int, int]:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 1))")).first()
    return row[0], row[1] or 0, row[2] or 0
