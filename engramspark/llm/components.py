"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize


def _local(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars of its own components: fewer edges, same components overall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def flush() -> pa.RecordBatch:
            rows = [(x, r) for x in parent if (r := root(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["u", "v"])

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p, q = root(x), root(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
            if len(parent) > 1_000_000:
                yield flush()
        if parent:
            yield flush()

    return edges.mapInArrow(lean(run), "u long, v long")


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component (its smallest node) of every node of ``edges`` (u, v).

    A node with very many edges is aggregated partially and its join is split by adaptive execution, so no
    task holds all its edges.  Each round is written, so a lost executor costs one round at most.
    """
    edges = materialize(_local(edges.select("u", "v").filter("u <> v")), "edges")
    before = None
    for _ in range(rounds):
        # Large star: every larger neighbour goes to the smallest of the neighbourhood.
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = materialize(small, "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def unpacked(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """A column of equally long binaries as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)
