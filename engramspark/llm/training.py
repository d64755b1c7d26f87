"""Parts of models trained over partitions: sums of arrays, labelled rows, isotonic fit."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Labels up to this many rows are broadcast to the documents; beyond it both sides are shuffled.
BROADCAST_ROWS = 2_000_000


def partition_sum(df: DataFrame, shape: tuple[int, ...], of: Callable[[Iterable[pa.RecordBatch]], np.ndarray], fan_in: int = 16) -> np.ndarray:
    """The sum over partitions of ``of(batches)``, arrays of doubles of one fixed ``shape``.

    Summed level by level, ``fan_in`` to one, so that the driver gets at most ``fan_in`` arrays.
    """
    import zlib

    zero = np.zeros(shape)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.ascontiguousarray(of(b for b in batches if b.num_rows), float).reshape(shape)
        if x.any():
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], names=["part"])

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = zero.copy(), False
        for b in batches:
            for p in b.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(p)).reshape(shape)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part"])

    parts = df.rdd.getNumPartitions()
    out = df.mapInArrow(lean(first), "part binary")
    while parts > fan_in:
        parts = -(-parts // fan_in)
        out = out.repartition(parts).mapInArrow(lean(more), "part binary")
    total = zero.copy()
    for row in out.collect():
        total += np.frombuffer(zlib.decompress(row.part)).reshape(shape)
    return total


def with_labels(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that have a label, with it as ``y`` (0 or 1); of several labels of one id the largest.

    Rows without id or label are not used.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label) > 0).cast("int").alias("y"))
    known = known.withColumnRenamed("doc_id", "label_id")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return docs.join(known, F.col(f"`{id_col}`") == F.col("label_id")).drop("label_id")


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots (x, non-decreasing y) of points with weights."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # weight, mean, sum of weighted x
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        blocks.append([c, b, c * a])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            c1, b1, s1 = blocks.pop()
            c0, b0, s0 = blocks[-1]
            blocks[-1] = [c0 + c1, (c0 * b0 + c1 * b1) / (c0 + c1), s0 + s1]
    return np.array([s / c for c, _, s in blocks]), np.array([b for _, b, _ in blocks])
