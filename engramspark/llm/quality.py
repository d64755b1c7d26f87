"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The statistics of each whole text are computed once and written (a narrow row a document).  The features
approximate a Gaussian kernel on them; each partition sums its part of the normal equations, whose size
depends on the number of features alone.  Scores are calibrated to probabilities by isotonic regression on
ridge scores of rows that the ridge did not see: training rows fall into two halves by a hash of their
statistics, and each half is scored by a ridge fitted on the other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, lean, map_texts, materialize, read_documents
from .training import isotonic, partition_sum, with_labels

DIVISOR, REMAINDER, THRESHOLD = 4, 2, 0.7
FEATURES, RIDGE, BINS, SEED = 300, 1e-3, 512, 20240501

STATISTICS = (
    "log_words", "word_length", "word_length_spread", "upper", "digits", "stops", "commas", "exclamations", "symbols", "pipes", "other_marks",
    "not_ascii", "spaces", "line_ends", "same_lines", "distinct_words", "top_word", "distinct_pairs", "same_windows", "byte_entropy", "compressed", "marked_words",
)

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "stops": b".", "commas": b",;:", "exclamations": b"!?", "symbols": b"#*$%&~^+=@_\\",
    "pipes": b"|<>{}[]", "other_marks": b"\"'()/`-", "not_ascii": bytes(range(0xC0, 0x100)), "spaces": b" \t", "line_ends": b"\n",
}
_MASKS = np.zeros((len(_CLASSES), 256))
for _k, _bytes in enumerate(_CLASSES.values()):
    _MASKS[_k, list(_bytes)] = 1


def statistics(text: bytes) -> np.ndarray:
    """The STATISTICS of one text; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(len(STATISTICS))
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = histogram / len(text)
    seen = share[share > 0]
    lengths = np.fromiter(map(len, words), float, n)
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    counts = np.unique(h, return_counts=True)[1]
    pairs = len(np.unique(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])) / (n - 1) if n > 1 else 1.0
    m = n - 4
    if m > 1:
        key = h[:m].copy()
        for j in range(1, 5):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[j : m + j]
        windows = 1 - len(np.unique(key)) / m
    else:
        windows = 0.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    last = np.fromiter((w[-1] for w in words), np.uint8, n)
    marked = ~((last >= 97) & (last <= 122) | (last >= 65) & (last <= 90) | (last >= 0x80) | (last == 46) | (last == 44))
    x = [np.log1p(n), np.log1p(lengths.mean()), np.log1p(lengths.std()), *np.sqrt(_MASKS @ share), np.sqrt(1 - len(set(lines)) / len(lines)), np.log(len(counts) / n) / np.log1p(n), np.sqrt(counts.max() / n), pairs, np.sqrt(windows), float(-(seen * np.log2(seen)).sum()), len(zlib.compress(text, 1)) / len(text), np.sqrt(marked.mean())]
    return np.array(x, float)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.c_[np.ones(len(x)), np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, len(STATISTICS))


def halves(column: pa.Array) -> np.ndarray:
    """0 or 1 for each row, by its statistics, so that equal texts are in one half."""
    return np.fromiter((zlib.crc32(x) & 1 for x in column.to_pylist()), np.int64, len(column))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and statistics (packed doubles) of each row, materialised."""

    def rows(ids: list, texts: list[bytes]) -> dict:
        return {"doc_id": ids, "stats": [statistics(x).tobytes() for x in texts]}

    return materialize(map_texts(docs, id_col, text_col, rows, "doc_id long, stats binary"), "quality-stats")


def train(rows: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Fit on rows (stats, y); without any row the scores are all 0.5, with one class near that class."""
    d = len(STATISTICS)
    rows = materialize(rows.select("stats", F.col("y").cast("double").alias("y")), "quality-train")

    def moments(batches) -> np.ndarray:
        out = np.zeros((2, d + 1))
        for b in batches:
            x = _matrix(b.column(0))
            out += np.c_[[x.sum(0), (x * x).sum(0)], [len(x), b.column(1).to_numpy().sum()]]
        return out

    s = partition_sum(rows, (2, d + 1), moments)
    n, positive = s[0, d], s[1, d]
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(d, features)) / np.sqrt(2.0 * d), rng.uniform(0, 2 * np.pi, features)
    prior = (positive + 1) / (n + 2)
    if not 0 < positive < n:
        return Model(np.zeros(d), np.ones(d), w, b, np.zeros(features + 1), (np.array([0.0]), np.array([prior])))
    mean = s[0, :d] / n
    scale = np.sqrt(np.maximum(s[1, :d] / n - mean**2, 1e-8))
    model = Model(mean, scale, w, b, np.zeros(features + 1), (np.array([0.0]), np.array([prior])))
    m = features + 1

    def normal(batches) -> np.ndarray:
        out = np.zeros((2, m, m + 1))
        for batch in batches:
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy()
            z = model.features(x)
            # Classes weigh the same, so that the rarer one shapes the scores too.
            weight = np.where(y > 0, 0.5 * n / positive, 0.5 * n / (n - positive))[:, None]
            half = halves(batch.column(0))
            for k in (0, 1):
                own = half == k
                out[k] += z[own].T @ (weight[own] * np.c_[z[own], y[own]])
        return out

    def solved(a: np.ndarray, share: float) -> np.ndarray:
        return np.linalg.solve(a[:, :m] + ridge * n * share * np.diag(np.r_[1e-9, np.full(features, 1 / features)]), a[:, m])

    a = partition_sum(rows, (2, m, m + 1), normal)
    model.beta = solved(a[0] + a[1], 1.0)
    others = [solved(a[1], 0.5), solved(a[0], 0.5)]  # for rows of the first half, of the second

    def binned(batches) -> np.ndarray:
        out = np.zeros((BINS, 3))
        for batch in batches:
            z, y, half = model.features(_matrix(batch.column(0))), batch.column(1).to_numpy(), halves(batch.column(0))
            r = np.where(half == 0, z @ others[0], z @ others[1])
            k = np.clip(((r + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            for j, v in enumerate((np.ones(len(r)), r, y)):
                out[:, j] += np.bincount(k, v, BINS)
        return out

    c = partition_sum(rows, (BINS, 3), binned)
    c = c[c[:, 0] > 0]
    model.knots = isotonic(c[:, 1] / c[:, 0], c[:, 2] / c[:, 0], c[:, 0])
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    Rows with crc32(id as text) mod 4 = 2 are held out of the training.  Null text counts as empty; texts
    without words share one score.  Repeated rows get equal scores; a null id is held in or out as the empty
    text; an empty table gives an empty result.  Only id, text and the label are read.
    """
    stats = measure(docs, id_col, text_col)
    model = train(with_labels(stats.filter(~held_out(F.col("doc_id"), DIVISOR, REMAINDER)), labels, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score = model.score(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.withColumn("held_out", held_out(F.col("doc_id"), DIVISOR, REMAINDER)).mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
