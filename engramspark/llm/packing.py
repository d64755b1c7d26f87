"""Best-fit packing of token sequences, planned on the histogram of lengths.

The plan needs only how many pieces have each length, at most ``capacity`` numbers, so the driver's work
and all it sends out are bounded by the capacity, however many documents there are:

* Pieces above a third of the capacity fit at most twice in a bin.  Greedy matching: the longest left is
  paired with the longest left that still fits beside it; without one it opens a bin alone.
* Shorter pieces, longest first, go into the bin with the smallest gap that holds them; when no gap does,
  new bins are opened.

A plan entry covers a range of ranks of one length and a range of bins.  Each piece then finds its bin by
its rank among the pieces of its length.  Ranks are counted in salted groups, so that a length that a third
of all pieces share is not ranked in one task.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_types, lean, map_texts, materialize, read_documents

CAPACITY, END_ID, VOCABULARY = 4096, 1, "word_bpe_49k.json"


@cache
def _tokenizer(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(vocabulary) if "/" not in vocabulary else vocabulary)


def _byte_chars() -> list[str]:
    """Byte-level vocabularies write bytes as characters: printable Latin-1 as itself, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


_BYTE_CHARS = _byte_chars()


class Encoder(dict):
    """word -> its ids as little-endian bytes.

    The tokenizer drops white space and never merges over it, so a text's ids are those of its words in
    turn.  It lower-cases too; doing so first (A-Z only, and not where a text might spell a special token)
    and parting a full stop or comma from an ASCII letter or digit before it leaves fewer words to encode.
    Words are kept in two generations of ``most / 2`` each: when the young one is full it becomes the old.
    """

    def __init__(self, vocabulary: str = VOCABULARY, most: int = 400_000):
        super().__init__()
        self.vocabulary, self.most, self.old = vocabulary, most, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if len(word) > 1 and word[-1] in b".," and word[-2] in b"abcdefghijklmnopqrstuvwxyz0123456789":
                ids = self[word[:-1]] + self[word[-1:]]
            else:
                ids = array("I", self.split(word.decode("utf-8", "replace"))).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def split(self, word: str) -> list[int]:
        """Lower-case Latin letters alone are one unit for the merges; anything else takes the whole way."""
        tokenizer = _tokenizer(self.vocabulary)
        if word.isalpha() and word.islower() and max(word) < "\u0250":
            return [t.id for t in tokenizer.model.tokenize(word if word.isascii() else "".join(map(_BYTE_CHARS.__getitem__, word.encode())))]
        return tokenizer.encode(word, add_special_tokens=False).ids

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        for text in texts:
            if len(self) > self.most // 2:
                self.old = dict(self)
                self.clear()
            yield b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids, then END_ID, cut at ``capacity``."""
    end = np.array([END_ID], "<u4").tobytes()
    state: dict[str, Encoder] = {}

    def rows(ids: list, texts: list[bytes]) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for i, body in zip(ids, state.setdefault(vocabulary, Encoder(vocabulary)).encode(texts), strict=True):
            data = body + end
            n = len(data) // 4
            for k, start in enumerate(range(0, n, capacity)):
                part = data[4 * start : 4 * (start + capacity)]
                for name, x in zip(out, (i, k, start, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[name].append(x)
        return out

    return map_texts(docs, id_col, text_col, rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first bin, bins, offset) for ``counts`` of each length.

    The pieces of an entry fill its bins in turn, so many to each bin, side by side from the offset on;
    the last bin of an entry may get fewer only where nothing is put behind them.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be 1 to the capacity")
    used = dict.fromkeys(left, 0)
    entries: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first bin, bins)
    order: list[int] = []  # the gaps, ascending
    bins = 0

    def put(n: int, per: int, first: int, many: int, offset: int) -> None:
        entries.append((n, used[n], per, first, many, offset))
        used[n] += per * many
        left[n] -= per * many

    def keep(gap: int, first: int, many: int) -> None:
        if gap > 0 and many > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, many))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large.pop()
        while left[a]:
            k = bisect_left(large, capacity - a + 1) - 1
            b = a if 2 * a <= capacity and left[a] > 1 else large[k] if k >= 0 else None
            if b is None:
                many = left[a]
                put(a, 1, bins, many, 0)
                keep(capacity - a, bins, many)
            elif b == a:
                many = left[a] // 2
                put(a, 2, bins, many, 0)
                keep(capacity - 2 * a, bins, many)
            else:
                many = min(left[a], left[b])
                put(a, 1, bins, many, 0)
                put(b, 1, bins, many, a)
                keep(capacity - a - b, bins, many)
                if not left[b]:
                    large.pop(k)
            bins += many
    for n in sorted((n for n in left if left[n] > 0), reverse=True):
        while left[n]:
            k = bisect_left(order, n)
            if k == len(order):
                many = -(-left[n] // (capacity // n))
                keep(capacity, bins, many)
                bins += many
                continue
            gap = order[k]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(k)
            per = gap // n
            full = min(many, left[n] // per)
            if full:
                put(n, per, first, full, capacity - gap)
                keep(gap - per * n, first, full)
            if full < many and left[n]:
                rest = left[n]
                put(n, rest, first + full, 1, capacity - gap)
                keep(gap - rest * n, first + full, 1)
                full += 1
            keep(gap, first + full, many - full)
    return np.array(entries, np.int64).reshape(-1, 6)


def ranked(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0; any order, without gaps."""
    spark = rows.sparkSession
    most = min(100_000, max(64, sum(counts.values()) // 1000))
    parts = spark.createDataFrame([(n, -(-c // most)) for n, c in counts.items()], "length long, parts long")  # a row for each length: bounded by the capacity
    salted = rows.join(F.broadcast(parts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.col("parts"))).drop("parts")
    salted = materialize(salted, "packing-salted")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    return salted.withColumn("rank", F.row_number().over(own) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "salt")


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Ties (equal lengths, repeated rows) are ranked in any order; each row gets its own place.
    """
    counts = {int(n): int(c) for n, c in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    entries = plan(counts, capacity)
    by = np.lexsort((entries[:, 1], entries[:, 0]))
    entries = entries[by]
    span = 1 << 44
    starts = entries[:, 0] * span + entries[:, 1]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = arrow_types(schema)
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            e = entries[np.searchsorted(starts, length * span + rank, side="right") - 1]
            nth = rank - e[:, 1]
            seq, off = e[:, 3] + nth // np.maximum(e[:, 2], 1), e[:, 5] + nth % np.maximum(e[:, 2], 1) * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq, types[5]), pa.array(off, types[6])], names=[x.strip().split(" ")[0] for x in schema.split(",")])

    return ranked(rows, counts).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long")).mapInArrow(lean(place), schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of every row of ``docs`` and their places.

    Null or blank text is the end id alone, a piece of one token.  Repeated rows and null ids are packed
    like any other; an empty table gives an empty result; other columns are not read.
    """
    return pack(materialize(pieces(docs, id_col, text_col, capacity, vocabulary), "packing-pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_documents(spark, sf_dir))
