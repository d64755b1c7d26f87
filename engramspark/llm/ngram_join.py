"""Exact n-gram Jaccard join with signature trees; connected components of the links.

1. Every document becomes the set of its distinct shingles (64-bit hashes).  Documents with equal sets are
   one class from here on, however many they are.
2. Classes meet at shared tokens of their prefixes: under one order of all shingles (rare ones first, by a
   counting sketch of fixed size), two sets that link must share one of the first n - ceil(3n/4) + 1.
   Any order gives every link; the sketch only keeps passages that many documents share out of prefixes.
3. First round: each class is compared with the one class that heads most of its tokens, if their bitmaps
   (below) leave a link possible.
4. Later rounds, over tokens whose classes are not yet in one component: a signature tree for each token.
   Leaves are classes (a bitmap of their shingles, their size), nodes hold the OR of the bitmaps below,
   the range of sizes, the largest excess of size over bits, and the component if there is one.  A dual
   traversal drops node pairs of one component, of sizes too far apart, or whose largest possible overlap
   (common bits and excess) is below what a link needs.  Pairs of leaves that are left are candidates.
   Two tying rounds look at an eighth of the tokens each and take, for every component, the candidate with
   the most common bits; they tie large groups of near copies together without listing their pairs.  The
   last round takes all tokens and all candidates that are left, so no link is missed.
5. Bitmaps of one width are full for large sets, so candidates of two large sets are tested again by bitmaps
   of at least two bits a shingle.
6. Candidates of every round that are left are verified on their full sets.

Classes of one token are cut into blocks; trees of two blocks are traversed against each other, so memory
is bounded and nothing is left out.  Tokens that the sketch calls very frequent are dealt over salts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, read_documents
from .components import connected, unpacked
from .training import partition_sum

SHINGLE, NUMERATOR, DENOMINATOR = 5, 3, 4
SKETCH_BITS, BITMAP_WORDS, FAN_OUT, BLOCK = 20, 64, 8, 4096
TYING_ROUNDS, TYING_PARTS, GATHERED = 2, 8, 4096
HOT_TOKEN, SALTS, BROADCAST_BYTES = 200_000, 32, 24 << 20
#: Postings name a token by its upper bits; tokens that share them only add candidates.
TOKEN_SHIFT = np.uint64(16)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_R, _R_INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)


class Shingler:
    """Shingle sets of texts, whole batches at once.

    A word's hash is a polynomial of its bytes modulo 2^64, from running sums over the batch, then mixed.
    """

    def __init__(self, batch_bytes: int = 1 << 18):
        self.batch_bytes = batch_bytes
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, self.batch_bytes + (1 << 16))
            self.powers, self.inverse = (np.cumprod(np.r_[np.uint64(1), np.full(n, r, np.uint64)], dtype=np.uint64) for r in (_R, _R_INVERSE))

    def _words(self, joined: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every word."""
        x = np.frombuffer(joined, np.uint8)
        self._reach(len(x) + 1)
        inside = ~_SPACE[x]
        edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
        start, end = edge[::2], edge[1::2]
        total = np.cumsum((x + np.uint64(1)) * self.powers[: len(x)], dtype=np.uint64)
        before = np.where(start > 0, total[start - 1], np.uint64(0)) if len(start) else total[:0]
        return start, _mix((total[end - 1] - before) * self.inverse[start] + (end - start).astype(np.uint64))

    def many(self, texts: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
        """For each text the sorted hashes of its distinct shingles; of a shorter text all words as one; none without words."""
        k = 0
        while k < len(texts):
            e, held = k, 0
            while e < len(texts) and (e == k or held + len(texts[e]) < self.batch_bytes):
                held += len(texts[e]) + 1
                e += 1
            batch = texts[k:e]
            k = e
            start, h = self._words(b" ".join(batch).lower())
            ends = np.cumsum([len(t) + 1 for t in batch])
            last = np.searchsorted(start, ends)
            m = max(0, len(h) - size + 1)
            full = h[:m] + np.uint64(size)
            for j in range(1, size):
                full = full * _P + h[j : j + m]
            full = _mix(full)
            a = 0
            for b in last.tolist():
                n = b - a
                if n >= size:
                    x = np.sort(full[a : b - size + 1])
                    yield x[np.r_[True, x[1:] != x[:-1]]]
                elif n:
                    x = h[a : a + 1] + np.uint64(n)
                    for j in range(1, n):
                        x = x * _P + h[a + j : a + j + 1]
                    yield _mix(x)
                else:
                    yield h[:0]
                a = b

    def shingles(self, text: bytes, size: int = SHINGLE) -> np.ndarray:
        return next(self.many([text], size))


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap of two linked sets of sizes a and b: J >= p/q means overlap >= p (a + b) / (p + q)."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * BITMAP_WORDS, np.uint8)
    bits[(s & np.uint64(64 * BITMAP_WORDS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def wide_bitmap(s: np.ndarray) -> bytes | None:
    """Two to four bits for each shingle, a power of two in all; None where ``bitmap`` has as many."""
    if 2 * len(s) <= 64 * BITMAP_WORDS:
        return None
    width = 1 << (2 * len(s) - 1).bit_length()
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def most_common(x: bytes, x_size: int, y: bytes, y_size: int) -> int:
    """The largest overlap that two sets with these wide bitmaps can have; the wider one is folded to the other's width."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    width = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(v.reshape(-1, width), 0) for v in (a, b))
    excess = min(x_size - int(np.bitwise_count(a).sum(dtype=np.int64)), y_size - int(np.bitwise_count(b).sum(dtype=np.int64)))
    return min(int(np.bitwise_count(a & b).sum(dtype=np.int64)) + excess, x_size, y_size)


# Signature trees


@dataclass
class Level:
    bits: np.ndarray  # nodes x words
    low: np.ndarray
    high: np.ndarray
    excess: np.ndarray
    component: np.ndarray  # -1 where there are several
    first: np.ndarray  # place of the first child below; children are contiguous
    last: np.ndarray


def forest(group: np.ndarray, bits: np.ndarray, size: np.ndarray, component: np.ndarray, fan_out: int = FAN_OUT) -> list[Level]:
    """Levels from the roots, one for each group of consecutive leaves, down to the leaves in the given order."""
    n = len(size)
    levels = [Level(bits, size, size, size - np.bitwise_count(bits).sum(1, dtype=np.int64), component, np.arange(n), np.arange(n))]
    while (group[1:] == group[:-1]).any():
        below = levels[0]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        nth = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
        at = np.flatnonzero(nth % fan_out == 0)
        end = np.r_[at[1:], len(group)] - 1
        low_c, high_c = np.minimum.reduceat(below.component, at), np.maximum.reduceat(below.component, at)
        levels.insert(0, Level(np.bitwise_or.reduceat(below.bits, at), np.minimum.reduceat(below.low, at), np.maximum.reduceat(below.high, at), np.maximum.reduceat(below.excess, at), np.where(low_c == high_c, low_c, -1), at, end))
        group = group[at]
    return levels


def may_link(x: Level, i: np.ndarray, y: Level, j: np.ndarray) -> np.ndarray:
    """Whether some pair below nodes i of x and j of y may link and is not in one component already."""
    ok = ~((x.component[i] == y.component[j]) & (x.component[i] >= 0))
    ok &= (DENOMINATOR * x.high[i] >= NUMERATOR * y.low[j]) & (DENOMINATOR * y.high[j] >= NUMERATOR * x.low[i])
    i, j, at = i[ok], j[ok], np.flatnonzero(ok)
    common = np.bitwise_count(x.bits[i] & y.bits[j]).sum(1, dtype=np.int64) + np.minimum(x.excess[i], y.excess[j])
    most = np.minimum(common, np.minimum(x.high[i], y.high[j]))
    ok[at] = most >= needed(x.low[i], y.low[j])
    return ok


def traverse(x: list[Level], y: list[Level] | None, chunk: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves that may link; depth first over chunks of node pairs.

    Each tree of x against the one of y in the same place; without y, against itself (i < j).
    """
    own = y is None
    y = x if own else y
    depth = max(len(x), len(y))
    # The shallower tree's root stands in for the levels that it lacks.
    a, b = ([None] * (depth - len(t)) + t for t in (x, y))
    roots = np.arange(len(x[0].low))
    stack = [(0, roots, roots)]
    while stack:
        k, i, j = stack.pop()
        ok = may_link(a[k] or x[0], i, b[k] or y[0], j)
        i, j = i[ok], j[ok]
        if k == depth - 1:
            if own:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue

        def children(t: list, k: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if t[k] is None:
                return i, i
            return t[k].first[i], t[k].last[i]

        i0, i1 = children(a, k, i)
        j0, j1 = children(b, k, j)
        ni, nj = i1 - i0 + 1, j1 - j0 + 1
        many = ni * nj
        for s in range(0, len(i), max(1, chunk // FAN_OUT**2)):
            e = s + max(1, chunk // FAN_OUT**2)
            m = many[s:e]
            which = np.repeat(np.arange(s, min(e, len(i))), m)
            pos = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            p, q = i0[which] + pos // nj[which], j0[which] + pos % nj[which]
            if own:
                p, q = p[p <= q], q[p <= q]
            stack.append((k + 1, p, q))


def best_of(pairs: Iterator[tuple[np.ndarray, np.ndarray]], group: np.ndarray, bits: np.ndarray, size: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows, those with the most common bits for their sizes: in each group one for each component,
    and one for each two components that have at least as many rows as the root of the group's rows (so no
    more than rows)."""
    number, rows = np.unique(group * (component.max() + 1) + component, return_inverse=True, return_counts=True)[1:]
    large = (rows * rows)[number] >= np.bincount(group)[group]
    keys, scores, left, right = [], [], [], []
    held = 0

    def squeeze() -> None:
        k, s, p, q = (np.concatenate(x) for x in (keys, scores, left, right))
        order = np.lexsort((q, p, s, k))
        top = order[np.r_[k[order][1:] != k[order][:-1], True]]
        for x, v in zip((keys, scores, left, right), (k[top], s[top], p[top], q[top]), strict=True):
            x[:] = [v]

    for i, j in pairs:
        common = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64)
        s = common / (size[i] + size[j] - common)
        a, b = number[i], number[j]
        both = np.flatnonzero(large[i] & large[j])
        keys.append(np.r_[a, b, np.minimum(a, b)[both]] << 32 | np.r_[np.full(2 * len(a), (1 << 32) - 1), np.maximum(a, b)[both]])
        scores.append(np.r_[s, s, s[both]])
        left.append(np.r_[i, i, i[both]])
        right.append(np.r_[j, j, j[both]])
        held += len(i)
        if held > 500_000:
            squeeze()
            held = 0
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    squeeze()
    chosen = np.unique(np.stack([left[0], right[0]], 1), axis=0)
    return chosen[:, 0], chosen[:, 1]


def tree_pairs(group: np.ndarray, side: np.ndarray, ids: np.ndarray, component: np.ndarray, size: np.ndarray, bits: np.ndarray, best: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of ids: within each group, or between its sides 0 and 1 where it has both.

    ``best``: of the pairs in a group only the best for its components.
    """
    component = np.unique(component, return_inverse=True)[1]  # -1 is free for nodes of several
    group = np.unique(group, return_inverse=True)[1]
    crossed = np.bincount(group, side) > 0

    def built(rows: np.ndarray) -> tuple[np.ndarray, list[Level]]:
        # Neighbours of like size and like bits share nodes.
        rows = rows[np.lexsort((bits[rows, 1], bits[rows, 0], component[rows], size[rows], group[rows]))]
        return rows, forest(group[rows], bits[rows], size[rows], component[rows])

    own = np.flatnonzero(~crossed[group])
    if len(own):
        left, x = built(own)
        found = ((left[i], left[j]) for i, j in traverse(x, None))
        for i, j in [best_of(found, group, bits, size, component)] if best else found:
            yield ids[i], ids[j]
    for g in np.flatnonzero(crossed).tolist():
        left, x = built(np.flatnonzero((group == g) & (side == 0)))
        right, y = built(np.flatnonzero((group == g) & (side == 1)))
        if len(left):
            for i, j in traverse(x, y):
                yield ids[left[i]], ids[right[j]]


class Seen:
    """Pairs that a task has put out, as sorted arrays: 16 bytes a pair, where a set of tuples takes about 200."""

    def __init__(self, most: int = 1_000_000):
        self.most = most
        self.u = self.v = np.zeros(0, np.int64)

    def fresh(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that were not here before, each once.  Beyond ``most`` the older ones are forgotten, and may come again."""
        u, v, new = np.r_[self.u, u], np.r_[self.v, v], np.r_[np.zeros(len(self.u), bool), np.ones(len(u), bool)]
        order = np.lexsort((new, v, u))
        u, v, new = u[order], v[order], new[order]
        one = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.zeros(0, bool)
        u, v, new = u[one], v[one], new[one]
        out = u[new], v[new]
        self.u, self.v = (u, v) if len(u) <= self.most else out
        return out


# DataFrames


def sets(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """doc_id, n, hi, lo (128 bits that name the set), cls (64 bits of them), bits, wide of each row (wide where the
    partition has the set first); last in each partition a row with the partition's sketch of shingle counts.  Materialised."""
    schema = "doc_id long, n long, hi long, lo long, cls long, bits binary, wide binary, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        shingler, seen = Shingler(), set()
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        names = [x.strip().split(" ")[0] for x in schema.split(",")]
        for b in batches:
            out: list[list] = [[] for _ in types]
            held: list[np.ndarray] = []
            for doc_id, s in zip(b.column(0).to_pylist(), shingler.many(b.column(1).to_pylist()), strict=True):
                name = xxhash.xxh3_128_digest(s.tobytes())
                hi, lo = np.frombuffer(name, np.int64).tolist()
                wide = None
                if name not in seen:
                    seen.add(name)
                    held.append(s)
                    wide = wide_bitmap(s)
                for col, v in zip(out, (doc_id, len(s), hi, lo, class_id(name, seed), bitmap(s).tobytes(), wide, None), strict=True):
                    col.append(v)
            if held:
                sketch += np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
        if sketch.any():
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, None, None, None, None, None, None, zlib.compress(sketch.astype("<u4").tobytes(), 1)), types, strict=True)], names=names)

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    return materialize(src.mapInArrow(lean(run), schema), "ngram-sets")


def class_id(name: bytes, seed: int) -> int:
    x = xxhash.xxh3_64_intdigest(name, seed)
    return x - ((x >> 63) << 64)


def order_levels(rows: DataFrame) -> np.ndarray:
    """For each cell of the sketch a coarse level of how often its shingles occur, and its count."""
    import zlib

    def of(batches) -> np.ndarray:
        out = np.zeros(1 << SKETCH_BITS)
        for b in batches:
            for x in b.column(0).to_pylist():
                out += np.frombuffer(zlib.decompress(x), "<u4")
        return out

    return partition_sum(rows.select("sketch").filter("sketch IS NOT NULL"), (1 << SKETCH_BITS,), of)


def postings(docs: DataFrame, id_col: str, text_col: str, seed: int, counts: np.ndarray, hot: float, salts: int, block: int) -> DataFrame:
    """token, block, cls, head of every class at every prefix token that several classes share; materialised.

    ``head`` is the smallest class of the token (of the token's salt, for hot tokens).
    """
    spark = docs.sparkSession
    level = np.minimum(255, np.ceil(4 * np.log2(counts + 1))).astype(np.uint8)
    shared = spark.sparkContext.broadcast((level, counts > hot))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, is_hot = shared.value
        shingler, seen = Shingler(), set()
        for b in batches:
            tokens, owners = [], []
            for s in shingler.many(b.column(0).to_pylist()):
                c = class_id(xxhash.xxh3_128_digest(s.tobytes()), seed)
                if not len(s) or c in seen:
                    continue
                seen.add(c)
                first = s[np.argsort(level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[: prefix_length(len(s))]]
                tokens.append(first)
                owners.append(np.full(len(first), c, np.int64))
            if tokens:
                t, o = np.concatenate(tokens), np.concatenate(owners)
                salt = np.where(is_hot[(t >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], o % salts + 1, 0).astype(np.int32)
                for k in range(0, len(t), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array((t[k : k + 200_000] >> TOKEN_SHIFT).view(np.int64)), pa.array(salt[k : k + 200_000]), pa.array(o[k : k + 200_000])], names=["token", "salt", "cls"])

    text = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    rows = text.mapInArrow(lean(run), "token long, salt int, cls long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    rows = rows.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt", "cls")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = tuple(np.zeros(0, np.int64) for _ in range(3))
        carry, base, head = empty, 0, None  # the last run's rows that are not out yet, its blocks so far, its head

        def out(t, s, c, size, base, heads) -> pa.RecordBatch | None:
            """Whole runs of the given sizes; the first goes on from block ``base``."""
            starts = np.cumsum(size) - size
            nth = np.arange(len(t)) - np.repeat(starts, size)
            number = nth // block
            if base and len(size):
                number[: size[0]] += base
            keep = np.repeat((size > 1) | (s[starts] > 0), size) if len(size) else np.zeros(0, bool)
            if base and len(size):
                keep[: size[0]] = True
            if keep.any():
                return pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array((s * (1 << 32) + number)[keep]), pa.array(c[keep]), pa.array(np.repeat(heads, size)[keep])], names=["token", "block", "cls", "head"])
            return None

        for b in batches:
            t, s, c = (np.r_[x, b.column(k).to_numpy().astype(np.int64)] for k, x in enumerate(carry))
            fresh = np.r_[True, (t[1:] != t[:-1]) | (c[1:] != c[:-1])] if len(t) else np.zeros(0, bool)
            t, s, c = t[fresh], s[fresh], c[fresh]
            if not len(t):
                continue
            starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])])
            size = np.diff(np.r_[starts, len(t)])
            heads = c[starts].copy()
            if head is not None:
                heads[0] = head
            done = starts[-1]
            if (x := out(t[:done], s[:done], c[:done], size[:-1], base, heads[:-1])) is not None:
                yield x
            if len(size) > 1:
                base = 0
            head = heads[-1]
            t, s, c = t[done:], s[done:], c[done:]
            while len(t) > block:  # a long run goes out block by block; its last row stays, to tell repeated rows
                if (x := out(t[:block], s[:block], c[:block], np.array([block]), base, np.array([head]))) is not None:
                    yield x
                base += 1
                t, s, c = t[block:], s[block:], c[block:]
            carry = t, s, c
        if len(carry[0]) and (x := out(*carry, np.array([len(carry[0])]), base, np.array([head]))) is not None:
            yield x

    return materialize(rows.mapInArrow(lean(runs), "token long, block long, cls long, head long"), "ngram-postings")


def verified(docs: DataFrame, id_col: str, text_col: str, seed: int, pairs: DataFrame, owners: DataFrame, salts: int = 64) -> DataFrame:
    """u, v, linked of every pair of classes (u, v), by their full sets; materialised.

    Sets are taken from one document of each class.  A class in very many pairs is dealt over salts, each
    with one copy of its set.
    """
    spark = docs.sparkSession
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    keys = pairs.select(F.col("u").alias("cls"), "u", "salt", F.lit(0).alias("role")).union(pairs.select(F.col("v").alias("cls"), "u", "salt", F.lit(1).alias("role"))).distinct()
    asked = keys.groupBy("cls").agg(F.collect_list(F.struct("u", "salt", "role")).alias("keys")).join(owners, "cls")
    asked = materialize(asked.select(F.col("owner").alias("owner_id"), F.col("cls").alias("owner_cls"), F.col("keys.u").alias("us"), F.col("keys.salt").alias("ss"), F.col("keys.role").alias("rs")), "ngram-asked")
    # A row has three arrays and two numbers: 72 bytes, and 16 for each key.
    if asked.agg(72 * F.count(F.lit(1)) + 16 * F.coalesce(F.sum(F.size("us")), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        asked = F.broadcast(asked)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text")).join(asked, F.col("doc_id").eqNullSafe(F.col("owner_id")))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            size = 0

            def batch(out=out) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["u", "salt", "role", "cls", "shingles"])

            texts, *asked = (c.to_pylist() for c in b.columns)
            for s, cls, us, ss, rs in zip(shingler.many(texts), *asked, strict=True):
                s = s.tobytes()
                if class_id(xxhash.xxh3_128_digest(s), seed) != cls:  # another row with this id
                    continue
                for x in zip(us, ss, rs, strict=True):
                    for col, v in zip(out, (*x, cls, s), strict=True):
                        col.append(v)
                    size += len(s)
                    if size > 16_000_000:
                        yield batch()
                        for col in out:
                            col.clear()
                        size = 0
            if out[0]:
                yield batch()

    sent = rows.select("text", "owner_cls", "us", "ss", "rs").mapInArrow(lean(send), "u long, salt int, role int, cls long, shingles binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartition(parts, "u", "salt").sortWithinPartitions("u", "salt", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, None
        for b in batches:
            us, vs, yes = [], [], []
            for u, salt, role, cls, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = np.frombuffer(data, np.uint64)
                if role == 0:
                    at, mine = (u, salt), s
                elif at == (u, salt):
                    both = np.concatenate([mine, s])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    us.append(u)
                    vs.append(cls)
                    yes.append(DENOMINATOR * common >= NUMERATOR * (len(mine) + len(s) - common))
                else:
                    raise RuntimeError("a class of a candidate pair has no set")
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(yes, pa.bool_())], names=["u", "v", "linked"])

    return materialize(sent.mapInArrow(lean(compare), "u long, v long, linked boolean").distinct(), "ngram-verified")


def possible(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs (u, v) whose bitmaps and sizes leave a link possible."""
    u, v = (bits.select(F.col("cls").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits")) for c in ("u", "v"))
    rows = pairs.join(v, "v").join(u, "u").select("u", "v", "u_n", "v_n", "u_bits", "v_bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                none, at = np.full(b.num_rows, -1), np.arange(b.num_rows)
                x, y = (forest(at, unpacked(b.column(k + 2), "<u8", BITMAP_WORDS), b.column(k).to_numpy(), none)[-1] for k in (2, 3))
                ok = pa.array(may_link(x, at, y, at))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["u", "v"])

    return rows.mapInArrow(lean(run), "u long, v long")


def wide_possible(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """The pairs (u, v) that wide bitmaps leave a link possible, those of two sets without any among them; materialised.

    ``wide``: cls, n, wide of the large sets.  ``pairs`` is a stored table.
    """
    asked = pairs.select(F.col("u").alias("cls")).union(pairs.select(F.col("v").alias("cls"))).distinct()
    if 16 * pairs.count() <= BROADCAST_BYTES:  # only the bitmaps that are asked for are sent
        asked = F.broadcast(asked)
    wide = wide.join(asked, "cls", "left_semi")
    u, v = (wide.select(F.col("cls").alias(c), F.col("n").alias(f"{c}_n"), F.col("wide").alias(f"{c}_wide")) for c in ("u", "v"))
    rows = pairs.join(v, "v", "left").join(u, "u", "left").select("u", "v", "u_n", "v_n", "u_wide", "v_wide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs, *columns = b.columns
            keep = []
            for n, m, x, y in zip(*(c.to_pylist() for c in columns), strict=True):
                keep.append(x is None or y is None or most_common(x, n, y, m) >= -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR)))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([us.filter(keep), vs.filter(keep)], names=["u", "v"])

    return materialize(rows.mapInArrow(lean(run), "u long, v long"), "ngram-possible")


def candidates(posted: DataFrame, labels: DataFrame, bits: DataFrame, tested: DataFrame, tying: bool) -> DataFrame:
    """u, v: pairs of classes of different components from the signature trees of the tokens, without those tested.

    ``tying``: trees of single blocks, and of their pairs the best for each component.
    """
    spark = posted.sparkSession
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("many"))
    sized = materialize(labels.join(sizes, "component").select("cls", "component", "many"), "ngram-sized")
    rows = posted.select("token", "block", "cls").join(sized, "cls", "left").withColumns({"component": F.coalesce("component", "cls"), "many": F.coalesce("many", F.lit(1))})
    if tying:
        rows = rows.withColumn("token", F.xxhash64("token", "block"))
    rows = materialize(rows, "ngram-labelled")
    mixed = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("a"), F.max("component").alias("b"), F.min("block").alias("first"), F.max("block").alias("last"), F.max("many").alias("m"), F.expr("max_by(component, many)").alias("main")).filter("a <> b")
    mixed = materialize(mixed.select("token", "n", "m", (F.col("first") == F.col("last")).alias("whole"), "main"), "ngram-mixed")
    # Tokens of one component meet in as few groups as hold about ``GATHERED`` rows each (or two rows for each of its
    # classes), so that bitmaps are sent once for many tokens, and no component is a task's alone.
    zero = F.lit(0).cast("long")
    load = mixed.filter("whole").groupBy("main").agg(F.ceil(F.sum("n") / F.greatest(F.lit(GATHERED), 2 * F.max("m"))).alias("parts")).filter("parts > 1")
    mixed = mixed.join(load, "main", "left").withColumn("main", F.when(F.col("parts") > 1, F.xxhash64("main", F.pmod(F.xxhash64("token"), F.col("parts")))).otherwise(F.col("main"))).drop("n", "m", "parts")
    single = rows.join(mixed.filter("whole"), "token").select(F.col("main").alias("key"), "token", zero.alias("x"), zero.alias("y"), F.lit(0).alias("side"), "cls", "component")
    # A token in one block is one group.  Of several blocks, each meets each, unless both are of one component.
    # Such tokens are few or none, and the rows are not shuffled for them.
    parted = mixed.filter("NOT whole").select("token")
    many = parted.count()
    several = rows.join(F.broadcast(parted) if 8 * many <= BROADCAST_BYTES else parted, "token")
    blocks = several.groupBy("token", "block").agg(F.min("component").alias("a"), F.max("component").alias("b"))
    x, y = F.least("block", "other"), F.greatest("block", "other")
    meets = blocks.join(blocks.select("token", F.col("block").alias("other"), F.col("a").alias("a2"), F.col("b").alias("b2")), "token").filter("a <> b OR a2 <> b2 OR a <> a2").select("token", "block", "other")
    several = several.join(meets, ["token", "block"]).select(F.xxhash64("token", x, y).alias("key"), "token", x.alias("x"), y.alias("y"), (F.col("block") > F.col("other")).cast("int").alias("side"), "cls", "component")
    dealt = materialize(single.unionByName(several) if many else single, "ngram-dealt")
    null = F.lit(None)
    with_bits = dealt.select("key", "cls").distinct().join(bits, "cls").select("key", F.lit(0).alias("kind"), zero.alias("token"), zero.alias("x"), zero.alias("y"), F.lit(0).alias("side"), "cls", zero.alias("component"), "n", "bits")
    plain = dealt.select("key", F.lit(1).alias("kind"), "token", "x", "y", "side", "cls", "component", zero.alias("n"), null.cast("binary").alias("bits"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_bits.unionByName(plain).repartition(parts, "key").sortWithinPartitions("key", "kind", "token", "x", "y", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()  # pairs meet at many tokens
        held: list[pa.RecordBatch] = []
        rows = 0

        def out(us: list, vs: list) -> pa.RecordBatch:
            u, v = seen.fresh(np.concatenate(us), np.concatenate(vs))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """Pairs of all tokens of some whole keys."""
            col = {c: t.column(c).to_numpy().astype(np.int64) for c in t.schema.names if c != "bits"}
            has = col["kind"] == 0
            table, n = unpacked(t.column("bits").filter(pa.array(has)).combine_chunks(), "<u8", BITMAP_WORDS), col["n"][has]
            # Both kinds are sorted by key, those with bits by class too: one number for key and class finds the bits.
            key = np.cumsum(np.r_[0, col["key"][1:] != col["key"][:-1]])
            names, number = np.unique(col["cls"], return_inverse=True)
            code = key * len(names) + number
            at = np.searchsorted(code[has], code[~has])
            c = {k: v[~has] for k, v in col.items()}
            group = np.stack([c["key"], c["token"], c["x"], c["y"]], 1)
            group = np.cumsum(np.r_[0, (group[1:] != group[:-1]).any(1)]) if len(group) else np.zeros(0, np.int64)
            us: list[np.ndarray] = []
            vs: list[np.ndarray] = []
            size = 0
            for u, v in tree_pairs(group, c["side"], c["cls"], c["component"], n[at], table[at], tying) if len(group) else ():
                us.append(np.minimum(u, v))
                vs.append(np.maximum(u, v))
                size += len(u)
                if size > 200_000:
                    yield out(us, vs)
                    us, vs, size = [], [], 0
            if size:
                yield out(us, vs)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows > 20_000 and held[0].column(0)[0].as_py() != b.column(0)[b.num_rows - 1].as_py():
                t = pa.Table.from_batches(held)
                keys = t.column("key").to_numpy()
                cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1  # the last key may go on
                yield from whole(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows = t.num_rows - cut
        if held:
            yield from whole(pa.Table.from_batches(held))

    found = dealt.mapInArrow(lean(run), "u long, v long").distinct().join(tested, ["u", "v"], "left_anti")
    # The class of the smaller component goes first: its set is sent once for many pairs, not once for each.
    found = found.join(sized.select(F.col("cls").alias("u"), F.col("many").alias("u_many")), "u", "left").join(sized.select(F.col("cls").alias("v"), F.col("many").alias("v_many")), "v", "left")
    turn = F.coalesce("u_many", F.lit(1)) > F.coalesce("v_many", F.lit(1))
    return found.select(F.when(turn, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(turn, F.col("u")).otherwise(F.col("v")).alias("v"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: float = HOT_TOKEN, salts: int = SALTS, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id.

    A-Z are lower-cased; words are runs without ASCII white space.  Null text counts as empty: no shingles,
    linked with nothing.  Rows with equal sets are linked, repeated rows too.  A null id never is a
    component's id unless all its rows lack one; rows without words are components of their own.  Very long
    texts are read whole; an empty table gives an empty result; other columns, whatever their names, are not read.
    """
    seed = 0
    while True:
        rows = sets(docs, id_col, text_col, seed)
        members = rows.filter("sketch IS NULL")
        same = members.groupBy("cls").agg(F.min("hi").alias("a"), F.max("hi").alias("b"), F.min("lo").alias("c"), F.max("lo").alias("d")).filter("a <> b OR c <> d")
        if same.isEmpty():
            break
        seed += 1  # two sets got one class number: number all anew
    posted = postings(docs, id_col, text_col, seed, order_levels(rows), hot, salts, block)
    classes = materialize(members.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("owner"), F.max("n").alias("n")), "ngram-classes")
    owners = classes.select("cls", "owner")

    votes = posted.filter("cls <> head").groupBy("cls", "head").agg(F.count(F.lit(1)).alias("votes"))
    first = votes.groupBy("cls").agg(F.max(F.struct("votes", "head")).alias("best")).select(F.col("best.head").alias("u"), F.col("cls").alias("v"))
    # A class has its bits once, whatever the number of its documents.
    bits = members.filter("n > 0").join(posted.select("cls").distinct(), "cls", "left_semi").groupBy("cls", "n", "bits").agg(F.count(F.lit(1)).alias("c")).drop("c")
    bits = materialize(bits, "ngram-bits")
    wide = materialize(members.filter("wide IS NOT NULL").dropDuplicates(["cls"]).select("cls", "n", "wide"), "ngram-wide")
    done = verified(docs, id_col, text_col, seed, wide_possible(materialize(possible(first, bits), "ngram-first"), wide), owners)
    labels = connected(done.filter("linked").select("u", "v"))
    for k in range(TYING_ROUNDS + 1):
        tying = k < TYING_ROUNDS
        part = posted.filter(F.pmod(F.xxhash64("token"), F.lit(TYING_PARTS)) == k) if tying else posted
        tested = done.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        found = materialize(candidates(part, labels.select(F.col("node").alias("cls"), "component"), bits, tested, tying), "ngram-candidates")
        found = wide_possible(found, wide)
        if found.isEmpty():
            continue
        more = verified(docs, id_col, text_col, seed, found, owners)
        done = done.union(more)
        links = more.filter("linked").select("u", "v")
        if not links.isEmpty():
            labels = connected(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links))

    placed = classes.join(labels, classes["cls"] == labels["node"], "left").withColumn("group", F.coalesce("component", "cls"))
    lowest = placed.groupBy("group").agg(F.min("owner").alias("lowest"))
    ids = placed.join(lowest, "group").select(F.col("cls").alias("class"), "lowest")
    out = members.select("doc_id", "n", "cls").join(ids, (F.col("cls") == F.col("class")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("lowest", "doc_id").alias("component_id"))


def thin(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's: one document of each group of near copies.

    Rows that share that id all stay, so do rows of components without any id and rows without words (null
    and blank texts).  All columns are kept, whatever their names; an empty table gives an empty result.
    """
    from .common import fresh

    (own,) = fresh(docs, "nj_kept")
    found = components(docs, id_col, text_col)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col(own)), "left_semi").select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read_documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.x, p.y FROM p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 100 * c >= 75 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, t.y FROM reach r JOIN both_ways t ON t.x = r.other)
SELECT r.doc_id, any_value(n.n) AS n_shingles, min(r.other) AS component_id FROM reach r JOIN n USING (doc_id) GROUP BY r.doc_id
"""
