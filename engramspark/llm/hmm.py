"""Hidden Markov language model over all training documents.

Words and their counts are gathered from the whole corpus.  A token is drawn in two steps: the hidden state
emits a class, the class emits the word by its count.  The most frequent words are classes of their own;
all others share classes by their last characters, so the number of classes, and with it what training
exchanges, is fixed, while the vocabulary grows with the corpus and is never sent to one machine: counts of
the words beyond a fixed dictionary are joined.

Baum-Welch starts from a seeded random model around the counts of all training documents; every round runs
over all of them until it converges: partitions sum expected counts of states, transitions and emissions of
whole documents.  A round goes block by block (by a hash of the document), and the model is fitted anew after
each block to the latest counts of all blocks (incremental EM), which takes fewer rounds.  Scoring is exact: the scaled forward recursion over the whole sequence, end included, times the words' probabilities in their classes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, lean, materialize, read_documents
from .training import partition_sum

DIVISOR, REMAINDER = 7, 2
STATES, OWN, SHARED, DICTIONARY = 12, 2048, 1024, 1 << 18
#: Training ends when a round gains less than TOLERANCE of the log-likelihood; ROUNDS only stops one that never does.
ROUNDS, TOLERANCE, SEED, BLOCKS = 200, 1e-5, 7, 8
#: Documents are computed in windows of WINDOW tokens, WIDE documents in step, HELD tokens at a time; vectors of KEPT tokens are kept.  The counts do not depend on these.
WINDOW, WIDE, HELD, KEPT = 32, 2048, 4_000_000, 1 << 20
END = 0  # the id of the end; words have their 64-bit hash
_CLASSES = OWN + SHARED


def word_id(word: bytes) -> int:
    return (xxhash.xxh3_64_intdigest(word) or 1) - (1 << 64) * (xxhash.xxh3_64_intdigest(word) >> 63)


def shared_class(word: bytes) -> int:
    """By the last three bytes: endings tell languages and kinds of text apart."""
    return OWN + xxhash.xxh32_intdigest(word[-3:]) % SHARED


def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``word_id`` and ``shared_class`` of each word."""
    ids = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    ids[ids == 0] = 1
    ends = np.fromiter(map(xxhash.xxh32_intdigest, [w[-3:] for w in words]), np.int64, len(words))
    return ids.view(np.int64), OWN + ends % SHARED


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """word, class (shared), count of every different token of ``docs``, the end of each document included; materialised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            ends = counts.pop(b"", 0)
            ids, shared = hashed(list(counts))
            n = np.fromiter(counts.values(), np.int64, len(counts))
            counts.clear()
            if ends:
                ids, shared, n = np.r_[ids, END], np.r_[shared, 0], np.r_[n, ends]
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(shared.astype(np.int32)), pa.array(n)], names=["word", "class", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(text.lower().split())
                counts[b""] += 1
                if len(counts) > 600_000:
                    yield flush()
        if counts:
            yield flush()

    text = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    counted = text.mapInArrow(lean(run), "word long, class int, n long").groupBy("word").agg(F.first("class").alias("class"), F.sum("n").alias("n"))
    return materialize(counted, "hmm-words")


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states; one more row of ones, for padding

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        unigram = (emit.sum(1) + 0.1) / (emit.sum() + 0.1 * len(emit))
        start = (start + 0.1) / (start + 0.1).sum()
        move = (move + 0.1) / (move + 0.1).sum(1, keepdims=True)
        emit = emit + 20 * unigram[:, None]
        return Model(start, move, np.r_[emit / emit.sum(0), np.ones((1, emit.shape[1]))])


def expected(model: Model, windows: np.ndarray, first: np.ndarray | None = None, chunk: int = WIDE, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, transitions and emissions, and the log-likelihood, of whole sequences.

    ``windows`` are rows of classes, padded with the number of classes; ``first`` marks those that open a
    sequence (all of them if None), the others go on where the row before ends.  ``chunk`` sequences of like
    length go in step.  The forward pass keeps its vectors of ``kept`` tokens, and of the windows beyond only
    the states' distribution before each; the backward one computes those windows' vectors again from it.  So
    memory is bounded but for one small vector for each window, and the counts are those of the uncut sequences.
    """
    n, k, classes, steps = len(windows), len(model.start), len(model.emit) - 1, windows.shape[1]
    heads = np.arange(n) if first is None else np.flatnonzero(first)
    sizes = np.diff(np.r_[heads, n])
    order = np.argsort(-sizes, kind="stable")
    # Each class's emissions are divided by the largest, so that two steps never leave the range of 32 bits.
    most = model.emit.max(1)
    move, table = np.ascontiguousarray(model.move, np.float32), np.ascontiguousarray(model.emit / most[:, None], np.float32)
    start, trans, emissions, likelihood = np.zeros(k), np.zeros((k, k)), np.zeros((k, classes + 1)), 0.0
    room = [np.zeros(0, np.float32)] * 4
    tokens, a = np.r_[0, np.cumsum(sizes[order])] * steps, 0
    while a < len(order):
        # As many as can be kept, but not so few that steps are short.
        some = order[a : a + min(chunk, max(chunk // 4, int(np.searchsorted(tokens, tokens[a] + kept, side="right")) - 1 - a, 1))]
        a += len(some)
        s, t, e, ll = _in_step(model.start, move, table, windows, heads[some], sizes[some], room, kept)
        start += s
        trans += t
        emissions += e
        likelihood += ll
    emissions = np.ascontiguousarray(emissions[:, :classes].T)
    return start, trans * model.move, emissions, likelihood + float(emissions.sum(1) @ np.log(most[:classes]))


def _forward(x: np.ndarray, emit: np.ndarray, alpha: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forward recursion through a window, from ``x`` (states x sequences): what comes after it, and the factors.

    ``emit`` and ``alpha`` are steps x states x sequences; every second ``alpha`` and the last are scaled to a
    sum of 1, that of step t by factor t // 2.
    """
    steps = len(emit)
    x, ones, factor = x.copy(), np.ones(len(x), np.float32), np.empty((-(-steps // 2), x.shape[1]), np.float32)
    for t in range(steps):
        a = alpha[t]
        np.multiply(x, emit[t], out=a)
        if t % 2 or t == steps - 1:
            r = factor[t // 2]
            np.dot(ones, a, out=r)
            np.reciprocal(r, out=r)
            a *= r
        np.dot(back, a, out=x)
    return x, factor


def _in_step(opening: np.ndarray, move: np.ndarray, table: np.ndarray, windows: np.ndarray, heads: np.ndarray, sizes: np.ndarray, room: list[np.ndarray], kept: int):
    """The counts of some sequences: ``heads`` are their first windows, ``sizes`` how many they have, most first.

    Steps before states before sequences, so that every operation runs along the sequences through memory in
    one piece.  ``room`` is memory to use again.
    """
    k, steps, pad = len(move), windows.shape[1], len(table) - 1
    back, ones = np.ascontiguousarray(move.T), np.ones(k, np.float32)
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # how many have a window j
    start, trans, emissions, likelihood = np.zeros(k), np.zeros((k, k)), np.zeros((k, pad + 1)), 0.0
    # The first window's place is used again for those that are not kept.
    place = np.cumsum(active) * k * steps
    keep = max(1, int(np.searchsorted(place, kept * k, side="right")))
    place -= active * k * steps
    for i, size in enumerate((place[keep - 1] + active[keep - 1] * k * steps,) * 2 + (active[0] * k * steps,) * 2):
        if len(room[i]) < size:
            room[i] = np.empty(size, np.float32)

    def through(j: int, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Window j from ``x``: what comes after it, its classes (steps x sequences), emissions, forward vectors, factors."""
        n = active[j]
        at = place[j] if j < keep else 0
        emit, alpha = (r[at : at + k * steps * n].reshape(steps, k, n) for r in room[:2])
        classes = np.ascontiguousarray(windows[heads[:n] + j].T, np.intp)
        spoken = room[2][: k * steps * n].reshape(steps, n, k)
        emit[:] = np.take(table, classes, axis=0, out=spoken, mode="clip").transpose(0, 2, 1)
        x, factor = _forward(x, emit, alpha, back)
        return x, classes, emit, alpha, factor

    x = np.repeat(opening.astype(np.float32)[:, None], active[0], 1)
    before, held = [], []
    for j in range(sizes[0]):
        before.append(np.ascontiguousarray(x[:, : active[j]]))
        if j < keep or j + 1 < sizes[0]:
            x, *rest = through(j, before[j])
            if j < keep:
                held.append(rest)
    after, seam = np.ones((k, 0), np.float32), np.ones((k, 0), np.float32)
    for j in range(sizes[0] - 1, -1, -1):
        n, m = active[j], after.shape[1]
        # Window 0 is computed again if others have used its place.
        classes, emit, alpha, factor = held.pop() if j < keep and (j or keep == sizes[0]) else through(j, before[j])[1:]
        trans += alpha[-1, :, :m] @ seam.T
        emit[1::2] *= factor[: steps // 2, None]
        if steps % 2:
            emit[-1] *= factor[-1]
        beta = room[2][: k * steps * n].reshape(steps, k, n)
        beta[-1] = np.concatenate([after, np.ones((k, n - m), np.float32)], 1)
        beta[-1] /= ones @ (alpha[-1] * beta[-1])
        for t in range(steps - 1, 0, -1):
            np.multiply(emit[t], beta[t], out=emit[t])
            np.dot(move, emit[t], out=beta[t - 1])
        emit[0] *= beta[0]
        states = room[3][: k * steps * n].reshape(k, steps, n)  # their probabilities
        np.multiply(alpha, beta, out=states.transpose(1, 0, 2))
        after, seam = move @ emit[0], emit[0].copy()
        emit[:, :, m:] *= (classes[:, m:] != pad)[:, None]  # those that end here
        trans += np.matmul(alpha[:-1], emit[1:].transpose(0, 2, 1)).sum(0, dtype=float)
        if j == 0:
            start += states[:, 0].sum(1, dtype=float)
        flat = classes.ravel()
        for state in range(k):
            emissions[state] += np.bincount(flat, states[state].ravel(), pad + 1)
        # Eight factors of 32 bits do not leave the range of 64.
        likelihood -= float(np.log(np.multiply.reduceat(factor.astype(float), np.arange(0, len(factor), 8))).sum())
    return start, trans, emissions, likelihood


def cut(sequences: list[np.ndarray], classes: int = _CLASSES, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequences cut to padded windows, and which of them open a sequence."""
    many = [-(-len(s) // window) for s in sequences]
    out, first = np.full((sum(many), window), classes, np.uint16), np.zeros(sum(many), bool)
    k = 0
    for s, m in zip(sequences, many, strict=True):
        out[k : k + m].ravel()[: len(s)] = s
        first[k] = True
        k += m
    return out, first


def batched(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of whole sequences, the longest first, so that those in step have like lengths."""
    if sequences:
        yield cut(sorted(sequences, key=len, reverse=True))


def _packed(start, move, emit, likelihood: float) -> np.ndarray:
    return np.r_[start[None, :], move, emit, np.full((1, len(start)), likelihood)]


def first_model(unigram: np.ndarray, states: int, seed: int) -> Model:
    """A random model around the counts of classes; it depends on nothing else."""
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * rng.dirichlet(np.ones(states), len(unigram)) * states
    return Model.from_counts(np.ones(states), np.ones((states, states)) + 5 * states * np.eye(states), emit)


def train(encoded: DataFrame, unigram: np.ndarray, states: int = STATES, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """``encoded`` has classes (little-endian 16 bits) and blocks of the training documents, ``unigram`` the classes' counts.

    Every round runs over all of them, until the log-likelihood gains less than TOLERANCE of itself.
    """
    model, before = first_model(unigram, states, seed), -np.inf
    rows = [encoded.filter(F.col("block") == k).select("classes") for k in range(BLOCKS)]
    shape = (2 + states + _CLASSES, states)
    # Before a block's turn its counts are its share of those of the first model.
    each = unigram.sum() / states
    parts = [_packed(model.start * unigram[0], model.move * each, model.emit[:-1] * each, 0.0) / BLOCKS] * BLOCKS
    for turn in range(rounds * BLOCKS):

        def of(batches, model=model) -> np.ndarray:
            out = np.zeros(shape)
            held: list[np.ndarray] = []
            size = 0

            def add() -> None:
                for windows, first in batched(held):
                    out.__iadd__(_packed(*expected(model, windows, first)))

            for b in batches:
                for x in b.column(0).to_pylist():
                    held.append(np.frombuffer(x, "<u2"))
                    size += len(held[-1])
                    if size > HELD:
                        add()
                        held.clear()
                        size = 0
            add()
            return out

        parts[turn % BLOCKS] = partition_sum(rows[turn % BLOCKS], shape, of)
        s = np.sum(parts, 0)
        model = Model.from_counts(s[0], s[1 : 1 + states], s[1 + states : -1])
        if turn % BLOCKS == BLOCKS - 1:
            likelihood = s[-1, 0]
            if likelihood - before <= TOLERANCE * abs(likelihood):
                break
            before = likelihood
    return model


def forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of each class sequence's probability: the scaled forward recursion, all sequences in step."""
    out = np.zeros(len(sequences))
    if not sequences:
        return out
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    lengths = np.array([len(sequences[i]) for i in order])
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    flat = np.concatenate([sequences[i] for i in order])
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # how many are longer than t
    x = np.broadcast_to(model.start, (len(order), len(model.start)))
    total = np.zeros(len(order))
    for t, n in enumerate(active.tolist()):
        x = x[:n] * model.emit[flat[starts[:n] + t]]
        s = x.sum(1)
        total[:n] += np.log10(s)
        x = (x / s[:, None]) @ model.move
    out[order] = total
    return out


def encode(docs: DataFrame, id_col: str, text_col: str, dictionary: tuple[np.ndarray, np.ndarray, np.ndarray], divisor: int, remainder: int) -> DataFrame:
    """Each document as classes; sums over its dictionary words; its other words, each once with its count; its block (-1 if held out).  Materialised, a folder for each block.

    ``dictionary``: ids, counts and classes of the most frequent words, by id.
    """
    ids, counts, classes = dictionary
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, known long, log_all double, log_shared double, classes binary, rare array<long>, times array<int>, block int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = np.argsort(ids)
        in_order = ids[by_id]
        log = np.log10(counts + 1.0)
        end = np.flatnonzero(ids == END)
        end_log, end_known = (float(log[end[0]]), 1) if len(end) else (0.0, 0)
        # The number of a word: its place in the dictionary, or beyond it a place in ``others``, which holds what ``cache`` has.
        cache: dict[bytes, int] = {}
        others = np.zeros(0, np.int64), np.zeros(0, np.int64)
        uid = TaskContext.get().partitionId() << 40

        def numbers(words: list[bytes]) -> np.ndarray:
            nonlocal others
            if len(cache) > 300_000:
                cache.clear()
                others = others[0][:0], others[1][:0]
            got = np.fromiter(map(cache.get, words, repeat(-1)), np.int64, len(words))
            missed = np.flatnonzero(got < 0).tolist()
            if missed:
                new = list({words[i]: None for i in missed})
                found, shared = hashed(new)
                at = np.minimum(np.searchsorted(in_order, found), max(0, len(ids) - 1))
                inside = in_order[at] == found if len(ids) else np.zeros(len(new), bool)
                number = np.empty(len(new), np.int64)
                number[inside] = by_id[at[inside]]
                number[~inside] = len(ids) + len(others[0]) + np.arange((~inside).sum())
                others = np.r_[others[0], found[~inside]], np.r_[others[1], shared[~inside]]
                cache.update(zip(new, number.tolist(), strict=True))
                got[missed] = np.fromiter((cache[words[i]] for i in missed), np.int64, len(missed))
                for w in new:
                    if len(w) > 64:
                        del cache[w]
            return got

        def encoded(doc_ids: list, held: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            nonlocal uid
            many, lengths = len(texts), np.fromiter(map(len, texts), np.int64, len(texts))
            number = numbers(list(chain.from_iterable(texts)))
            doc = np.repeat(np.arange(many), lengths)
            known = number < len(ids)
            cls = np.zeros(len(number) + many, "<u2")  # the end of each document is 0
            cls[np.arange(len(number)) + doc] = np.r_[classes, others[1]][number]
            ends = np.r_[0, np.cumsum(lengths + 1)]
            data = memoryview(cls).cast("B")
            block = [-1 if h else zlib.crc32(data[2 * a : 2 * b]) % BLOCKS for h, a, b in zip(held, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            k, of = number[known], doc[known]
            under = classes[k] >= OWN
            log_all = np.bincount(of, log[k], many) + end_log
            log_shared = np.bincount(of[under], log[k[under]], many) + 0.0  # whole numbers where nothing is counted
            # Other words by document and id, each once with its count.
            rare, of = others[0][number[~known] - len(ids)], doc[~known]
            order = np.lexsort((rare, of))
            rare, of = rare[order], of[order]
            at = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])]) if len(rare) else np.zeros(0, np.int64)
            times = np.diff(np.r_[at, len(rare)]).astype(np.int32)
            offsets = pa.array(np.searchsorted(of[at], np.arange(many + 1)).astype(np.int32))
            columns = [
                pa.array(uid + 1 + np.arange(many)), pa.array(doc_ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(lengths + 1), pa.array(np.bincount(doc[known], minlength=many) + end_known), pa.array(log_all), pa.array(log_shared),
                pa.Array.from_buffers(pa.binary(), many, [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(cls)]), pa.ListArray.from_arrays(offsets, pa.array(rare[at])), pa.ListArray.from_arrays(offsets, pa.array(times)), pa.array(block, pa.int32()),
            ]
            uid += many
            return pa.RecordBatch.from_arrays(columns, names=[x.strip().split(" ")[0] for x in schema.split(",")])

        for b in batches:
            doc_ids, texts, held = (c.to_pylist() for c in b.columns)
            a, size, words = 0, 0, []
            for i, text in enumerate(texts):
                words.append(text.lower().split())
                size += len(words[-1]) + 1
                if size > 50_000 or i == len(texts) - 1:
                    yield encoded(doc_ids[a : i + 1], held[a : i + 1], words)
                    a, size, words = i + 1, 0, []

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"), held_out(F.col(f"`{id_col}`"), divisor, remainder).alias("held"))
    return materialize(src.mapInArrow(lean(run), schema), "hmm-encoded", "block")


def most_frequent(words: DataFrame, most: int):
    """word, class, n of the most frequent words, by n and word: all whose count is in the upper classes of a
    histogram of counts (64 to an octave) that hold ``most`` words or fewer.  So no task sends more either."""
    level = F.floor(F.log2("n") * 64).cast("int")
    histogram = words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # a few thousand rows
    held, least = 0, None
    for r in histogram:
        held += r["count"]
        if held > most:
            break
        least = r.level
    top = words.filter(level >= (least if least is not None else 1 << 30)).select("word", "class", "n").toPandas()
    return top.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR, remainder: int = REMAINDER, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are told apart by a 64-bit hash.  Null text counts as empty: one token, the end.  Rows with
    crc32(id as text) mod ``divisor`` = ``remainder`` are scored but not learned from; a null id counts as
    the empty text there.  Repeated rows are learned from and scored each.  Without training rows there are
    no counts and base scores are 0.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    words = count_words(docs.filter(~held_out(F.col(f"`{id_col}`"), divisor, remainder)), text_col)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, v_all = int(total.n), int(total.v)
    top = most_frequent(words.filter(F.col("word") != END), DICTIONARY)
    end = words.filter(F.col("word") == END).select("n").first()
    ids = np.r_[np.array([END] if end else [], np.int64), top["word"].to_numpy(np.int64)]
    counts = np.r_[np.array([end.n] if end else [], float), top["n"].to_numpy(float)]
    # The end is class 0, the most frequent words are classes 1 to OWN - 1.
    own = np.arange(len(top)) + 1
    classes = np.r_[np.zeros(1 if end else 0, np.int64), np.where(own < OWN, own, top["class"].to_numpy(np.int64))]
    by = words.filter(F.col("word") != END).groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()  # at most SHARED rows
    mass = np.ones(_CLASSES)
    np.add.at(mass, by["class"].to_numpy(np.int64), by["n"].to_numpy(float) + by["v"].to_numpy(float))
    first = top.iloc[: OWN - 1]
    np.subtract.at(mass, first["class"].to_numpy(np.int64), first["n"].to_numpy(float) + 1)
    unigram = np.zeros(_CLASSES)
    np.add.at(unigram, by["class"].to_numpy(np.int64), by["n"].to_numpy(float))
    np.subtract.at(unigram, first["class"].to_numpy(np.int64), first["n"].to_numpy(float))
    unigram[1 : 1 + len(first)] = first["n"].to_numpy(float)
    unigram[0] = end.n if end else 0
    log_mass = np.where(np.arange(_CLASSES) < OWN, 0.0, np.log10(mass))

    encoded = encode(docs, id_col, text_col, (ids, counts, classes), divisor, remainder)
    model = train(encoded, unigram, states, rounds)

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, known long, log_all double, log_classes double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                seq = [np.frombuffer(x, "<u2").astype(np.int64) for x in b.column(7).to_pylist()]
                lengths = np.array([len(s) for s in seq])
                under = np.add.reduceat(log_mass[np.concatenate(seq)], np.r_[0, np.cumsum(lengths)[:-1]])
                got = forward(model, seq) - under + b.column(6).to_numpy()
                yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(got)], names=[x.strip().split(" ")[0] for x in schema.split(",")])

    main = encoded.drop("rare", "times", "block").mapInArrow(lean(run), schema)
    asked = encoded.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    sums = asked.join(words.select("word", "n"), "word").groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_log"), F.sum("times").alias("rare_known"))
    rare = F.coalesce("rare_log", F.lit(0.0))
    return main.join(sums, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("log_all") + rare - F.col("n_tokens") * F.lit(float(np.log10(n_all + v_all + 1)))).alias("base_score"), (F.col("log_classes") + rare).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_documents(spark, sf_dir))
