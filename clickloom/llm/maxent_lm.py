"""Hashed maximum-entropy language model: n-gram and skip features, a class-factored softmax, distributed gradient updates.

A word's probability is P(class | context) * P(leaf | class, context) * P(word | leaf). The two softmaxes read hashed
features: the word before, the pair before, and the word before that (a skip). Frequent words are leaves of their own; any
other word belongs to the leaf of its first bytes, within which its probability is its smoothed count. Each task
makes its own pass of mini-batch updates from the common weights, and the tasks' updates are averaged feature by feature.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .arrow import map_batches

_FNV = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LmParams:
    """classes, members: leaves are classes * members, half of them single words. frequent: words (of at most word_bytes) whose ids all
    tasks know; counts of all others are joined. contexts: hashed rows of one word of context. pairs: of two words. inner: of word and class.
    rate: of the updates. batch: tokens in one. block: feature rows that are averaged together. fan_in: tasks whose blocks are merged first."""

    classes: int = 32
    members: int = 32
    frequent: int = 1 << 17
    word_bytes: int = 64
    contexts: int = 1 << 13
    pairs: int = 1 << 14
    inner: int = 1 << 14
    rate: float = 0.25
    batch: int = 2048
    block: int = 256
    fan_in: int = 64
    flush: int = 400_000

    @property
    def leaves(self) -> int:
        return self.classes * self.members

    @property
    def rows(self) -> int:
        """Of the class weights: contexts for the word before, contexts for the skip, pairs."""
        return 2 * self.contexts + self.pairs


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 1 by 5; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(text: bytes | None) -> list[bytes]:
    """Words split at 0x09-0x0D and 0x20, A-Z lower-cased; the end, an empty word, closes a text."""
    return [*(text or b"").lower().split(), b""]


def token_counts(train: DataFrame, p: LmParams) -> DataFrame:
    """(word, c) of train(text): each task counts what it reads, emptying its counter at `flush` words, and the counts are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                held.update(tokens(text.as_py()))
                if len(held) > p.flush:
                    yield _counted(held)
                    held.clear()
        yield _counted(held)

    return map_batches(train.select("text"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])


def _prefix_leaf(word: Column, p: LmParams) -> Column:
    """The leaf of a word that isn't a leaf of its own: by its first three bytes."""
    half = p.leaves // 2
    return (F.lit(half) + F.crc32(F.substring(word, 1, 3)) % (p.leaves - half)).cast("int")


@dataclass
class Vocabulary:
    """The frequent words' numbers (by falling count), counts and leaves, and each leaf's log10 denominator."""

    number: dict[bytes, int]
    count: np.ndarray
    leaf: np.ndarray
    denominator: np.ndarray
    mass: np.ndarray
    total: int
    distinct: int

    def log_unigram_total(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))


def vocabulary(counts: DataFrame, p: LmParams) -> Vocabulary:
    """What all tasks need of the counts; its size is bounded by `frequent` words of `word_bytes` and the leaves."""
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.filter(F.length("word") <= p.word_bytes).orderBy(F.desc("c"), "word").limit(p.frequent).toArrow()
    words, c = top["word"].to_pylist(), top["c"].to_numpy().astype(np.int64)
    half = p.leaves // 2
    leaf = np.array([i if i < half else half + zlib.crc32(w[:3]) % (p.leaves - half) for i, w in enumerate(words)], np.int32)
    own = counts.sparkSession.createDataFrame([(bytearray(w),) for w in words[:half]], "word binary")
    mass, kinds = np.zeros(p.leaves), np.zeros(p.leaves)
    mass[: len(words[:half])], kinds[: len(words[:half])] = c[:half], 1
    for r in counts.join(F.broadcast(own), "word", "left_anti").groupBy(_prefix_leaf(F.col("word"), p).alias("leaf")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        mass[r["leaf"]], kinds[r["leaf"]] = r["c"], r["n"]
    denominator = np.log10(mass + 0.5 * (kinds + 1))
    single = np.arange(p.leaves) < half
    denominator[single] = np.log10(np.maximum(mass[single] + 0.5, 0.5))
    return Vocabulary({w: i for i, w in enumerate(words)}, c, leaf, denominator, mass, row["n"], row["v"])


def _digits(text: bytes, v: Vocabulary, p: LmParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of a text's tokens: numbers (-1: not frequent), leaves, hashes for contexts, and the words that aren't frequent."""
    said = tokens(text)
    number = np.fromiter(map(v.number.get, said, repeat(-1)), np.int64, len(said))
    leaf = v.leaf[number] if len(v.leaf) else np.zeros(len(said), np.int32)
    rare = np.flatnonzero(number < 0)
    own = [said[i] for i in rare]
    half, others = p.leaves // 2, p.leaves - p.leaves // 2
    crc = zlib.crc32
    leaf[rare] = [half + crc(w[:3]) % others for w in own]
    # A context word is itself among the first words, else its leaf.
    first = p.contexts - p.leaves - 1
    context = np.where((number >= 0) & (number < first), number, first + leaf)
    return number, leaf, context, own


def _features(contexts: list[np.ndarray], p: LmParams) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the class weights for each token (one column a feature), and the word before, for the inner weights."""
    start = p.contexts - 1
    before, second = [], []
    for c in contexts:
        padded = np.concatenate([[start, start], c])
        before.append(padded[1:-1])
        second.append(padded[:-2])
    one, two = np.concatenate(before).astype(np.uint64), np.concatenate(second).astype(np.uint64)
    pair = ((one * np.uint64(p.contexts) + two) * _FNV >> np.uint64(40)) % np.uint64(p.pairs)
    rows = np.stack([one, np.uint64(p.contexts) + two, np.uint64(2 * p.contexts) + pair], 1).astype(np.int64)
    return rows, one


def _inner_rows(before: np.ndarray, cls: np.ndarray, p: LmParams) -> np.ndarray:
    return (((before * np.uint64(p.classes) + cls.astype(np.uint64)) * _FNV >> np.uint64(40)) % np.uint64(p.inner)).astype(np.int64)


@dataclass
class Weights:
    """outer: feature rows by class. inner: rows of word and class by member. The biases are the logs of the training masses."""

    outer: np.ndarray
    inner: np.ndarray
    class_bias: np.ndarray
    member_bias: np.ndarray


def first_weights(v: Vocabulary, p: LmParams) -> Weights:
    mass = (v.mass + 0.5).reshape(p.classes, p.members)
    return Weights(np.zeros((p.rows, p.classes), np.float32), np.zeros((p.inner, p.members), np.float32), np.log(mass.sum(1) / mass.sum()).astype(np.float32), np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32))


def _odds(w: Weights, rows: np.ndarray, before: np.ndarray, cls: np.ndarray, p: LmParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of all classes and of the class's members, and the rows of the inner weights; held within 60, which sums of a few bounded updates don't reach."""
    outer = np.take(w.outer, rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        outer += np.take(w.outer, rows[:, k], axis=0)
    outer += w.class_bias
    inner_rows = _inner_rows(before, cls, p)
    inner = np.take(w.inner, inner_rows, axis=0)
    inner += np.take(w.member_bias, cls, axis=0)
    for odds in (outer, inner):
        np.clip(odds, -60, 60, out=odds)
    return outer, inner, inner_rows


def _row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)


def _log_probability(w: Weights, rows: np.ndarray, before: np.ndarray, leaf: np.ndarray, p: LmParams) -> np.ndarray:
    """log10 P(leaf | context) of each token."""
    cls, at = leaf // p.members, np.arange(len(leaf))
    outer, inner, _ = _odds(w, rows, before, cls, p)
    own = outer[at, cls].astype(np.float64) + inner[at, leaf % p.members]
    for odds in (outer, inner):
        own -= np.log(_row_sums(np.exp(odds, out=odds)).astype(np.float64))
    return own / np.log(10)


def _gradients(w: Weights, rows: np.ndarray, before: np.ndarray, leaf: np.ndarray, p: LmParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log probability by the odds: what occurred less what was expected, for classes and members."""
    cls, at = leaf // p.members, np.arange(len(leaf))
    outer, inner, inner_rows = _odds(w, rows, before, cls, p)
    for odds, own in ((outer, cls), (inner, leaf % p.members)):
        np.exp(odds, out=odds)
        odds /= -_row_sums(odds)[:, None]
        odds[at, own] += 1
    return outer, inner, inner_rows


def _push(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """Add each row's summed gradient, over the root of its occurrences, to the table."""
    order = np.argsort(rows.astype(np.uint16) if len(table) <= 1 << 16 else rows, kind="stable")  # 16 bits are sorted by radix
    ranked = rows[order]
    edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    n = np.diff(np.concatenate([edge, [len(ranked)]]))
    own = ranked[edge]
    seen[own] += n
    alone = n == 1
    table[own[alone]] += rate * gradient[order[edge[alone]]]
    if not alone.all():
        several = np.flatnonzero(~alone)
        shared = np.repeat(~alone, n)
        starts = np.concatenate([[0], np.cumsum(n[several])[:-1]])
        sums = np.add.reduceat(gradient[order[shared]], starts, axis=0)
        table[own[several]] += sums * (rate / np.sqrt(n[several])).astype(np.float32)[:, None]


def _update(w: Weights, seen: tuple[np.ndarray, np.ndarray], rows: np.ndarray, before: np.ndarray, leaf: np.ndarray, p: LmParams) -> None:
    outer, inner, inner_rows = _gradients(w, rows, before, leaf, p)
    for k in range(rows.shape[1]):
        _push(w.outer, seen[0], rows[:, k], outer, p.rate)
    _push(w.inner, seen[1], inner_rows, inner, p.rate)


def _batched(texts: Iterator[bytes], v: Vocabulary, p: LmParams) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts' digits gathered to about `batch` tokens, with features."""
    held, n = [], 0
    for text in texts:
        held.append(_digits(text, v, p))
        n += len(held[-1][0])
        if n >= p.batch:
            yield held, *_features([h[2] for h in held], p), np.concatenate([h[1] for h in held])
            held, n = [], 0
    if held:
        yield held, *_features([h[2] for h in held], p), np.concatenate([h[1] for h in held])


def train(docs: DataFrame, v: Vocabulary, p: LmParams) -> Weights:
    """One pass over all training texts: every task updates its own copy of the weights, and rows are averaged by their occurrences."""
    spark = docs.sparkSession
    start = first_weights(v, p)
    shared = spark.sparkContext.broadcast((v, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w = shared.value
        w = Weights(w.outer.copy(), w.inner.copy(), w.class_bias, w.member_bias)
        seen = (np.zeros(p.rows, np.int64), np.zeros(p.inner, np.int64))
        texts = (t.as_py() for batch in batches for t in batch.column(0).cast(pa.binary()))
        for _, rows, before, leaf in _batched(texts, words, p):
            for lo in range(0, len(leaf), p.batch):
                _update(w, seen, rows[lo : lo + p.batch], before[lo : lo + p.batch], leaf[lo : lo + p.batch], p)
        for table, n, name in ((w.outer, seen[0], 0), (w.inner, seen[1], 1)):
            for b in range(0, len(table), p.block):
                count = n[b : b + p.block]
                on = np.flatnonzero(count)
                if len(on):
                    weighted = table[b : b + p.block][on] * count[on, None]
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([b], pa.int32()), pa.array([on.astype(np.int32).tobytes()], pa.binary()), pa.array([count[on].astype(np.float64).tobytes()], pa.binary()), pa.array([weighted.astype(np.float32).tobytes()], pa.binary())], _BLOCK)

    parts = map_batches(docs.select("text"), run, _PART)
    # Blocks are merged in two steps, so that no merger reads more than the blocks of fan_in tasks and then one for each such group.
    near = parts.withColumn("g", F.floor(F.spark_partition_id() / p.fan_in).cast("int"))
    few = map_batches(near.repartition("t", "b", "g").sortWithinPartitions("t", "b"), _merger(p), _PART)
    merged = map_batches(few.repartition("t", "b").sortWithinPartitions("t", "b"), _merger(p), _PART)
    out = Weights(start.outer.copy(), start.inner.copy(), start.class_bias, start.member_bias)
    for r in merged.toLocalIterator():
        rows, n = np.frombuffer(r["rows"], np.int32), np.frombuffer(r["n"], np.float64)
        table = (out.outer, out.inner)[r["t"]]
        table[r["b"] + rows] = np.frombuffer(r["w"], np.float32).reshape(len(rows), -1) / n[:, None]
    return out


_PART = "t int, b int, rows binary, n binary, w binary"
_BLOCK = [x.split()[0] for x in _PART.split(", ")]


def _merger(p: LmParams):
    """Sums sorted rows of one block as they stream past."""
    width = {0: p.classes, 1: p.members}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, w = None, None, None

        def closed() -> pa.RecordBatch:
            on = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([on.astype(np.int32).tobytes()], pa.binary()), pa.array([n[on].tobytes()], pa.binary()), pa.array([w[on].astype(np.float32).tobytes()], pa.binary())], _BLOCK)

        for batch in batches:
            for i in range(batch.num_rows):
                t, b, rows, count, own = (batch.column(c)[i].as_py() for c in range(5))
                if (t, b) != key:
                    if key is not None:
                        yield closed()
                    key, n, w = (t, b), np.zeros(p.block), np.zeros((p.block, width[t]))
                at = np.frombuffer(rows, np.int32)
                n[at] += np.frombuffer(count, np.float64)
                w[at] += np.frombuffer(own, np.float32).reshape(len(at), -1)
        if key is not None:
            yield closed()

    return run


_SCORED = "row long, doc_id long, n_tokens long, known long, base double, model double, rare array<binary>"


def _partial_scores(docs: DataFrame, v: Vocabulary, w: Weights, p: LmParams) -> DataFrame:
    """What is known of each text without the counts of its rare words, which are listed."""
    shared = docs.sparkSession.sparkContext.broadcast((v, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, weights = shared.value
        log_count = np.log10(words.count + 0.5) if len(words.count) else np.zeros(1)
        single = p.leaves // 2
        unigram_total = words.log_unigram_total()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            texts = (t.as_py() for t in batch.column(1).cast(pa.binary()))
            at = 0
            for held, rows, before, leaf in _batched(texts, words, p):
                model = np.empty(len(leaf))
                for lo in range(0, len(leaf), p.batch):
                    part = slice(lo, lo + p.batch)
                    model[part] = _log_probability(weights, rows[part], before[part], leaf[part], p)
                number = np.concatenate([h[0] for h in held])
                known = np.where(number >= 0, log_count[number], 0.0)
                within = np.where(leaf < single, 0.0, known - words.denominator[leaf])
                edge = np.concatenate([[0], np.cumsum([len(h[0]) for h in held])])
                total = [np.concatenate([[0.0], np.cumsum(x)]) for x in (known - unigram_total, model + within, (number >= 0).astype(np.float64))]
                base, score, sure = (x[edge[1:]] - x[edge[:-1]] for x in total)
                n = len(held)
                rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(h[3]) for h in held])]), pa.int32()), pa.array([x for h in held for x in h[3]], pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), ids.slice(at, n), pa.array(np.diff(edge)), pa.array(np.rint(sure).astype(np.int64)), pa.array(base), pa.array(score), rare], [x.split()[0] for x in _SCORED.split(", ")])
                at += n
                row += n

    return map_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, _SCORED)


def score_documents(docs: DataFrame, params: LmParams | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The counts and the weights come from the rows whose crc32(doc_id) mod 5 isn't 1 (so rows with a null doc_id learn, too);
    a null text counts as empty, one end token. base_score is the smoothed unigram log10 probability, score the model's, over
    the same tokens and one unknown word for each leaf. Repeated rows count each; other columns aren't read; an empty table gives
    no rows, and without training rows every word is unknown. The rare words of all texts are joined with their exact counts.
    """
    p = params or LmParams()
    own = docs.select("doc_id", "text")
    training = own.filter(~held_out(F.col("doc_id")))
    counts = stored(token_counts(training, p), "token-counts")
    v = vocabulary(counts, p)
    weights = train(training, v, p)
    parts = stored(_partial_scores(own, v, weights, p), "partial-scores")
    words = parts.select("row", F.explode("rare").alias("word"))
    seen = words.join(counts, "word", "left")
    rest = seen.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("__log"), F.count("c").alias("__known"))
    # Each rare word lacks log10(count + 0.5) in both sums; its denominators are in already.
    out = parts.drop("rare").join(rest, "row", "left")
    log = F.coalesce("__log", F.lit(0.0))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("__known", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base") + log).alias("base_score"), (F.col("model") + log).alias("score"))
