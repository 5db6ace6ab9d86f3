"""Quality classifier: supervised subword embeddings averaged per document, a softmax over two labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, release
from .wordhash import chunks, mix, word_hashes, words

_K = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class QualityParams:
    """buckets: of hashed words and n-grams (a power of two). dim: of a vector. grams: lengths of character n-grams, in bytes.
    steps: mini-batches of `batch` documents, over as many passes as that takes. rate: falls from it to 0.
    train_docs, train_chars: at most so many labelled documents, of so many characters together, are learned from, the first by a hash
    of their doc_id; scoring reads every whole text. threshold: least score of an accepted document."""

    buckets: int = 1 << 16
    dim: int = 8
    grams: tuple[int, ...] = (3, 4)
    steps: int = 1000
    rate: float = 0.5
    batch: int = 32
    seed: int = 5
    train_docs: int = 3000
    train_chars: int = 40_000_000
    threshold: float = 0.3


def features(texts: list[bytes], p: QualityParams) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, buckets, texts' offsets) for ranges of texts: n-grams, words, and pairs of neighbouring words
    that are equal, all hashed; an empty text has none."""
    mask = np.uint64(p.buckets - 1)
    for a, b in chunks(texts, 250_000):
        buf, starts, ends, first = words(texts[a:b])
        h = word_hashes(buf, starts, ends)
        lens = np.fromiter((len(t) + 1 for t in texts[a:b]), np.int64, b - a)
        edge = np.concatenate([[0], np.cumsum(lens)])
        wide = buf.astype(np.uint64) + np.uint64(1)
        parts = []
        for n in p.grams:
            rolled = np.zeros(max(0, len(wide) - n + 1), np.uint64)
            for j in range(n):
                rolled = rolled * np.uint64(0x100000001B3) ^ wide[j : j + len(rolled)]
            parts.append((rolled * _K >> np.uint64(40)) & mask)
        again = np.zeros(len(h), np.uint64)
        if len(h):
            again[1:] = np.where(h[1:] == h[:-1], np.uint64(1), np.uint64(2))
        ids, offsets = [], [0]
        for i in range(b - a):
            lo, hi = int(edge[i]), int(edge[i + 1]) - 1
            own = [g[lo : max(lo, hi - n + 1)] for g, n in zip(parts, p.grams, strict=True)]
            w = slice(int(first[i]), int(first[i + 1]))
            own += [h[w] >> np.uint64(20) & mask, mix(again[w.start + 1 : w.stop]) & mask]
            ids.append(np.concatenate(own))
            offsets.append(offsets[-1] + len(ids[-1]))
        yield a, np.concatenate(ids).astype(np.int64), np.array(offsets)


def train(texts: list[bytes], labels: list[int], p: QualityParams) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent over mini-batches; returns each bucket's part of the log odds of label 1, and the bias.

    The softmax reads the average vector linearly, so that a bucket's vector times the output's difference is all that scoring needs.
    """
    rng = np.random.default_rng(p.seed)
    bags = []
    for _, ids, offsets in features(texts, p):
        bags += [np.unique(ids[lo:hi], return_counts=True) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
    y = np.array(labels, np.float64)
    vectors = (rng.random((p.dim, p.buckets)) - 0.5) * (2 / p.dim)
    out, bias = np.zeros((p.dim, 2)), np.zeros(2)
    for done in range(p.steps if bags else 0):
        at = done * p.batch % len(bags)
        if at < p.batch:
            order = rng.permutation(len(bags))
        rate = p.rate * (1 - done / p.steps)
        some = [i for i in order[at : at + p.batch] if len(bags[i][0])]
        if not some:
            continue
        ids = np.concatenate([bags[i][0] for i in some])
        share = np.concatenate([bags[i][1] / bags[i][1].sum() for i in some])
        edge = np.concatenate([[0], np.cumsum([len(bags[i][0]) for i in some])[:-1]])
        hidden = np.add.reduceat(vectors[:, ids] * share, edge, axis=1)
        odds = hidden.T @ out + bias
        prob = np.exp(odds - odds.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        error = np.stack([1 - y[some], y[some]], 1) - prob
        back = np.repeat(error @ out.T, np.diff([*edge, len(ids)]), axis=0) * share[:, None]
        out += rate * hidden @ error
        bias += rate * error.sum(0) / len(some)
        for d in range(p.dim):
            vectors[d] += rate * np.bincount(ids, back[:, d], p.buckets)
    return ((out[:, 1] - out[:, 0]) @ vectors).astype(np.float32), float(bias[1] - bias[0])


def held_out(doc_id: Column, remainder: int = 0) -> Column:
    """Whether crc32 of the doc_id as text leaves that remainder by 5; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, p: QualityParams) -> tuple[list[bytes], list[int]]:
    """At most train_docs labelled whole texts of docs, train_chars in all; of a doc_id with several labels or texts, the largest.

    They are the first by a hash of the doc_id among those that have a text in docs; one that doesn't fit into train_chars is passed over.
    """
    marks = labels.filter("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")).filter(~held_out(F.col("doc_id")))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(~held_out(F.col("doc_id")))
    sizes = own.select("doc_id", F.length("text").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n")).join(marks, "doc_id")
    first = sizes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.train_docs).collect()
    picked, total = [], 0
    for r in first:
        if total + r["n"] <= p.train_chars:
            picked.append((r["doc_id"], r["quality"]))
            total += r["n"]
    few = docs.sparkSession.createDataFrame(picked, "doc_id long, quality int")
    rows = own.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("quality").alias("quality")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"].encode() for r in rows], [r["quality"] for r in rows]


_SCHEMA = "doc_id long, score double"


def _score_batches(weights: np.ndarray, bias: float, p: QualityParams, texts: list[bytes]) -> np.ndarray:
    odds = np.full(len(texts), bias)
    for first, ids, offsets in features(texts, p):
        value = np.concatenate([[0.0], np.cumsum(weights[ids], dtype=np.float64)])
        n = np.diff(offsets)
        odds[first : first + len(n)] += (value[offsets[1:]] - value[offsets[:-1]]) / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _model(docs: DataFrame, labels: DataFrame, p: QualityParams):
    """The broadcast model; what the driver's Python needed for it is given back, as the driver stays for what follows."""
    model = train(*training_rows(docs, labels, p), p)
    release()
    return docs.sparkSession.sparkContext.broadcast(model)


def score_quality(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, score, predicted.

    The model learns from labels(doc_id, quality) of documents whose crc32(doc_id) mod 5 isn't 0; nothing but the text enters a score.
    A null text counts as empty and scores by the bias alone; without any labelled document every score is 0.5. Null and
    repeated doc_ids are returned as they are; labels other than 0 and 1 aren't used; other columns aren't read; an empty table
    gives no rows.
    """
    p = params or QualityParams()
    model = _model(docs, labels, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            scores = _score_batches(weights, bias, p, [t.as_py() for t in batch.column(1).cast(pa.binary())])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores)], ["doc_id", "score"])

    scored = map_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, _SCHEMA)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that the classifier accepts, with all their columns; texts are scored as they stream past.

    Null, empty and repeated rows are judged like any other, each by its text; without labelled documents every score is 0.5 and all
    rows stay; an empty table stays empty.
    """
    p = params or QualityParams()
    model = _model(docs, labels, p)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            scores = _score_batches(weights, bias, p, [t.as_py() or b"" for t in batch.column(at).cast(pa.binary())])
            yield batch.filter(pa.array(scores >= p.threshold))

    return map_batches(docs, run, docs.schema)
