"""Maximum inner product search: score-aware (anisotropic) product codes of four bits, table scans, reranking by exact products within a residual bound."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .arrow import map_batches


@dataclass(frozen=True)
class AnnParams:
    """neighbours: of a query. width: dimensions of a subspace. eta: weight of the residual's part parallel to the vector against the part
    across it. sample: vectors that the codebooks are fitted on, the first by a hash of their id; all rows are coded. rerank: of each query and
    block, the vectors whose exact products are computed first; they bound which others have to be. block: rows of a table scan. queries: at a time."""

    neighbours: int = 20
    width: int = 2
    eta: float = 4.0
    sample: int = 8192
    rounds: int = 6
    rerank: int = 200
    block: int = 16384
    queries: int = 4096
    at_once: int = 64
    seed: int = 3


def fit_codebooks(x: np.ndarray, p: AnnParams) -> np.ndarray:
    """(subspaces, 16, width) centres that minimise |r|^2 + (eta - 1) * (r . x / |x|)^2 over the sample's residuals r."""
    rng = np.random.default_rng(p.seed)
    subspaces = x.shape[1] // p.width
    parts = x.reshape(len(x), subspaces, p.width)
    books = parts[rng.integers(0, len(x), 16)].transpose(1, 0, 2).copy()
    along = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(parts.shape)
    codes = encode(x, books, p)
    for _ in range(p.rounds):
        for s in range(subspaces):
            r = parts - np.take_along_axis(books[None], codes[:, :, None, None], 2)[:, :, 0]
            others = np.einsum("nsd,nsd->n", r, along) - np.einsum("nd,nd->n", r[:, s], along[:, s])
            u = along[:, s]
            left = np.eye(p.width) + (p.eta - 1) * u[:, :, None] * u[:, None, :]
            right = parts[:, s] + (p.eta - 1) * u * (others + np.einsum("nd,nd->n", parts[:, s], u))[:, None]
            for c in range(16):
                own = codes[:, s] == c
                if own.any():
                    books[s, c] = np.linalg.solve(left[own].sum(0), right[own].sum(0))
        codes = encode(x, books, p, codes)
    return books


def encode(x: np.ndarray, books: np.ndarray, p: AnnParams, codes: np.ndarray | None = None, sweeps: int = 2) -> np.ndarray:
    """Four-bit codes by coordinate descent: each subspace in turn takes the centre of least score-aware loss, given the others."""
    subspaces = books.shape[0]
    parts = x.reshape(len(x), subspaces, p.width)
    along = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(parts.shape)
    plain = ((parts[:, :, None] - books[None]) ** 2).sum(3)
    lost = np.einsum("nsd,nscd->nsc", along, parts[:, :, None] - books[None])
    codes = plain.argmin(2) if codes is None else codes.copy()
    at = np.arange(len(x))
    total = np.take_along_axis(lost, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for s in range(subspaces):
            rest = total - lost[at, s, codes[:, s]]
            codes[:, s] = (plain[:, s] + (p.eta - 1) * (rest[:, None] + lost[:, s]) ** 2).argmin(1)
            total = rest + lost[at, s, codes[:, s]]
    return codes


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes in a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), codes.dtype)], 1)
    return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)


def pair_tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """For each query, the scores of all 256 values of each byte of codes."""
    subspaces = books.shape[0]
    one = np.einsum("qsd,scd->qsc", q.reshape(len(q), subspaces, -1), books)
    if subspaces % 2:
        one = np.concatenate([one, np.zeros((len(q), 1, 16))], 1)
    return (one[:, 0::2, None, :] + one[:, 1::2, :, None]).reshape(len(q), one.shape[1] // 2, 256).astype(np.float32)


def scan(q: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Approximate products of queries and coded rows, by one table look-up for each byte."""
    tables, out = pair_tables(q, books), np.zeros((len(q), len(codes)), np.float32)
    columns = np.ascontiguousarray(codes.T).astype(np.intp)
    for s in range(codes.shape[1]):
        out += np.take(tables[:, s], columns[s], axis=1)
    return out


def best_places(scores: np.ndarray, n: int) -> np.ndarray:
    """The places of the n largest scores; of equal ones at the end, the first places."""
    if len(scores) <= n:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - n)[len(scores) - n]
    over = np.flatnonzero(scores > least)
    return np.concatenate([over, np.flatnonzero(scores == least)[: n - len(over)]])


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, books: np.ndarray, p: AnnParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the best rows of a block by exact products; rows are sorted by id, codes are one a subspace.

    A product differs from its code score by |q| times the row's residual norm at most. So the rows of best code scores give a product
    that the last neighbour has at least, and all rows that may reach it are read, by one matrix product where they are many.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    centres = books[np.arange(len(books)), codes].reshape(x.shape)
    off, lengths, columns = np.linalg.norm(x - centres, axis=1), np.linalg.norm(q, axis=1), packed(codes)
    # What sums of single and double precision may be off by, for a query of length one.
    single = 1.2e-7 * (columns.shape[1] + 4) * np.linalg.norm(centres, axis=1).max()
    double = 4 * 2.3e-16 * x.shape[1] * np.linalg.norm(x, axis=1).max()
    for lo in range(0, len(q), p.at_once):
        asked = q[lo : lo + p.at_once]
        near, places, many = scan(asked, columns, books), [], []
        for i, row in enumerate(near):
            at = best_places(row, p.rerank)
            if len(at) < len(ids):
                exact = (x[at] * asked[i]).sum(1)[ids[at] != q_ids[lo + i]]
                if len(exact) >= p.neighbours:
                    least = np.partition(exact, len(exact) - p.neighbours)[len(exact) - p.neighbours]
                    at = np.flatnonzero(~(row + lengths[lo + i] * (off + single + double) < least))
                else:
                    at = np.arange(len(ids))
            if len(at) > p.rerank:
                many.append(i)
            places.append(at)
        whole = asked[many] @ x.T
        for i, products in zip(many, whole, strict=True):
            products[ids == q_ids[lo + i]] = -np.inf
            n = min(p.neighbours, len(products))
            least = np.partition(products, len(products) - n)[len(products) - n]
            places[i] = np.flatnonzero(products >= least - 2 * double * lengths[lo + i])
        for i, at in enumerate(places):
            own = q_ids[lo + i]
            at = at[ids[at] != own]
            exact = (x[at] * q[lo + i]).sum(1)  # row by row, so that equal vectors tie
            order = np.lexsort((ids[at], -exact))[: p.neighbours]
            out.append((np.full(len(order), own), ids[at][order], exact[order]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3))


def nearest(embeddings: DataFrame, params: AnnParams | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of embeddings(vec_id, embedding) whose vec_id is divisible by 20, its nearest others.

    Nearness is the largest inner product of the vectors in double precision, ties to the smaller vec_id; rank counts from 1. Rows with a
    null vec_id, and vectors that are null, empty, zero, or hold null or non-finite components, take no part; nor do
    vectors of another length than the most common one (the longest of equally common ones). Rows that share a vec_id are one row, the
    one with the largest vector. Other columns aren't read; an empty table gives no rows.

    Rows are dealt to blocks of about `block`; each block meets the queries in groups of `queries`, scans its codes
    and reranks; a query's best of each block are merged. So no pair of rows is a row of any table.
    """
    p = params or AnnParams()
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id IS NOT NULL").filter(_usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, total = sizes[0]["d"], sizes[0]["n"]
    rows = rows.filter(F.size("v") == dim)
    if not rows.groupBy("vec_id").count().filter("count > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.max("v").alias("v"))
        total = rows.count()
    width = next(w for w in range(p.width, 0, -1) if dim % w == 0)
    p = AnnParams(**{**p.__dict__, "width": width})
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample).select("v").toArrow()
    books = fit_codebooks(np.array(sample["v"].to_pylist(), np.float64), p)
    shared = spark.sparkContext.broadcast(books)
    blocks = -(-total // p.block)
    asked = rows.filter(F.col("vec_id") % 20 == 0)
    groups = max(1, -(-asked.count() // p.queries))
    side = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    block = F.pmod(F.xxhash64("v", "vec_id"), F.lit(blocks)).cast("int")
    data = rows.withColumn("block", block).withColumn("kind", F.lit(1)).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    questions = asked.withColumn("side", side).withColumn("kind", F.lit(0)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    names = ["block", "side", "kind", "vec_id", "v"]
    stream = questions.select(names).unionByName(data.select(names)).repartition("block", "side").sortWithinPartitions("block", "side", "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for ids, x, kind in _cells(batches, dim):
            asks, own = kind == 0, kind == 1
            if not asks.any() or not own.any():
                continue
            codes = encode(x[own], centres, p)
            q, i, score = _search_block(ids[asks], x[asks], ids[own], x[own], codes, centres, p)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(score)], ["query_id", "vec_id", "score"])

    found = stored(map_batches(stream, run, "query_id long, vec_id long, score double"), "nearest-by-block")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, p.neighbours)
    merged = found.groupBy("query_id").agg(best.alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def _cells(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, kinds) of each run of rows with one (block, side)."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    key = None

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate([h[c] for h in held]) for c in range(3))

    for batch in batches:
        block, side, kind, ids = (batch.column(c).to_numpy() for c in range(4))
        x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        edge = np.flatnonzero((block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
        for lo, hi in zip([0, *edge], [*edge, len(ids)], strict=True):
            if hi == lo:
                continue
            if key is not None and key != (block[lo], side[lo]):
                yield joined()
                held = []
            key = (block[lo], side[lo])
            held.append((ids[lo:hi], x[lo:hi], kind[lo:hi]))
    if held:
        yield joined()
