"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning, exact verification, connected components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .arrow import map_batches
from .rows import numbered
from .skew import join_groups, salts
from .wordhash import mix, overlap, shingle_sets

#: Ids (8 bytes each) that are broadcast to pick texts; more of them are shuffled.
BROADCAST_IDS = 1_000_000
#: Members of a hub, or of one side of a bucket, that one task compares.
HUB_ROWS, BLOCK_ROWS = 250, 1024


@dataclass(frozen=True)
class NearDupParams:
    """words: of a shingle. percent: least 100 * intersection / union. bands, rows: of the signature; a pair at the threshold
    shares no band with probability (1 - (percent / 100) ** rows) ** bands, 5e-8 here. batch: hashes compared at a time. miss: a pair is
    pruned when the posterior probability that it reaches the threshold falls below this."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    batch: int = 32
    miss: float = 1e-6

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def least_matches(p: NearDupParams) -> list[tuple[int, int]]:
    """(hashes compared, least matches) for each batch: with fewer, P(similarity >= threshold) < miss.

    The prior of the similarity is uniform, so after m matches of n it is Beta(m + 1, n - m + 1).
    """
    x = (np.arange(200_000) + 0.5) / 200_000
    out = []
    for n in range(p.batch, p.hashes + 1, p.batch):
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log1p(-x) + math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n - m + 1)
            if np.exp(log[x >= p.percent / 100]).sum() / len(x) >= p.miss:
                out.append((n, m))
                break
    return out


def signatures(sets: list[np.ndarray], p: NearDupParams) -> tuple[np.ndarray, np.ndarray]:
    """For each non-empty set a row of `hashes` bytes, one of each min-wise hash, and a row of band keys.

    A band key is a 64-bit digest of the band's whole hashes, whose last bits are the band's number.
    """
    sizes = np.array([len(s) for s in sets])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    keys = mix(np.arange(1, 2 * p.hashes + 1, dtype=np.uint64))
    out = np.empty((len(sets), p.hashes), np.uint8)
    bands = np.zeros((len(sets), p.bands), np.uint64)
    for i in range(p.hashes):
        y = x * np.uint32(int(keys[2 * i]) & 0xFFFFFFFF | 1) + np.uint32(int(keys[2 * i + 1]) & 0xFFFFFFFF)
        least = np.minimum.reduceat(y, starts)
        out[:, i] = (least >> np.uint32(20)) ^ (least >> np.uint32(9)) ^ least
        bands[:, i // p.rows] = mix(bands[:, i // p.rows] + least + np.uint64(i + 1))
    low = np.uint64((1 << (p.bands - 1).bit_length()) - 1)
    return out, (bands & ~low | np.arange(p.bands, dtype=np.uint64)).view(np.int64)


def _lowered(texts: pa.Array) -> list[bytes]:
    """Texts as UTF-8 with A-Z in lower case; null is empty."""
    return [(t.as_py() or b"").lower() for t in texts.cast(pa.binary())]


_SETS = "row long, n_shingles long, digest binary, sig binary, bands binary"


def document_sets(rows: DataFrame, p: NearDupParams) -> DataFrame:
    """row, n_shingles, and of non-empty sets a 128-bit digest, the signature and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = shingle_sets(_lowered(part.column(1)), p.words)
                full = [i for i, s in enumerate(sets) if len(s)]
                digests: list = [None] * len(sets)
                sigs: list = [None] * len(sets)
                bands: list = [None] * len(sets)
                if full:
                    for i, row, own in zip(full, *signatures([sets[i] for i in full], p), strict=True):
                        sigs[i], bands[i] = row.tobytes(), own.tobytes()
                        digests[i] = np.array([mix(sets[i] ^ np.uint64(len(sets[i]))).sum(), mix(sets[i] + np.uint64(0x1234567)).sum()], np.uint64).tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.binary())], ["row", "n_shingles", "digest", "sig", "bands"])

    return map_batches(rows.select("row", F.coalesce("text", F.lit("")).alias("text")), run, _SETS)


def _survives(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two arrays of signatures aren't pruned; each batch is compared only for pairs that are left."""
    alive, matches, at = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in steps:
        matches = matches + (a[alive, at:n] == b[alive, at:n]).sum(1)
        on = matches >= least
        alive, matches, at = alive[on], matches[on], n
    return alive


def _pruned(pairs: DataFrame, hubs: DataFrame, nodes: DataFrame, p: NearDupParams) -> DataFrame:
    """The pairs(hub, id) that sequential Bayesian comparison of signatures leaves; hubs(hub, n) counts them, and a hub of many meets them where they are."""
    steps = least_matches(p)
    sig = nodes.select("id", "sig")
    of_hub = hubs.join(sig.select(F.col("id").alias("hub"), F.col("sig").alias("b")), "hub")
    both = join_groups(stored(pairs.join(sig.withColumnRenamed("sig", "a"), "id"), "signed-pairs"), of_hub, "hub", "n", pairs.count()).select("hub", "id", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, p.hashes) for c in (2, 3))
            alive = pa.array(_survives(a, b, steps))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(alive) for c in (0, 1)], ["hub", "id"])

    return map_batches(both, run, "hub long, id long")


def _node_texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the rows in ids."""
    texts = rows.select(F.col("row").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, docs: DataFrame, p: NearDupParams) -> DataFrame:
    """The pairs(hub, id) whose full sets reach the threshold: members stream past their hub's set, in salted parts of HUB_ROWS."""
    ids = stored(pairs.select("id").union(pairs.select(F.col("hub").alias("id"))).distinct(), "pair-ids")
    texts = stored(_node_texts(docs, ids), "pair-texts")
    degree = stored(pairs.groupBy("hub").agg(F.count("*").alias("n")), "hubs").withColumn("parts", salts(F.col("n"), HUB_ROWS))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    total = pairs.count()
    members = join_groups(pairs, degree, "hub", "n", total).select("hub", part, F.lit(1).alias("kind"), "id").join(texts, "id")
    hubs = degree.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("hub").alias("id")).join(texts, "id")
    names = ["hub", "part", "kind", "id", "text"]
    stream = hubs.select(names).unionByName(members.select(names)).repartition("hub", "part").sortWithinPartitions("hub", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_set = np.zeros(0, np.uint64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                sets = shingle_sets(_lowered(rows.column(4)), p.words)
                out: list[tuple[int, int]] = []
                for hub, kind, i, own in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), rows.column(3).to_pylist(), sets, strict=True):
                    if kind == 0:
                        hub_set = own
                    elif _similar(hub_set, own, p.percent):
                        out.append((hub, i))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], ["hub", "id"])

    return map_batches(stream, run, "hub long, id long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, label) of every id in edges(hub, id): label is the smallest id that it reaches.

    Each round takes the smallest label among an id's neighbours, then its label's label; rounds are stored, and their
    number grows with the logarithm of a component's width, as good as always. Hubs and labels that many rows have in common are looked
    up by join_groups.
    """
    both = stored(edges.select("hub", "id").union(edges.select("id", "hub")).distinct(), f"{name}-edges")
    total = both.count()
    labels = stored(both.groupBy("id").agg(F.least(F.min("hub"), F.min("id")).alias("label"), F.count("*").alias("n")), f"{name}-labels")
    while True:
        of_hub = labels.select(F.col("id").alias("hub"), F.col("label").alias("other"), "n")
        near = join_groups(both, of_hub, "hub", "n", total).groupBy("id").agg(F.min("other").alias("other"))
        hooked = stored(labels.join(near, "id").select("id", "n", "label", F.least("label", "other").alias("new")), f"{name}-hooked")
        shared = hooked.groupBy("new").agg(F.count("*").alias("times"))
        next_ = shared.join(labels.select(F.col("id").alias("new"), F.col("label").alias("next")), "new")
        jumped = join_groups(hooked, next_, "new", "times", total).select("id", "n", F.least("new", "next").alias("label"), F.col("label").alias("old"))
        done = stored(jumped, f"{name}-labels")
        labels = done.select("id", "label", "n")
        if not done.filter("label != old").count():
            return labels.drop("n")


def _crossing(bands: DataFrame, labels: DataFrame, docs: DataFrame, nodes: DataFrame, p: NearDupParams) -> DataFrame | None:
    """Links within buckets whose members aren't in one component yet: all pairs across components that share a band are compared there.

    The largest component of a bucket is dealt in blocks of BLOCK_ROWS, and so are the other members; each block of the others meets
    every block of both, one task a pair of blocks, so that the largest component's members are copied only once for each block
    of the others. A pair is compared in the first band that it shares, pruned by signatures, and verified exactly unless its ends
    have been linked in the task before. What is stored of a bucket is its members, never its pairs.
    """
    labelled = stored(bands.join(labels, "id", "left").select("band", "id", F.coalesce("label", "id").alias("label")), "labelled")
    open_ = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo != hi").select("band", "n")
    open_ = stored(open_, "open-buckets")
    if open_.isEmpty():
        return None
    rows = stored(join_groups(labelled, open_, "band", "n", labelled.count()).drop("n"), "open-rows")
    sizes = rows.groupBy("band", "label").agg(F.count("*").alias("m")).groupBy("band").agg(F.sum("m").alias("n"), F.max(F.struct("m", "label")).alias("main"))
    main_parts, other_parts = salts(F.col("main.m"), BLOCK_ROWS), salts(F.col("n") - F.col("main.m"), BLOCK_ROWS)
    sizes = stored(sizes.select("band", "n", F.col("main.label").alias("main"), main_parts.alias("main_parts"), other_parts.alias("other_parts")), "open-sizes")
    cells = _block_pairs(join_groups(rows, sizes, "band", "n", rows.count()))
    steps, names, schema = least_matches(p), cells.columns, cells.schema

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, low, high), own in _cells(batches):
            found = _cell_pairs(own, band, low != high, p, steps)
            on = sorted({i for _, *pair in found for i in pair})
            if on:
                yield pa.RecordBatch.from_arrays([pa.array([band] * len(on), pa.int64()), *[pa.array([x] * len(on), pa.int32()) for x in (low, high)], pa.array([own[i][0] for i in on], pa.int32()), *[pa.array([own[i][c] for i in on], pa.int64()) for c in (1, 2)]], names)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, low, high), own in _cells(batches):
            links = _cell_links(own, _cell_pairs(own, band, low != high, p, steps), p)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], ["hub", "id"])

    # First the members with a partner that isn't pruned, by signatures alone; only their texts are then dealt.
    near = stored(map_batches(_by_cell(cells.join(nodes.select("id", "sig", "bands"), "id"), "sig", "bands"), paired, schema), "open-members")
    ids = stored(near.select("id").distinct(), "open-ids")
    texts = _node_texts(docs, ids).join(nodes.select("id", "sig", "bands"), "id")
    return map_batches(_by_cell(near.join(texts, "id"), "sig", "bands", "text"), linked, "hub long, id long")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """(band, low, high, block, id, label): each row once for each pair of blocks that it takes part in.

    Blocks of a bucket's largest component are numbered -1, -2 ..., those of its other members 0, 1 ...; the former meet the latter only.
    """
    is_main = F.col("label") == F.col("main")
    block = F.when(is_main, -1 - F.pmod(F.xxhash64("id"), F.col("main_parts"))).otherwise(F.pmod(F.xxhash64("id"), F.col("other_parts"))).cast("int")
    others = F.sequence(F.when(is_main, F.lit(0)).otherwise(-F.col("main_parts")), F.col("other_parts") - 1)
    met = rows.select("band", "id", "label", block.alias("block"), F.explode(others).alias("other"))
    return met.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "label")


def _by_cell(df: DataFrame, *more: str) -> DataFrame:
    cell = ["band", "low", "high"]
    return df.select(*cell, "block", "id", "label", *more).repartition(*cell).sortWithinPartitions(*cell, "id")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with one (band, low, high), across batches."""
    key, held = None, []
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols, strict=True):
            if row[:3] != key:
                if len(held) > 1:
                    yield key, held
                key, held = row[:3], []
            held.append(row[3:])
    if len(held) > 1:
        yield key, held


def _cell_pairs(rows: list[tuple], band: int, across: bool, p: NearDupParams, steps: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(equal hashes, i, j) of the pairs of rows(block, id, label, sig, bands, ...) of different components that aren't pruned, most alike first.

    A pair is left to the first band that it shares.
    """
    block = np.array([r[0] for r in rows])
    label = np.array([r[2] for r in rows])
    if (label == label[0]).all():
        return []
    sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), p.hashes)
    keys = np.frombuffer(b"".join(r[4] for r in rows), np.int64).reshape(len(rows), p.bands)
    earlier = int(np.flatnonzero(keys[0] == band)[0])
    found: list[tuple[int, int, int]] = []
    for i in range(len(rows) - 1):
        j = np.arange(i + 1, len(rows))
        on = label[j] != label[i]
        if across:
            on &= block[j] != block[i]
        j = j[on]
        if len(j):
            j = j[_survives(np.broadcast_to(sig[i], (len(j), p.hashes)), sig[j], steps)]
        if len(j) and earlier:
            j = j[(keys[j, :earlier] != keys[i, :earlier]).all(1)]
        for x in j:
            found.append((int((sig[i] == sig[x]).sum()), i, int(x)))
    found.sort(reverse=True)
    return found


def _cell_links(rows: list[tuple], found: list[tuple[int, int, int]], p: NearDupParams) -> list[tuple[int, int]]:
    """The pairs of found that are similar, unless their components have been linked by pairs before."""
    parent = {r[2]: r[2] for r in rows}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sets: dict[int, np.ndarray] = {}
    links = []
    for _, i, j in found:
        a, b = root(rows[i][2]), root(rows[j][2])
        if a == b:
            continue
        for x in (i, j):
            if x not in sets:
                sets[x] = shingle_sets([rows[x][5].encode().lower()], p.words)[0]
        if _similar(sets[i], sets[j], p.percent):
            parent[max(a, b)] = min(a, b)
            links.append((rows[i][1], rows[j][1]))
    return links


def near_duplicates(docs: DataFrame, params: NearDupParams | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are split at bytes 0x09-0x0D and 0x20, A-Z lower-cased. A document's set has its distinct shingles; with fewer words, the
    whole sequence; without words or text it is empty and linked with nothing. Documents whose sets have
    100 * intersection >= percent * union are linked; component_id is the smallest doc_id reachable. kept: doc_id = component_id.
    Every row is a document, also those that share a doc_id or have none: null counts as the largest doc_id, and of the rows that share a
    component's smallest doc_id, the first by a hash of their texts is kept. Other columns aren't read; an empty table gives no rows.

    Equal sets are one node. Each bucket of a band first links its members to its smallest; components follow; buckets
    with several components are then compared pair by pair. No pair that shares a band is left out.
    """
    rows = numbered(docs.select("doc_id", "text"), "row")
    out = _components_of_rows(rows, params or NearDupParams())
    # A component has few smallest rows and may have many others: its doc_id is looked up by groups.
    named = stored(out.select("row", "n_shingles", "component"), "row-components")
    shared = named.groupBy("component").agg(F.count("*").alias("__n")).filter("__n > 1")
    ids = rows.select(F.col("row").alias("component"), F.col("doc_id").alias("component_id")).join(shared, "component")
    found = join_groups(named, ids, "component", "__n", named.count(), "left").select("row", "n_shingles", "component", "component_id")
    both = rows.select("row", "doc_id").join(found, "row")
    return both.select("doc_id", "n_shingles", F.when(F.col("component") == F.col("row"), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (F.col("component") == F.col("row")).alias("kept"))


def _components_of_rows(rows: DataFrame, p: NearDupParams) -> DataFrame:
    """(row, n_shingles, component) of rows(row, text), whose numbers aren't null or repeated: component is the smallest row reachable."""
    sets = stored(document_sets(rows, p), "sets")
    nodes = stored(sets.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("row").alias("id"), F.count("*").alias("n"), F.max("sig").alias("sig"), F.max("bands").alias("bands")), "nodes")
    linked = _node_components(nodes, rows, p)
    named = nodes.select("digest", "n", "id").join(linked, "id", "left").select("digest", "n", F.coalesce("label", "id").alias("component"))
    out = join_groups(sets.select("row", "n_shingles", "digest"), named, "digest", "n", sets.count(), "left")
    return out.select("row", "n_shingles", F.coalesce("component", "row").alias("component"))


def _band_rows(nodes: DataFrame, p: NearDupParams) -> DataFrame:
    """(id, band) of every band key of the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), p.bands)), pa.array(keys)], ["id", "band"])

    return map_batches(nodes.select("id", "bands"), run, "id long, band long")


def _node_components(nodes: DataFrame, rows: DataFrame, p: NearDupParams) -> DataFrame:
    every = stored(_band_rows(nodes, p), "bands")
    buckets = every.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    # One row a band on one side: a hot band's rows are split among tasks by the adaptive skew join.
    bands = stored(every.join(buckets.hint("merge"), "band"), "shared-bands")
    stars = stored(bands.filter("id != hub").select("hub", "id").distinct(), "stars")
    hubs = stored(stars.groupBy("hub").agg(F.count("*").alias("n")), "star-hubs")
    edges = stored(_verified(stored(_pruned(stars, hubs, nodes, p), "pairs"), rows, p), "links")
    labels = components(edges, "first")
    more = _crossing(bands.select("band", "id"), labels, rows, nodes, p)
    if more is None:
        return labels
    more = stored(more, "more-links")
    return labels if more.isEmpty() else components(edges.union(more), "second")


def keep_one_of_each_group(docs: DataFrame, params: NearDupParams | None = None) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that stay, one document of each group, with all their columns.

    It is the one with the smallest doc_id, null last, of equal ones the first by a hash of the text. Documents without words all
    stay; an empty table stays empty.
    """
    rows = numbered(docs, "__row")
    out = _components_of_rows(rows.select(F.col("__row").alias("row"), "text"), params or NearDupParams())
    gone = stored(out.filter("component != row").select(F.col("row").alias("__row")), "near-gone")
    other = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return rows.join(other, "__row", "left_anti").select(*[f"`{c}`" for c in docs.columns])
