"""Best-fit decreasing packing of tokenised documents into sequences of a fixed capacity.

Pieces of one length are interchangeable, so the plan is made on the histogram of lengths (at most `capacity` counts,
whatever the size of the corpus): a segment tree over remaining capacities finds the tightest open bin, and a whole
run of equal pieces is placed at once. The runs say which piece of a length, by its rank, goes to which bin.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored
from .arrow import map_batches, release

#: Words whose ids an encoder holds: of how many characters, and how many at most (the first ones, among which are the most frequent).
WORD_CHARS, HELD_WORDS = 48, 250_000
#: Marks in a copy of a text where it is cut.
CUT = "\x00"
_VISIBLE, _LETTER = r"[!-~\x{C0}-\x{24F}]", r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]"
#: Cuts beside a line end between visible characters, and before a mark after a letter that ends a word.
_CUTS = ((rf"({_VISIBLE})\n({_VISIBLE})", "\\1\x00\n\x00\\2"), (rf"({_LETTER})([.,;:!?])(\x00|$)", "\\1\x00\\2\\3"))


class CapacityTree:
    """A segment tree over remaining capacities 0..capacity; a leaf counts the open bins with just that much room."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.total = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = self.size + room
        while i:
            self.total[i] += n
            i //= 2

    def count(self, room: int) -> int:
        return self.total[self.size + room]

    def tightest(self, need: int) -> int | None:
        """The least room >= need that an open bin has."""
        i = self.size + need
        if self.total[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.total[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.total[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


@dataclass(frozen=True)
class Run:
    """Pieces of `length` with ranks from `rank` on: `each` of them go to each of `bins` bins from `bin` on, from `offset`."""

    length: int
    rank: int
    bin: int
    bins: int
    each: int
    offset: int


def best_fit_runs(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """The placement of best-fit decreasing over lengths with their counts, and the number of bins.

    Equal bins are kept as ranges of bin numbers, so the work depends on the distinct lengths, not on the pieces.
    """
    tree, open_bins, runs, n_bins = CapacityTree(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                fits = capacity // length
                fresh = -(-left // fits)
                open_bins.setdefault(capacity, []).append((n_bins, fresh))
                tree.add(capacity, fresh)
                n_bins += fresh
                continue
            first, n = open_bins[room].pop()
            each = min(room // length, left)
            used = min(n, left // each)
            if used < n:
                open_bins[room].append((first + used, n - used))
            tree.add(room, -used)
            rest = room - each * length
            if rest:
                open_bins.setdefault(rest, []).append((first, used))
                tree.add(rest, used)
            runs.append(Run(length, rank, first, used, each, capacity - room))
            rank += used * each
            left -= used * each
    return runs, n_bins


class Encoder:
    """Ids of a byte-level BPE as little-endian unsigned 32-bit integers, all of them made by the tokenizers library.

    The byte-level splitting ends a word before every space that a character other than white space follows, whatever comes
    before it; a line end between visible characters, and a mark that ends a word after a Latin letter, are words of their own. Words are
    encoded one by one. So texts are cut there, each distinct word of a batch is encoded once, and the ids of short ones are held
    for the next batch. Texts that hold a special token's string, which splits them before that, or the cutting mark are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.apart = [CUT, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.held: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, text: str) -> bytes:
        return self.batch(pa.array([text]))[0]

    def batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text."""
        whole = np.zeros(len(texts), bool)
        for s in self.apart:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        marked = pc.replace_substring(texts.filter(pa.array(~whole)), " ", CUT + " ")
        for pattern, by in _CUTS:
            marked = pc.replace_substring_regex(marked, pattern, by)
        split = pc.split_pattern(marked, CUT)
        coded = split.flatten().dictionary_encode()
        at, parts = coded.indices.to_numpy(), coded.dictionary
        edge = split.offsets.to_numpy() - split.offsets[0].as_py()
        out = _gathered(self._looked_up(parts.to_pylist()), at, edge)
        keeps = np.concatenate([[0], np.cumsum(_keep_on(parts)[at])])
        for r in np.flatnonzero(keeps[edge[1:]] > keeps[edge[:-1]]).tolist():
            out[r] = b"".join(self._looked_up(_joined_parts(parts.take(pa.array(at[edge[r] : edge[r + 1]])).to_pylist())))
        plain, single = iter(out), iter(self._encoded([t.as_py() for t in texts.filter(pa.array(whole))]))
        return [next(single if w else plain) for w in whole]

    def _looked_up(self, words: list[str]) -> list[bytes]:
        """The ids of words, each by itself."""
        out = [*map(self.held.get, words)]
        missing = [w for w, b in zip(words, out, strict=True) if b is None]
        made = dict(zip(missing, self._encoded(missing), strict=True))
        if made:
            out = [made[w] if b is None else b for w, b in zip(words, out, strict=True)]
        short = ((w, b) for w, b in made.items() if len(w) <= WORD_CHARS)
        self.held.update(islice(short, max(0, HELD_WORDS - len(self.held))))
        return out


def _keeps_on(part: str) -> bool:
    """Whether this part's space may belong to a run of white space."""
    return part[:1] == " " and (len(part) == 1 or part[1].isspace() or part[1] == "\u180e")


def _keep_on(parts: pa.StringArray) -> np.ndarray:
    """_keeps_on of each part; one with a visible ASCII character after the space doesn't."""
    unsure = pc.match_substring_regex(parts, r"^ ([^!-~]|$)").to_numpy(zero_copy_only=False)
    at = np.flatnonzero(unsure)
    unsure[at] = [_keeps_on(p) for p in parts.take(pa.array(at)).to_pylist()]
    return unsure


def _joined_parts(parts: list[str]) -> list[str]:
    """A text's parts after those that keep on have been put back to the part before them."""
    out: list[list[str]] = []
    for part in parts:
        if out and _keeps_on(part):
            out[-1].append(part)
        else:
            out.append([part])
    return ["".join(p) for p in out]


def _gathered(ids: list[bytes], code: np.ndarray, edge: np.ndarray) -> list[bytes]:
    """For each text, the ids of its strings (numbers in code between its edges), joined."""
    size = np.fromiter((len(b) // 4 for b in ids), np.int64, len(ids))
    start = np.cumsum(size) - size
    n = size[code]
    end = np.cumsum(n)
    flat = np.frombuffer(b"".join(ids), "<u4")[np.arange(end[-1] if len(end) else 0) + np.repeat(start[code] - (end - n), n)]
    cut = np.concatenate([[0], end])[edge]
    return [flat[lo:hi].tobytes() for lo, hi in zip(cut[:-1], cut[1:], strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a process, so that what it holds serves all its tasks."""
    return Encoder(path)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, chunk long, place long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, after a shorter first one if n isn't a multiple."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


@dataclass(frozen=True)
class Vocabulary:
    """path: of a vocabulary file of the tokenizers library, on every machine."""

    path: str


def tokenised_pieces(docs: DataFrame, vocabulary: Vocabulary, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """The pieces of every document, with their place among the pieces of that length in the task (chunk) that made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, end, seen = encoder(vocabulary.path), np.array([end_id], "<u4").tobytes(), [0] * (capacity + 1)
        chunk = TaskContext.get().partitionId()
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, text in zip(batch.column(0).to_pylist(), words.batch(pc.fill_null(batch.column(1), "")), strict=True):
                ids = text + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    for c, v in zip(out, (doc_id, piece, start, length, zlib.crc32(own), own if keep_ids else None, chunk, seen[length]), strict=True):
                        c.append(v)
                    seen[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])
            del out, batch
            release()

    pieces = map_batches(docs.select("doc_id", "text"), run, _PIECES)
    return pieces if keep_ids else pieces.drop("ids")


def pack_documents(docs: DataFrame, vocabulary: Vocabulary, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    A null text counts as empty and is one piece, the end id. Rows with a null or repeated doc_id are packed like others.
    Only documents longer than capacity are cut. Within a sequence, pieces lie without gaps from offset 0. Other columns
    aren't read; an empty table gives no rows. The driver holds one count for each length and the runs, whose number depends
    on the capacity alone; the pieces are stored, numbered by counts of each task and length, and never gathered.
    """
    spark = docs.sparkSession
    pieces = stored(tokenised_pieces(docs, vocabulary, capacity, end_id, keep_ids), "pieces")
    per_chunk = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = stored(per_chunk.withColumn("before", before), "piece-ranks")
    histogram = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = best_fit_runs(histogram, capacity)
    runs.sort(key=lambda r: (r.length, r.rank))
    table = spark.sparkContext.broadcast(np.array([(r.length, r.rank, r.bin, r.each, r.offset) for r in runs], np.int64).reshape(-1, 5))
    # The ranks grow with tasks times lengths, so they are never broadcast; a key holds what one task made of one length.
    numbered = pieces.join(ranked.drop("n").hint("merge"), ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("place")).drop("before", "place", "chunk")
    names = [c for c in numbered.columns if c not in ("rank",)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, bins, each, offset = table.value.T
        width = int(rank.max()) + 1 if len(rank) else 1
        for batch in batches:
            at = pa.Table.from_batches([batch])
            own, q = at["length"].to_numpy(), at["rank"].to_numpy()
            i = np.searchsorted(length * width + rank, own * width + np.minimum(q, width - 1), side="right") - 1
            nth = q - rank[i]
            placed = at.select(names).append_column("sequence_id", pa.array(bins[i] + nth // each[i])).append_column("offset", pa.array(offset[i] + nth % each[i] * own))
            yield from placed.to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in numbered.schema}
    packed = map_batches(numbered, place, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "sequence_id bigint", "offset bigint"]))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))
