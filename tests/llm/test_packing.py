import random
import zlib
from collections import Counter
from dataclasses import astuple

import numpy as np
import pyarrow as pa

from clickloom.llm import packing
from clickloom.llm.packing import CapacityTree, Encoder, best_fit_runs, cut, pack_documents
from clickloom.llm.queries import vocabulary


def sequential_best_fit(lengths, capacity):
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = min((r, i) for i, r in enumerate(rooms) if r >= n) if any(r >= n for r in rooms) else None
        if fit:
            rooms[fit[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_runs_equal_sequential_best_fit():
    rng = random.Random(3)
    for capacity in (7, 50, 128):
        for _ in range(30):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 300))]
            runs, bins = best_fit_runs(Counter(lengths), capacity)
            used: Counter = Counter()
            ranks: Counter = Counter()
            for r in runs:
                assert r.rank == ranks[r.length]
                ranks[r.length] += r.bins * r.each
                for b in range(r.bin, r.bin + r.bins):
                    assert used[b] == r.offset
                    used[b] += r.each * r.length
            assert ranks == Counter(lengths)
            assert sorted(capacity - used[b] for b in range(bins)) == sequential_best_fit(lengths, capacity)


def test_tree_finds_the_tightest_room():
    rng = random.Random(9)
    tree, rooms = CapacityTree(100), Counter()
    for _ in range(2000):
        room = rng.randint(0, 100)
        if rng.random() < 0.5 or not rooms[room]:
            tree.add(room, 1)
            rooms[room] += 1
        else:
            tree.add(room, -1)
            rooms[room] -= 1
        need = rng.randint(0, 100)
        assert tree.tightest(need) == min((r for r, n in rooms.items() if n and r >= need), default=None)


def test_encoder_equals_the_library(spark):
    encoder = Encoder(*astuple(vocabulary()))
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += ["", " ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "a\n b", "don't we'll 've", "x\u00a0y\u2003z", "a\tb\r\nc", "é日本 語\u3000x", "1 2\n3", "<|endoftext|>", "a <|endoftext|> b", "\na", "a\n", "it's\n's 's", "a\x1cb c", "🙂 🙂\n🙂", "\u0085a b", " " * 150_000, "a" + " " * 199_990 + "b", "\n" * 200_000, "ab" * 100_000, " x" * 120_000, "a  b   c", " \n x  \n  y ", "\n  a", "x \u180eb \u180e", "\u3000 a \u3000", "a <|endoftext|>  b", "  <|endoftext|>", "a" * 300 + " b", "ein.\nErt, x.\n y\n\nz w!\n", "\n", "a.", "é.\nß, ж.", "x.\u00a0\ny \u00a0\ny", "a\n\u180eb", "it's.\n's"]
    texts += ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}" for c in range(lo, lo + 256) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x30000, 256)]
    for text in texts + texts[:200]:  # once more from what is held
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want, text
    for lo in range(0, len(texts), 100):
        assert encoder.batch(pa.array(texts[lo : lo + 100])) == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[lo : lo + 100]]


def test_pieces_cover_documents_and_sequences_without_gaps(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (3, "again"), (None, "x"), (4, "tail " * 2047), (5, "a b c"), (6, "a b c")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, offset int").union(spark.range(100, 400).selectExpr("id", "repeat('w ', cast(id AS int))", "1"))
    out = pack_documents(docs.repartition(5), vocabulary(), keep_ids=True).collect()
    encoder = Encoder(*astuple(vocabulary()))
    by_doc: dict = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    assert len(by_doc[1]) == 1 and by_doc[1][0]["length"] == 1
    whole = [x for x in sorted((r for r in by_doc[3]), key=lambda r: r["piece"]) if len(x["ids"]) > 400]
    assert b"".join(r["ids"] for r in whole) == encoder.ids("word " * 9000) + b"\0\0\0\0"
    seqs: dict = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) == len(sequential_best_fit([r["length"] for r in out], 2048))
    assert pack_documents(docs.limit(0), vocabulary()).count() == 0
    assert cut(2048, 2048) == [(0, 2048)] and cut(4097, 2048) == [(0, 1), (1, 2048), (2049, 2048)]


def test_encoder_holds_no_more_words_than_its_limit(monkeypatch):
    monkeypatch.setattr(packing, "HELD_WORDS", 5)
    encoder = Encoder(*astuple(vocabulary()))
    texts = [" ".join(f"word{i * j}" for j in range(1, 9)) for i in range(40)]
    for _ in range(2):
        got = encoder.batch(pa.array(texts))
        assert len(encoder.held) == 5
        assert got == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
