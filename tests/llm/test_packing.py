"""Pieces against the tokenizer itself, sequences against the rules of packing."""

import struct
import zlib
from collections import defaultdict

import pytest
from cases import clashing, document, frame, odd_documents, words

from knotwork.llm import packing

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")
PATH = vocabularies.path("word_bpe_49k.json")


def ids_of(text):
    return [*tokenizers.Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check(spark, rows, capacity):
    found = packing.pack_documents(clashing(frame(spark, rows)), PATH, capacity).collect()
    wanted = defaultdict(int)
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID]
        for n, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            wanted[(r.doc_id, n, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in found:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == wanted
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(k[3] * n for k, n in wanted.items())
    return len(sequences), total


@pytest.mark.parametrize("capacity", [16, 4096])
def test_odd_documents(spark, capacity):
    check(spark, odd_documents(), capacity)


def test_few_sequences(spark):
    rows = [document(i, " ".join(words(i, 5 + 37 * i % 300))) for i in range(400)]
    count, total = check(spark, rows, 512)
    assert count <= total / 512 * 1.02 + 1


def test_memory_limits_do_not_change_ids(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "KNOWN_CHUNKS", 3)
    monkeypatch.setattr(packing, "KNOWN_RUNS", 2)
    encoder = packing.WordEncoder(PATH)
    for text in ["anist, berol! corin. anist", "don't l'été ÀÉß, 12 a1 'S's", "berol anist " + "x" * 500, "", " \n\t"]:
        ids, ends = encoder.encode(pa.array([text, None, text]))
        assert ids[: ends[1]].tolist() == ids_of(text)[:-1] == ids[ends[2] :].tolist()
        assert ends[1] == ends[2]


def test_best_fit_takes_the_tightest():
    lengths = sorted([7, 6, 5, 4, 3, 3, 2, 2, 1], reverse=True)
    sequence, offset = packing.best_fit(lengths, 10)
    free, wanted = [], []
    for length in lengths:
        fits = [i for i, f in enumerate(free) if f >= length]
        best = min(fits, key=lambda i: free[i], default=None)
        if best is None:
            free.append(10)
            best = len(free) - 1
        wanted.append(10 - free[best])
        free[best] -= length
    assert offset == wanted and max(sequence) + 1 == len(free)


def test_empty_table(spark):
    assert packing.pack_documents(frame(spark, []), PATH).count() == 0
