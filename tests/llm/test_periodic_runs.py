"""Runs against a plain search over all starts and periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from cases import clashing, document, frame, odd_documents, words

from knotwork.llm import periodic_runs


def plain_runs(seq, least=24, power=3):
    """All maximal stretches of each period; of equal stretches the one of least period."""
    found = {}
    for p in range(1, len(seq) // power + 1):
        start = 0
        for end in range(p, len(seq) + 1):
            if end == len(seq) or seq[end] != seq[end - p]:
                if end - start >= max(least, power * p):
                    found.setdefault((start, end - start), p)
                start = end - p + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def code_of(sequences):
    numbers = {}
    codes = [numbers.setdefault(w, len(numbers)) for seq in sequences for w in seq]
    return np.array(codes, np.int64), np.concatenate([[0], np.cumsum([len(s) for s in sequences])]).astype(np.int64)


def rows_of(sequences, **options):
    codes, offsets = code_of(sequences)
    out = [[] for _ in sequences]
    for doc, start, length, period in zip(*(x.tolist() for x in periodic_runs.find_runs(codes, offsets, **options))):
        out[doc].append((start - int(offsets[doc]), length, period))
    return out


def sequences(seed, count):
    """Random words with periodic parts, powers of powers, near misses and neighbours that go on alike."""
    pick = random.Random(seed)
    out = []
    for _ in range(count):
        letters = [str(i) for i in range(pick.choice([1, 2, 3, 50]))]
        seq = []
        for _ in range(pick.randrange(1, 6)):
            kind = pick.random()
            if kind < 0.4:
                seq += [pick.choice(letters) for _ in range(pick.randrange(0, 40))]
            else:
                base = [pick.choice(letters) for _ in range(pick.choice([1, 2, 3, 5, 8, 9, 13, 31, 40]))]
                if kind < 0.6:
                    base = base * 3 + base[: pick.randrange(len(base) + 1)]
                seq += (base * 12)[: pick.randrange(1, 4 * len(base) + 30)]
                if pick.random() < 0.3 and seq:
                    seq[pick.randrange(len(seq))] = "x"
        out.append(seq)
    return out


def test_difference_cover_reaches_every_pair():
    assert {(a - b) % 31 for a in periodic_runs.COVER for b in periodic_runs.COVER} == set(range(31))


@pytest.mark.parametrize("seed", range(8))
def test_extensions_equal_plain_ones(seed):
    pick = random.Random(seed)
    for seq in sequences(seed, 12):
        if len(seq) < 2:
            continue
        codes, _ = code_of([seq])
        found = periodic_runs.Extensions(codes)
        pairs = [pick.sample(range(len(seq)), 2) for _ in range(60)]
        a, b = (np.array(x) for x in zip(*pairs))
        for i, j, n in zip(a.tolist(), b.tolist(), found.extend(a, b).tolist()):
            wanted = next((k for k in range(len(seq)) if max(i, j) + k >= len(seq) or seq[i + k] != seq[j + k]), None)
            assert n == wanted


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_plain_search(seed, monkeypatch):
    many = sequences(seed, 40)
    wanted = [plain_runs(seq) for seq in many]
    assert sum(map(len, wanted)) > 20
    assert rows_of(many) == wanted
    monkeypatch.setattr(periodic_runs, "PAIRS", 50)
    assert rows_of(many) == wanted


@pytest.mark.parametrize(("least", "power"), [(6, 3), (3, 3), (40, 4), (1, 5)])
def test_other_bounds(least, power):
    many = sequences(least, 30)
    assert rows_of(many, least=least, power=power) == [plain_runs(seq, least, power) for seq in many]


def test_two_periods_are_no_run():
    with pytest.raises(ValueError):
        rows_of([["a"] * 30], power=2)


def plain_row(r):
    seq = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
    if r.doc_id is not None and seq:
        h = zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(seq)
            p = 1 + (len(seq) - a) // (3 + g % 8)
            seq = [seq[i] if i < a else seq[a + (i - a) % p] for i in range(len(seq))]
    runs = plain_runs(seq)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    text = " ".join(w for i, w in enumerate(seq) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (r.doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_documents_equal_plain_rows(spark):
    rows = [r for r in odd_documents() if len(r.text or "") < 10_000]
    rows += [document(100 + i, "  ".join(seq) + "\n") for i, seq in enumerate(sequences(99, 60))]
    rows += [document(1000 + i, " ".join(words(i, 400))) for i in range(40)]
    found = periodic_runs.repeated_runs(clashing(frame(spark, rows)), edit=True)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(plain_row, rows), key=str)
    assert any(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows)


def test_very_long_texts(spark):
    base = words(5, 1000)
    rows = [document(1, " ".join(["same"] * 300_000)), document(None, " ".join(words(6, 200_000) + base * 7)), document(None, "a " * 23)]
    found = {r.doc_id: r for r in periodic_runs.repeated_runs(frame(spark, rows[:2])).collect()}
    assert (found[1].n_runs, found[1].length, found[1].period) == (1, 300_000, 1)
    assert found[None].period == 1000 and found[None].length >= 7000
    assert [r.n_runs for r in periodic_runs.repeated_runs(frame(spark, rows[2:])).collect()] == [0]


def test_empty_table(spark):
    assert periodic_runs.repeated_runs(frame(spark, [])).count() == 0


def test_query_equals_plain_rows(spark):
    from knotwork.llm import queries

    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet").collect()
    found = queries.QUERIES["op13_periodic_runs"](spark, folder).collect()
    short = {r.doc_id for r in documents if len(r.text or "") < 20_000}
    wanted = [plain_row(r) for r in documents if r.doc_id in short]
    assert len(found) == len(documents)
    assert sorted((tuple(r) for r in found if r.doc_id in short), key=str) == sorted(wanted, key=str)
