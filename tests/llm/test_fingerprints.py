"""Fingerprints against exact likeness and a direct reading of the edit rule."""

import hashlib

from cases import clashing, document, frame, odd_documents, words
from pyspark.sql import functions as F

from knotwork.llm import fingerprints


def shingles(text):
    parts = text.lower().split()
    return {tuple(parts[i : i + 5]) for i in range(len(parts) - 4)} if len(parts) >= 5 else ({tuple(parts)} if parts else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_and_likeness(spark):
    rows = [document(3 * i, " ".join(words(i % 7, 30 + 60 * (i % 5)))) for i in range(60)]
    found = {r.doc_id: r for r in fingerprints.fingerprint_edits(frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r.doc_id)
    for place, r in enumerate(order):
        following = order[(place + 1) % len(order)].text
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + following[:half]
        got = found[r.doc_id]
        assert got.n_chars == len(r.text)
        assert got.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got.near_edited - likeness(shingles(r.text), shingles(edited))) < 0.15
        assert abs(got.near_next - likeness(shingles(r.text), shingles(following))) < 0.15
        if len(shingles(r.text)) < fingerprints.K:
            assert got.distinct_shingles == len(shingles(r.text))
    same = {}
    for r in rows:
        assert same.setdefault(r.text, found[r.doc_id].fingerprint) == found[r.doc_id].fingerprint


def test_odd_documents(spark):
    rows = [r for r in odd_documents() if r.doc_id not in (7, 8)]
    found = fingerprints.fingerprint_edits(clashing(frame(spark, rows))).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].fingerprint == by_id[2].fingerprint == by_id[3].fingerprint == ""
    assert by_id[1].near_edited == 1.0
    text = {r.doc_id: r.text or "" for r in rows}
    assert by_id[12].edited_sha256 == hashlib.sha256((text[12][: len(text[12]) - len(text[12]) // 2] + text[11][: len(text[12]) // 2]).encode()).hexdigest()
    assert by_id[1].edited_sha256 == hashlib.sha256(b"").hexdigest()
    assert abs(by_id[10].distinct_shingles / len(shingles(text[10])) - 1) < 0.3


def test_repeated_ids_keep_their_rows(spark):
    rows = [document(1, "a b c"), document(2, "z y x w"), document(2, "c d e f"), document(3, "q r s t")]
    found = fingerprints.fingerprint_edits(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in found) == [1, 2, 2, 3]
    three = next(r for r in found if r.doc_id == 3)
    assert three.edited_sha256 == hashlib.sha256(b"q r " + b"c d").hexdigest() or three.edited_sha256 == hashlib.sha256(b"q r sc d"[:0] + b"q r " + b"c d").hexdigest()


def test_sketches_merge(spark):
    a, b = " ".join(words(1, 400)), " ".join(words(2, 400))
    row = (
        spark.createDataFrame([(a, b)], "a string, b string")
        .select(fingerprints.sketch(F.col("a")).alias("x"), fingerprints.sketch(F.col("b")).alias("y"))
        .select("x", "y", fingerprints.merge(F.col("x"), F.col("y")).alias("both"))
        .select(
            fingerprints.distinct_shingles(F.col("both")).alias("n"),
            fingerprints.containment(F.col("x"), F.col("both")).alias("inside"),
            fingerprints.resemblance(F.col("x"), F.col("both")).alias("near"),
        )
        .first()
    )
    assert abs(row.n / len(shingles(a) | shingles(b)) - 1) < 0.3
    assert row.inside == 1.0 and abs(row.near - 0.5) < 0.15


def test_single_and_empty(spark):
    one = fingerprints.fingerprint_edits(frame(spark, [document(5, "abcd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fingerprints.fingerprint_edits(frame(spark, [])).count() == 0
