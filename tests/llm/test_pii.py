"""Base spans against the stated patterns themselves; checks, context and long texts."""

import hashlib
import random
import re

import pytest
from cases import clashing, document, frame, odd_documents

from knotwork.llm import pii

STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sum_of_luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total


def plain_base(text):
    found = []
    for rank, (kind, pattern) in enumerate(STATED.items()):
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match.group())
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in match.group().split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and sum_of_luhn(digits) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((match.start(), rank, kind, match.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


def base(text):
    return [(kind, s, e) for kind, s, e, _ in pii.spans_of(text) if kind in pii.BASE_KINDS]


def samples(seed, count):
    pick = random.Random(seed)
    parts = ["a@b.c", "x.y+z@mail-1.example.com", "@", "@a.b", "a@", "a@b", ".", "..", "1.2.3.4", "256.1.1.1", "001.002.003.004", "1.2.3.4.5.6.7.8"]
    parts += ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-1234", "+1", "++49 30 1234567", "+49(0)", "378282246310005", " ", "é", "\n", "-", "%"]
    parts += ["1", "12", "0" * 17, "55", ")", "(", "\U0001f600", "DE89 3704 0044 0532 0130 00", "abc"]
    return ["".join(pick.choice(parts) for _ in range(pick.randrange(1, 14))) for _ in range(count)]


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_equal_stated_patterns(seed):
    for text in samples(seed, 1500):
        assert base(text) == plain_base(text), text


def test_checks():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")


def test_further_kinds_need_their_check_or_context():
    assert [s[:3] for s in pii.spans_of("Konto GB82 WEST 1234 5698 7654 32 END")] == [("iban", 6, 33)]
    assert pii.spans_of("Konto GB82 WEST 1234 5698 7654 33 END") == []
    assert [s[0] for s in pii.spans_of("SSN: 123-45-6789")] == ["ssn"]
    assert pii.spans_of("part 123-45-6789") == []
    assert [s[0] for s in pii.spans_of("call me at 030 1234 5678")] == ["local_phone"]
    assert pii.spans_of("between 1990 1995 1999 and more") == []


def test_context_moves_the_score():
    plain, raised, lowered = (pii.spans_of(t)[0][3] for t in ("4111111111111111", "visa 4111111111111111", "order 4111111111111111"))
    assert lowered < plain < raised


def test_long_texts_take_linear_time():
    for text in ["a" * 400_000 + "@b.c", "1" * 400_000, "1." * 200_000, "+1" + " " * 400_000, "a@" * 200_000, "@a" * 200_000, "1 " * 200_000, "A1 " * 100_000]:
        pii.spans_of(text)
    assert base("a" * 400_000 + "@b.c") == [("email", 0, 400_004)]
    assert base("x " * 100_000 + "4111111111111111") == [("card", 200_000, 200_016)]


def plain_row(r):
    text = r.text or ""
    found = plain_base(text)
    counts = [sum(kind == k for kind, _, _ in found) for k in STATED]
    return (r.doc_id, *counts, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest())


def test_odd_documents(spark):
    rows = odd_documents() + [document(100 + i, t) for i, t in enumerate(samples(9, 200))]
    found = pii.digest(pii.find_personal_data(clashing(frame(spark, rows))))
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = sorted((tuple(r)[:6] for r in found.collect()), key=str)
    assert got == sorted(map(plain_row, rows), key=str)


def test_base_spans_are_among_all_spans(spark):
    rows = [document(1, "iban GB82 WEST 1234 5698 7654 32, mail a@b.c, ip 1.2.3.4"), document(2, None)]
    found = {r.doc_id: r for r in pii.digest(pii.find_personal_data(frame(spark, rows))).collect()}
    assert found[1].spans == "iban:5:32,email:39:44,ip:49:56" and found[1].n_email == found[1].n_ip == 1
    assert found[2].spans == ""


def test_redaction(spark):
    from pyspark.sql import functions as F

    rows = frame(spark, [document(1, "é a@b.c, 1.2.3.4!"), document(2, "clean"), document(3, "")])
    spans = pii.find_personal_data(rows)
    shown = rows.join(spans, "doc_id").select("doc_id", pii.redact(F.col("text"), F.col("spans")))
    assert dict(map(tuple, shown.collect())) == {1: "é [email], [ip]!", 2: "clean", 3: ""}


def test_empty_table(spark):
    assert pii.digest(pii.find_personal_data(frame(spark, []))).count() == 0


def test_query_equals_stated_patterns(spark):
    from knotwork.llm import queries

    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet").collect()
    found = queries.QUERIES["op12_pii"](spark, folder).collect()
    assert sorted(tuple(r)[:6] for r in found) == sorted(map(plain_row, documents))
