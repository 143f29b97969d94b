"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Each kind has a pattern, a check and a start score. The base kinds (email, ip, card, phone) are
the leftmost non-overlapping matches of their patterns; a match that fails its check is dropped and
not tried again. Their score tells how sure they are, but they always stay. The further kinds
(IBAN by mod-97, social security numbers, phone numbers without a country code) are less sure by
their form alone: they stay only where the check and the words around lift the score to
``LEAST_SCORE``, and where no base span overlaps.

Patterns run in linear time on any text: runs are matched possessively, and an address is found
from its @ outwards. Texts never leave their task: no shuffle.

Defined results: a null or empty text has no spans; places count code points, the end is
exclusive; spans go by start, then by the order of ``KINDS``; texts are read whole, whatever their
length; repeated rows give a row each; a null id stays null; extra columns, whatever their names, are
left aside; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban", "ssn", "local_phone"]
LEAST_SCORE = 0.5
# Code points before and behind a span that are searched for context words.
BEFORE, BEHIND = 48, 24
CONTEXT_GAIN = 0.25

_LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can only begin with the first digit of a row of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])\(?[0-9]{2,5}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")

# Start score once the check has passed, words that raise it and words that lower it.
KIND_SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "local_phone": 0.35}
FOR_WORDS = {
    "email": "e-?mail|mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|address|host|server|login|client|adresse",
    "card": "card|visa|master|amex|credit|debit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|fax|mobile|cell|whatsapp|telefon|tel[eé]fono|t[eé]l[eé]phone|rufnummer|handy",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social|security",
}
FOR_WORDS["local_phone"] = FOR_WORDS["phone"]
AGAINST_WORDS = {
    "email": "example|noreply|no-reply",
    "ip": "version|release|section|chapter|kapitel",
    "card": "order|invoice|tracking|serial|isbn|bestellung|pedido|commande",
    "phone": "order|invoice|isbn|serial|version",
    "iban": "example|sample",
    "ssn": "order|invoice|part|serial|isbn",
}
AGAINST_WORDS["local_phone"] = AGAINST_WORDS["phone"]
_CONTEXT = {
    kind: tuple(re.compile(rf"\b(?:{words[kind]})", re.IGNORECASE) for words in (FOR_WORDS, AGAINST_WORDS)) for kind in KINDS
}

SPAN = "array<struct<kind: string, start: long, end: long, score: double>>"


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Whether the digits pass the mod-10 check of card numbers."""
    twice = sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0


def mod97(text: str) -> bool:
    """Whether an account number passes the check of IBANs: country and check digits moved to the end leave 1."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with a domain behind it takes the longest local part before it that no earlier match holds."""
    free = 0
    for match in _DOMAIN.finditer(text):
        at = match.start()
        # No local part holds an @, so nothing before the last one counts.
        low = max(free, text.rfind("@", free, at) + 1)
        start = low + len(text[low:at].rstrip(_LOCAL_PART))
        if start < at:
            free = match.end()
            yield start, free


def ips(text: str) -> Iterator[tuple[int, int]]:
    for match in _IP.finditer(text):
        parts = [part.lstrip("0") for part in match.group().split(".")]
        if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
            yield match.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 12:
            digits = digits_of(match.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield match.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for match in _PHONE.finditer(text):
        if 9 <= len(digits_of(match.group())) <= 15:
            yield match.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest piece up to a blank that passes, as words in capitals may stand behind a number."""
    for match in _IBAN.finditer(text):
        whole = match.group()
        ends = [len(whole), *[i for i in range(len(whole) - 1, 0, -1) if whole[i] == " "]]
        for end in ends:
            number = whole[:end].replace(" ", "")
            if 15 <= len(number) <= 34 and mod97(number):
                yield match.start(), match.start() + end
                break


def _matches(pattern: re.Pattern, low: int, high: int) -> Callable[[str], Iterator[tuple[int, int]]]:
    def find(text: str) -> Iterator[tuple[int, int]]:
        for match in pattern.finditer(text):
            if low <= len(digits_of(match.group())) <= high:
                yield match.span()

    return find


FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "email": emails,
    "ip": ips,
    "card": cards,
    "phone": phones,
    "iban": ibans,
    "ssn": _matches(_SSN, 9, 9),
    "local_phone": _matches(_LOCAL_PHONE, 8, 13),
}
_DIGIT = re.compile("[0-9]")


def context_score(kind: str, text: str, start: int, end: int) -> float:
    """The kind's start score, raised or lowered by words around the span."""
    around = text[max(0, start - BEFORE) : start] + " \0 " + text[end : end + BEHIND]
    favour, against = _CONTEXT[kind]
    score = KIND_SCORES[kind] + CONTEXT_GAIN * (bool(favour.search(around)) - bool(against.search(around)))
    return min(1.0, max(0.0, score))


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """Kind, start, end and score of each span of a text, in order."""
    found: list[tuple[int, int, int, float]] = []
    if "@" in text:
        found += [(s, 0, e, context_score("email", text, s, e)) for s, e in emails(text)]
    if _DIGIT.search(text):
        for rank, kind in enumerate(KINDS[1 : len(BASE_KINDS)], 1):
            found += [(s, rank, e, context_score(kind, text, s, e)) for s, e in FINDERS[kind](text)]
        taken = sorted((s, e) for s, _, e, _ in found)
        for rank, kind in enumerate(KINDS[len(BASE_KINDS) :], len(BASE_KINDS)):
            for s, e in FINDERS[kind](text):
                score = context_score(kind, text, s, e)
                if score >= LEAST_SCORE and not any(a < e and s < b for a, b in taken):
                    found.append((s, rank, e, score))
                    taken.append((s, e))
    return [(KINDS[rank], s, e, score) for s, rank, e, score in sorted(found)]


def find_personal_data(documents: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end, score) of each document (doc_id, text)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                spans = spans_of(text.as_py() or "")
                out.append([dict(zip(("kind", "start", "end", "score"), span)) for span in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, f"doc_id long, spans {SPAN}")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one counts."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("done"))

    def step(state: Column, span: Column) -> Column:
        # substr counts from 1.
        before = F.substr(text, (state["done"] + 1).cast("int"), (span["start"] - state["done"]).cast("int"))
        shown = F.concat(state["out"], before, F.lit("["), span["kind"], F.lit("]"))
        after = F.struct(shown.alias("out"), span["end"].alias("done"))
        return F.when(span["start"] >= state["done"], after).otherwise(state)

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(text, (s["done"] + 1).cast("int"))))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans and all spans as text."""

    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(BASE_KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
