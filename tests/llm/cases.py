"""Small inputs that the tests of this folder share."""

from __future__ import annotations

import random

from pyspark.sql import Row
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
LABELS = "doc_id long, quality int, toxic int"
VOCABULARY = [f"{a}{b}{c}" for a in ("an", "ber", "cor", "dan", "el", "fa") for b in ("i", "o", "u", "e") for c in ("n", "st", "r", "th", "l")]


def words(seed: int, count: int) -> list[str]:
    picker = random.Random(seed)
    return [picker.choice(VOCABULARY) for _ in range(count)]


def document(doc_id, text, source="a", lang="en") -> Row:
    return Row(doc_id=doc_id, text=text, lang=lang, source=source, n_chars=len(text or ""))


def frame(spark, rows, schema=DOCUMENTS):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def odd_documents() -> list[Row]:
    """Nulls, empty and blank texts, repeated rows and ids, ties, one very long text, marker strings."""
    long = " ".join(words(1, 30_000))
    same = " ".join(words(2, 40))
    return [
        document(1, None),
        document(2, ""),
        document(3, " \t\n\x0b\x0c\r "),
        document(4, "one"),
        document(5, "one two three"),
        document(6, same),
        document(7, same),
        document(7, same),
        document(8, same, source=None),
        document(8, " ".join(words(3, 40))),
        document(None, same),
        document(9, long, source="b"),
        document(10, long + " end", source="b"),
        document(11, "<|startoftext|> a<|endoftext|>b <|im_end|><|im_start|>x", lang=None),
        document(12, "Ünï çödé text line ﬁ İ \U0001f600 \x00 \x1c"),
        document(13, "one two three"),
    ]


def clashing(df):
    """The documents with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = "copy shuffle_key rate steps table size rep cls keys component_id kept key tree sketch score predicted selected draw"
    names += " log_weight _label _label_doc _gone piece start length sequence_id offset license origin path own other next_text edited"
    return df.withColumns({name: F.lit("x") for name in names.split()})
