"""Document fingerprints: bottom-k sketches of shingle hashes, as column expressions.

A sketch is the sorted array of the ``K`` least 64-bit hashes of a text's distinct word shingles.
Sketches of parts merge into the sketch of their union; two sketches estimate resemblance and
containment, one estimates the number of distinct shingles. Below ``K`` shingles all of it is exact.

Words are lower-cased and stand between ASCII white space; a text with fewer words than a shingle
has is one shingle, a text without words has an empty sketch. The likeness of two empty sketches is
1, of an empty and a full one 0.

``fingerprint_edits`` compares each document with an edited copy and with the next document. Next
ids come from a range-partitioned list of ids (no global window); texts are shuffled by id twice.

Defined results: a null text is the empty text; ids that repeat share the next smaller id, whose
least text is taken where that id repeats too; a row without an id has an empty next document; a
single document follows itself; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import cut

K = 128
SHINGLE_WORDS = 5


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Hashes of a text's shingles in order, repeated ones included."""
    parts = F.array_remove(F.split(F.lower(text), "[\\x09-\\x0D\\x20]+"), "")
    hashes = F.transform(parts, lambda w: F.xxhash64(w))

    def rolled(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - words)
        several = F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)]))
        return F.when(F.size(h) >= words, several).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, rolled)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def sketch(text: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two texts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def _shared(a: Column, b: Column, k: int) -> Column:
    """Of the least hashes of both: how many lie in both, in the first, and in any."""

    def counts(union: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(a, b), union))
        return F.struct(both.alias("both"), F.size(F.array_intersect(a, union)).alias("first"), F.size(union).alias("any"))

    return let(merge(a, b, k), counts)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of either text that lie in both."""
    return let(_shared(a, b, k), lambda s: F.when(s["any"] == 0, 1.0).otherwise(s["both"] / s["any"]))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that lie in the second."""
    return let(_shared(a, b, k), lambda s: F.when(s["first"] == 0, 1.0).otherwise(s["both"] / s["first"]))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles behind a sketch."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def as_text(a: Column) -> Column:
    """A sketch as a string of 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def next_ids(ids: DataFrame) -> DataFrame:
    """doc_id, next_id: the next smaller id, and the largest after the smallest."""
    ranged = cut(
        ids.filter("doc_id IS NOT NULL")
        .select("doc_id")
        .distinct()
        .repartitionByRange(F.desc("doc_id"))
        .withColumn("_range", F.spark_partition_id())
    )
    tops = ranged.groupBy("_range").agg(F.max("doc_id").alias("_top"))
    # One row for each range: this window stays as small as the number of partitions.
    after = tops.select(
        "_range",
        F.coalesce(F.lead("_top").over(Window.orderBy("_range")), F.max("_top").over(Window.partitionBy(F.lit(0)))).alias("_after"),
    )
    within = F.lead("doc_id").over(Window.partitionBy("_range").orderBy(F.desc("doc_id")))
    return (
        ranged.withColumn("_next", within)
        .join(F.broadcast(after), "_range")
        .select("doc_id", F.coalesce("_next", "_after").alias("next_id"))
    )


def edited_text(text: Column, following: Column) -> Column:
    """The text with its last half replaced by the beginning of another."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_edits(documents: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document."""
    # The ids go in as they are where they are long already: only then do both joins see the same exchange
    # of the texts, which is written once and read twice.
    doc_id = F.col("doc_id") if dict(documents.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    docs = documents.select(doc_id, F.coalesce("text", F.lit("")).alias("text"))
    order = next_ids(docs)
    known = docs.filter("doc_id IS NOT NULL")
    following = (
        known.join(order.select(F.col("doc_id").alias("_for"), "next_id"), F.col("doc_id") == F.col("next_id"))
        .groupBy("_for")
        .agg(F.min("text").alias("next_text"))
    )
    paired = known.join(following, F.col("doc_id") == F.col("_for")).select("doc_id", "text", "next_text")
    rows = paired.unionByName(docs.filter("doc_id IS NULL").withColumn("next_text", F.lit("")))
    rows = rows.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    sketched = rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch(F.col("text"), k).alias("own"),
        sketch(F.col("edited"), k).alias("other"),
        sketch(F.col("next_text"), k).alias("following"),
    )
    own = F.col("own")
    return sketched.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(own).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        resemblance(own, F.col("other"), k).alias("near_edited"),
        resemblance(own, F.col("following"), k).alias("near_next"),
        containment(own, F.col("other"), k).alias("kept_in_edited"),
        distinct_shingles(own, k).alias("distinct_shingles"),
    )
