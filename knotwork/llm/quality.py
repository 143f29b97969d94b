"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

The raw model counts hashed tokens and token pairs of all documents, the target model those of
documents labelled good. The log weight of a document is the sum of the log ratios of its buckets.
A cut between labelled good and bad documents says how many documents resemble the target; that
many are drawn without replacement by the largest values of log weight plus seeded Gumbel noise.

Labels come from a seeded sample of at most ``LABELLED_DOCUMENTS`` rows, a table of bounded size
that is broadcast; counts, weights and the draw cover all documents. Nothing but the counts of
``BUCKETS`` buckets leaves the tasks of the two passes, so no text is shuffled.

Defined results: a null or empty text has log weight 0; equal texts have equal weights but own
noise by id; rows that tie at the last place are all kept; without labels of both kinds every
document is kept; extra columns stay in ``keep_quality``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import bounded_labels, kth_largest, mixed, text_slices, unit_hash, word_codes, without
from knotwork.session import cut

BUCKETS = 10_000
SMOOTHING = 1.0
LABELLED_DOCUMENTS = 20_000
SEED = 5
# Bad documents whose rejection is worth the loss of one good document.
GOOD_COST = 5

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_TWICE, _OVER_ONE = np.uint64(3), np.uint64(7)


def _codes(chunk: str) -> list[int]:
    return [zlib.crc32(t.encode()) for t in _TOKEN.findall(chunk)]


def ngram_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of tokens and of token pairs, and the text that each of them belongs to."""
    offsets, codes, dictionary = word_codes(texts)
    spelled = [_codes(c) for c in dictionary.to_numpy(zero_copy_only=False)]
    sizes = np.fromiter(map(len, spelled), dtype=np.int64, count=len(spelled))
    pool = np.fromiter((c for s in spelled for c in s), dtype=np.uint64, count=int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    counts = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(counts)])
    tokens = pool[np.arange(ends[-1]) + np.repeat(starts[codes] - ends[:-1], counts)]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(ends[offsets]))
    # Stuttering takes any word, so pairs of one token, next to each other or over one between, are one n-gram each.
    pairs = np.where(tokens[:-1] == tokens[1:], _TWICE, mixed(tokens[:-1] * _PAIR + tokens[1:]))
    within = owner[:-1] == owner[1:]
    over = np.flatnonzero((tokens[:-2] == tokens[2:]) & (owner[:-2] == owner[2:]))
    pairs = np.concatenate([pairs[within], np.full(len(over), _OVER_ONE)])
    size = np.uint64(buckets)
    return (
        (mixed(tokens) % size).astype(np.int64),
        owner,
        (pairs % size).astype(np.int64),
        np.concatenate([owner[:-1][within], owner[over]]),
    )


def ngram_counts(rows: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of all texts and of the target texts of ``rows`` (text, target)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in text_slices(batches):
            good = np.array(batch.column(1).to_pylist(), dtype=bool)
            for found, owner in _both(batch.column(0), buckets):
                raw += np.bincount(found, minlength=buckets)
                target += np.bincount(found[good[owner]], minlength=buckets)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(buckets)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"]
        )

    parts = rows.select("text", "target").mapInArrow(work, "bucket long, raw long, target long")
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for row in parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    return raw, target


def _both(texts: pa.Array, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    single, owner, pair, pair_owner = ngram_buckets(texts, buckets)
    return [(single, owner), (pair, pair_owner)]


def log_ratios(raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    def model(counts):
        return np.log((counts + smoothing) / (counts.sum() + smoothing * len(counts)))

    return model(target) - model(raw)


def log_weights(rows: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, target label or null, log_weight for each row of ``rows`` (doc_id, text, _label)."""
    shared = rows.sparkSession.sparkContext.broadcast(ratios)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            weight = np.zeros(len(batch))
            for found, owner in _both(batch.column(1), len(shared.value)):
                weight += np.bincount(owner, weights=shared.value[found], minlength=len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(weight)], names=["doc_id", "_label", "log_weight"]
            )

    return rows.select("doc_id", "text", "_label").mapInArrow(work, "doc_id long, _label int, log_weight double")


def best_cut(weights: np.ndarray, good: np.ndarray, good_cost: int = GOOD_COST) -> float:
    """The cut with the least cost of labelled rows on the wrong side; midway between its neighbours."""
    order = np.argsort(weights, kind="stable")
    weights, good = weights[order], good[order]
    wrong = good_cost * np.concatenate([[0], np.cumsum(good)]) + np.concatenate([np.cumsum(~good[::-1])[::-1], [0]])
    edges = np.concatenate([[True], weights[1:] > weights[:-1], [True]])
    places = np.flatnonzero(edges)
    place = places[np.argmin(wrong[places])]
    if place == 0:
        return -np.inf
    return np.inf if place == len(weights) else float(weights[place - 1] + weights[place]) / 2


def importance_resample(
    documents: DataFrame, labels: DataFrame, seed: int = SEED, most_labels: int = LABELLED_DOCUMENTS, buckets: int = BUCKETS
) -> DataFrame:
    """doc_id, log_weight, draw (weight plus Gumbel noise), selected for every row of ``documents``."""
    known = bounded_labels(labels, "quality", most_labels, seed)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.join(F.broadcast(known), F.col("doc_id") == F.col("_label_doc"), "left")
    raw, target = ngram_counts(rows.withColumn("target", F.coalesce(F.col("_label") == 1, F.lit(False))), buckets)
    noise = -F.log(-F.log(unit_hash(seed, F.col("doc_id"))))
    scored = cut(log_weights(rows, log_ratios(raw, target)).withColumn("draw", F.col("log_weight") + noise))
    judged = scored.filter("_label IS NOT NULL").select("log_weight", "_label").toPandas()
    good = judged["_label"].to_numpy() == 1
    threshold = best_cut(judged["log_weight"].to_numpy(), good) if good.any() and not good.all() else -np.inf
    k = scored.filter(F.col("log_weight") >= F.lit(float(threshold))).count()
    last = kth_largest(scored, "draw", k) if k else float("inf")
    return scored.select("doc_id", "log_weight", "draw", (F.col("draw") >= F.lit(last)).alias("selected"))


def keep_quality(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that the draw selects, with all their columns."""
    return without(documents, importance_resample(documents, labels, **options).filter(~F.col("selected")))
