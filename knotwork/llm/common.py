"""What several operators of this subpackage share: words and shingles in Arrow batches, guarded joins, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.session import cut

SHINGLE_WORDS = 5
# Text that is worked on at once in a task; longer texts come alone.
SLICE_BYTES = 2_000_000
# A side of more rows than this is not broadcast.
BROADCAST_ROWS = 50_000
JOIN_SALTS = 32
# Edges of one union-find in a task.
FOREST_EDGES = 500_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unit_hash(seed: int, *columns: Column) -> Column:
    """Seeded number in (0, 1): 48 bits of MD5 over the seed and the columns, as other engines can compute it too."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(float(16**12))


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join of rows with a table that has one row for a key, however often a key occurs on the left.

    The right side is broadcast once a count has shown that it has at most ``most`` rows. Beyond
    that its rows are copied to a few salts and each left row takes one of them, so that a key with
    a third of the left rows is spread over many tasks. Null keys are matched like any other value.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    right = right.select(*[F.col(c).alias(k) for c, k in zip(on, keys)], *[c for c in right.columns if c not in on])
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(on, keys)]
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), same, how).drop(*keys)
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(JOIN_SALTS))
    copies = right.withColumn("_salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(JOIN_SALTS - 1).cast("long"))))
    salted = left.withColumn("_salt", salt)
    return salted.join(copies, [*same, F.col("_salt") == F.col("_salt2")], how).drop(*keys, "_salt", "_salt2")


def components(edges: DataFrame) -> DataFrame:
    """key, component (the least key reachable) for the ends of ``edges`` (src, dst).

    Each task turns at most ``FOREST_EDGES`` edges at a time into stars with a union-find. A node
    that got several roots ties them together: these ties are the edges of the next, smaller level.
    The levels end when every node has one root; a level of few edges fits into one task.
    """

    def star(forest: Forest) -> pa.RecordBatch:
        nodes = list(forest.parent)
        columns = [pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["key", "root"])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), 0
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.union(a, b)
            held += len(batch)
            if held >= FOREST_EDGES:
                yield star(forest)
                forest, held = Forest(), 0
        yield star(forest)

    current, found = edges.select("src", "dst"), None
    while True:
        rooted = current.mapInArrow(stars, "key long, root long")
        # As many roots for a node as forests that hold it.
        level = cut(rooted.groupBy("key").agg(F.min("root").alias("component"), F.collect_set("root").alias("roots")))
        if found is None:
            found = level.select("key", "component")
        else:
            up = level.select(F.col("key").alias("_key"), F.col("component").alias("_up"))
            found = found.join(up, F.col("component") == F.col("_key"), "left")
            found = found.select("key", F.coalesce("_up", "component").alias("component"))
        ties = level.select(F.explode("roots").alias("src"), F.col("component").alias("dst")).filter("src <> dst").distinct()
        current = cut(ties)
        count = current.count()
        if not count:
            return found
        current = current.repartition(-(-count // FOREST_EDGES))


class Forest:
    """Union-find whose roots are the least members."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds a few megabytes of text, or one longer text."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
        start = 0
        while start < len(batch):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: offsets of each text's words, dictionary codes, dictionary."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    words = pc.dictionary_encode(parts.flatten())
    offsets = offsets - offsets[0]
    codes = np.asarray(words.indices)
    empty = pc.index(words.dictionary, pa.scalar("", words.dictionary.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return offsets, codes, words.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread evenly."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


# A random number for each byte value.
_BYTES = np.random.default_rng(64).integers(1, 2**63, 256, dtype=np.uint64)


def word_hashes(words: pa.StringArray) -> np.ndarray:
    """64-bit hashes of words from their bytes: byte numbers times powers by place, summed and mixed."""
    if not len(words):
        return np.zeros(0, np.uint64)
    wide = np.int64 if pa.types.is_large_string(words.type) else np.int32
    offsets = np.frombuffer(words.buffers()[1], dtype=wide)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    text = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    powers = np.cumprod(np.full(int(sizes.max()) + 1, _ODD), dtype=np.uint64)
    place = np.arange(len(text)) - np.repeat(offsets[:-1], sizes)
    out = np.zeros(len(words), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(_BYTES[text] * powers[place], offsets[:-1][full])
    return mixed(out + sizes.astype(np.uint64))


def shingle_sets(texts: pa.Array, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in rising order, one after another, and their offsets.

    Only A-Z are lower-cased. A text with fewer words is one shingle; one without words has none.
    """
    offsets, codes, dictionary = word_codes(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = word_hashes(dictionary)[codes] if len(dictionary) else np.zeros(0, np.uint64)
    rolled = hashes[: max(0, len(hashes) - words + 1)].copy()
    for place in range(1, words):
        rolled = rolled * _ODD + hashes[place : place + len(rolled)]
    rolled = mixed(rolled)
    sets = []
    for start, stop in zip(offsets[:-1], offsets[1:]):
        if stop - start >= words:
            sets.append(np.unique(rolled[start : stop - words + 1]))
        elif stop > start:
            short = hashes[start:stop]
            value = np.uint64(stop - start)
            for h in short:
                value = np.uint64((int(value) * int(_ODD) + int(h)) & 0xFFFFFFFFFFFFFFFF)
            sets.append(mixed(np.array([value], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def set_digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def bounded_labels(labels: DataFrame, column: str, most: int, seed: int) -> DataFrame:
    """_label_doc, _label: one row for each labelled document, a seeded sample where there are more than ``most``.

    The result has about ``most`` rows at most and may be broadcast. Null ids and null labels take no part.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("_label_doc")).agg(F.max(column).cast("int").alias("_label"))
    rows = known.count()
    return known if rows <= most else known.filter(unit_hash(seed, F.col("_label_doc")) < most / rows)


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a column of numbers, by histograms that narrow in on it."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    while low < high:
        width = (high - low) / bins
        bin_ = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        inside = rows.filter(F.col(column).between(low, high))
        counts = inside.groupBy(bin_.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        for row in sorted(counts.collect(), key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                low, high, held = row["low"], row["high"], row["n"]
                break
            above += row["n"]
        if low < high and held <= bins:
            values = sorted((r[0] for r in rows.filter(F.col(column).between(low, high)).select(column).collect()), reverse=True)
            return values[k - above - 1]
    return low


def without(documents: DataFrame, gone: DataFrame, most: int = 20 * BROADCAST_ROWS) -> DataFrame:
    """``documents`` but for the ids of ``gone`` (doc_id); a short list is broadcast, a longer one shuffled.

    Rows that share an id share its fate; rows without an id stay.
    """
    ids = cut(gone.select("doc_id").distinct())
    if ids.count() <= most:
        ids = F.broadcast(ids)
    return documents.join(ids, documents["doc_id"] == ids["doc_id"], "left_anti")
