"""Approximate k nearest neighbours by neighbour-of-neighbour descent.

Seeded partitions of the space give every point a first list. Then the neighbours of a point are
compared with each other and whoever finds a closer one takes it into its list, until hardly a list
changes. Points that lie together share a block, to which each vector goes once and in short: by codes
whose error is small against the distance to the nearest neighbour. The lists are measured in doubles
at the end. A task holds the vectors of one leaf, or of the neighbours of one block of points: both
have a bound that does not hang on the data. ``neighbors.knn`` is the exact way.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.blocks import list_column, matrix, squared_distances, strips
from knotwork.operators.neighbors import DEFAULT_K, knn
from knotwork.session import cut, discard

# Rows that a leaf of a partition aims at; larger leaves are dealt into parts by a hash of the key.
LEAF_ROWS = 512
# Larger tables take larger leaves: a row sent to a leaf is compared with all others in it.
LARGE_LEAF_ROWS = 8_192
PARTITIONS = 4
# Partitions come in groups, as long as a group changes more than this share of all list places.
GROUPS, GAIN = 4, 0.1
LEAST_POOL = 30
# The descent ends when a round changes less than this share of all list places.
SETTLED = 0.002
# Points of a block, and bytes of the vectors around them if they share none.
BLOCK_POINTS, BLOCK_BYTES = 32_768, 2**30
# Pairs of a block that are held before the farther ones go.
HELD_PAIRS = 2**22
# Codes: numpy type and steps over the span of a position; the error is at most this share of the least distance listed.
CODES = ((np.uint8, 2**8 - 1), (np.uint16, 2**16 - 1))
CODE_ERROR = 1 / 32
SAMPLE_ROWS = 1_000


def _directions(seed: int, bits: int, width: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(width, bits))


def _projected(points: DataFrame, directions: np.ndarray) -> DataFrame:
    """``points`` with side: the places of each vector along the directions (width x bits, a small model)."""
    shared = points.sparkSession.sparkContext.broadcast(directions)

    def work(batches):
        for batch in batches:
            vectors = matrix(batch.column("vec"))
            along = vectors @ shared.value if len(vectors) else np.zeros((0, shared.value.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, list_column(along)], names=[*batch.schema.names, "side"])

    return points.mapInArrow(work, points.withColumn("side", F.array(F.lit(0.0))).schema)


def _pair_lists(vectors: np.ndarray, limits: np.ndarray | None, fresh: np.ndarray | None, k: int, strip: slice = slice(None)):
    """Places (i, j) and distances of the at most k nearest j of each i of the strip that beat the limit of i."""
    rows = np.arange(len(vectors))[strip]
    squares = squared_distances(vectors[strip], vectors)
    squares[np.arange(len(rows)), rows] = np.inf
    if fresh is not None:
        squares[~(fresh[strip][:, None] | fresh[None, :])] = np.inf
    if limits is not None:
        squares[squares >= (limits[strip] ** 2)[:, None]] = np.inf
    kept = min(k, len(vectors) - 1)
    near = np.argpartition(squares, kept - 1, axis=1)[:, :kept] if kept < len(vectors) - 1 else np.argsort(squares, axis=1)[:, :kept]
    found = np.isfinite(np.take_along_axis(squares, near, axis=1)).ravel()
    i, j = np.repeat(rows, kept)[found], near.ravel()[found]
    return i, j, np.sqrt(((vectors[i] - vectors[j]) ** 2).sum(axis=1))


def _leaves(points: DataFrame, rows: int, leaf_rows: int, seed: int) -> DataFrame:
    """``points`` with leaf and part: signs along random directions, cut at their medians."""
    width = len(points.select("vec").first()["vec"])
    bits = max(0, math.ceil(math.log2(rows / leaf_rows)))
    if bits:
        placed = _projected(points, _directions(seed, bits, width))
        middles = placed.agg(*[F.percentile_approx(F.col("side")[i], 0.5).alias(f"m{i}") for i in range(bits)]).first()
        leaf = F.concat(*[(F.col("side")[i] > F.lit(middles[i])).cast("int").cast("string") for i in range(bits)])
    else:
        placed, leaf = points, F.lit("")
    placed = placed.select(*points.columns, leaf.alias("leaf"))
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * leaf_rows)).alias("parts"))
    # Copies share a leaf: a hash of the key deals them into parts, whose rows are copies as well.
    parts = placed.join(sizes, "leaf").withColumn("part", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("parts")))
    return parts.select(*points.columns, "leaf", "part")


def _leaf_lists(points: DataFrame, k: int, rows: int, seed: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """src, dst, distance inside the leaves of one partition, below the ``limit`` of src if ``points`` have one."""
    limited = "limit" in points.columns

    def work(table: pa.Table) -> pa.Table:
        keys, found = table.column("key"), []
        if len(keys) > 1:
            vectors = matrix(table.column("vec"))
            limits = table.column("limit").to_numpy() if limited else None
            found = [_pair_lists(vectors, limits, None, k, strip) for strip in strips(len(keys), len(keys))]
        i, j, distance = [np.concatenate(side) for side in zip(*found)] if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table([keys.take(pa.array(i)), keys.take(pa.array(j)), pa.array(distance)], names=["src", "dst", "distance"])

    kind = points.schema["key"].dataType.simpleString()
    return _leaves(points, rows, leaf_rows, seed).groupBy("leaf", "part").applyInArrow(work, f"src {kind}, dst {kind}, distance double")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """src, dst, distance, fresh: the k nearest of each src; a pair that was known stays known."""
    single = pairs.repartition("src").groupBy("src", "dst").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("src").orderBy("distance", "dst")
    return single.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k).drop("_place")


def _limited(points: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """``points`` with limit: the distance that a new neighbour has to beat."""
    limits = lists.groupBy(F.col("src").alias("key")).agg(F.max("distance").alias("limit"), F.count(F.lit(1)).alias("n"))
    limit = F.when(F.col("n") >= k, F.col("limit")).otherwise(F.lit(float("inf")))
    return points.join(limits.select("key", limit.alias("limit")), "key", "left").fillna({"limit": float("inf")})


def _grid(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least value and span of each position of the vectors; a task gives one row for each position."""

    def work(batches):
        low = high = None
        for batch in batches:
            vectors = matrix(batch.column(0))
            if len(vectors):
                vectors = np.where(np.isfinite(vectors), vectors, np.nan)
                least, greatest = np.fmin.reduce(vectors, axis=0), np.fmax.reduce(vectors, axis=0)
                low, high = (least, greatest) if low is None else (np.fmin(low, least), np.fmax(high, greatest))
        if low is not None:
            ends = [pa.array(side, from_pandas=True) for side in (low, high)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), *ends], names=["position", "low", "high"])

    ends = points.select("vec").mapInArrow(work, "position int, low double, high double").groupBy("position")
    rows = sorted(ends.agg(F.min("low").alias("low"), F.max("high").alias("high")).collect())
    low = np.array([0.0 if r.low is None else r.low for r in rows])
    span = np.array([0.0 if r.high is None else r.high for r in rows]) - low
    return low, np.where((span > 0) & np.isfinite(span), span, 1.0)


def _codes(points: DataFrame, lists: DataFrame, grid: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, code: each vector in as few bytes as its nearest neighbour allows, or whole in single or double precision."""
    low, span = grid
    near = lists.filter("distance > 0").groupBy(F.col("src").alias("key")).agg(F.min("distance").alias("near"))

    def work(batches):
        for batch in batches:
            vectors = matrix(batch.column(1))
            bound = batch.column(2).to_numpy(zero_copy_only=False) * CODE_ERROR
            codes, left = np.empty(len(vectors), dtype=object), np.arange(len(vectors))
            with np.errstate(all="ignore"):
                for kind, top in CODES if len(vectors) else ():
                    steps = np.rint((vectors[left] - low) / span * top)
                    error = np.sqrt((((low + steps * (span / top)) - vectors[left]) ** 2).sum(axis=1))
                    fits = error <= bound[left]
                    for place, row in zip(left[fits], steps[fits].astype(kind)):
                        codes[place] = row.tobytes()
                    left = left[~fits]
                for place in left:
                    single = vectors[place].astype(np.float32)
                    codes[place] = (single if (single == vectors[place]).all() else vectors[place]).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], names=["key", "code"])

    kind = points.schema["key"].dataType.simpleString()
    return points.select("key", "vec").join(near, "key", "left").mapInArrow(work, f"key {kind}, code binary")


def _decoded(codes: pa.Array, grid: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    low, span = grid
    out, sizes = np.empty((len(codes), len(low))), pc.binary_length(codes).to_numpy(zero_copy_only=False)
    for kind, top in (*CODES, (np.float32, None), (np.float64, None)):
        here = sizes == np.dtype(kind).itemsize * len(low)
        if here.any():
            rows = np.frombuffer(b"".join(codes.filter(pa.array(here)).to_pylist()), kind).reshape(-1, len(low))
            out[here] = rows if top is None else low + rows * (span / top)
    return out


def _nearest_pairs(i: np.ndarray, j: np.ndarray, distance: np.ndarray, k: int):
    """The k nearest j of each i, every pair once."""
    order = np.lexsort((j, distance, i))
    i, j, distance = i[order], j[order], distance[order]
    # The same pair has the same distance wherever it was found.
    new = np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])] if len(i) else np.zeros(0, bool)
    i, j, distance = i[new], j[new], distance[new]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept], distance[kept]


def _improvements(codes: DataFrame, grid: tuple[np.ndarray, np.ndarray], blocks: DataFrame, lists: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """src, dst, distance of pairs among the neighbours of a point that beat the list of src; and a table to discard.

    A point brings its own list and the k nearest of those that list it, so 2k + 1 vectors at most.
    """
    nearest = Window.partitionBy("dst").orderBy(F.desc("fresh"), "distance", "src")
    back = lists.withColumn("_place", F.row_number().over(nearest)).filter(F.col("_place") <= k)
    around = lists.select(F.col("src").alias("hub"), F.col("dst").alias("key"), "fresh").unionByName(
        back.select(F.col("dst").alias("hub"), F.col("src").alias("key"), "fresh")
    )
    around = around.repartition("hub").groupBy("hub", "key").agg(F.max("fresh").alias("fresh"))
    around = cut(around.join(blocks.withColumnRenamed("key", "hub"), "hub"))
    needed = around.select(F.col("block").alias("place"), F.col("key").alias("member")).repartition("member").distinct()
    known = _limited(codes, lists, k).withColumnRenamed("key", "member")
    members = needed.join(known, "member").select("place", "member", "code", "limit")
    kind = codes.schema["key"].dataType.simpleString()

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("member").combine_chunks()
        names = keys.unique()
        owner, asked = [pc.index_in(side, value_set=names).to_numpy() for side in (keys, left.column("key").combine_chunks())]
        # All rows of each key, should it repeat.
        rows = np.bincount(owner, minlength=len(names))
        first, each = (np.cumsum(rows) - rows)[asked], rows[asked]
        at = np.repeat(np.arange(len(asked)), each)
        places = np.argsort(owner, kind="stable")[first[at] + np.arange(len(at)) - (np.cumsum(each) - each)[at]]
        hubs = left.column("hub").combine_chunks().dictionary_encode().indices.to_numpy()[at]
        order = np.argsort(hubs, kind="stable")
        places, fresh = places[order], (left.column("fresh").to_numpy() > 0)[at][order]
        vectors, limits = _decoded(right.column("code").combine_chunks(), grid), right.column("limit").to_numpy()
        edges = np.flatnonzero(np.r_[True, np.diff(hubs[order]) != 0, True])
        found, held = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))], 0
        for low, high in zip(edges[:-1], edges[1:]):
            if high - low < 2 or not fresh[low:high].any():
                continue
            at = places[low:high]
            i, j, far = _pair_lists(vectors[at], limits[at], fresh[low:high], k)
            found.append((at[i], at[j], far))
            held += len(i)
            if held > HELD_PAIRS:
                found = [_nearest_pairs(*[np.concatenate(side) for side in zip(*found)], k)]
                held = 0
        i, j, distance = _nearest_pairs(*[np.concatenate(side) for side in zip(*found)], k)
        return pa.table([keys.take(pa.array(i)), keys.take(pa.array(j)), pa.array(distance)], names=["src", "dst", "distance"])

    grouped = around.groupBy("block").cogroup(members.groupBy("place"))
    return grouped.applyInArrow(work, f"src {kind}, dst {kind}, distance double"), around


def _measured(points: DataFrame, lists: DataFrame) -> DataFrame:
    """src, dst, distance of the listed pairs from the vectors themselves, the least if a key has several."""

    def work(batches):
        for batch in batches:
            apart = matrix(batch.column(2)) - matrix(batch.column(3))
            distance = np.sqrt((apart**2).sum(axis=1)) if len(apart) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance)], names=["src", "dst", "distance"])

    numbered = points.withColumn("row", F.monotonically_increasing_id())
    here, there = [numbered.select(*[F.col(name).alias(new) for name, new in (("key", end), ("vec", f"_{end}"), ("row", f"_{end}_row"))]) for end in ("src", "dst")]
    pairs = lists.select("src", "dst").join(there, "dst").join(here, "src").filter(F.col("_src_row") != F.col("_dst_row"))
    kind = points.schema["key"].dataType.simpleString()
    measured = pairs.select("src", "dst", "_src", "_dst").mapInArrow(work, f"src {kind}, dst {kind}, distance double")
    return measured.repartition("src").groupBy("src", "dst").agg(F.min("distance").alias("distance"))


def knn_approx(
    points: DataFrame,
    k: int = DEFAULT_K,
    pool: int | None = None,
    partitions: int = PARTITIONS,
    settled: float = SETTLED,
    seed: int = 42,
) -> DataFrame:
    """src, dst, distance, place: k near points of each point of ``points`` (key, vec), ties by key.

    k is kept between 2 and n - 1. While searching, a point keeps ``pool`` neighbours, 2k or more: in many
    dimensions the way to a neighbour leads over some that are farther. Points without a vector take no part; an empty table gives an
    empty one. Copies of one vector may list other copies than the exact search does, at the same
    distance. ``partitions`` are those of a group. ``recall`` measures how many of the nearest points the lists hold.
    """
    points = cut(points.select("key", "vec").filter(F.col("key").isNotNull() & F.col("vec").isNotNull()))
    rows = points.count()
    kind = points.schema["key"].dataType.simpleString()
    if rows < 2:
        return points.sparkSession.createDataFrame([], f"src {kind}, dst {kind}, distance double, place int")
    k = min(max(2, k), rows - 1)
    held = min(max(k, 2 * k if pool is None else pool, LEAST_POOL), rows - 1)
    large = rows > LEAF_ROWS
    leaf_rows = min(LARGE_LEAF_ROWS, max(LEAF_ROWS, rows // 4))

    def merge(lists: DataFrame | None, found: DataFrame) -> DataFrame:
        found = found.withColumn("fresh", F.lit(1))
        merged = cut(_best(found if lists is None else lists.withColumn("fresh", F.lit(0)).unionByName(found), held))
        if lists is not None:
            discard(lists)
        return merged

    lists, known = None, points
    spent = []
    for group in range(GROUPS if large else 1):
        seeds = range(seed + group * partitions, seed + (group + 1) * partitions) if large else [seed]
        lists = merge(lists, reduce(DataFrame.unionByName, [_leaf_lists(known, held, rows, each, leaf_rows) for each in seeds]))
        if lists.filter("fresh = 1").count() <= GAIN * rows * held:
            break
        known = cut(_limited(points, lists, held))
        spent.append(known)
    if large:
        grid = _grid(points)
        codes = cut(_codes(points, lists, grid))
        fitting = BLOCK_BYTES // ((2 * held + 1) * 8 * len(grid[0]))
        block_rows = max(LEAF_ROWS, min(BLOCK_POINTS, rows // 16, fitting))
        block = F.concat_ws("-", "leaf", "part").alias("block")
        blocks = cut(_leaves(points, rows, block_rows, seed).groupBy("key").agg(F.min(block).alias("block")))
        fresh = F.lit(1)
        while True:
            better, used = _improvements(codes, grid, blocks, lists.withColumn("fresh", fresh), held)
            lists, fresh = merge(lists, better), F.col("fresh")
            discard(used)
            # Every change lowers the sum of some list, so the rounds come to an end.
            if lists.filter("fresh = 1").count() <= settled * rows * held:
                break
        spent += [codes, blocks]
        lists = _measured(points, lists)
    for table in spent:
        discard(table)
    order = Window.partitionBy("src").orderBy("distance", "dst")
    return lists.select("src", "dst", "distance", F.row_number().over(order).alias("place")).filter(F.col("place") <= k)


def recall(points: DataFrame, found: DataFrame, k: int = DEFAULT_K, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row: recall, n_queries. The share of the k nearest points that the lists hold.

    Measured against the exact search for ``sample_rows`` points drawn by hash; a listed point counts
    when it is no farther than the exact k-th, so copies stand for each other.
    """
    points = points.select("key", "vec").filter(F.col("key").isNotNull() & F.col("vec").isNotNull())
    asked = cut(points.orderBy(F.xxhash64("key"), "key").limit(sample_rows))
    exact = knn(points, k + 1, queries=asked, include_self=True).filter(F.col("src") != F.col("dst"))
    order = Window.partitionBy("src").orderBy("distance", "dst")
    exact = exact.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    edge = exact.groupBy("src").agg(F.max("distance").alias("_edge"), F.count(F.lit(1)).alias("_wanted"))
    held = found.join(edge, "src").groupBy("src").agg(
        F.sum((F.col("distance") <= F.col("_edge") * (1 + 1e-9)).cast("long")).alias("_held")
    )
    each = edge.join(held, "src", "left").fillna({"_held": 0})
    share = F.sum(F.least("_held", "_wanted")) / F.sum("_wanted")
    return each.agg(F.coalesce(share, F.lit(1.0)).alias("recall"), F.count(F.lit(1)).alias("n_queries"))
