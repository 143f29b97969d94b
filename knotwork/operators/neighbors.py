"""k nearest neighbours and what is built on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.scalars import similarity_weight
from knotwork.operators.blocks import BLOCK_ROWS, ROUGH_ROWS, UNCERTAIN, Rough, matrix, measured, nearest_center, nearest_rows, squared_distances, strips
from knotwork.operators.skew import salted_join
from knotwork.session import cut

DEFAULT_K = 15
# The cells of the space are a model that each task holds; their number has this bound.
MAX_CELLS = 4_096
# Shelves among which the cells of a small table are dealt, so that the bounds leave some out.
FEW_SHELVES = 8
# Rows of which a first look keeps the least value alone.
GROUPED = 32
# Vectors with more copies than this are searched once for all copies.
COPY_LIMIT = 1_024


def _near_pairs(q: np.ndarray, b: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that may be among the k nearest of a query: all within rounding of the k-th place."""
    approximate = squared_distances(q, b)
    selves = np.flatnonzero(own >= 0)
    approximate[selves, own[selves]] = np.inf
    wanted = min(k, len(b))
    edge = np.partition(approximate, wanted - 1, axis=1)[:, wanted - 1]
    slack = 1e-9 * (np.abs(edge[np.isfinite(edge)]).max(initial=0.0) + (q**2).sum(axis=1).max())
    return np.nonzero((approximate <= (edge + slack)[:, None]) & np.isfinite(approximate))


def _rough_pairs(rough: Rough, q: np.ndarray, own: np.ndarray, k: int, out: np.ndarray):
    """The same from single precision, or None where that does not tell enough rows apart.

    The k-th least of the minima of disjoint groups of rows is no less than the k-th least of all.
    """
    factors, _, error = rough.placed(q)
    if not np.isfinite(factors).all():
        return None
    values = np.matmul(factors, rough.table, out=out[: len(q), : rough.table.shape[1]])
    selves = np.flatnonzero(own >= 0)
    values[selves, own[selves]] = np.inf
    groups = values.shape[1] // GROUPED
    least = values[:, : groups * GROUPED].reshape(len(q), GROUPED, groups).min(axis=1)
    edge = np.partition(least, k - 1, axis=1)[:, k - 1] + 2 * error
    places = np.flatnonzero(values <= np.nextafter(edge.astype(np.float32), np.float32(np.inf))[:, None])
    if len(places) > max(UNCERTAIN * values.size, 8 * k * len(q)):
        return None
    return np.divmod(places, values.shape[1])


def _shortlist(k: int, drop_self: bool):
    """Per cogroup: the k nearest base rows of each query row, by (distance, key)."""

    def work(queries: pa.Table, base: pa.Table) -> pa.Table:
        schema = pa.schema(
            [("src", queries.schema.field("src").type), ("dst", queries.schema.field("src").type), ("distance", pa.float64())]
        )
        if queries.num_rows == 0 or base.num_rows == 0:
            return schema.empty_table()
        base = base.sort_by("dst")
        q, b = matrix(queries.column("query_vec")), matrix(base.column("vec"))
        own = np.full(len(q), -1)
        if drop_self:
            own = pd.Index(base.column("dst").to_pandas()).get_indexer(queries.column("src").to_pandas())
        rough = Rough(b) if len(b) >= 2 * GROUPED * (k + 1) else None
        rough = rough if rough is not None and rough.sound else None
        out = np.empty((ROUGH_ROWS, len(b)), dtype=np.float32) if rough else None
        left, right, distance = [], [], []
        for strip in [slice(s, s + ROUGH_ROWS) for s in range(0, len(q), ROUGH_ROWS)] if rough else strips(len(q), len(b)):
            pairs = _rough_pairs(rough, q[strip], own[strip], k, out) if rough else None
            rows, columns = pairs if pairs is not None else _near_pairs(q[strip], b, own[strip], k)
            # Whoever may belong to the list is measured again, exactly.
            exact = np.sqrt(measured(q[strip], b, rows, columns))
            order = np.lexsort((columns, exact, rows))
            rows, columns, exact = rows[order], columns[order], exact[order]
            starts = np.searchsorted(rows, rows, side="left")
            kept = np.arange(len(rows)) - starts < k
            left.append(rows[kept] + strip.start)
            right.append(columns[kept])
            distance.append(exact[kept])
        return pa.table(
            [
                queries.column("src").take(pa.array(np.concatenate(left))),
                base.column("dst").take(pa.array(np.concatenate(right))),
                pa.array(np.concatenate(distance)),
            ],
            schema=schema,
        )

    return work


def _router(pivots: np.ndarray, radii: np.ndarray, closest: np.ndarray, wanted: int, probes: int | None, shelf: np.ndarray):
    """Which shelves hold a cell that a query must visit; ``shelf`` has the shelf of each cell.

    ``closest[c]`` holds the smallest distances of base rows of cell c to its pivot. A base row at
    distance t from pivot p is at most d(query, p) + t away, so the ``wanted``-th smallest such sum
    bounds the search; a cell whose nearest possible row is farther away is skipped.
    """
    between = np.sqrt(squared_distances(pivots, pivots))
    order = np.argsort(shelf, kind="stable")
    names, first = np.unique(shelf[order], return_index=True)

    def shelves_of(visited: np.ndarray) -> list:
        found = np.logical_or.reduceat(visited[:, order], first, axis=1)
        return [names[row].astype(np.int32).tolist() for row in found]

    def route(batches):
        for batch in batches:
            vectors = matrix(batch.column(batch.schema.get_field_index("vec")))
            cells = []
            for start in range(0, len(vectors), 64):
                part = vectors[start : start + 64]
                away = np.sqrt(squared_distances(part, pivots))
                if probes is not None:
                    visited = np.zeros(away.shape, dtype=bool)
                    np.put_along_axis(visited, np.argsort(away, axis=1)[:, :probes], True, axis=1)
                    cells += shelves_of(visited)
                    continue
                sums = (away[:, :, None] + closest[None, :, :]).reshape(len(part), -1)
                place = min(wanted, sums.shape[1]) - 1
                bound = np.partition(sums, place, axis=1)[:, place] * (1 + 1e-9) + 1e-9
                home = away.argmin(axis=1)
                gap = between[home]
                plane = np.divide(away**2 - away[np.arange(len(part)), home][:, None] ** 2, 2 * gap, out=np.zeros_like(gap), where=gap > 0)
                least = np.maximum(away - radii[None, :], plane)
                cells += shelves_of(least <= bound[:, None])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, type=pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"]
            )

    return route


def knn(
    points: DataFrame,
    k: int = DEFAULT_K,
    queries: DataFrame | None = None,
    include_self: bool = False,
    probes: int | None = None,
    block_rows: int = BLOCK_ROWS,
    copy_limit: int = COPY_LIMIT,
) -> DataFrame:
    """src, dst, distance, place: the k nearest points of each query row, ties by key.

    ``points`` and ``queries`` have ``key`` and ``vec``; without queries the points are their own,
    and k is kept between 2 and n - 1. If some vector has more than ``copy_limit`` copies, distinct
    vectors are searched and every copy takes over the list of its vector.
    """
    itself = queries is None
    points = points.select("key", "vec")
    if itself:
        k = min(max(2, k), max(points.count() - 1, 1))
    asked = points if itself else queries.select("key", "vec")
    sides = [points] if itself else [points, asked]
    crowded = any(
        side.groupBy("vec").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > copy_limit).take(1) for side in sides
    )
    if not crowded:
        return _search(points, k, asked, itself and not include_self, probes, block_rows)
    # The k + 1 least keys of a vector are all that a list can need; Spark keeps no more than
    # that per vector and map task before the shuffle.
    first = Window.partitionBy("vec").orderBy("key")
    few = points.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= k + 1)
    single = cut(few.groupBy("vec").agg(F.min("key").alias("key"), F.sort_array(F.collect_list("key")).alias("_keys")))
    wanted = single if itself else cut(asked.groupBy("vec").agg(F.min("key").alias("key")))
    near = _search(single.select("key", "vec"), k + 1, wanted.select("key", "vec"), False, probes, block_rows)
    keys = single.select(F.col("key").alias("dst"), "_keys")
    each = salted_join(near, keys, ["dst"]).select("src", "distance", F.explode("_keys").alias("dst"))
    order = Window.partitionBy("src").orderBy("distance", "dst")
    each = each.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k + 1)
    lists = each.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("distance", "dst"))).alias("_list"))
    by_vector = cut(wanted.select("vec", F.col("key").alias("src")).join(lists, "src").select("vec", "_list"))
    rows = salted_join(asked, by_vector, ["vec"])
    if itself and not include_self:
        rows = rows.withColumn("_list", F.filter("_list", lambda item: item["dst"] != F.col("key")))
    out = rows.select(F.col("key").alias("src"), F.posexplode(F.slice("_list", 1, k)).alias("_place", "_item"))
    return out.select("src", "_item.dst", "_item.distance", (F.col("_place") + 1).alias("place"))


def cell_pivots(base: DataFrame, cells: int) -> np.ndarray:
    """Centers of cells: the vectors of some rows of ``base`` (a key and vec), drawn by hash."""
    key = base.columns[0]
    sample = base.orderBy(F.xxhash64(key), key).limit(cells).select("vec").collect()
    return np.array([row["vec"] for row in sample], dtype=np.float64)


def meet_in_cells(left: DataFrame, right: DataFrame, block_rows: int, work, schema: str, spread: bool) -> DataFrame:
    """``work`` on the rows of ``left`` (src, cell) and ``right`` (dst, cell) in each cell, large cells in
    blocks of bounded size; ``spread`` deals the left rows of a single cell to all cores."""
    tasks = left.sparkSession.sparkContext.defaultParallelism if spread else 1
    sizes = right.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    visits = left.groupBy("cell").agg(F.count(F.lit(1)).alias("visits"))
    blocks = F.greatest(F.ceil(F.col("visits") / block_rows), F.least(F.lit(tasks), F.ceil(F.col("visits") / 256)))
    # One row for each cell, at most MAX_CELLS.
    layout = F.broadcast(
        sizes.join(visits, "cell").select(
            "cell", F.ceil(F.col("rows") / block_rows).cast("int").alias("chunks"), blocks.cast("int").alias("blocks")
        )
    )

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    right = right.join(layout, "cell").withColumn("chunk", F.pmod(F.xxhash64("dst"), F.col("chunks")).cast("int"))
    right = right.withColumn("block", every("blocks")).drop("chunks", "blocks")
    left = left.join(layout, "cell").withColumn("block", F.pmod(F.xxhash64("src"), F.col("blocks")).cast("int"))
    left = left.withColumn("chunk", every("chunks")).drop("chunks", "blocks")
    group = ["cell", "chunk", "block"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(work, schema)


def _search(
    points: DataFrame, k: int, queries: DataFrame, drop_self: bool, probes: int | None, block_rows: int
) -> DataFrame:
    """The k nearest points of each query row.

    The space is cut into cells around sampled pivots. Triangle and half-plane bounds tell which
    cells can hold a neighbour, so the result is exact; ``probes`` visits only that many nearest
    cells and is then approximate. Small cells that lie together share a shelf of about a block, and
    a query is sent once to each shelf that it must visit, so that its copies are as many as blocks
    and not as many as cells. Shelves larger than a block are split, so a crowded region is
    many tasks, and each task returns at most k rows per query.
    """
    base = points.select(F.col("key").alias("dst"), "vec")
    rows = base.count()
    asked = queries.select(F.col("key").alias("src"), "vec")
    cells = max(1, min(MAX_CELLS, math.ceil(rows / block_rows)))
    if cells == 1:
        placed = base.withColumn("cell", F.lit(0))
        routed = asked.withColumn("cell", F.lit(0))
    else:
        pivots = cell_pivots(base, cells)
        placed = cut(nearest_center(base, pivots))
        wanted = k + 1 if drop_self else k
        near = Window.partitionBy("cell").orderBy("radius")
        firsts = placed.select("cell", "radius").withColumn("_place", F.row_number().over(near)).filter(F.col("_place") <= wanted)
        # One row for each cell: k distances and the radius.
        model = (
            firsts.groupBy("cell")
            .agg(F.sort_array(F.collect_list("radius")).alias("closest"))
            .join(placed.groupBy("cell").agg(F.max("radius").alias("radius")), "cell")
            .collect()
        )
        radii = np.full(cells, -np.inf)
        closest = np.full((cells, wanted), np.inf)
        for row in model:
            radii[row["cell"]] = row["radius"]
            closest[row["cell"], : len(row["closest"])] = row["closest"]
        schema = asked.withColumn("cells", F.array(F.lit(0))).schema
        shelf = np.arange(len(pivots))
        if probes is None:
            shelves = min(cells, max(math.ceil(rows / BLOCK_ROWS), min(FEW_SHELVES, math.isqrt(cells))))
            shelf, block_rows = nearest_rows(pivots, pivots[:shelves])[0], max(block_rows, BLOCK_ROWS)
        route = _router(pivots, radii, closest, wanted, probes, shelf)
        routed = cut(asked.mapInArrow(route, schema)).withColumn("cell", F.explode("cells")).drop("cells")
        # One row for each cell.
        names = base.sparkSession.createDataFrame(list(enumerate(shelf.tolist())), "cell int, _shelf int")
        placed = placed.join(F.broadcast(names), "cell").drop("radius", "cell").withColumnRenamed("_shelf", "cell")
    kind = asked.schema["src"].dataType.simpleString()
    lists = meet_in_cells(
        routed.withColumnRenamed("vec", "query_vec"), placed, block_rows, _shortlist(k, drop_self), f"src {kind}, dst {kind}, distance double", spread=cells == 1
    )
    order = Window.partitionBy("src").orderBy("distance", "dst")
    return lists.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def simplify_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges without loops and repeats; the least weight stays."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    plain = edges.filter(F.col("src") != F.col("dst")).select(a.alias("src"), b.alias("dst"), "weight")
    return plain.groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def knn_graph(
    points: DataFrame, k: int = DEFAULT_K, include_self: bool = False, simplify: bool = True, weighted: bool = False, **options
) -> DataFrame:
    """src, dst, weight of the k-NN graph; weight 1, or 1 / (1 + distance)."""
    weight = similarity_weight(F.col("distance")) if weighted else F.lit(1.0)
    edges = knn(points, k, include_self=include_self, **options).select("src", "dst", weight.alias("weight"))
    return simplify_edges(edges) if simplify else edges


def core_distance(neighbors: DataFrame, min_samples: int) -> DataFrame:
    """Distance to the min_samples-th neighbour of each point, from a neighbour table."""
    return neighbors.filter(F.col("place") == min_samples).select(F.col("src").alias("key"), F.col("distance").alias("core"))


def mutual_reachability(neighbors: DataFrame, cores: DataFrame) -> DataFrame:
    """Undirected edges weighted by max(core of either end, distance)."""
    a = cores.select(F.col("key").alias("src"), F.col("core").alias("_a"))
    b = cores.select(F.col("key").alias("dst"), F.col("core").alias("_b"))
    reach = F.greatest("_a", "_b", "distance")
    # Copies of a point share their nearest keys, so a dst can be hot.
    edges = salted_join(neighbors.join(a, "src"), b, ["dst"], count_on=neighbors).select("src", "dst", reach.alias("weight"))
    return simplify_edges(edges)


def fuzzy_knn_weights(neighbors: DataFrame, k: int, rounds: int = 40) -> DataFrame:
    """Undirected neighbour memberships: exp(-(d - rho) / sigma), united as a + b - ab.

    rho is the nearest distance; sigma makes the memberships of a point sum to log2(k) and is
    found by halving an interval on the k distances of each point.
    """
    target = math.log2(k)
    lists = neighbors.groupBy("src").agg(F.sort_array(F.collect_list("distance")).alias("_d"))
    rho, distances = F.element_at("_d", 1), F.col("_d")

    def mass(sigma):
        return F.aggregate(distances, F.lit(0.0), lambda acc, d: acc + F.exp(-(d - rho) / sigma))

    start = F.struct(F.lit(1e-9).alias("low"), (F.element_at("_d", -1) * 1000 + 1e-6).alias("high"))

    def halve(state, _):
        middle = (state["low"] + state["high"]) / 2
        heavy = mass(middle) > target
        return F.struct(
            F.when(heavy, state["low"]).otherwise(middle).alias("low"),
            F.when(heavy, middle).otherwise(state["high"]).alias("high"),
        )

    interval = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve)
    scales = lists.select("src", rho.alias("_rho"), ((interval["low"] + interval["high"]) / 2).alias("_sigma"))
    membership = F.exp(-(F.col("distance") - F.col("_rho")) / F.col("_sigma"))
    directed = neighbors.join(scales, "src").select("src", "dst", membership.alias("_w"))
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    both = directed.select(a.alias("src"), b.alias("dst"), "_w").groupBy("src", "dst").agg(
        F.sum("_w").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.min("_w").alias("_min"), F.max("_w").alias("_max")
    )
    united = F.col("_sum") - F.when(F.col("_n") == 2, F.col("_min") * F.col("_max")).otherwise(0.0)
    return both.select("src", "dst", united.alias("weight"))
