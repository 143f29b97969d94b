"""Products of two vector tables, cut into blocks of bounded size.

Rows are hashed into blocks; every pair of blocks is one cogroup whose two sides fit into a task.
A task works on two NumPy matrices and gives back sums, counts or a short list for each row, never
the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows on each side of a block pair: 16384 x 64 doubles are 8 MB.
BLOCK_ROWS = 16_384
# Rows of the left block that are multiplied at once, and cells of the distance matrix, of which several are held.
STRIP_ROWS = 512
STRIP_CELLS = 2**21
# A squared distance below this share of the lengths is measured by differences, a few pairs at once.
CANCELLED = 1e-4
MEASURED_PAIRS = 65_536
# Squared distances that agree to this share are told apart by differences.
CLOSE_CALL = 1e-8
# Rows and columns of a product in single precision: 4 MB.
ROUGH_ROWS, ROUGH_COLUMNS = 256, 4_096
# A share of uncertain values beyond which single precision is of no use.
UNCERTAIN = 0.02
# Rows that a tile holds while the others stream past: 65536 x 64 doubles are 32 MB.
HELD_ROWS = 65_536
# Tiles for each core, and pairs of rows in a tile.
TILES_OF_CORE = 4
TILE_PAIRS = 2**32


def matrix(column) -> np.ndarray:
    """An Arrow list column as a 2-D array of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def list_column(values: np.ndarray, kind=np.float64) -> pa.Array:
    """A 2-D array as an Arrow list column, without going through Python lists."""
    offsets = np.arange(0, values.size + 1, max(values.shape[1], 1), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values, dtype=kind).ravel()))


def measured(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (a[i], b[j]) from their differences, without cancellation."""
    out = np.empty(len(i))
    for start in range(0, len(i), MEASURED_PAIRS):
        part = slice(start, start + MEASURED_PAIRS)
        out[part] = ((a[i[part]] - b[j[part]]) ** 2).sum(axis=1)
    return out


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, to about ten digits whatever offset the vectors share.

    One matrix product round a common centre gives most of them; pairs that are close against their
    distance from the centre, where it would cancel, are measured by their differences.
    """
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    centre = b.mean(axis=0)
    near_a, near_b = a - centre, b - centre
    aa, bb = np.einsum("ij,ij->i", near_a, near_a), np.einsum("ij,ij->i", near_b, near_b)
    scale = aa[:, None] + bb[None, :]
    out = scale - 2.0 * (near_a @ near_b.T)
    i, j = np.nonzero(out < scale * CANCELLED)
    out[i, j] = measured(a, b, i, j)
    return out


def nearest_rows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``a`` the place of the nearest row of ``b``, the first on a tie, and the distance.

    Whoever comes close to the least is measured directly, so neither the offset of the vectors nor
    the block that a row falls into decides.
    """
    place, distance = np.empty(len(a), dtype=np.int64), np.empty(len(a))
    for strip in strips(len(a), len(b)):
        rows = a[strip]
        squares = squared_distances(rows, b)
        i, j = np.nonzero(squares <= squares.min(axis=1, keepdims=True) * (1 + CLOSE_CALL))
        exact = measured(rows, b, i, j)
        order = np.lexsort([j, exact, i])
        first = np.searchsorted(i[order], np.arange(len(rows)))
        place[strip] = j[order][first]
        distance[strip] = np.sqrt(exact[order][first])
    return place, distance


class Rough:
    """Values that rise with the distance to the rows of ``base`` (or fall with the product), in single precision.

    One matrix product gives |b|^2 / 2 - a.b round the centre of ``base`` and in units of its size, with a bound
    on the error of each row, so that sums and lists are exact once the few values within it are measured.
    """

    def __init__(self, base: np.ndarray, distance: bool = True):
        self.centre = base.mean(axis=0) if distance else np.zeros(base.shape[1])
        near = base - self.centre
        size = math.sqrt(np.einsum("ij,ij->i", near, near).max(initial=0.0))
        self.size = size if size else 1.0
        near = near / self.size
        half = np.einsum("ij,ij->i", near, near) / 2 if distance else np.zeros(len(near))
        self.table = np.concatenate([-near, half[:, None]], axis=1).astype(np.float32).T.copy()
        self.sound = bool(np.isfinite(self.table).all())

    def placed(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows as factors of the product, their squares, and the greatest error of their values."""
        near = (rows - self.centre) / self.size
        squares = np.einsum("ij,ij->i", near, near)
        error = (rows.shape[1] + 16) * 2.0**-24 * (np.sqrt(squares) + 1.0)
        return np.concatenate([near, np.ones((len(near), 1))], axis=1).astype(np.float32), squares, error


def strips(rows: int, columns: int = BLOCK_ROWS) -> list[slice]:
    """Parts of the rows whose products with this many columns have a bounded number of cells."""
    step = max(1, min(STRIP_ROWS, STRIP_CELLS // max(columns, 1)))
    return [slice(start, min(start + step, rows)) for start in range(0, rows, step)]


def block_count(rows: int, spread: int = 1) -> int:
    """Blocks for this many rows; small tables still use some parallel tasks."""
    return max(1, math.ceil(rows / BLOCK_ROWS), min(spread, math.ceil(rows / 256)))


def block_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    work: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    left_rows: int,
    right_rows: int,
) -> DataFrame:
    """``work(left block, right block)`` for every pair of blocks.

    Each left row is sent to all right blocks and the other way round, so the traffic is
    rows x blocks and the work is spread evenly whatever the keys are.
    """
    spread = max(1, math.isqrt(left.sparkSession.sparkContext.defaultParallelism))
    left_blocks, right_blocks = block_count(left_rows, spread), block_count(right_rows, spread)

    def every(blocks: int):
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    a = left.withColumn("_lb", F.pmod(F.xxhash64(left_key), F.lit(left_blocks)).cast("int"))
    b = right.withColumn("_rb", F.pmod(F.xxhash64(right_key), F.lit(right_blocks)).cast("int"))
    a, b = a.withColumn("_rb", every(right_blocks)), b.withColumn("_lb", every(left_blocks))
    return a.groupBy("_lb", "_rb").cogroup(b.groupBy("_lb", "_rb")).applyInArrow(work, schema)


def tile_sides(left_rows: int, right_rows: int, tasks: int) -> tuple[int, int]:
    """Parts of the left and of the right side: each left row is copied to all right parts and the other way round.

    The right parts fit into memory; left parts of any size stream past, so there are only as many as
    keep ``tasks`` busy and a tile's work bounded. Both numbers are about the root of the tiles at most.
    """
    root = max(1, math.isqrt(tasks))
    right = max(math.ceil(right_rows / HELD_ROWS), min(root, math.ceil(right_rows / 256)), 1)
    held = math.ceil(right_rows / right)
    left = max(math.ceil(left_rows * held / TILE_PAIRS), min(math.ceil(tasks / right), math.ceil(left_rows / 256)), 1)
    return left, right


def tile_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    work: Callable[[pa.Table], Callable[[pa.Table], pa.Table]],
    schema: str,
    left_rows: int,
    right_rows: int,
) -> DataFrame:
    """A square grid of tiles: ``work(right part)`` is called on each batch of the left part.

    A tile holds its right part and lets its left part stream past. There are several tiles for each core,
    as some partitions get two.
    """
    tasks = TILES_OF_CORE * left.sparkSession.sparkContext.defaultParallelism
    left_parts, right_parts = tile_sides(left_rows, right_rows, tasks)
    names = {"_l": F.struct(*left.columns), "_r": F.struct(*right.columns)}

    def side(rows: DataFrame, own: str, key: str, number: int, parts: int, others: int) -> DataFrame:
        place = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return rows.select(place.alias("_own"), every.alias("_other"), F.lit(number).alias("_side"), names[own].alias(own))

    a = side(left, "_l", left_key, 1, left_parts, right_parts)
    b = side(right, "_r", right_key, 0, right_parts, left_parts)
    a = a.select((F.col("_own") * right_parts + F.col("_other")).alias("_tile"), "_side", "_l")
    b = b.select((F.col("_other") * right_parts + F.col("_own")).alias("_tile"), "_side", "_r")
    both = a.unionByName(b, allowMissingColumns=True)
    placed = both.repartition(left_parts * right_parts, "_tile").sortWithinPartitions("_tile", "_side")

    def run(batches):
        tile, held, ready = None, [], None
        for batch in batches:
            code = 2 * np.asarray(batch.column(0), dtype=np.int64) + np.asarray(batch.column(1))
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                part, now = batch.slice(low, high - low), int(code[low])
                if now // 2 != tile:
                    tile, held, ready = now // 2, [], None
                column = part.column(part.schema.get_field_index("_l" if now % 2 else "_r"))
                rows = pa.Table.from_arrays(column.flatten(), names=[f.name for f in column.type])
                if not now % 2:
                    held.append(rows)
                elif held:
                    if ready is None:
                        ready = work(pa.concat_tables(held).combine_chunks())
                    yield from ready(rows).combine_chunks().to_batches()

    return placed.select("_tile", "_side", "_l", "_r").mapInArrow(run, schema)


def nearest_center(points: DataFrame, centers: np.ndarray, vec: str = "vec") -> DataFrame:
    """Adds ``cell`` (place of the nearest center, the first on a tie) and ``radius`` (distance to it).

    The centers are a model of bounded size that every task holds; nothing is shuffled.
    """
    shared = points.sparkSession.sparkContext.broadcast(np.asarray(centers, dtype=np.float64))
    schema = points.withColumns({"cell": F.lit(0), "radius": F.lit(0.0)}).schema

    def assign(batches):
        for batch in batches:
            vectors = matrix(batch.column(batch.schema.get_field_index(vec)))
            cell, radius = nearest_rows(vectors, shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(radius)], names=[*batch.schema.names, "cell", "radius"]
            )

    return points.mapInArrow(assign, schema)
