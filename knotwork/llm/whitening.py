"""Whitening of embeddings with MLlib's BlockMatrix.

Three passes. The first gives the exact sums of the scaled integer components. The second centres
the rows and lays them, numbered, into blocks of a written table; a product of the transposed block
matrix with itself, split along the rows, is the scatter matrix. Its eigenvectors are taken on the
driver (a matrix of width x width), and the third pass is the product of the block matrix with the
whitening matrix. Only block numbers, sums and matrices of the width reach the driver; a task of a
product holds ``BLOCKS_A_TASK`` blocks of at most ``BLOCK_BYTES`` from each side.

Each part of the table fills its blocks by itself and ends in rows of zeros that belong to no
vector; they add nothing to sums and products.

Defined results: vectors that are null or hold a null or non-finite component take no part; shorter
vectors count as filled up with zeros; scaled components are held at +-2^48; a deviation that does
not fit into 64 bits is null; repeated rows and ids, and null ids, count as rows of their own;
components without variance (as far as doubles tell) are left out, so equal vectors give no
rows; of equal eigenvalues any orthonormal vectors are taken, the same ones for all rows; extra
columns, whatever their names, are left aside; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.llm.topk import padded_matrix
from knotwork.session import cut, scratch

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
LIMIT = 2**48
BLOCK_BYTES = 8_000_000
LEAST_BLOCK_ROWS = 256
# Blocks for which the row count of a block stays small; the driver holds the numbers of all blocks.
BLOCKS = 4096
BLOCKS_A_TASK = 8
# Rows summed at once: 2^13 components below 2^49 fit into 64 bits.
SUM_ROWS = 8192

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_MATRIX = MatrixUDT.sqlType()
_PLACE = T.StructType([T.StructField("_1", T.LongType()), T.StructField("_2", T.LongType())])
_BLOCKS = T.StructType([T.StructField("_1", _PLACE), T.StructField("_2", MatrixUDT())])


def scaled(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + SHIFT of each component, exact for doubles."""
    return np.clip(np.floor(vectors * SCALE), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def finite_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, vec of the rows that take part."""
    values = F.col("embedding")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return rows.filter(values.isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("vec"))


def component_sums(known: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each scaled component."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts, totals = 0, [], []
        for batch in batches:
            for start in range(0, len(batch), SUM_ROWS):
                column = batch.column(0).slice(start, SUM_ROWS)
                sizes = np.diff(np.asarray(column.offsets))
                width = int(sizes.max(initial=0))
                sums = scaled(padded_matrix(column, width)).sum(axis=0).tolist()
                counts += [0] * (width - len(counts))
                totals += [0] * (width - len(totals))
                for place in range(width):
                    counts[place] += len(column)
                    totals[place] += sums[place]
                n += len(column)
        rows = [(-1, n, 0), *[(place, c, t) for place, (c, t) in enumerate(zip(counts, totals))]]
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([Decimal(r[2]) for r in rows], pa.decimal128(38, 0))], names=["place", "n", "total"]
        )

    parts = known.select("vec").mapInArrow(work, "place int, n long, total decimal(38,0)")
    found = {r["place"]: r for r in parts.groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    n = found[-1]["n"] if found else 0
    # Vectors without a component count with its zero.
    return n, [int(found[p]["total"]) + SHIFT * (n - found[p]["n"]) for p in range(len(found) - 1)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the components of (n x - S)^2 of each row, exact; None beyond 64 bits."""
    mean, rest = zip(*[divmod(s, n) for s in sums])
    gap = x - np.array(mean, dtype=np.int64)
    about = ((gap.astype(np.float64) * n - np.array(rest, dtype=np.float64)) ** 2).sum(axis=1)
    # Below this bound every term fits into 32 bits and the sum of squares into 64 bits without sign.
    fits = about < 2.0**63.5
    terms = gap[fits] * n - np.array(rest, dtype=np.int64)
    exact = (terms.astype(np.uint64) ** np.uint64(2)).sum(axis=1, dtype=np.uint64)
    out: list[int | None] = [None] * len(x)
    for place, value in zip(np.flatnonzero(fits).tolist(), exact.tolist()):
        out[place] = value if value < 2**63 else None
    return out


def _matrix_column(values: list[np.ndarray]) -> pa.Array:
    """Dense matrices, row by row, in the stored form of MLlib's matrix type."""
    count = len(values)
    kind = pa.struct(
        [
            pa.field("type", pa.int8(), False),
            pa.field("numRows", pa.int32(), False),
            pa.field("numCols", pa.int32(), False),
            pa.field("colPtrs", pa.list_(pa.int32())),
            pa.field("rowIndices", pa.list_(pa.int32())),
            pa.field("values", pa.list_(pa.float64())),
            pa.field("isTransposed", pa.bool_(), False),
        ]
    )
    ends = np.concatenate([[0], np.cumsum([v.size for v in values])]).astype(np.int32)
    none = pa.nulls(count, pa.list_(pa.int32()))
    columns = [
        pa.array([1] * count, pa.int8()),
        pa.array([len(v) for v in values], pa.int32()),
        pa.array([v.shape[1] for v in values], pa.int32()),
        none,
        none,
        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([v.ravel() for v in values]))),
        pa.array([True] * count),
    ]
    return pa.StructArray.from_arrays(columns, fields=list(kind))


def centred_blocks(known: DataFrame, n: int, sums: list[int], block_rows: int) -> DataFrame:
    """part, place, ids, deviations, matrix: the blocks that each part fills with its centred rows."""
    width = len(sums)
    mean, rest = zip(*[divmod(s, n) for s in sums])
    mean, rest = np.array(mean, dtype=np.int64), np.array([r / n for r in rest])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held, count = TaskContext.get().partitionId(), 0, [], 0

        def block(ids: pa.Array, vectors: pa.Array) -> pa.RecordBatch:
            x = scaled(padded_matrix(vectors, width))
            values = np.zeros((block_rows, width))
            values[: len(x)] = (x - mean) - rest
            columns = [pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([ids.to_pylist()], pa.list_(pa.int64()))]
            columns += [pa.array([deviations(x, n, sums)], pa.list_(pa.int64())), _matrix_column([values])]
            return pa.RecordBatch.from_arrays(columns, names=["part", "place", "ids", "deviations", "matrix"])

        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= block_rows:
                rows = pa.Table.from_batches(held).combine_chunks()
                for low in range(0, count - block_rows + 1, block_rows):
                    some = rows.slice(low, block_rows).combine_chunks()
                    yield block(some.column(0).chunk(0), some.column(1).chunk(0))
                    place += 1
                left = count % block_rows
                held, count = rows.slice(count - left).to_batches() if left else [], left
        if count:
            some = pa.Table.from_batches(held).combine_chunks()
            yield block(some.column(0).chunk(0), some.column(1).chunk(0))

    longs = T.ArrayType(T.LongType())
    fields = [("part", T.IntegerType()), ("place", T.IntegerType()), ("ids", longs), ("deviations", longs), ("matrix", _MATRIX)]
    return known.mapInArrow(work, T.StructType([T.StructField(*f) for f in fields]))


def numbered(blocks: DataFrame) -> DataFrame:
    """A written table of blocks with ``number``, from 0 without gaps: parts one after another."""
    counts = blocks.groupBy("part").count().orderBy("part").collect()  # a row for each task that wrote blocks
    first, before = [], 0
    for row in counts:
        first.append((row["part"], before))
        before += row["count"]
    firsts = blocks.sparkSession.createDataFrame(first, "part int, first long")
    return blocks.join(F.broadcast(firsts), "part").withColumn("number", F.col("first") + F.col("place")).drop("first", "part", "place")


def block_matrix(table: DataFrame, rows: int, width: int, count: int) -> BlockMatrix:
    """One column of blocks from a table of their places and MLlib matrices."""
    java = callMLlibFunc("createBlockMatrix", table, rows, width, rows * count, width)
    return BlockMatrix(java, rows, width)


def scatter(matrix: BlockMatrix, count: int) -> np.ndarray:
    """Transposed matrix times matrix, with the rows dealt to tasks of ``BLOCKS_A_TASK`` blocks."""
    splits = max(1, -(-count // BLOCKS_A_TASK))
    left = matrix.transpose()._java_matrix_wrapper._java_model
    java = left.multiply(matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def whitening_matrix(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors over the roots of their eigenvalues, in columns, and each one's share of the variance."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = [i for i in range(min(components, len(values))) if values[i] > max(values[0], 0.0) * len(values) * 2.0**-50]
    return vectors[:, kept] / np.sqrt(values[kept]), values[kept] / np.trace(covariance)


def _projected(spark: SparkSession, matrix: BlockMatrix, weights: np.ndarray) -> str:
    """Path of the written blocks of matrix times weights."""
    place = T.Row(_1=0, _2=0)
    dense = DenseMatrix(*weights.shape, weights.ravel(order="F").tolist())
    right = block_matrix(spark.createDataFrame([(place, dense)], _BLOCKS), weights.shape[0], weights.shape[1], 1)
    java = matrix.multiply(right)._java_matrix_wrapper._java_model
    path = scratch(spark, "projected")
    callMLlibFunc("getMatrixBlocks", java).select(
        F.struct(F.col("_1._1").cast("long").alias("_1"), F.col("_1._2").cast("long").alias("_2")).alias("_1"), "_2"
    ).write.parquet(path)
    return path


def _values(matrix: dict, rows: int, columns: int) -> np.ndarray:
    flat = np.asarray(matrix["values"], dtype=np.float64)
    return flat.reshape(rows, columns) if matrix["isTransposed"] else flat.reshape(columns, rows).T


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """For each vector of ``rows`` (vec_id, embedding) its first whitened components, and what was fitted."""
    spark = rows.sparkSession
    known = finite_vectors(rows)
    n, sums = component_sums(known)
    width = len(sums)
    if not n or not width:
        return spark.createDataFrame([], SCHEMA)
    most = max(1, BLOCK_BYTES // (8 * width))
    block_rows = min(most, max(LEAST_BLOCK_ROWS, 1 << (-(-n // BLOCKS) - 1).bit_length()))
    written = cut(centred_blocks(known, n, sums, block_rows))
    # The stored form of a matrix is read back as MLlib's type.
    typed = T.StructType([T.StructField(f.name, MatrixUDT() if f.name == "matrix" else f.dataType) for f in written.schema])
    table = numbered(spark.read.schema(typed).parquet(written._knotwork_path))
    place = F.struct(F.col("number").alias("_1"), F.lit(0).cast("long").alias("_2")).alias("_1")
    count = table.count()
    centred = block_matrix(table.select(place, F.col("matrix").alias("_2")), block_rows, width, count)
    weights, explained = whitening_matrix(scatter(centred, count) / n, components)
    kept = len(explained)
    if not kept:
        return spark.createDataFrame([], SCHEMA)
    path = _projected(spark, centred, weights)
    projected = spark.read.schema(T.StructType([T.StructField("_1", _PLACE), T.StructField("_2", _MATRIX)])).parquet(path)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(kept)
        for batch in batches:
            for matrix in batch.column(0).to_pylist():
                total += _values(matrix, block_rows, kept).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    parts = projected.select("_2").mapInArrow(totals, "total array<double>")
    mean = np.array(parts.select(*[F.sum(F.get("total", F.lit(i))) for i in range(kept)]).first(), dtype=np.float64) / n
    own = block_matrix(spark.read.schema(_BLOCKS).parquet(path), block_rows, kept, count)
    # Centred rows stay centred under a product but for rounding, which the outer product takes away.
    covariance = scatter(own, count) / n - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(kept)).max())

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(len(batch)):
                ids, own_deviations = (batch.column(i)[place].values for i in (0, 1))
                size = len(ids)
                values = _values(batch.column(2)[place].as_py(), block_rows, kept)[:size]
                at = np.repeat(np.arange(size), kept)
                columns = [
                    ids.take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), size)),
                    pa.array(np.full(len(at), n, dtype=np.int64)),
                    own_deviations.take(pa.array(at)),
                    pa.array(np.ascontiguousarray(values).ravel()),
                    pa.array(np.tile(explained, size)),
                    pa.array(np.full(len(at), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])

    places = projected.select(F.col("_1._1").alias("number"), F.col("_2").alias("values"))
    joined = table.select("number", "ids", "deviations").join(places, "number").select("ids", "deviations", "values")
    return joined.mapInArrow(lay_out, SCHEMA)
