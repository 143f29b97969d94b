"""Scaling, projection, centroids and cluster quality of vector tables (key, vec)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions import arrays
from knotwork.operators.blocks import CANCELLED, block_join, list_column, matrix, measured, nearest_rows, strips, tile_join
from knotwork.operators.skew import attach_row

NOISE = -1
# Centers of at most this size are held by every task.
HELD_BYTES = 64_000_000
# Rows and columns of which distances are held at once for sums: 2 MB.
SUM_ROWS, SUM_COLUMNS = 128, 2_048


def dimension(points: DataFrame, vec: str = "vec") -> int:
    """Length of the vectors, read from one row."""
    row = points.filter(F.col(vec).isNotNull()).select(F.size(vec)).first()
    if row is None:
        raise ValueError("no vectors")
    return row[0]


def _by_position(function, dim: int, vec: str = "vec") -> Column:
    """An aggregate for each position: partial sums on the map side, no exploded rows."""
    return F.array(*[function(F.col(vec)[i]) for i in range(dim)])


def mean_vector(dim: int, vec: str = "vec") -> Column:
    return _by_position(F.avg, dim, vec)


def standardize(points: DataFrame, vec: str = "vec", fit_on: DataFrame | None = None) -> DataFrame:
    """z-scores with the population deviation; a constant position becomes 0."""
    source = points if fit_on is None else fit_on
    dim = dimension(source, vec)
    model = source.agg(mean_vector(dim, vec).alias("_mean"), _by_position(F.stddev_pop, dim, vec).alias("_std"))
    centred = arrays.subtract(F.col(vec), F.col("_mean"))
    scaled = F.zip_with(centred, F.col("_std"), lambda x, s: F.when(s > 0, x / s).otherwise(F.lit(0.0)))
    return attach_row(points, model).withColumn(vec, scaled).drop("_mean", "_std")


def pca(points: DataFrame, k: int, vec: str = "vec", out: str = "vec", fit_on: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
    """Projection on the k main axes of the centred training vectors, and the variance shares.

    Only the mean and the d x k axes are read back. Each axis is turned so that its largest
    entry is positive.
    """
    source = points if fit_on is None else fit_on
    dim = dimension(source, vec)
    mean = source.agg(mean_vector(dim, vec).alias("_mean"))
    centre = attach_row(source.select(vec), mean).select(array_to_vector(arrays.subtract(F.col(vec), F.col("_mean"))).alias("_in"))
    model = PCA(k=min(k, dim), inputCol="_in", outputCol="_out").fit(centre)
    axes = model.pc.toArray()
    largest = np.abs(axes).argmax(axis=0)
    axes = axes * np.sign(axes[largest, np.arange(axes.shape[1])])
    centre_values = np.array(mean.first()[0])
    schema = points.withColumn(out, F.col(vec)).schema

    def project(batches):
        for batch in batches:
            values = (matrix(batch.column(batch.schema.get_field_index(vec))) - centre_values) @ axes
            column = list_column(values)
            names = batch.schema.names
            columns = dict(zip(names, batch.columns)) | {out: column}
            yield pa.RecordBatch.from_arrays([columns[f] for f in schema.names], names=schema.names)

    return points.mapInArrow(project, schema), [float(v) for v in model.explainedVariance.toArray()]


def project_2d(points: DataFrame, vec: str = "vec") -> DataFrame:
    """key, x, y: the two main axes of the unit vectors, which keep cosine geometry."""
    length = arrays.norm(F.col(vec))
    unit = F.transform(vec, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))
    flat, _ = pca(points.select("key", unit.alias("vec")), 2)
    return flat.select("key", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))


def centroids(points: DataFrame, cluster: str = "cluster", vec: str = "vec") -> DataFrame:
    """cluster, centroid, members; noise has none."""
    dim = dimension(points, vec)
    members = points.filter(F.col(cluster) != NOISE)
    return members.groupBy(F.col(cluster).alias("cluster")).agg(
        mean_vector(dim, vec).alias("centroid"), F.count(F.lit(1)).alias("members")
    )


def global_centroid(points: DataFrame, vec: str = "vec") -> DataFrame:
    return points.agg(mean_vector(dimension(points, vec), vec).alias("centroid"))


def _held_centers(centers: DataFrame) -> pa.Table | None:
    """The centers by cluster, if a count shows that they fit into every task."""
    count = centers.count()
    if not count or count * dimension(centers, "centroid") * 8 > HELD_BYTES:
        return None
    return centers.select("cluster", "centroid").orderBy("cluster").toArrow().combine_chunks()


def nearest_centroid(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Adds ``nearest`` and ``nearest_distance``; the least cluster wins a tie.

    Centers that a count shows to be small are held by every task and the points stay where they
    are. Beyond that points and centers meet as pairs of blocks and the least (distance, cluster) of a
    point is kept; both ways decide on directly measured distances. Clusters keep their type. Keys must be unique.
    """
    kind = dict(centers.dtypes)["cluster"]
    held = _held_centers(centers)
    if held is not None:
        shared = points.sparkSession.sparkContext.broadcast((matrix(held.column("centroid")), held.column("cluster").combine_chunks()))
        schema = points.select("*", F.lit(None).cast(kind).alias("nearest"), F.lit(0.0).alias("nearest_distance")).schema

        def assign(batches):
            for batch in batches:
                others, names = shared.value
                place, distance = nearest_rows(matrix(batch.column(batch.schema.get_field_index("vec"))), others)
                columns = [*batch.columns, names.take(pa.array(place)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "nearest", "nearest_distance"])

        return points.mapInArrow(assign, schema)
    return _nearest_by_blocks(points, centers)


def _nearest_by_blocks(points: DataFrame, centers: DataFrame) -> DataFrame:
    columns = points.columns
    left = points.select(F.col("key").alias("_key"), F.col("vec").alias("_vec"))
    right = centers.select("cluster", "centroid")
    kind = dict(right.dtypes)["cluster"]
    schema = f"_key {dict(left.dtypes)['_key']}, nearest {kind}, nearest_distance double"

    def work(rows: pa.Table, near: pa.Table) -> pa.Table:
        names = ["_key", "nearest", "nearest_distance"]
        if not rows.num_rows or not near.num_rows:
            empty = [rows.column("_key").slice(0, 0), near.column("cluster").slice(0, 0), pa.array([], pa.float64())]
            return pa.table(empty, names=names)
        near = near.sort_by("cluster")
        place, distance = nearest_rows(matrix(rows.column("_vec")), matrix(near.column("centroid")))
        return pa.table([rows.column("_key"), near.column("cluster").take(pa.array(place)), pa.array(distance)], names=names)

    found = block_join(left, right, "_key", "cluster", work, schema, points.count(), centers.count())
    best = found.groupBy("_key").agg(F.min(F.struct("nearest_distance", "nearest")).alias("_best"))
    placed = points.join(best, points["key"].eqNullSafe(best["_key"]))
    return placed.select(*columns, F.col("_best.nearest").alias("nearest"), F.col("_best.nearest_distance").alias("nearest_distance"))


def pairwise_distance(points: DataFrame, centers: DataFrame) -> DataFrame:
    """key, cluster, distance for each point and centroid; one row per point and center is the result itself.

    Points stream past parts of the centers, whatever their number.
    """
    left, right = points.select("key", "vec"), centers.select("cluster", "centroid")
    kinds = dict(left.dtypes)["key"], dict(right.dtypes)["cluster"]

    def work(near: pa.Table):
        near = near.sort_by("cluster")
        others, names = matrix(near.column("centroid")), near.column("cluster").combine_chunks()

        def measure(rows: pa.Table) -> pa.Table:
            own, parts = matrix(rows.column("vec")), []
            keys = rows.column("key").combine_chunks()
            for strip in strips(len(own), len(others)):
                i, j = np.indices((strip.stop - strip.start, len(others))).reshape(2, -1)
                distance = np.sqrt(measured(own[strip], others, i, j))
                parts.append(pa.table([keys.take(pa.array(i + strip.start)), names.take(pa.array(j)), pa.array(distance)], names=["key", "cluster", "distance"]))
            return pa.concat_tables(parts)

        return measure

    return tile_join(left, right, "key", "cluster", work, f"key {kinds[0]}, cluster {kinds[1]}, distance double", points.count(), centers.count())


def centroid_distances(points: DataFrame, train: Column, cluster: str = "cluster") -> DataFrame:
    """key and the distances to the assigned, the nearest and the global centroid.

    Centroids come from training rows. Noise and clusters unseen in training take the nearest
    centroid; without any cluster all three are the global distance.
    """
    seen = points.filter(train)
    whole = global_centroid(seen).select(F.col("centroid").alias("_global"))
    centers = centroids(seen, cluster)
    base = attach_row(points, whole).withColumn("dist_global", arrays.distance(F.col("vec"), F.col("_global"))).drop("_global")
    if not centers.take(1):
        return base.select("key", F.col("dist_global").alias("dist_assigned"), F.col("dist_global").alias("dist_nearest"), "dist_global")
    near = nearest_centroid(base, centers)
    own = centers.select(F.col("cluster").alias(cluster), F.col("centroid").alias("_own"))
    assigned = F.coalesce(arrays.distance(F.col("vec"), F.col("_own")), F.col("nearest_distance"))
    return near.join(own, cluster, "left").select(
        "key", assigned.alias("dist_assigned"), F.col("nearest_distance").alias("dist_nearest"), "dist_global"
    )


def _distance_sums(right: pa.Table):
    """Distance sum and row count from each row that streams past to each cluster of the part."""
    b = matrix(right.column("vec"))
    names, place = np.unique(right.column("cluster").to_numpy(), return_inverse=True)
    order = np.argsort(place, kind="stable")
    members, place, b = np.bincount(place), place[order], b[order]
    centre = b.mean(axis=0)
    near_b = b - centre
    bb = np.einsum("ij,ij->i", near_b, near_b)
    # |a|^2 + |b|^2 - 2 a.b round a common centre as one product.
    table = np.concatenate([near_b, bb[:, None], np.ones((len(b), 1))], axis=1).T.copy()
    parts = [slice(start, min(start + SUM_COLUMNS, len(b))) for start in range(0, len(b), SUM_COLUMNS)]
    clusters = [np.unique(place[part], return_index=True) for part in parts]
    buffer = np.empty(SUM_ROWS * SUM_COLUMNS)

    def sums(left: pa.Table) -> pa.Table:
        a = matrix(left.column("vec"))
        totals = np.zeros((len(a), len(names)))
        near_a = a - centre
        aa = np.einsum("ij,ij->i", near_a, near_a)
        factors = np.concatenate([-2.0 * near_a, np.ones((len(a), 1)), aa[:, None]], axis=1)
        for start in range(0, len(a), SUM_ROWS):
            strip = slice(start, min(start + SUM_ROWS, len(a)))
            own, height = aa[strip], strip.stop - strip.start
            for part, (present, first) in zip(parts, clusters):
                width = part.stop - part.start
                flat = buffer[: height * width]
                squares = np.matmul(factors[strip], table[:, part], out=flat.reshape(height, width))
                # Pairs that are close against their distance from the centre are measured by their differences.
                close = np.flatnonzero(squares < ((own + bb[part].max()) * CANCELLED)[:, None])
                i, j = np.divmod(close, width)
                lost = flat[close] < (own[i] + bb[part][j]) * CANCELLED
                flat[close[lost]] = measured(a[strip], b[part], i[lost], j[lost])
                np.sqrt(squares, out=squares)
                totals[strip, present] += np.add.reduceat(squares, first, axis=1)
        rows = pa.array(np.repeat(np.arange(len(a)), len(names)))
        columns = [left.column("key").take(rows), left.column("cluster").take(rows), pa.array(np.tile(names, len(a)))]
        columns += [pa.array(totals.ravel()), pa.array(np.tile(members, len(a)))]
        return pa.table(columns, names=["key", "own", "cluster", "total", "members"])

    return sums


def silhouette_samples(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """key, own, silhouette with Euclidean distance on non-noise rows; singletons are 0.

    The measure needs every distance. Rows stream past parts of the rows and only sums per row and
    cluster of the part leave a task.
    """
    rows = points.filter(F.col(cluster) != NOISE).select("key", F.col(cluster).cast("long").alias("cluster"), "vec")
    count = rows.count()
    kind = rows.schema["key"].dataType.simpleString()
    sums = tile_join(
        rows, rows, "key", "key", _distance_sums, f"key {kind}, own long, cluster long, total double, members long", count, count
    )
    merged = sums.groupBy("key", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("members").alias("members"))
    same = F.col("own") == F.col("cluster")
    sides = merged.groupBy("key", "own").agg(
        F.max(F.when(same, F.col("members"))).alias("_size"),
        F.max(F.when(same, F.try_divide(F.col("total"), F.col("members") - 1))).alias("_a"),
        F.min(F.when(~same, F.col("total") / F.col("members"))).alias("_b"),
    )
    value = F.when(F.col("_size") <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0))
    )
    return sides.select("key", "own", value.alias("silhouette"))


def silhouette(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One row: mean silhouette, or -1 with fewer than two clusters or three points."""
    members = points.filter(F.col(cluster) != NOISE)
    counts = members.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(cluster).alias("k")).first()
    if counts["n"] < 3 or counts["k"] < 2:
        return points.sparkSession.range(1).select(F.lit(-1.0).alias("silhouette"))
    return silhouette_samples(points, cluster).agg(F.avg("silhouette").alias("silhouette"))


def cluster_density_grid(rows: DataFrame, bins: int = 20, cluster: str = "cluster") -> DataFrame:
    """bin_x, bin_y, cluster, n: the table behind a scatter plot of (x, y)."""
    span = rows.agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))

    def place(axis: str) -> Column:
        width = (F.col(f"_{axis}1") - F.col(f"_{axis}0")) / bins
        step = F.coalesce(F.floor(F.try_divide(F.col(axis) - F.col(f"_{axis}0"), width)), F.lit(0))
        return F.least(step, F.lit(bins - 1)).cast("int")

    spread = attach_row(rows, span).select(place("x").alias("bin_x"), place("y").alias("bin_y"), F.col(cluster).alias("cluster"))
    return spread.groupBy("bin_x", "bin_y", "cluster").agg(F.count(F.lit(1)).alias("n"))
