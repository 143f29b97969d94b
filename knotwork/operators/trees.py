"""Random forests whose trees look at every distance between two values and grow until their leaves are pure.

A task grows some trees over all training rows, which it reads as packed numbers; a level of a tree is
settled at once, all its nodes and the features drawn for them side by side. Trees are stored as bytes and
meet the rows that they score in blocks.
"""

from __future__ import annotations

import math
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasProbabilityCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.blocks import matrix
from knotwork.session import cut

# Trees that one task grows, rows that it packs together, and rows that meet the trees of a part in one task.
TASK_TREES = 8
PACKED_ROWS = 8_192
SCORE_ROWS = 16_384
# Numbers of the training rows that a task holds in memory; more lie in a file of its own.
HELD_NUMBERS = 2**25
# Cells (a row and a feature drawn for its node) that are sorted at once.
SORTED_CELLS = 2**16
# Rows of two labels are counted in the halves of one number.
LABEL_BITS, LABEL_MASK = 31, 2**31 - 1
# A node of a stored tree: the feature (-1 in a leaf), the left child (the right one is next to it), and the bound
# up to which rows go left, or the share of positives in a leaf.
NODE = np.dtype([("feature", "<i4"), ("left", "<i4"), ("value", "<f8")])


def packed_rows(rows: DataFrame, features: str, label: str) -> DataFrame:
    """size, wide, values, labels: rows some thousands at a time; numbers are wide only if they need to be."""

    def work(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, PACKED_ROWS):
                part = batch.slice(low, PACKED_ROWS)
                if part.column(0).null_count or part.column(1).null_count or part.column(0).flatten().null_count:
                    raise ValueError("a training row without a label or a feature")
                values, labels = matrix(part.column(0)), part.column(1).to_numpy()
                single = values.astype(np.float32)
                wide = not np.array_equal(single.astype(np.float64), values, equal_nan=True)
                held = values if wide else single
                yield pa.RecordBatch.from_pydict({"size": [len(part)], "wide": [wide], "values": [held.tobytes()], "labels": [labels.tobytes()]})

    listed = vector_to_array(features) if isinstance(rows.schema[features].dataType, VectorUDT) else F.col(features)
    plain = rows.select(listed.cast("array<double>"), F.col(label).cast("double"))
    return plain.mapInArrow(work, "size long, wide boolean, values binary, labels binary")


class Sorted:
    """Training rows as places: ``places[feature, row]`` orders the values of a feature, equal values share a place.

    Rows are put into an order of their own, so that a tree does not depend on how they came.
    """

    def __init__(self, values: list[np.ndarray], labels: np.ndarray):
        size, self.width = len(labels), values[0].shape[1]
        rng = np.random.default_rng(0)
        factors = rng.integers(1, 2**63, self.width, dtype=np.uint64) | np.uint64(1)
        # Adding zero makes one of the two zeros.
        marks = [((v.astype(np.float64) + 0.0).view(np.uint64) * factors).sum(axis=1, dtype=np.uint64) for v in values]
        order = np.lexsort([labels, np.concatenate(marks)])
        self.values, self.first = values, np.cumsum([0, *map(len, values)])
        self.order = order
        shape = (self.width, size)
        self.places = np.empty(shape, np.int32) if size * self.width <= HELD_NUMBERS else np.memmap(tempfile.TemporaryFile(), np.int32, shape=shape)
        for feature in range(self.width):
            column = np.concatenate([v[:, feature] for v in values])[order]
            by_value = np.argsort(column, kind="stable")
            ordered = column[by_value]
            rises = (ordered[1:] != ordered[:-1]) & ~(np.isnan(ordered[1:]) & np.isnan(ordered[:-1]))
            self.places[feature, by_value] = np.concatenate([[0], np.cumsum(rises)])
        self.classes, self.labels = np.unique(labels[order], return_inverse=True)

    def value(self, rows: np.ndarray, features: np.ndarray) -> np.ndarray:
        at = self.order[rows]
        chunk = np.searchsorted(self.first, at, side="right") - 1
        out = np.empty(len(rows))
        for number in np.unique(chunk):
            own = chunk == number
            out[own] = self.values[number][at[own] - self.first[number], features[own]]
        return out


def _best_splits(data: Sorted, rows, node, tally, drawn, leaf):
    """For each node and each feature drawn for it: the best score of a split, the last row to the left and the first to
    the right, and whether the feature has two values. ``drawn`` lists the nodes' features, a column each."""
    nodes, slots = drawn.shape
    score = np.full((nodes, slots), -np.inf)
    left, right = np.zeros((nodes, slots), np.int64), np.zeros((nodes, slots), np.int64)
    varied = np.zeros((nodes, slots), bool)
    size = len(rows)
    starts = np.searchsorted(node, np.arange(nodes))
    lengths = np.diff(starts, append=size)
    step = max(1, SORTED_CELLS // size)
    bits, place_bits = int(size).bit_length(), int(len(data.labels)).bit_length()
    flat, many = data.places.reshape(-1), len(data.labels)
    numbers = np.arange(size)
    for low in range(0, slots, step):
        count = min(step, slots - low)
        place = flat[(drawn.T[low : low + count] * many)[:, node] + rows]
        # A cell is sorted by slot, node and place; its row comes with it in the low bits where all fit into 63 bits.
        high = ((node + (np.arange(count) * nodes)[:, None]) << place_bits) | place
        if int(count * nodes).bit_length() + place_bits + bits <= 63:
            cells = np.sort(((high << bits) | numbers).reshape(-1))
            own, high = cells & ((1 << bits) - 1), cells >> bits
        else:
            by = np.argsort(high.reshape(-1), kind="stable")
            own, high = by % size, high.reshape(-1)[by]
        # The places between two values of a node; rows to the left of each are the first of its segment up to it.
        gaps = np.flatnonzero((high[1:] != high[:-1]) & (high[1:] >> place_bits == high[:-1] >> place_bits))
        if not len(gaps):
            continue
        segment = high[gaps] >> place_bits
        of = np.tile(np.arange(nodes), count)[segment]
        columns = slice(low, low + count)
        seen = np.zeros(count * nodes, bool)
        seen[segment] = True
        varied[:, columns] = seen.reshape(count, nodes).T
        if leaf > 1:
            on_left = gaps - (starts + (np.arange(count) * size)[:, None]).reshape(-1)[segment] + 1
            fits = (on_left >= leaf) & (lengths[of] - on_left >= leaf)
            gaps, segment, of = gaps[fits], segment[fits], of[fits]
            if not len(gaps):
                continue
        left_all, right_all, left_squares, right_squares = 0, 0, 0.0, 0.0
        for pair in tally:
            # All slots of a node hold the same rows, so a slot's sum up to a node's start is that of any other.
            whole = np.add.reduceat(pair, starts)
            before = np.concatenate([[0], np.cumsum(whole)])
            lefts = np.cumsum(pair[own])[gaps] - (before[:-1] + (np.arange(count) * before[-1])[:, None]).reshape(-1)[segment]
            rights = whole[of] - lefts
            for side in (0, LABEL_BITS):
                one, two = (lefts >> side & LABEL_MASK).astype(np.float64), (rights >> side & LABEL_MASK).astype(np.float64)
                left_all, right_all = left_all + one, right_all + two
                left_squares, right_squares = left_squares + one * one, right_squares + two * two
        gain = left_squares / left_all + right_squares / right_all
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        most = np.maximum.reduceat(gain, first)
        best = np.flatnonzero(gain == np.repeat(most, np.diff(first, append=len(gaps))))
        best = best[np.concatenate([[True], segment[best][1:] != segment[best][:-1]])]
        at = (of[best], low + segment[best] // nodes)
        score[at] = most
        left[at], right[at] = rows[own[gaps[best]]], rows[own[gaps[best] + 1]]
    return score, left, right, varied


def grow(data: Sorted, seed: list[int], depth: int | None, leaf: int) -> np.ndarray:
    """One tree over rows drawn with replacement; each node looks at as many features with two values as the root of
    their number says, if there are as many, and splits until it is pure or all its rows are alike."""
    rng = np.random.default_rng(seed)
    width, size = data.places.shape
    wanted = max(1, int(math.sqrt(width)))
    times = np.bincount(rng.integers(0, size, size), minlength=size)
    rows = np.flatnonzero(times)
    tally = []
    for label in range(0, len(data.classes), 2):
        tally.append(np.where(data.labels[rows] == label, times[rows], 0) + (np.where(data.labels[rows] == label + 1, times[rows], 0) << LABEL_BITS))
    positive = np.flatnonzero(data.classes == 1)
    positive = int(positive[0]) if len(positive) else -1
    node, nodes, level, made, known = np.zeros(len(rows), np.int64), 1, 0, 0, []
    while nodes:
        starts = np.searchsorted(node, np.arange(nodes))
        sums = [np.add.reduceat(pair, starts) for pair in tally]
        totals = np.stack([total >> side & LABEL_MASK for total in sums for side in (0, LABEL_BITS)], axis=1)
        counts = np.diff(starts, append=len(rows))
        out = np.zeros(nodes, NODE)
        out["feature"] = -1
        out["value"] = totals[:, positive] / totals.sum(axis=1) if positive >= 0 else 0.0
        known.append(out)
        made += nodes
        open_ = (totals.max(axis=1) < totals.sum(axis=1)) & (counts >= 2 * leaf) & (depth is None or level < depth)
        held = np.flatnonzero(open_[node])
        rows, tally, node = rows[held], [pair[held] for pair in tally], np.cumsum(open_)[node[held]] - 1
        alive = np.flatnonzero(open_)
        if not len(alive):
            break
        turns = np.argsort(rng.random((len(alive), width)), axis=1)
        best, feature = np.full(len(alive), -np.inf), np.zeros(len(alive), np.int64)
        left, right, seen = np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int64)
        low = 0
        while low < width:
            # A feature without two values in a node does not count, and a node without a split looks further.
            asking = np.flatnonzero((seen < wanted) | np.isneginf(best))
            if not len(asking):
                break
            count = min(wanted, width - low) if low == 0 else 1
            of = np.full(len(alive), -1)
            of[asking] = np.arange(len(asking))
            own = np.flatnonzero(of[node] >= 0) if len(asking) < len(alive) else slice(None)
            drawn = turns[asking, low : low + count]
            score, to_left, to_right, varied = _best_splits(data, rows[own], of[node[own]], [pair[own] for pair in tally], drawn, leaf)
            for slot in range(count):
                seen[asking] += varied[:, slot]
                better = score[:, slot] > best[asking]
                at = asking[better]
                best[at], feature[at] = score[better, slot], drawn[better, slot]
                left[at], right[at] = to_left[better, slot], to_right[better, slot]
            low += count
        split = ~np.isneginf(best)
        ids = np.flatnonzero(split)
        if not len(ids):
            break
        one, two = data.value(left[ids], feature[ids]), data.value(right[ids], feature[ids])
        middle = one / 2 + two / 2
        # The middle of two neighbouring numbers may be the upper one, and there is none before what is no number.
        bound = np.where((middle < two) & (middle >= one), middle, one)
        out["feature"][alive[ids]] = feature[ids]
        out["value"][alive[ids]] = bound
        out["left"][alive[ids]] = made + 2 * np.arange(len(ids))
        held = np.flatnonzero(split[node])
        rows, tally, node = rows[held], [pair[held] for pair in tally], node[held]
        goes_right = data.places[feature[node], rows] > data.places[feature[node], left[node]]
        child = 2 * (np.cumsum(split)[node] - 1) + goes_right
        by = np.argsort(child, kind="stable")
        rows, tally, node = rows[by], [pair[by] for pair in tally], child[by]
        nodes, level = 2 * len(ids), level + 1
    return np.concatenate(known)


def shares(tree: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The share of positives in the leaf of each row."""
    at, open_ = np.zeros(len(values), np.int64), np.arange(len(values))
    while len(open_):
        feature = tree["feature"][at[open_]]
        open_, feature = open_[feature >= 0], feature[feature >= 0]
        nodes = at[open_]
        at[open_] = tree["left"][nodes] + ~(values[open_, feature] <= tree["value"][nodes])
    return tree["value"][at]


def _grown(packed: DataFrame, trees: int, depth: int | None, leaf: int, seed: int) -> DataFrame:
    """tree, nodes: every task reads all packed rows and grows its trees."""
    spark = packed.sparkSession
    tasks = math.ceil(trees / TASK_TREES)

    def work(batches):
        numbers, values, labels, held_numbers, file = None, [], [], 0, None
        for batch in batches:
            for number, wide, held, marks in zip(*(batch.column(i) for i in (0, 2, 3, 4))):
                numbers = number.as_py()
                marks = np.frombuffer(marks.as_buffer(), np.float64).copy()
                labels.append(marks)
                part = np.frombuffer(held.as_buffer(), np.float64 if wide.as_py() else np.float32).reshape(len(marks), -1)
                held_numbers += part.size
                if held_numbers > HELD_NUMBERS:
                    file = file or tempfile.TemporaryFile()
                    at = file.seek(0, 2)
                    file.write(part.tobytes())
                    file.flush()
                    part = np.memmap(file, part.dtype, "r", at, part.shape)
                values.append(part)
        if numbers is None:
            return
        data = Sorted(values, np.concatenate(labels))
        for tree in range(numbers, trees, tasks):
            nodes = grow(data, [seed, tree], depth, leaf)
            yield pa.RecordBatch.from_arrays([pa.array([tree]), pa.array([nodes.tobytes()], pa.binary())], names=["tree", "nodes"])

    turns = spark.range(0, tasks, 1, tasks).withColumnRenamed("id", "number")
    return turns.crossJoin(packed.coalesce(1).hint("shuffle_replicate_nl")).mapInArrow(work, "tree long, nodes binary")


def mean_shares(rows: DataFrame, models: list[ForestModel], features: str, name: str) -> DataFrame:
    """Rows with the mean over all trees of all models; the trees of a model meet a block of rows in one task."""
    held = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    blocks = max(1, math.ceil(held.count() / SCORE_ROWS))
    listed = vector_to_array(features) if isinstance(rows.schema[features].dataType, VectorUDT) else F.col(features)
    points = held.select("_row", listed.cast("array<double>").alias("_x"), F.pmod("_row", F.lit(blocks)).alias("_block"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))

    def work(number: int):
        def score(points: pa.Table, trees: pa.Table) -> pa.Table:
            values, total = matrix(points.column("_x")), np.zeros(points.num_rows)
            for nodes in trees.sort_by("tree").column("nodes") if points.num_rows else ():
                total += shares(np.frombuffer(nodes.as_buffer(), NODE), values)
            return pa.table({"_row": points.column("_row"), "part": pa.array([number] * len(total), pa.int32()), "total": total})

        return score

    parts = [
        points.groupBy("_block").cogroup(model.trees.withColumn("_block", every).groupBy("_block")).applyInArrow(work(number), "_row long, part int, total double")
        for number, model in enumerate(models)
    ]
    sums = parts[0]
    for part in parts[1:]:
        sums = sums.unionByName(part)
    # Added up in the order of the parts, so that the last digit does not hang on the order of arrival.
    listed = F.transform(F.array_sort(F.collect_list(F.struct("part", "total"))), lambda p: p["total"])
    mean = F.aggregate(listed, F.lit(0.0), lambda a, x: a + x) / F.lit(float(sum(model.getNumTrees for model in models)))
    found = cut(sums.groupBy("_row").agg(mean.alias(name)))
    return held.join(found, "_row").drop("_row")


class ForestModel(Model, HasFeaturesCol, HasProbabilityCol):
    """Grown trees, as a written table (tree, nodes)."""

    def __init__(self, trees: DataFrame, count: int):
        super().__init__()
        self.trees, self.getNumTrees = trees, count

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = mean_shares(dataset, [self], self.getFeaturesCol(), "_share")
        chance = array_to_vector(F.array(F.lit(1.0) - F.col("_share"), F.col("_share")))
        return out.select(*dataset.columns, chance.alias(self.getProbabilityCol()))


class Forest(Estimator, HasFeaturesCol, HasLabelCol, HasProbabilityCol):
    """Estimator of a random forest on an array or vector of features, or on ``packed_rows`` of them."""

    def __init__(self, trees: int, depth: int | None, leaf: int, seed: int):
        super().__init__()
        self.trees, self.depth, self.leaf, self.seed = trees, depth, leaf, seed

    def setParams(self, **names: str) -> Forest:
        return self._set(**names)

    def _fit(self, dataset: DataFrame) -> ForestModel:
        packed = dataset
        if self.getFeaturesCol() in dataset.columns:
            packed = cut(packed_rows(dataset, self.getFeaturesCol(), self.getLabelCol()))
        if not packed.take(1):
            raise ValueError("no rows to learn from")
        model = ForestModel(cut(_grown(packed, self.trees, self.depth, self.leaf, self.seed)), self.trees)
        for param in (model.featuresCol, model.probabilityCol):
            model.set(param, self.getOrDefault(self.getParam(param.name)))
        return model
