"""A network that weighs its input features per row before two hidden layers.

Data-parallel training: in each epoch every partition takes small steps on its own rows from the
shared weights, and the weights are averaged by rows with a Spark aggregation. Only weights reach
the driver; their size depends on the number of features, not on the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.scalars import PROBABILITY_CEILING, PROBABILITY_FLOOR
from knotwork.operators.blocks import list_column, matrix


@dataclass(frozen=True)
class GatedConfig:
    """Defaults of the network."""

    hidden1: int = 128
    hidden2: int = 64
    dropout: float = 0.1
    rate: float = 1e-3
    batch: int = 64
    epochs: int = 50
    decay: float = 1e-4
    seed: int = 42


def _shapes(width: int, config: GatedConfig) -> list[tuple[int, int]]:
    """Weights and offsets of the gate, the two hidden layers and the output."""
    sizes = [(width, width), (width, config.hidden1), (config.hidden1, config.hidden2), (config.hidden2, 1)]
    return [shape for rows, columns in sizes for shape in ((rows, columns), (1, columns))]


def _unpack(flat: np.ndarray, width: int, config: GatedConfig) -> list[np.ndarray]:
    shapes = _shapes(width, config)
    cuts = np.cumsum([rows * columns for rows, columns in shapes])[:-1]
    return [part.reshape(shape) for part, shape in zip(np.split(flat, cuts), shapes)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _forward(weights: list[np.ndarray], x: np.ndarray, drop=None):
    gate_w, gate_b, w1, b1, w2, b2, w3, b3 = weights
    gate = _sigmoid(x @ gate_w + gate_b)
    one = np.maximum(x * gate @ w1 + b1, 0)
    one = one if drop is None else one * drop[0]
    two = np.maximum(one @ w2 + b2, 0)
    two = two if drop is None else two * drop[1]
    return gate, one, two, (two @ w3 + b3)[:, 0]


def _slopes(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray, drop) -> tuple[float, np.ndarray]:
    """Mean cross-entropy and its derivative by all weights."""
    gate_w, _, w1, _, w2, _, w3, _ = weights
    gate, one, two, logit = _forward(weights, x, drop)
    loss = float(np.mean(np.logaddexp(0.0, logit) - y * logit))
    out = ((_sigmoid(logit) - y) / len(y))[:, None]
    to_two = out @ w3.T * (two > 0) * drop[1]
    to_one = to_two @ w2.T * (one > 0) * drop[0]
    to_gate = (to_one @ w1.T) * x * gate * (1 - gate)
    parts = [x.T @ to_gate, to_gate.sum(0), (x * gate).T @ to_one, to_one.sum(0), one.T @ to_two, to_two.sum(0), two.T @ out, out.sum(0)]
    return loss, np.concatenate([part.ravel() for part in parts])


def _partition_trainer(state: np.ndarray, steps: int, width: int, config: GatedConfig, epoch: int):
    """One epoch over a partition, from the shared weights and optimiser memory after ``steps`` steps."""

    def train(batches):
        weights, first, second = (part.copy() for part in np.split(state, 3))
        step, rows, loss = steps, 0, 0.0
        keep = 1 - config.dropout
        for batch in batches:
            x, y = matrix(batch.column("features")), batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            rng = np.random.default_rng([config.seed, epoch, rows])
            order = rng.permutation(len(x))
            for low in range(0, len(x), config.batch):
                pick = order[low : low + config.batch]
                drop = [(rng.random((len(pick), h)) < keep) / keep for h in (config.hidden1, config.hidden2)]
                part, slope = _slopes(_unpack(weights, width, config), x[pick], y[pick], drop)
                step += 1
                first = 0.9 * first + 0.1 * slope
                second = 0.999 * second + 0.001 * slope**2
                move = (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                weights -= config.rate * (move + config.decay * weights)
                loss += part * len(pick)
            rows += len(x)
        if rows:
            places = np.arange(-2, len(state))
            values = np.concatenate([[(step - steps) * rows, loss], np.concatenate([weights, first, second]) * rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.int32()), pa.array(values), pa.array(np.full(len(places), rows), pa.int64())],
                names=["place", "total", "rows"],
            )

    return train


@dataclass
class GatedModel:
    flat: np.ndarray
    width: int
    config: GatedConfig
    losses: list[float]

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``probability`` and ``gate``, the weight of each feature in this row."""
        shared = rows.sparkSession.sparkContext.broadcast(self.flat)
        width, config = self.width, self.config
        schema = rows.withColumns({"probability": F.lit(0.0), "gate": F.col("features")}).schema

        def work(batches):
            weights = _unpack(shared.value, width, config)
            for batch in batches:
                gate, _, _, logit = _forward(weights, matrix(batch.column("features")).reshape(-1, width))
                chance = np.clip(_sigmoid(logit), PROBABILITY_FLOOR, PROBABILITY_CEILING)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(chance), list_column(gate)],
                    names=[*batch.schema.names, "probability", "gate"],
                )

        return rows.mapInArrow(work, schema)


def fit_gated(train: DataFrame, config: GatedConfig = GatedConfig()) -> GatedModel:
    """Train on rows (y, features)."""
    rows = train.select("y", "features")
    width = rows.select(F.size("features")).first()[0]
    rng = np.random.default_rng(config.seed)
    fan = np.repeat([rows_in for rows_in, _ in _shapes(width, config)[::2]], 2)
    flat = np.concatenate([rng.uniform(-1, 1, shape).ravel() / np.sqrt(n) for n, shape in zip(fan, _shapes(width, config))])
    state, steps = np.concatenate([flat, np.zeros(2 * len(flat))]), 0
    losses: list[float] = []
    for epoch in range(config.epochs):
        # Weights and optimiser memory live on from epoch to epoch; both are averaged over partitions by rows.
        pushed = rows.mapInArrow(_partition_trainer(state, steps, width, config, epoch), "place int, total double, rows long")
        merged = pushed.groupBy("place").agg((F.sum("total") / F.sum("rows")).alias("value")).toPandas()
        values = merged.sort_values("place")["value"].to_numpy()
        steps += max(1, round(float(values[0])))
        losses.append(float(values[1]))
        state = values[2:].copy()
    return GatedModel(np.split(state, 3)[0], width, config, losses)
