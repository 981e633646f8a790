"""Spark's multilayer perceptron (one layer of sigmoid units, softmax) fitted with matrix products over packed rows.

The first weights, the loss, the quasi-Newton steps and the model are those of ``MultilayerPerceptronClassifier``. Its
passes over the rows are replaced: rows are packed once into blocks of numbers, a task turns its blocks into the sums of
loss and gradient by matrix products, and the driver adds one such sum per task, in the order of the partitions. Hidden
units are computed in single precision (``STEP`` rows at once), the softmax, the loss and all sums beyond in double.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemirror.session import cut

BLOCK = 8192                # rows packed together
STEP = 1024                 # rows multiplied at once
TASK_ROWS = 1_000_000       # rows of a task, or fewer while cores are free
LEAST_TASK_ROWS = 50_000
TOLERANCE = 1e-6            # as the classifier's default
HISTORY, LOOK_BACK = 10, 20
SEARCH_STEPS = 10
DECREASE, CURVATURE = 1e-4, 0.9


def _packed_rows(block: int):
    """``n, x, y``: features of up to ``block`` rows, row by row, and their labels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                y = part.column("label").to_numpy(zero_copy_only=False).astype(np.int16)
                yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), pa.array([x.tobytes()], pa.binary()),
                                                  pa.array([y.tobytes()], pa.binary())], names=["n", "x", "y"])
    return run


def packed(train: DataFrame) -> tuple[DataFrame, int]:
    """The blocks of ``features, label``, dealt evenly over tasks, and the number of rows."""
    rows = train.select(vector_to_array("features").alias("x"), "label")
    blocks = cut(rows.mapInArrow(_packed_rows(BLOCK), "n long, x binary, y binary"))
    count = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    free = min(train.sparkSession.sparkContext.defaultParallelism, -(-count // LEAST_TASK_ROWS))
    return cut(blocks.repartition(max(1, free, -(-count // TASK_ROWS)))), count


def _unrolled(weights: np.ndarray, layers: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights (inputs x outputs) and intercepts of both layers, as views of the classifier's vector."""
    d, h, k = layers
    ends = np.cumsum([d * h, h, h * k, k])
    return (weights[:ends[0]].reshape(d, h), weights[ends[0]:ends[1]],
            weights[ends[1]:ends[2]].reshape(h, k), weights[ends[2]:ends[3]])


def block_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray, layers: list[int]) -> tuple[float, np.ndarray]:
    """Loss and gradient, summed over the rows."""
    w1, b1, w2, b2 = _unrolled(weights.astype(np.float32), layers)
    gradient, loss = np.zeros_like(weights), 0.0
    g1, c1, g2, c2 = _unrolled(gradient, layers)
    for start in range(0, len(x), STEP):
        part, label = x[start:start + STEP], y[start:start + STEP]
        hidden = part @ w1
        hidden += b1
        np.negative(hidden, out=hidden)
        with np.errstate(over="ignore"):
            np.exp(hidden, out=hidden)
        hidden += 1.0
        np.reciprocal(hidden, out=hidden)
        out = (w2.T @ hidden.T).astype(float) + b2[:, None]          # classes x rows
        out -= out.max(axis=0)
        at = np.arange(len(label))
        chosen = out[label, at]
        np.exp(out, out=out)
        total = out.sum(axis=0)
        loss += float(np.log(total).sum() - chosen.sum())
        out /= total
        out[label, at] -= 1.0
        c2 += out.sum(axis=1)
        out = out.astype(np.float32)
        g2 += (out @ hidden).T
        back = out.T @ w2.T
        back *= hidden
        np.subtract(1.0, hidden, out=hidden)
        back *= hidden
        g1 += part.T @ back
        c1 += back.sum(axis=0)
    return loss, gradient


def _task_sums(weights: np.ndarray, layers: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, gradient = 0.0, np.zeros_like(weights)
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y")):
                more, slope = block_sums(np.frombuffer(x.as_buffer(), np.float32).reshape(-1, layers[0]),
                                         np.frombuffer(y.as_buffer(), np.int16), weights, layers)
                loss += more
                gradient += slope
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([gradient.tobytes()], pa.binary())], names=["loss", "gradient"])
    return run


class _SearchFailed(Exception):
    pass


def _between(a: tuple, b: tuple) -> float:
    """Where the cubic through both ends (place, value, slope) is smallest, off the ends by a tenth at least."""
    (at, av, ad), (bt, bv, bd) = a, b
    low, high = sorted((at + 0.1 * (bt - at), at + 0.9 * (bt - at)))
    d1 = ad + bd - 3 * (av - bv) / (at - bt)
    root = d1 * d1 - ad * bd
    if root < 0:
        return (at + bt) / 2
    d2 = np.sign(bt - at) * np.sqrt(root)
    t = bt - (bt - at) * (bd + d2 - d1) / (bd - ad + 2 * d2) if bd - ad + 2 * d2 else (at + bt) / 2
    return float(min(max(t, low), high)) if np.isfinite(t) else (at + bt) / 2


def _step(along: Callable[[float], tuple], begin: tuple, first: float) -> float:
    """A step with the strong Wolfe conditions; ``along`` gives (place, value, slope)."""
    _, value, slope = begin

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(SEARCH_STEPS):
            c = along(_between(low, high))
            if c[1] > value + DECREASE * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= CURVATURE * abs(slope):
                return c[0]
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise _SearchFailed

    low, t = begin, first
    for i in range(SEARCH_STEPS):
        c = along(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + DECREASE * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= CURVATURE * abs(slope):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise _SearchFailed


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int) -> np.ndarray:
    """Limited-memory BFGS with the stopping rules of Spark's optimiser."""
    value, gradient = f(x)
    start, values, memory, failed = value, [value], [], False
    for number in range(max_iter):
        if np.linalg.norm(gradient) <= max(TOLERANCE * abs(value), 1e-8):
            break
        direction, factors = gradient.copy(), []
        for s, g in reversed(memory):
            factors.append((s @ direction) / (s @ g))
            direction -= factors[-1] * g
        if memory:
            s, g = memory[-1]
            direction *= (s @ g) / (g @ g)
        for (s, g), factor in zip(memory, reversed(factors)):
            direction += (factor - (g @ direction) / (s @ g)) * s
        direction = -direction
        seen: dict[float, tuple[float, np.ndarray]] = {}

        def along(t: float) -> tuple:
            seen[t] = f(x + t * direction)
            return t, seen[t][0], float(seen[t][1] @ direction)

        try:
            t = _step(along, (0.0, value, float(gradient @ direction)), 1.0 if number else 1.0 / np.linalg.norm(direction))
        except _SearchFailed:
            if failed or not memory:
                break
            failed, memory = True, []
            continue
        failed = False
        value, after = seen[t]
        if t * float((direction @ (after - gradient))) > 0:
            memory = [*memory, (t * direction, after - gradient)][-HISTORY:]
        x, gradient = x + t * direction, after
        values = [*values, value][-LOOK_BACK:]
        if abs(value - max(values)) <= TOLERANCE * abs(start):
            break
    return x


def fit_perceptron(train: DataFrame, layers: list[int], max_iter: int, seed: int):
    """Spark's model with ``layers`` inputs, hidden units and classes, for ``features, label``."""
    spark = train.sparkSession
    # The classifier itself draws the first weights and makes the model; no step over these rows is taken.
    shape = spark.createDataFrame([(Vectors.dense([0.0] * layers[0]), float(i)) for i in range(2)], ["features", "label"])
    first = MultilayerPerceptronClassifier(layers=layers, maxIter=0, seed=seed).fit(shape).weights.toArray()
    blocks, count = packed(train)

    def mean(weights: np.ndarray) -> tuple[float, np.ndarray]:
        sums = blocks.mapInArrow(_task_sums(weights, layers), "loss double, gradient binary").collect()   # one row per task
        gradient = np.sum([np.frombuffer(r["gradient"]) for r in sums], axis=0)
        return sum(r["loss"] for r in sums) / count, gradient / count

    weights = minimised(mean, first, max_iter)
    return MultilayerPerceptronClassifier(layers=layers, maxIter=0, seed=seed, initialWeights=Vectors.dense(weights)).fit(shape)
