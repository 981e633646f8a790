"""Trees over binned features: rows are reduced to the bins of their features and equal ones counted, so that the work of
a fit depends on how many different rows of bins there are, not on the number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemirror.session import cut, cut_counted

BINS = 32            # as many as Spark's trees take by default
CELL_ROWS = 50_000   # counted rows of a task
CELL_TASKS = 64      # tasks at most: every task sends its sums, so more of them would only shuffle more
SUM_BYTES = 1 << 20  # sums in one row
LEAF = 127           # no bin is above it


def bin_edges(arrays: DataFrame, dims: int, bins: int = BINS) -> list[np.ndarray]:
    """Per feature the values to divide at: between all values if there are at most ``bins`` of them, else at quantiles of
    all rows."""
    steps = [(i + 1) / bins for i in range(bins - 1)]
    x = [F.get("x", F.lit(i)) for i in range(dims)]
    row = arrays.agg(*[a for i in range(dims) for a in (F.approx_count_distinct(x[i]).alias(f"n{i}"),
                                                        F.percentile_approx(x[i], steps, 10000).alias(f"q{i}"))]).first()
    out = [np.unique(np.array(row[f"q{i}"], dtype=float)) for i in range(dims)]
    few = [i for i in range(dims) if row[f"n{i}"] <= 2 * bins]
    if few:
        values = arrays.agg(*[F.collect_set(x[i]).alias(f"v{i}") for i in few]).first()    # about 2 x bins numbers a feature
        for i in few:
            seen = np.sort(np.array(values[f"v{i}"], dtype=float))
            if len(seen) <= bins:
                out[i] = (seen[:-1] + seen[1:]) / 2
    return out


def _codes(x: pa.Array, edges: list[np.ndarray]) -> np.ndarray:
    rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
    return np.column_stack([np.searchsorted(t, rows[:, i]) for i, t in enumerate(edges)]).astype("int8")


def _binned(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = _codes(batch.column("x"), edges)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in codes], pa.binary()), batch.column("label")],
                                                 names=["bins", "label"])
    return run


def counted_bins(train: DataFrame, bins: int = BINS) -> tuple[DataFrame, list[np.ndarray]]:
    """``bins, label, n`` of rows ``features, label``, and the edges of the bins."""
    arrays = train.select(vector_to_array("features").alias("x"), "label")
    edges = bin_edges(arrays, arrays.select(F.size("x")).first()[0], bins)
    return arrays.mapInArrow(_binned(edges), "bins binary, label double").groupBy("bins", "label").agg(
        F.count(F.lit(1)).alias("n")), edges


def dealt(cells: DataFrame, by: list[str], task_rows: int = CELL_ROWS, most: int | None = CELL_TASKS) -> DataFrame:
    """Cells dealt by hash and in order inside a task, with the task's number in ``part``: the draws of a task follow from
    the rows alone."""
    done, rows = cut_counted(cells)
    tasks = max(1, -(-rows // task_rows))
    return cut(done.repartition(min(tasks, most or tasks), F.xxhash64(*by)).sortWithinPartitions(*by).withColumn(
        "part", F.spark_partition_id()))


class Binned:
    """A model of the bins' numbers, applied to features."""

    def __init__(self, edges: list[np.ndarray], model):
        self.edges, self.model = edges, model

    def transform(self, df: DataFrame) -> DataFrame:
        edges = self.edges

        @F.arrow_udf("array<double>")
        def numbers(x: pa.Array) -> pa.Array:
            codes = _codes(x, edges).astype(float)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="int32") * codes.shape[1]), pa.array(codes.ravel()))

        coded = df.withColumnRenamed("features", "_features").withColumn(
            "features", array_to_vector(numbers(vector_to_array("_features"))))
        kept = [F.col("_features").alias("features") if c == "features" else F.col(f"`{c}`") for c in df.columns]
        return self.model.transform(coded).select(*kept, "prediction")


def binned_vectors(cells: DataFrame, width: int) -> DataFrame:
    """``features`` (the bins' numbers) beside the columns of ``cells``."""
    @F.arrow_udf("array<double>")
    def numbers(bins: pa.Array) -> pa.Array:
        codes = np.frombuffer(b"".join(bins.to_pylist()), dtype="int8").astype(float)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1, dtype="int32") * width), pa.array(codes))

    return cells.withColumn("features", array_to_vector(numbers("bins")))


# ---------------------------------------------------------------- forests

@dataclass
class Nodes:
    """Nodes of all trees, the roots first: ``feature``, ``bin`` (at most it goes left; ``LEAF`` always), ``child`` (the
    left one, the right one follows; a leaf's is itself) and the ``sums`` of its rows."""

    feature: np.ndarray
    bin: np.ndarray
    child: np.ndarray
    sums: np.ndarray

    @classmethod
    def roots(cls, trees: int, channels: int) -> Nodes:
        return cls(np.zeros(trees, "int32"), np.full(trees, LEAF, "int8"), np.arange(trees, dtype="int32"),
                   np.zeros((trees, channels)))

    def reached(self, codes: np.ndarray, tree: int, depth: int) -> np.ndarray:
        flat, base = codes.ravel(), np.arange(len(codes)) * codes.shape[1]
        node = np.full(len(codes), tree, dtype="int32")
        for _ in range(depth):
            node = self.child[node] + (flat[base + self.feature[node]] > self.bin[node])
        return node

    def divide(self, at: np.ndarray, feature: np.ndarray, bins: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Split the nodes ``at``; the numbers of their children."""
        first = len(self.feature)
        new = np.arange(first, first + 2 * len(at), dtype="int32")
        self.feature[at], self.bin[at], self.child[at] = feature, bins, new[::2]
        self.feature = np.r_[self.feature, np.zeros(len(new), "int32")]
        self.bin = np.r_[self.bin, np.full(len(new), LEAF, "int8")]
        self.child = np.r_[self.child, new]
        sums = np.empty((len(new), self.sums.shape[1]))
        sums[::2], sums[1::2] = left, right
        self.sums = np.r_[self.sums, sums]
        return new


def _gini(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of the classes' sums, and what a division makes larger when it makes the impurity smaller."""
    weight = sums.sum(axis=-1)
    return weight, (sums ** 2).sum(axis=-1) / np.maximum(weight, 1e-300)


def _variance(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of (weight, sum of labels)."""
    return sums[..., 0], sums[..., 1] ** 2 / np.maximum(sums[..., 0], 1e-300)


def class_draws(seed: int) -> Callable:
    """Bootstrap of counted rows: a cell of n rows comes Poisson(n) times, the sum of n rows' Poisson(1)."""
    def draws(cells: pa.Table, tree: int) -> np.ndarray:
        n = cells.column("n").to_numpy()
        return np.random.default_rng([seed, tree, cells.column("part")[0].as_py()]).poisson(n).astype(float)
    return draws


def given_draws(cells: pa.Table, tree: int) -> np.ndarray:
    return cells.column(f"t{tree}").to_numpy()


def _level_sums(nodes: Nodes, slot: np.ndarray, subset: np.ndarray, groups: np.ndarray, depth: int, trees: int, bins: int,
                channels: int, draws: Callable):
    """Of one task: sums by open node, feature of the node's choice, bin and channel, several nodes a row. A tree's open
    nodes follow each other; ``groups`` has tree, first and last + 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        cells = pa.Table.from_batches(kept)
        rows = cells.num_rows
        codes = np.frombuffer(b"".join(cells.column("bins").to_pylist()), dtype="int8").reshape(rows, -1)
        channel = cells.column("channel").to_numpy().astype(int)
        k = subset.shape[1]
        for tree in range(trees):
            own = groups[groups[:, 1] == tree]
            if not len(own):
                continue
            low, high = own[0, 2], own[-1, 3]
            at = slot[nodes.reached(codes, tree, depth)]
            weight = draws(cells, tree)
            seen = np.flatnonzero((at >= 0) & (weight != 0))
            at, weight = at[seen], weight[seen]
            taken = codes[seen[:, None], subset[at]].astype(int)
            where = (((at - low)[:, None] * k + np.arange(k)) * bins + taken) * channels + channel[seen, None]
            sums = np.bincount(where.ravel(), np.repeat(weight, k), (high - low) * k * bins * channels)
            sums = sums.reshape(high - low, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[:, 0].astype("int32")), pa.array([sums[a - low:b - low].tobytes() for a, b in own[:, 2:]], pa.binary())],
                names=["group", "sums"])
    return run


def _best_splits(groups: np.ndarray, subset: np.ndarray, bins: int, channels: int, measure: Callable):
    """Adds a group's sums of all tasks and finds each node's best division; ``gain`` 0 where nothing is gained."""
    def run(parts: pa.Table) -> pa.Table:
        group = parts.column("group")[0].as_py()
        low, high = groups[group, 2:]
        total = 0.0
        for part in parts.column("sums"):
            total = total + np.frombuffer(part.as_buffer())
        sums = total.reshape(high - low, subset.shape[1], bins, channels)
        left = sums.cumsum(axis=2)
        whole = left[:, :, -1:, :]
        right = whole - left
        (lw, ls), (rw, rs), (_, ws) = measure(left), measure(right), measure(whole)
        gain = np.where((lw > 0) & (rw > 0), ls + rs - ws, 0.0)
        gain = np.where(gain > 1e-12 * np.abs(ws), gain, 0.0).reshape(high - low, -1)
        best, node = gain.argmax(axis=1), np.arange(high - low)
        feature, at = np.divmod(best, bins)
        return pa.table({
            "slot": pa.array(np.arange(low, high, dtype="int32")), "gain": pa.array(gain[node, best]),
            "feature": pa.array(subset[low:high][node, feature].astype("int32")), "bin": pa.array(at.astype("int32")),
            "low": pa.array(list(left[node, feature, at])), "high": pa.array(list(right[node, feature, at]))})
    return run


def grow(cells: DataFrame, width: int, bins: int, trees: int, depth: int, tried: int, channels: int, measure: Callable,
         draws: Callable, seed: int) -> Nodes:
    """A forest level by level, all trees at once: a level is one aggregate over the cells (``bins, channel, part`` and what
    ``draws`` takes); the driver holds the nodes. A node tries ``tried`` features drawn for it."""
    nodes = Nodes.roots(trees, channels)
    open_nodes, tree_of = np.arange(trees), np.arange(trees)
    rng = np.random.default_rng([seed, trees])
    for level in range(depth):
        order = np.argsort(tree_of, kind="stable")
        open_nodes, tree_of = open_nodes[order], tree_of[order]
        subset = np.sort(rng.random((len(open_nodes), width)).argsort(axis=1)[:, :tried], axis=1)
        slot = np.full(len(nodes.feature), -1)
        slot[open_nodes] = np.arange(len(open_nodes))
        step = max(1, SUM_BYTES // (8 * tried * bins * channels))
        found = []
        for tree in np.unique(tree_of):
            a, b = np.searchsorted(tree_of, [tree, tree + 1])
            found += [(tree, i, min(i + step, b)) for i in range(a, b, step)]
        groups = np.array([(g, *f) for g, f in enumerate(found)])
        best = (cells.mapInArrow(_level_sums(nodes, slot, subset, groups, level, trees, bins, channels, draws),
                                 "group int, sums binary")
                .groupBy("group").applyInArrow(_best_splits(groups, subset, bins, channels, measure),
                                               "slot int, gain double, feature int, bin int, low array<double>, high array<double>")
                .toPandas().sort_values("slot"))                # one row per open node
        low, high = np.array(best["low"].tolist()), np.array(best["high"].tolist())
        at = best["slot"].to_numpy()
        if level == 0:
            nodes.sums[open_nodes[at]] = low + high
        split = best["gain"].to_numpy() > 0
        parents = open_nodes[at[split]]
        new = nodes.divide(parents, best["feature"].to_numpy()[split], best["bin"].to_numpy()[split], low[split], high[split])
        tree_of = np.repeat(tree_of[at[split]], 2)
        weight = measure(nodes.sums[new])[0]
        mixed = (weight > 1) & ((nodes.sums[new] != 0).sum(axis=1) > 1)
        open_nodes, tree_of = new[mixed], tree_of[mixed]
        if not len(open_nodes):
            break
    return nodes


class Forest:
    """Mean of the trees' leaves: class shares, of which the largest is predicted, or labels."""

    def __init__(self, nodes: Nodes, edges: list[np.ndarray], trees: int, depth: int, shift: float | None = None):
        self.nodes, self.edges, self.trees, self.depth, self.shift = nodes, edges, trees, depth, shift

    def transform(self, df: DataFrame) -> DataFrame:
        nodes, edges, trees, depth, shift = self.nodes, self.edges, self.trees, self.depth, self.shift
        if shift is None:
            leaves = nodes.sums / np.maximum(nodes.sums.sum(axis=1, keepdims=True), 1e-300)
        else:
            leaves = shift + nodes.sums[:, 1:] / np.maximum(nodes.sums[:, :1], 1e-300)

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            codes = _codes(x, edges)
            total = np.zeros((len(codes), leaves.shape[1]))
            for tree in range(trees):
                total += leaves[nodes.reached(codes, tree, depth)]
            return pa.array(total.argmax(axis=1).astype(float) if shift is None else total[:, 0] / trees)

        return df.withColumn("prediction", predicted(vector_to_array("features")))


def fit_class_forest(train: DataFrame, classes: int, trees: int, depth: int, seed: int) -> Forest:
    """Bootstrapped Gini trees; a node tries the square root of the number of features."""
    cells, edges = counted_bins(train)
    cells = dealt(cells.withColumn("channel", F.col("label").cast("int")), ["bins", "label"])
    width, bins = len(edges), max(len(t) for t in edges) + 1
    nodes = grow(cells, width, bins, trees, depth, int(np.ceil(np.sqrt(width))) if trees > 1 else width, classes, _gini,
                 class_draws(seed), seed)
    return Forest(nodes, edges, trees, depth)


def _drawn_sums(trees: int, seed: int, shift: float):
    """Of one task: the bootstrap weight and label sum of every cell in every tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        rows = pa.Table.from_batches(kept).combine_chunks()
        coded = rows.column("bins").combine_chunks().dictionary_encode()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        cell, size = coded.indices.to_numpy(), len(coded.dictionary)
        n, y = rows.column("n").to_numpy(), rows.column("label").to_numpy() - shift
        part, sums = rows.column("part")[0].as_py(), [[], []]
        for tree in range(trees):
            weight = np.random.default_rng([seed, tree, part]).poisson(n).astype(float)
            sums[0].append(np.bincount(cell, weight, size))
            sums[1].append(np.bincount(cell, weight * y, size))
        for channel in (0, 1):
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.full(size, channel, "int32")),
                                              *[pa.array(s) for s in sums[channel]]],
                                             names=["bins", "channel", *[f"t{t}" for t in range(trees)]])
    return run


def fit_label_forest(train: DataFrame, trees: int, depth: int, seed: int) -> Forest:
    """Bootstrapped variance trees; a node tries a third of the features. Equal rows of bins and label are drawn once for
    every tree, the sums by cell are all that the levels read."""
    rows, edges = counted_bins(train)
    shift = train.agg(F.avg("label")).first()[0]
    names = [f"t{t}" for t in range(trees)]
    dealt_rows = dealt(rows, ["bins", "label"], 10 * CELL_ROWS, None)
    sums = dealt_rows.mapInArrow(_drawn_sums(trees, seed, shift), "bins binary, channel int, " + ", ".join(f"{t} double" for t in names))
    cells = dealt(sums.groupBy("bins", "channel").agg(*[F.sum(t).alias(t) for t in names]), ["bins", "channel"])
    width, bins = len(edges), max(len(t) for t in edges) + 1
    nodes = grow(cells, width, bins, trees, depth, -(-width // 3) if trees > 1 else width, 2, _variance, given_draws, seed)
    return Forest(nodes, edges, trees, depth, shift)
