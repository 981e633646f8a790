"""Gaussian mixtures fitted by distributed expectation maximisation.

Equal values are compressed to counts and packed into blocks of columns once. Every iteration is one Spark job: a task
turns its blocks into a few weighted sums per component by two matrix products, the sums are added up by a grouped
aggregate, and the driver updates the (tiny) parameters. Several columns or tables are fitted in the same job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemirror.operators.profile import value_counts
from tablemirror.session import cut

RIDGE = 1e-6    # added to variances
CHUNK = 1024    # rows computed at once: their densities stay in a core's cache
PACKED_ROWS = 16_384         # rows of a packed block
TASK_BLOCKS = 8              # blocks of a task: every iteration reads them again
FEW_VALUES = 256             # a column of a block with no more values is packed as their numbers
PACKED = "name string, n int, ones boolean, values array<binary>, codes array<binary>"


@dataclass(frozen=True)
class Mixture:
    """Diagonal mixture. ``offsets`` hold everything of the log density but the squared distances."""

    weights: np.ndarray      # (k,)
    means: np.ndarray        # (k, d)
    variances: np.ndarray    # (k, d)
    offsets: np.ndarray      # (k,)

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """(n, k) log joint densities."""
        inverse = 1.0 / self.variances
        squared = ((x ** 2) @ inverse.T - 2.0 * (x @ (self.means * inverse).T)
                   + (self.means ** 2 * inverse).sum(axis=1))
        return self.offsets - 0.5 * squared


def plain_offsets(weights: np.ndarray, variances: np.ndarray) -> np.ndarray:
    return np.log(weights) - 0.5 * (np.log(variances) + math.log(2 * math.pi)).sum(axis=1)


def digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 6, then the asymptotic series."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    while (x < 6).any():
        small = x < 6
        out[small] -= 1.0 / x[small]
        x[small] += 1.0
    inv2 = 1.0 / (x * x)
    return out + np.log(x) - 0.5 / x - inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 / 240)))


def _pack_column(x: np.ndarray) -> tuple[bytes, bytes]:
    values, codes = np.unique(x, return_inverse=True)
    return (values.tobytes(), codes.astype("u1").tobytes()) if len(values) <= FEW_VALUES else (b"", x.tobytes())


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ``PACKED_ROWS`` rows of one name, a column at a time: the numbers, and last their counts."""
    kept: dict[str, list[np.ndarray]] = {}

    def packed(name: str, rows: np.ndarray) -> pa.RecordBatch:
        ones = bool((rows[-1] == 1.0).all())
        parts = [_pack_column(x) for x in (rows[:-1] if ones else rows)]
        return pa.RecordBatch.from_arrays([
            pa.array([name]), pa.array([rows.shape[1]], pa.int32()), pa.array([ones]), pa.array([[v for v, _ in parts]], pa.list_(pa.binary())),
            pa.array([[c for _, c in parts]], pa.list_(pa.binary()))], names=["name", "n", "ones", "values", "codes"])

    for batch in batches:
        named = batch.column("name").dictionary_encode()
        where = named.indices.to_numpy()
        numbers = [c for c in batch.schema.names if c not in ("name", "cnt")]
        rows = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in (*numbers, "cnt")], dtype=float)
        for at, name in enumerate(named.dictionary.to_pylist()):
            parts = kept.setdefault(name, [])
            parts.append(rows[:, where == at])
            if sum(p.shape[1] for p in parts) >= PACKED_ROWS:
                whole = np.concatenate(parts, axis=1)
                full = whole.shape[1] // PACKED_ROWS * PACKED_ROWS
                for start in range(0, full, PACKED_ROWS):
                    yield packed(name, np.ascontiguousarray(whole[:, start:start + PACKED_ROWS]))
                kept[name] = [whole[:, full:]]
    for name, parts in kept.items():
        rows = np.concatenate(parts, axis=1)
        if rows.shape[1]:
            yield packed(name, np.ascontiguousarray(rows))


def packed_blocks(data: DataFrame) -> DataFrame:
    """``name, x..., cnt`` as packed blocks (see ``PACKED``), dealt evenly over tasks."""
    blocks = cut(data.mapInArrow(_packed_rows, PACKED))
    return cut(blocks.repartition(max(1, -(-blocks.count() // TASK_BLOCKS))))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Name, numbers (a row per dimension) and weights of every block."""
    for batch in batches:
        for name, n, ones, values, codes in zip(*(batch.column(c).to_pylist() for c in ("name", "n", "ones", "values", "codes"))):
            rows = np.array([np.frombuffer(v)[np.frombuffer(c, "u1")] if v else np.frombuffer(c) for v, c in zip(values, codes)])
            yield (name, rows, np.ones(n)) if ones else (name, rows[:-1], rows[-1])


def _terms(model: Mixture) -> np.ndarray:
    """(k, 2 d + 1) factors of the numbers, their squares and one, which add up to the log joint densities."""
    inverse = 1.0 / model.variances
    rest = model.offsets - 0.5 * (model.means ** 2 * inverse).sum(axis=1)
    return np.hstack([model.means * inverse, -0.5 * inverse, rest[:, None]])


def _powers(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x ** 2, np.ones((1, x.shape[1]))])


def _sums(models: dict[str, Mixture], centres: dict[str, np.ndarray], tables: dict[str, str]):
    """Of one task: the weighted sums of every model over the rows of its table, added up over all blocks."""
    terms = {name: _terms(model) for name, model in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for table, x, weights in _blocks(batches):
            # Models of one table share its centre.
            wanted = [n for n in models if tables[n] == table]
            if not wanted:
                continue
            centred = x - centres[wanted[0]][:, None]
            for start in range(0, x.shape[1], CHUNK):
                powers, w = _powers(centred[:, start:start + CHUNK]), weights[start:start + CHUNK]
                for name in wanted:
                    total = sums.setdefault(name, [0.0, 0.0])
                    for i, one in enumerate(_expected(terms[name], powers, w)):
                        total[i] = total[i] + one
        out = []
        for name, (moments, loglik) in sums.items():
            k, d = len(moments), moments.shape[1] // 2
            out.append(pd.DataFrame({
                "name": name, "k": np.repeat(np.arange(k, dtype="int32"), d), "dim": np.tile(np.arange(d, dtype="int32"), k),
                "r": np.repeat(moments[:, -1], d), "rx": moments[:, :d].ravel(), "rxx": moments[:, d:-1].ravel(),
                "loglik": np.where(np.arange(k * d) == 0, loglik, 0.0)}))
        if out:
            yield pa.RecordBatch.from_pandas(pd.concat(out), preserve_index=False)
    return run


def _log_totals(terms: np.ndarray, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Densities (k, n) divided by the largest of their column, their totals, and the logarithms of the whole densities."""
    logs = terms @ powers
    top = logs.max(axis=0)
    logs -= top
    np.exp(logs, out=logs)
    total = logs.sum(axis=0)
    return logs, total, np.log(total) + top


def _expected(terms: np.ndarray, powers: np.ndarray, w: np.ndarray) -> tuple:
    """First and second moments and sums of the weighted responsibilities, and the log likelihood of some rows."""
    e, total, logs = _log_totals(terms, powers)
    e *= w / total
    return e @ powers.T, float(logs @ w)


def _step(data: DataFrame, models: dict[str, Mixture], centres: dict[str, np.ndarray],
          tables: dict[str, str]) -> dict[str, tuple]:
    partial = data.mapInArrow(
        _sums(models, centres, tables),
        "name string, k int, dim int, r double, rx double, rxx double, loglik double")
    rows = partial.groupBy("name", "k", "dim").agg(
        F.sum("r").alias("r"), F.sum("rx").alias("rx"), F.sum("rxx").alias("rxx"),
        F.sum("loglik").alias("loglik")).toPandas()      # models x components x dimensions rows
    out = {}
    for name, part in rows.groupby("name"):
        part = part.sort_values(["k", "dim"])
        k, d = models[name].means.shape
        shape = (k, d)
        out[name] = (part["r"].to_numpy().reshape(shape)[:, 0], part["rx"].to_numpy().reshape(shape),
                     part["rxx"].to_numpy().reshape(shape), float(part["loglik"].sum()))
    return out


def _moments(nk, rx, rxx):
    safe = nk + 10 * np.finfo(float).eps
    means = rx / safe[:, None]
    return safe, means, np.maximum(rxx / safe[:, None] - means ** 2, 0.0) + RIDGE


def _update_plain(nk, rx, rxx, prior) -> Mixture:
    nk, means, variances = _moments(nk, rx, rxx)
    weights = nk / nk.sum()
    return Mixture(weights, means, variances, plain_offsets(weights, variances))


def _update_variational(nk, rx, rxx, prior) -> Mixture:
    """Dirichlet-process mixture in one dimension; priors: concentration, centred mean 0, data variance."""
    concentration, spread = prior
    nk, xk, sk = _moments(nk, rx, rxx)
    later = np.concatenate([np.cumsum(nk[::-1])[::-1][1:], [0.0]])
    a, b = 1.0 + nk, concentration + later
    beta, dof = 1.0 + nk, 1.0 + nk
    means = nk[:, None] * xk / beta[:, None]
    variances = (spread + nk[:, None] * sk + (nk / beta)[:, None] * xk ** 2) / dof[:, None]
    both = digamma(a + b)
    log_weights = digamma(a) - both + np.concatenate([[0.0], np.cumsum(digamma(b) - both)[:-1]])
    stick = a / (a + b) * np.concatenate([[1.0], np.cumprod(b / (a + b))[:-1]])
    log_precision = math.log(2.0) + digamma(0.5 * dof)
    offsets = (log_weights - 0.5 * (np.log(variances[:, 0]) + math.log(2 * math.pi))
               - 0.5 * np.log(dof) + 0.5 * (log_precision - 1.0 / beta))
    return Mixture(stick / stick.sum(), means, variances, offsets)


def _fit(data: DataFrame, start: dict[str, Mixture], centres: dict[str, np.ndarray], priors: dict,
         update, max_iter: int, tolerance: float, rows: dict[str, float], tables: dict[str, str]) -> dict[str, Mixture]:
    """Iterate until the mean log likelihood of every model over its table moves by less than ``tolerance``."""
    models, last = dict(start), {name: -math.inf for name in start}
    active = set(start)
    for _ in range(max_iter):
        open_ = sorted({tables[n] for n in active})
        sums = _step(data.filter(F.col("name").isin(open_)), {n: models[n] for n in active}, centres, tables)
        for name, (nk, rx, rxx, loglik) in sums.items():
            models[name] = update(nk, rx, rxx, priors.get(name))
            mean = loglik / rows[name]
            if abs(mean - last[name]) < tolerance:
                active.discard(name)
            last[name] = mean
        if not active:
            break
    return models


def fit_columns(df: DataFrame, columns: Sequence[str], components: int = 10, bayesian: bool = True,
                concentration: float = 0.001, max_iter: int = 100, tolerance: float = 1e-3) -> dict[str, Mixture]:
    """One 1-D mixture per column, all in the same jobs; started from evenly spaced quantiles."""
    data = packed_blocks(value_counts(df, columns, "double").filter(~F.isnan("value")))
    quantiles = [(i + 0.5) / components for i in range(components)]
    row = df.agg(*[agg for i, c in enumerate(columns) for agg in (
        F.avg(F.col(c).cast("double")).alias(f"m{i}"), F.var_samp(F.col(c).cast("double")).alias(f"v{i}"),
        F.count(c).alias(f"n{i}"),
        F.percentile_approx(F.col(c).cast("double"), quantiles, 10000).alias(f"q{i}"))]).first()
    start, centres, priors, rows = {}, {}, {}, {}
    for i, c in enumerate(columns):
        width = max(row[f"v{i}"] or 0.0, RIDGE)
        centres[c] = np.array([row[f"m{i}"]])
        means = np.array(row[f"q{i}"], dtype=float)[:, None] - centres[c]
        variances = np.full_like(means, width / components + RIDGE)
        weights = np.full(components, 1.0 / components)
        start[c] = Mixture(weights, means, variances, plain_offsets(weights, variances))
        priors[c], rows[c] = (concentration, width), row[f"n{i}"]
    update = _update_variational if bayesian else _update_plain
    fitted = _fit(data, start, centres, priors, update, max_iter, tolerance, rows, {c: c for c in columns})
    return {c: Mixture(m.weights, m.means + centres[c], m.variances, m.offsets) for c, m in fitted.items()}


def fit_rows(df: DataFrame, columns: Sequence[str], components: int, max_iter: int = 100,
             tolerance: float = 1e-3) -> Mixture:
    """One diagonal mixture over whole rows; started from the quantiles of each column."""
    return fit_tables({"row": df}, columns, [components], max_iter, tolerance)["row", components]


def packed_tables(dfs: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """The numbers of several tables as packed blocks, equal rows counted."""
    data = None
    for table, df in dfs.items():
        one = df.select(F.lit(table).alias("name"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
        data = one if data is None else data.unionByName(one)
    return packed_blocks(data.groupBy(*data.columns).agg(F.count(F.lit(1)).alias("cnt")))


def fit_tables(dfs: dict[str, DataFrame], columns: Sequence[str], components: Sequence[int], max_iter: int = 100,
               tolerance: float = 1e-3, data: DataFrame | None = None) -> dict[tuple[str, int], Mixture]:
    """``fit_rows`` of every table with every number of components, all in the same jobs.

    ``data``: the tables' ``packed_tables``, if they have been made already."""
    columns = list(columns)
    numbers = [F.col(f"`{c}`").cast("double") for c in columns]
    data = packed_tables(dfs, columns) if data is None else data
    start, centres, rows, tables = {}, {}, {}, {}
    wanted = [(i + 0.5) / k for k in components for i in range(k)]
    for table, df in dfs.items():
        row = df.agg(*[agg for i, x in enumerate(numbers) for agg in (
            F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"), F.percentile_approx(x, wanted, 10000).alias(f"q{i}"))],
            F.count(F.lit(1)).alias("n")).first()
        centre = np.array([row[f"m{i}"] for i in range(len(columns))])
        spreads = np.array([max(row[f"v{i}"], RIDGE) for i in range(len(columns))])
        at = 0
        for k in components:
            grid = np.array([row[f"q{i}"][at:at + k] for i in range(len(columns))], dtype=float).T - centre
            at += k
            for j in range(grid.shape[1]):
                # A different order per dimension, or all centres would lie on one line.
                grid[:, j] = grid[(np.arange(k) * (2 * j + 1) + j) % k, j]
            weights = np.full(k, 1.0 / k)
            variances = np.tile(spreads / k + RIDGE, (k, 1))
            name = f"{k}:{table}"
            start[name] = Mixture(weights, grid, variances, plain_offsets(weights, variances))
            centres[name], rows[name], tables[name] = centre, row["n"], table
    fitted = _fit(data, start, centres, {}, _update_plain, max_iter, tolerance, rows, tables)
    return {(tables[n], int(n.split(":")[0])): Mixture(m.weights, m.means + centres[n], m.variances, m.offsets)
            for n, m in fitted.items()}


def packed_log_likelihoods(data: DataFrame, models: dict[str, tuple[str, Mixture]]) -> DataFrame:
    """``name, loglik``: the mean log density of the rows of a packed table under every model, given with its table's name.

    Rows with an unknown number have no density; they are not counted either."""
    # Numbers are taken from the middle of the components, as while fitting.
    centres = {n: m.weights @ m.means / m.weights.sum() for n, (_, m) in models.items()}
    terms = {n: _terms(Mixture(m.weights, m.means - centres[n], m.variances, m.offsets)) for n, (_, m) in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, x, weights in _blocks(batches):
            known = ~np.isnan(x).any(axis=0)
            x, w = x[:, known], weights[known]
            wanted = [n for n in models if models[n][0] == table]
            sums = [sum(float(_log_totals(terms[n], _powers(x[:, at:at + CHUNK] - centres[n][:, None]))[2] @ w[at:at + CHUNK])
                        for at in range(0, x.shape[1], CHUNK)) for n in wanted]
            if wanted:
                yield pa.RecordBatch.from_arrays([pa.array(wanted), pa.array(sums, pa.float64()), pa.array([float(w.sum())] * len(wanted))],
                                                 names=["name", "s", "n"])
    return data.mapInArrow(run, "name string, s double, n double").groupBy("name").agg((F.sum("s") / F.sum("n")).alias("loglik"))


def mean_log_likelihood(df: DataFrame, columns: Sequence[str], model: Mixture) -> DataFrame:
    """``loglik``: mean log density per row."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.dropna()      # rows with an unknown number have no density; they are not counted either
            if len(batch):
                logs = model.log_densities(batch.to_numpy(dtype=float))
                top = logs.max(axis=1, keepdims=True)
                yield pd.DataFrame({"s": [float((np.log(np.exp(logs - top).sum(axis=1)) + top[:, 0]).sum())],
                                    "n": [len(batch)]})
    partial = df.select(*[F.col(c).cast("double") for c in columns]).mapInPandas(score, "s double, n long")
    return partial.agg((F.sum("s") / F.sum("n")).alias("loglik"))
