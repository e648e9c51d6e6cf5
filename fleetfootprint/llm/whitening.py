"""Whitening of embeddings by shifted Cholesky QR over a distributed table.

The entries of a vector are coded as long numbers, x = floor(1024 c) + 100000, and centred by their exact mean. Each pass
multiplies the centred rows by the triangular solves found so far and adds up the d x d Gram matrix of the results. Its
Cholesky factor, of the matrix plus a shift in the first pass so that it exists for any condition number, orthogonalises
the rows further; passes go on until the Gram matrix is the identity. The composed factors are the R of the centred
rows, and the singular values and vectors of R give eigenvalues and components of their covariance, without ever
squaring the condition number.

What leaves a task is one Gram matrix per vector length; matrices are added in at most ``GRAM_GROUPS`` groups before the
driver adds those. Order of addition is fixed, so reruns agree. The sign of a component makes its largest entry positive.

Defined cases: vectors that are null or hold null, NaN, infinite or excessive entries (codes beyond 2^48) are dropped;
zero vectors stay; an empty vector has no components and so no rows; vectors of different lengths are separate fit lists;
a component without variance (as of equal or repeated rows only) has whitened 0 and explained 0 and stays out of
identity_error; rows that repeat a vec_id, or have none, get rows each; ties of eigenvalues are ordered by the
decomposition; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfootprint.session import settle

SCALE, OFFSET = 1024, 100_000
LARGEST = 2.0**38
COMPONENTS = 8
GRAM_GROUPS = 16
MAX_PASSES = 12
DONE = 1e-13
ROUNDING = np.finfo(np.float64).eps / 2
MATRIX = "length int, task int, matrix binary"


@dataclass
class Fit:
    """The list of vectors of one length: how many, their exact sums per dimension, and what the passes have found."""

    n: int
    sums: np.ndarray
    solves: list[np.ndarray]
    axes: np.ndarray | None = None
    scales: np.ndarray | None = None
    explained: np.ndarray | None = None
    identity_error: float = 0.0

    def offsets(self, codes: np.ndarray) -> np.ndarray:
        """n x - S, exact: as Python numbers where 64 bits might not do."""
        most = self.n * (int(np.abs(codes).max(initial=0)) + 1) + int(np.abs(self.sums).max(initial=0))
        kind = np.int64 if most < 2**62 else object
        return codes.astype(kind) * self.n - self.sums.astype(kind)

    def centred(self, codes: np.ndarray) -> np.ndarray:
        return (self.offsets(codes) / self.n).astype(np.float64)

    def orthogonal(self, codes: np.ndarray) -> np.ndarray:
        rows = self.centred(codes)
        for factor in self.solves:
            rows = np.linalg.solve(factor.T, rows.T).T
        return rows

    def whitened(self, codes: np.ndarray) -> np.ndarray:
        return self.centred(codes) @ self.axes * self.scales


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, length and codes of the vectors that can be used."""
    entries = F.col(vector_col).cast("array<double>")
    good = F.forall(entries, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return vectors.filter(good).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.size(entries).alias("length"),
        F.transform(entries, lambda c: F.floor(c * SCALE) + OFFSET).alias("codes"),
    )


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and codes (rows x length) of a batch with columns length and codes."""
    lengths = batch.column("length").to_numpy()
    flat = batch.column("codes").flatten().to_numpy()
    ends = np.cumsum(lengths)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, rows, flat[(ends[rows] - length)[:, None] + np.arange(length)]


def _added(rows: DataFrame, value: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """``value`` of each length and batch of codes, added up over all rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, _, codes in _by_length(batch):
                part = value(length, codes)
                totals[length] = totals[length] + part if length in totals else part
        task = TaskContext.get().partitionId()
        columns = [pa.array(list(totals), pa.int32()), pa.array([task] * len(totals), pa.int32()), pa.array([m.tobytes() for m in totals.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["length", "task", "matrix"])

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("task", kind="stable")
        total = sum(np.frombuffer(m) for m in ordered["matrix"])
        return pd.DataFrame({"length": [key[0]], "task": [key[1]], "matrix": [total.tobytes()]})

    parts = rows.select("length", "codes").mapInArrow(partial, MATRIX)
    group = (F.col("task") % GRAM_GROUPS).cast("int").alias("group")
    summed = parts.groupBy("length", group).applyInPandas(add, MATRIX).orderBy("length", "task").collect()
    out: dict[int, np.ndarray] = {}
    for row in summed:
        matrix = np.frombuffer(bytes(row["matrix"]))
        out[row["length"]] = out[row["length"]] + matrix if row["length"] in out else matrix
    return out


def _sums(rows: DataFrame) -> dict[int, Fit]:
    """Number and exact sums of the vectors of each length: whole numbers, so added by Spark in any order."""
    every = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, _, codes in _by_length(batch):
                high, low = codes >> 24, codes & (2**24 - 1)
                part = high.sum(axis=0).astype(object) * 2**24 + low.sum(axis=0).astype(object)
                totals[length] = totals[length] + part if length in totals else part
        for length, total in totals.items():
            columns = [pa.array([length] * length, pa.int32()), pa.array(range(length), pa.int32()), pa.array([str(v) for v in total])]
            yield pa.RecordBatch.from_arrays(columns, ["length", "axis", "total"])

    parts = rows.filter("length > 0").select("length", "codes").mapInArrow(partial, "length int, axis int, total string")
    total = F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")
    found = parts.groupBy("length", "axis").agg(total).orderBy("length", "axis").collect()
    fits = {r["length"]: Fit(r["n"], np.zeros(0, object), []) for r in every}
    for row in found:
        fit = fits[row["length"]]
        fit.sums = np.append(fit.sums, int(row["total"]))
    return fits


def _decompose(fit: Fit, gram: np.ndarray, components: int) -> None:
    """Components and scales from R, the last factor being a root of the last Gram matrix, which may have empty directions."""
    values, vectors = np.linalg.eigh(gram)
    factor = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
    for solve in reversed(fit.solves):
        factor = factor @ solve
    _, singular, axes = np.linalg.svd(factor)
    values = singular**2 / fit.n
    spread = float(values.sum())
    k = min(components, len(values))
    signs = np.sign(axes[np.arange(k), np.abs(axes[:k]).argmax(axis=1)])
    # below this a direction holds rounding only
    there = singular[:k] > singular[0] * len(values) * fit.n**0.5 * ROUNDING * 8 if spread else np.zeros(k, bool)
    fit.axes = (axes[:k] * signs[:, None]).T
    fit.scales = np.where(there, 1 / np.sqrt(np.where(there, values[:k], 1)), 0.0)
    fit.explained = np.where(there, values[:k] / (spread or 1), 0.0)


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A fit for each vector length of ``rows`` (length, codes), a settled table."""
    fits = _sums(rows)
    open_fits = {length: f for length, f in fits.items() if length}
    for number in range(MAX_PASSES):
        if not open_fits:
            break
        lengths = list(open_fits)

        def gram(length: int, codes: np.ndarray, models: dict[int, Fit] = open_fits) -> np.ndarray:
            found = models[length].orthogonal(codes)
            return (found.T @ found).ravel()

        for length, flat in _added(rows.filter(F.col("length").isin(lengths)), gram).items():
            model, matrix = open_fits[length], flat.reshape(length, length)
            # the identity, or a projector: directions without variance stay empty
            if number and np.abs(matrix - matrix @ matrix).max() <= DONE * length * max(1.0, model.n**0.5) or number == MAX_PASSES - 1:
                _decompose(model, matrix, components)
                open_fits = {k: v for k, v in open_fits.items() if k != length}
            else:
                model.solves.append(_factor(matrix, model.n, first=not number))
    lengths = [length for length in fits if length]

    def second(length: int, codes: np.ndarray) -> np.ndarray:
        white = fits[length].whitened(codes)
        return np.append((white.T @ white).ravel(), white.sum(axis=0))

    if lengths:
        for length, flat in _added(rows.filter("length > 0"), second).items():
            model = fits[length]
            k = len(model.scales)
            mean = flat[k * k :] / model.n
            covariance = flat[: k * k].reshape(k, k) / model.n - np.outer(mean, mean)
            there = model.scales > 0
            error = np.abs(covariance - np.eye(k))[np.ix_(there, there)]
            model.identity_error = float(error.max(initial=0.0))
    return fits


def _factor(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Upper triangular factor of a Gram matrix, of the matrix plus a shift in the first pass and where it needs one."""
    d, norm = len(gram), float(np.linalg.norm(gram, 2))
    shift = 11 * (n * d + d * (d + 1)) * ROUNDING * norm if first else 0.0
    # a large list must not be shifted away: what is needed is to stay above the rounding of the sums
    shift = min(shift, norm * 1e-6)
    for _ in range(60):
        try:
            return np.linalg.cholesky(gram + np.eye(d) * shift).T
        except np.linalg.LinAlgError:
            shift = max(shift * 10, ROUNDING * d * norm, np.finfo(np.float64).tiny)
    return np.eye(d)  # no variance at all


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation (exact, decimal), whitened, explained and identity_error for every usable vector."""
    rows = settle(coded(vectors, id_col, vector_col), "coded-vectors")
    models = fit(rows, components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for length, at, codes in _by_length(batch):
                model = models[length]
                if not length:
                    continue
                away = model.offsets(codes)
                if int(np.abs(away).max(initial=0)) >= int((2**62 / length) ** 0.5):
                    away = away.astype(object)
                deviation = [str(v) for v in (away * away).sum(axis=1)]
                k, n = len(model.scales), len(at)
                columns = [
                    ids.take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n)),
                    pa.array(deviation).take(pa.array(np.repeat(np.arange(n), k))), pa.array(model.whitened(codes).ravel()),
                    pa.array(np.tile(model.explained, n)), pa.array(np.full(n * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = "vec_id long, component int, n long, deviation string, whitened double, explained double, identity_error double"
    return rows.mapInArrow(project, schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
