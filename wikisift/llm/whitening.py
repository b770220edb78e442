"""Whitening of embeddings by their leading principal components.

Entries are fixed-point numbers, x = floor(scale * c), so sums are exact and equal vectors
are found by equal bytes. Each distinct vector counts once in the fit. Tasks sum the
vectors, then the products of the centred ones; a row of the covariance is added up in one
stream in the order of the parts. What reaches the driver is one matrix of the dimension,
whose leading eigenpairs come from ``eigen``; they are broadcast and rows are projected
where they are read.

Centring is exact: with S = q*n + r, x - S/n is the integer x - q less r/n.

Defined results: a vector that is null, empty, or holds a null, NaN or infinite entry is
left out, and so is one whose length is not the commonest (of equally common ones the
greatest counts). A null id keeps its rows; rows that repeat are returned as often. Values
beyond 64 bits are cut to them, and a ``deviation`` that does not fit is null. A component
along which the fit does not vary (a single vector, more components than independent
directions) has a null ``whitened``, is explained by 0 and takes no part in
``identity_error``, which is null when nothing varies. Components of tied eigenvalues are
some orthogonal ones. An empty table gives no rows. Other columns are ignored, whatever
they are called. Vectors of d entries need memory for d*d numbers in each task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikisift.llm.eigen import leading_eigenpairs
from wikisift.sources.tables import materialize

_SLICE_ENTRIES = 1 << 19
_LARGEST = np.nextafter(2.0**63, 0)
_WIDTHS = [np.dtype("<i1"), np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8")]


@dataclass
class Whitening:
    """``x - quotient - remainder/n`` is a centred vector; components are the columns of ``vectors``."""

    scale: float
    n: int
    quotient: np.ndarray
    remainder: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def size(self) -> int:
        return len(self.quotient)

    def _shifted(self, x: np.ndarray) -> np.ndarray:
        """x - q; as Python integers where 64 bits might not hold it."""
        if x.size and max(int(x.max()), -int(x.min()), int(np.abs(self.quotient).max())) >= 1 << 62:
            x = x.astype(object)
        return x - self.quotient

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self._shifted(x).astype(np.float64) - self.remainder / max(self.n, 1)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column per component, NaN where the fit does not vary."""
        with np.errstate(divide="ignore", invalid="ignore"):
            by = np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)
        return (self.centred(x) @ self.vectors) * by

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over the entries of (n*x - S)^2, as n^2*sum(u^2) - 2n*sum(u*r) + sum(r^2) with u = x - q."""
        u, r, n = self._shifted(x), self.remainder, self.n
        most = int(np.abs(u).max()) if u.size else 0
        if most * max(most, n) * max(self.size, 1) >= 1 << 62:
            u, r = u.astype(object), r.astype(object)
        squares, mixed, own = (u * u).sum(axis=1).tolist(), (u * r).sum(axis=1).tolist(), sum(int(v) ** 2 for v in r)
        sums = [n * n * a - 2 * n * b + own for a, b in zip(squares, mixed)]
        return [s if s < 1 << 63 else None for s in sums]


def _fixed_points(column: pa.Array, scale: float):
    """Groups ``(rows, x)`` of the usable vectors of a batch, one group for each length, in slices of bounded size."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    values = column.flatten()
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        step = max(_SLICE_ENTRIES // length, 1)
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            if some[-1] - some[0] + 1 == len(some):
                part = values.slice(ends[some[0]] - length, len(some) * length)
            else:
                part = values.take(pa.array(((ends[some] - length)[:, None] + np.arange(length)).reshape(-1)))
            c = part.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(some), length)
            fine = np.isfinite(c).all(axis=1)  # a null entry is NaN here
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(scale * c[fine]), -(2.0**63), _LARGEST).astype(np.int64)
            yield some[fine], x


def _packed(x: np.ndarray) -> list[bytes]:
    """The bytes of each vector, in the least width that holds all its entries."""
    low, high = x.min(axis=1), x.max(axis=1)
    width = sum(((low < np.iinfo(w).min) | (high > np.iinfo(w).max)).astype(np.int64) for w in _WIDTHS[:-1])
    out: list[bytes] = [b""] * len(x)
    for k in np.unique(width).tolist():
        at = np.flatnonzero(width == k)
        data, step = x[at].astype(_WIDTHS[k]).tobytes(), x.shape[1] * _WIDTHS[k].itemsize
        for j, row in enumerate(at.tolist()):
            out[row] = data[j * step : (j + 1) * step]
    return out


def _unpacked(column: pa.Array, size: int):
    """Slices of the vectors of a column of ``_packed`` bytes as 64-bit integers, in the order of their widths."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data, widths = column.buffers()[2], np.diff(offsets) // size
    step = max(_SLICE_ENTRIES // size, 1)
    for kind in _WIDTHS:
        rows = np.flatnonzero(widths == kind.itemsize)
        for i in range(0, len(rows), step):
            parts = [np.frombuffer(data, kind, size, int(offsets[r])) for r in rows[i : i + step].tolist()]
            yield np.stack(parts).astype(np.int64)


def fit_list(df: DataFrame, vector: str, scale: float) -> DataFrame:
    """``(d, x, copies)``: each distinct usable vector once, its length, and how many rows have it."""

    def run(batches):
        for b in batches:
            for _, x in _fixed_points(b.column(0), scale):
                if not len(x):
                    continue
                held: dict[bytes, int] = {}
                for one in _packed(x):
                    held[one] = held.get(one, 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(held), x.shape[1], np.int32)), pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                    names=["d", "x", "copies"],
                )

    found = df.select(F.col(vector).alias("vector")).mapInArrow(run, "d int, x binary, copies bigint")
    return found.groupBy("d", "x").agg(F.sum("copies").alias("copies"))


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each entry; halves of the numbers are added so that nothing overflows."""

    def run(batches):
        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            for x in _unpacked(b.column(0), size):
                n += len(x)
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, size, dtype=np.int32)), pa.array(np.append(n, high)), pa.array(np.append(0, low))], names=["i", "high", "low"]
        )

    parts = fit.select("x").mapInArrow(run, "i int, high bigint, low bigint")
    wide = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]
    total = {r["i"]: (int(r["high"]), int(r["low"])) for r in parts.groupBy("i").agg(*wide).collect()}
    return total[-1][0], [(total[i][0] << 32) + total[i][1] for i in range(size)]


def _covariance(fit: DataFrame, model: Whitening) -> np.ndarray:
    """Covariance of the fit list, centred before multiplying, divisor n."""
    shared, size = fit.sparkSession.sparkContext.broadcast(model), model.size

    def products(batches):
        total = np.zeros((size, size))
        for b in batches:
            for x in _unpacked(b.column(0), size):
                z = shared.value.centred(x)
                total += z.T @ z
        part = TaskContext.get().partitionId()
        for i in range(0, size, 64):
            rows = range(i, min(i + 64, size))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array(list(total[i : i + 64]), pa.list_(pa.float64()))],
                names=["i", "part", "row"],
            )

    def added(batches):
        at, total = None, None
        for b in batches:
            for i, row in zip(b.column(0).to_pylist(), b.column(2)):
                row = row.values.to_numpy()
                if i == at:
                    total = total + row
                    continue
                if at is not None:
                    yield one(at, total)
                at, total = i, row
        if at is not None:
            yield one(at, total)

    def one(i, row):
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row], pa.list_(pa.float64()))], names=["i", "row"])

    parts = fit.select("x").mapInArrow(products, "i int, part int, row array<double>")
    rows = parts.repartition("i").sortWithinPartitions("i", "part").mapInArrow(added, "i int, row array<double>").collect()
    matrix = np.zeros((size, size))
    for r in rows:
        matrix[r["i"]] = r["row"]
    return (matrix + matrix.T) / (2 * model.n)


def _identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list, less the identity."""
    live = np.flatnonzero(model.values > 0)
    if not len(live):
        return None
    shared, size, k = fit.sparkSession.sparkContext.broadcast(model), model.size, len(live)

    def run(batches):
        total, mean = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            for x in _unpacked(b.column(0), size):
                w = shared.value.whitened(x)[:, live]
                total += w.T @ w
                mean += w.sum(axis=0)
        flat = np.append(total.reshape(-1), mean)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "v"])

    sums = {r["i"]: r["v"] for r in fit.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    flat = np.array([sums[i] for i in range(k * k + k)]) / model.n
    moment, mean = flat[: k * k].reshape(k, k), flat[k * k :]
    return float(np.abs(moment - np.outer(mean, mean) - np.eye(k)).max())


def fit_whitening(df: DataFrame, vector: str = "embedding", components: int = 4, scale: float = 256.0) -> Whitening | None:
    """Learn the whitening from all rows of ``df``; None when no row has a usable vector."""
    fit = materialize(fit_list(df, vector, scale), "fit-list")
    common = fit.groupBy("d").agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    if common is None:
        return None
    size = common["d"]
    fit = fit.where(F.col("d") == size)
    n, sums = _sums(fit, size)
    model = Whitening(
        scale, n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64), np.zeros(0), np.zeros((size, 0)), np.zeros(0)
    )
    matrix = _covariance(fit, model)
    values, vectors = leading_eigenpairs(matrix, components)
    noise = 4 * size * np.finfo(np.float64).eps * (values[0] if len(values) else 0.0)
    model.values, model.vectors = np.where(values > noise, values, 0.0), vectors
    trace = np.trace(matrix)
    model.explained = model.values / trace if trace > 0 else np.zeros(len(values))
    model.identity_error = _identity_error(fit, model)
    return model


def whiten(df: DataFrame, model: Whitening | None, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """``keep`` columns, component, n, deviation, whitened, explained and identity_error of each usable row and component."""
    rows = df.select(*keep, F.col(vector).alias("_vector"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    names = [*keep, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            for at, x in _fixed_points(b.column(b.num_columns - 1), model.scale) if model else ():
                if x.shape[1] != model.size or not len(x):
                    continue
                k = len(model.values)
                own, component = pa.array(np.repeat(at, k)), np.tile(np.arange(k), len(at))
                whitened = model.whitened(x).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.take(own) for c in b.columns[:-1]), pa.array((component + 1).astype(np.int32)), pa.array(np.full(len(own), model.n)),
                        pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                        pa.array(whitened, mask=np.isnan(whitened)), pa.array(model.explained[component]),
                        pa.array([model.identity_error] * len(own), pa.float64()),
                    ],
                    names=names,
                )

    return rows.mapInArrow(run, f"{kept}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def op13_whitening(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(rows, fit_whitening(rows))
