"""Embedding whitening: a centred scatter summed over partitions, cyclic Jacobi on the driver, the whitening matrix broadcast."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stage

EPS = float(np.finfo(np.float64).eps)
#: Lattice points stay within this distance of the offset, so that sums of a batch fit 64 bits.
REACH = 1 << 40


@dataclass(frozen=True)
class Lattice:
    """Entries c become whole numbers floor(scale * c) + offset, whose sums don't depend on their order."""

    scale: float = 64.0
    offset: int = 1_000_000

    def points(self, values: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(self.scale * values), -REACH, REACH).astype(np.int64) + self.offset


@dataclass(frozen=True)
class Whitening:
    """A fit: n vectors of `width` whole numbers with sums per dimension, components by falling eigenvalue.

    `matrix` (width x components) takes a centred vector to whitened coordinates; its columns are zero where the eigenvalue is numerically zero.
    """

    lattice: Lattice
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    matrix: np.ndarray
    explained: np.ndarray

    @property
    def width(self) -> int:
        return len(self.sums)


def jacobi_eigen(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns, the largest loading positive) of a symmetric matrix by cyclic Jacobi rotations.

    Each sweep meets every pair of dimensions once, in rounds of disjoint pairs as in a round-robin tournament, and ends once
    |a_pq| <= eps sqrt(a_pp a_qq) for all pairs, the test that leaves small eigenvalues of a positive matrix accurate.
    """
    a = (np.asarray(a, np.float64) + np.asarray(a, np.float64).T) / 2
    d = len(a)
    v = np.eye(d)
    seats = [*range(d), *([-1] if d % 2 else [])]
    floor = EPS * EPS * max(float(np.abs(np.diag(a)).sum()), np.finfo(np.float64).tiny)

    def standing(p, q):
        x = np.abs(a[p, q])
        return (x > EPS * np.sqrt(np.abs(a[p, p] * a[q, q]))) & (x > floor)

    upper = np.triu_indices(d, 1)
    for _ in range(sweeps):
        if not standing(*upper).any():
            break
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(min(x), max(x)) for x in zip(seats[:half], seats[: half - 1 : -1]) if -1 not in x]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            p, q = (np.array(x, np.int64) for x in zip(*pairs))
            turn = standing(p, q)
            p, q = p[turn], q[turn]
            if not len(p):
                continue
            with np.errstate(over="ignore"):
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            for m in (a, a.T, v.T):  # rows, columns, and the columns of v
                x, y = m[p].copy(), m[q].copy()
                m[p], m[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
            a[p, q] = a[q, p] = 0.0
    else:
        raise ArithmeticError("Jacobi rotations did not settle")
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    values, v = values[order], v[:, order]
    return values, v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)


def finite_rows(column: pa.Array, width: int | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places, values) of the vectors of a batch that are not null and hold finite entries alone, for each width or the one asked for."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (lengths > 0) & (bad[starts[1:]] == bad[starts[:-1]])
    out = []
    for w in np.unique(lengths[good]).tolist() if width is None else [width]:
        places = np.flatnonzero(good & (lengths == w))
        out.append((w, places, values[starts[places][:, None] + np.arange(w)]))
    return out


def lattice_sums(vectors: DataFrame, vector: str, lattice: Lattice) -> tuple[int, list[int]]:
    """n and the exact sums per dimension over the vectors of the commonest width, the widest of equals; (0, []) for none."""

    def add(batches):
        for b in batches:
            for w, places, values in finite_rows(b[vector]):
                yield {"width": [w] * (w + 1), "i": list(range(-1, w)), "v": [len(places), *lattice.points(values).sum(axis=0).tolist()]}

    sums = arrow_map(vectors.select(vector), add, "width int, i int, v long").groupBy("width", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    sums = stage(sums, "sums")
    top = sums.filter("i = -1").orderBy(F.desc("v"), F.desc("width")).limit(1).collect()
    if not top:
        return 0, []
    rows = sums.filter(F.col("width") == top[0]["width"]).collect()  # a row for each dimension
    found = {r["i"]: int(r["v"]) for r in rows}
    return found[-1], [found[i] for i in range(top[0]["width"])]


def deviations(points: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, in 64 bits, where steps that pass them cancel out."""
    with np.errstate(over="ignore"):
        return points * np.int64(n) - sums


def _wrapped(sums) -> np.ndarray:
    return np.array([(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in sums], np.int64)


def scatter(rows: DataFrame, vector: str, width: int, to: int, coordinates) -> np.ndarray:
    """Sums over all rows of z and of z z^T (the last row and column hold those of z), z being `to` centred coordinates of a row.

    Tasks add up products of whole batches; the driver gets one number for each pair of coordinates.
    """

    def multiply(batches):
        total = np.zeros((to + 1, to + 1))
        for b in batches:
            for _, _, values in finite_rows(b[vector], width):
                z = coordinates(values)
                total[:to, :to] += z.T @ z
                total[to, :to] += z.sum(axis=0)
        i, j = np.tril_indices(to + 1)
        yield {"i": i.tolist(), "j": j.tolist(), "v": total[i, j].tolist()}

    sums = arrow_map(rows.select(vector), multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((to + 1, to + 1))
    for i, j, v in sums:
        total[i, j] = total[j, i] = v
    return total


def fit_whitening(vectors: DataFrame, vector: str = "embedding", components: int | None = None, lattice: Lattice = Lattice()) -> Whitening | None:
    """The whitening of all rows whose vector isn't null and holds finite entries alone; None where there is no such row.

    Of vectors of several widths those of the commonest count. Entries beyond 2^40 lattice steps of zero are held there.
    Repeated rows count as often as they stand. Other columns are ignored.
    """
    n, sums = lattice_sums(vectors, vector, lattice)
    if not n:
        return None
    wrapped, width = _wrapped(sums), len(sums)
    total = scatter(vectors, vector, width, width, lambda values: deviations(lattice.points(values), n, wrapped) / n)
    covariance = total[:width, :width] / n
    values, axes = jacobi_eigen(covariance)
    k = width if components is None else min(components, width)
    trace = float(np.trace(covariance))
    stands = values > 16 * width * EPS * max(float(values[0]), 0.0)  # beyond what rounding leaves of a zero
    stands &= values > 0
    matrix = np.where(stands, axes / np.sqrt(np.where(stands, values, 1.0)), 0.0)[:, :k]
    return Whitening(lattice, n, tuple(sums), values[:k], axes[:, :k], matrix, np.maximum(values[:k], 0.0) / trace if trace > 0 else np.zeros(k))


def whiten(vectors: DataFrame, fit: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, deviation, whitened) of the rows that the fit took: the exact sum of (n x - S)^2 and an array of whitened coordinates.

    deviation is null where the sum passes 64 bits; a coordinate is null where the eigenvalue of its component is numerically zero, as for
    a single vector or copies of one.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((fit.n, _wrapped(fit.sums), fit.lattice, fit.matrix))  # as large as the square of the width

    def project(batches):
        n, sums, lattice, matrix = shared.value
        dead = ~matrix.any(axis=0)
        for b in batches:
            for _, places, values in finite_rows(b["vector"], len(sums)):
                u = deviations(lattice.points(values), n, sums)
                about = (u.astype(np.float64) ** 2).sum(axis=1)
                with np.errstate(over="ignore"):
                    exact = (u * u).sum(axis=1)
                w = ((u / n) @ matrix).ravel()
                flat = pa.array(w, mask=np.tile(dead, len(u)) if dead.any() else None)
                offsets = pa.array(np.arange(0, len(w) + 1, matrix.shape[1], dtype=np.int32))
                yield {"key": b["key"].take(pa.array(places)), "deviation": pa.array(exact, mask=about > 9.2e18), "whitened": pa.ListArray.from_arrays(offsets, flat).cast(pa.list_(pa.float64()))}

    kind = vectors.select(key).dtypes[0][1]
    source = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    return arrow_map(source, project, f"key {kind}, deviation long, whitened array<double>").withColumnRenamed("key", key)


def identity_error(vectors: DataFrame, fit: Whitening, vector: str = "embedding") -> float:
    """The largest entry, in absolute value, of the measured covariance of the whitened rows minus the identity; components of no variance are left out."""
    sums, lattice, n = _wrapped(fit.sums), fit.lattice, fit.n
    live = fit.matrix.any(axis=0)
    matrix = fit.matrix[:, live]
    k = matrix.shape[1]
    if not k:
        return 0.0
    total = scatter(vectors, vector, fit.width, k, lambda values: (deviations(lattice.points(values), n, sums) / n) @ matrix)
    mean = total[k, :k] / n
    return float(np.abs(total[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max())


def whitened_components(vectors: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component; none for an empty table."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = fit_whitening(vectors, vector, components)
    if fit is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, fit, vector)
    shares = F.array(*(F.lit(float(x)) for x in fit.explained))
    rows = whiten(vectors, fit, key, vector).select(F.col(key).cast("long").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
