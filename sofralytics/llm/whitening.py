"""Whitening of embeddings by a matrix-free block Jacobi-Davidson eigensolver.

Entries are put on a lattice, x = floor(64 c) + 1,000,000, and each distinct vector counts once (the fit list).  The
covariance V of the fit list is never built: the solver only asks for products V W with a few columns W.  Each product is
one Spark job over the written fit list; a task centres its rows, multiplies and returns one partial sum, and sums are
added by an aggregation.  Sums of x are exact integers, and rows are centred exactly before anything is multiplied.

The solver works on the wanted pairs and a few guards as a block.  A correction equation

    (I - Q Q') (V - theta I) (I - Q Q') t = -r,     t orthogonal to Q (all pairs locked or in the block),

is solved for each pair not yet converged by a few steps of MINRES; the equations advance together, so that one job
serves a step of all of them.  The corrections widen the search space, a Rayleigh-Ritz step in it gives the next pairs,
and pairs whose residual is down to rounding are locked from the largest on.  Only vectors of the embeddings' dimension
are held by the driver, never rows.

Rows are dropped whose vector is null, holds null or non-finite entries or entries beyond the lattice's range (2^50 / 64
in size), or has another length than most distinct vectors.  Directions without variance are no components; equal
vectors, an empty table and a table of one vector give none.  Repeated rows and null ids are kept; extra columns pass
through, and ``deviation`` and ``whitened`` are replaced.  Deviations beyond 64 bits are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sofralytics.llm.common import arrow_rows, fresh, saved

SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 50)
GUARDS, INNER, WIDEST, OUTER = 4, 5, 5, 100  # guard pairs; MINRES steps; search space in blocks; rounds at most
ROWS = 4096
_EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: ``vectors`` (dimension x components), their ``values``, and the fit list's exact moments."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    residuals: np.ndarray
    products: int

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]


def lattice(vector: Column) -> Column:
    """The lattice vector (array<bigint>) of an embedding; null where it has none."""
    scaled = F.transform(vector, lambda c: c.cast("double") * SCALE)
    usable = F.forall(scaled, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return F.when(usable, F.transform(scaled, lambda c: F.floor(c).cast("bigint") + SHIFT))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


class FitList:
    """The written fit list and its distributed sums."""

    def __init__(self, rows: DataFrame, vector: str):
        found = rows.select(lattice(F.col(vector)).alias("x")).where("x IS NOT NULL").distinct()
        found = saved(found, "fit_list")
        sizes = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
        self.size, self.n = (sizes["d"], sizes["count"]) if sizes else (0, 0)
        self.rows = found.where(F.size("x") == self.size)
        self.products = 0
        self.sums: tuple[int, ...] = ()
        if self.n and self.size:
            self.sums = tuple(int(s) for s in self._added(_whole_sums(self.size), "decimal(38,0)", self.size))

    def _added(self, run, kind: str, cells: int) -> list:
        """The sums over all tasks of the values that ``run`` yields for each cell."""
        with arrow_rows(self.rows.sparkSession, ROWS):
            found = self.rows.mapInArrow(run, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        out = [0] * cells
        for r in found:  # dimension x block cells at most
            out[r["cell"]] = r["value"]
        return out

    def _moments(self, step: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """The sum over all rows of ``step`` of their centred matrix."""
        size, centre = self.size, centred(self.n, self.sums)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                total += step(centre(matrix(batch.column(0), size)))
            cells = np.arange(total.size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel())], names=["cell", "value"])

        return np.array(self._added(run, "double", shape[0] * shape[1])).reshape(shape)

    def product(self, block: np.ndarray) -> np.ndarray:
        """V times the block's columns."""
        self.products += 1
        block = np.ascontiguousarray(block)
        return self._moments(lambda rows: rows.T @ (rows @ block), block.shape) / self.n

    def trace(self) -> float:
        return float(self._moments(lambda rows: np.array([[np.sum(rows * rows)]]), (1, 1))[0, 0]) / self.n

    def identity_error(self, transform: np.ndarray) -> float:
        """The largest entry of the whitened rows' covariance less the identity."""
        k = transform.shape[1]

        def step(rows: np.ndarray) -> np.ndarray:
            white = rows @ transform
            return np.vstack([white.T @ white, white.sum(axis=0)])

        found = self._moments(step, (k + 1, k)) / self.n
        return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


def _whole_sums(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for batch in batches:  # ROWS vectors of entries below 2^51 stay below 2^63
            total = [a + int(b) for a, b in zip(total, matrix(batch.column(0), size).sum(axis=0), strict=True)]
        values = pa.array(total, pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), values], names=["cell", "value"])

    return run


def centred(n: int, sums: tuple[int, ...]) -> Callable[[np.ndarray], np.ndarray]:
    """Rows less their mean: whole parts are taken off as integers, the mean's fraction (exact to rounding) after."""
    base = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return lambda rows: (rows - base).astype(np.float64) - rest


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, one a column, that advance together; ``apply`` takes all columns."""
    found = np.zeros_like(right)
    older, old = np.zeros_like(right), np.zeros_like(right)  # directions
    beta = np.linalg.norm(right, axis=0)
    start, eta = beta.copy(), beta.copy()
    before, now = np.zeros_like(right), _ratio(right, beta)
    beta = np.zeros_like(beta)
    c_old, c, s_old, s = np.ones_like(eta), np.ones_like(eta), np.zeros_like(eta), np.zeros_like(eta)
    for _ in range(steps):
        if np.all(np.abs(eta) <= tolerance * start):
            break
        image = apply(now)
        alpha = np.sum(now * image, axis=0)
        image = image - alpha * now - beta * before
        following = np.linalg.norm(image, axis=0)
        first = c * alpha - c_old * s * beta
        length = np.hypot(first, following)
        second, third = s * alpha + c_old * c * beta, s_old * beta
        c_old, s_old = c, s
        c, s = _ratio(first, length), _ratio(following, length)
        older, old = old, _ratio(now - third * older - second * old, length)
        found += c * eta * old
        eta = -s * eta
        before, now, beta = now, _ratio(image, following), following
    return found


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.broadcast_shapes(a.shape, b.shape)), where=b != 0)


def _against(columns: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns add to the bases; columns that add nothing are left out."""
    for _ in range(3):
        for basis in bases:
            columns = columns - basis @ (basis.T @ columns)
        size = np.linalg.norm(columns, axis=0)
        columns = columns[:, size > 1e-12] / size[size > 1e-12]
        if not columns.shape[1]:
            return columns
        left, values, _ = np.linalg.svd(columns, full_matrices=False)
        columns = left[:, values > 1e-6 * values[0]]
    return columns


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residuals) of the ``wanted`` largest eigenpairs of a positive semidefinite matrix.

    A residual counts as rounding at 8 sqrt(size) eps times the largest value.
    """
    wanted = min(wanted, size)
    block = min(size, wanted + GUARDS)
    random = np.random.default_rng(seed)
    locked, locked_values, locked_residuals = np.empty((size, 0)), np.empty(0), np.empty(0)
    space = np.linalg.qr(random.standard_normal((size, block)))[0]
    image = product(space)
    largest = 0.0
    for _ in range(OUTER):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn  # Ritz vectors, largest first
        largest = max(largest, float(theta[0])) if len(theta) else largest
        residual = image - theta * space
        residual -= locked @ (locked.T @ residual)
        sizes = np.linalg.norm(residual, axis=0)
        limit = 8 * np.sqrt(size) * _EPS * largest
        whole = space.shape[1] + locked.shape[1] == size  # nothing is left to search
        missing = wanted - locked.shape[1]
        done = 0
        while done < min(missing, space.shape[1]) and (sizes[done] <= limit or (whole and sizes[done] <= 1e3 * limit)):
            done += 1
        locked = np.hstack([locked, space[:, :done]])
        locked_values, locked_residuals = np.append(locked_values, theta[:done]), np.append(locked_residuals, sizes[:done])
        space, image, theta, residual, sizes = space[:, done:], image[:, done:], theta[done:], residual[:, done:], sizes[done:]
        missing -= done
        if not missing:
            order = np.argsort(-locked_values, kind="stable")
            return locked_values[order], locked[:, order], locked_residuals[order]
        active = min(missing + GUARDS, space.shape[1])
        if space.shape[1] > (WIDEST - 1) * block:  # restart from the best half
            space, image = space[:, : 2 * block], image[:, : 2 * block]
        apart = np.hstack([locked, space[:, :active]])
        open_ = np.flatnonzero(sizes[:active] > limit)

        def project(columns: np.ndarray, apart: np.ndarray = apart) -> np.ndarray:
            return columns - apart @ (apart.T @ columns)

        shift = theta[open_]
        wider = minres(lambda t, shift=shift, project=project: project(product(t) - shift * t), -project(residual[:, open_]), INNER, 1e-3)
        wider = _against(wider, locked, space)
        if not wider.shape[1]:  # the corrections lie in the space already: images have gathered rounding
            image = product(space)
            continue
        space, image = np.hstack([space, wider]), np.hstack([image, product(wider)])
    raise RuntimeError(f"no convergence after {OUTER} rounds: residuals {sizes[:missing]}")


def fit(rows: DataFrame, vector: str, components: int = 16) -> Whitening:
    """The whitening of the distinct lattice vectors of a column of embeddings."""
    fit_list = FitList(rows, vector)
    empty = np.empty(0)
    trace = fit_list.trace() if fit_list.n and fit_list.size else 0.0
    if not trace:
        return Whitening(fit_list.n, fit_list.sums, empty, np.empty((fit_list.size, 0)), 0.0, 0.0, empty, 0)
    values, vectors, residuals = jacobi_davidson(fit_list.product, fit_list.size, components)
    held = values > 16 * fit_list.size * _EPS * values[0]
    values, vectors, residuals = values[held], vectors[:, held], residuals[held]
    error = fit_list.identity_error(vectors / np.sqrt(values))
    return Whitening(fit_list.n, fit_list.sums, values, vectors, trace, error, residuals, fit_list.products)


def deviations(rows: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """The exact sums of (n x - S)^2; null beyond 64 bits."""
    mean = [s // n for s in sums]
    apart = rows - np.array(mean, dtype=np.int64)
    rest = np.array([s - n * m for s, m in zip(sums, mean, strict=True)], dtype=np.int64)  # from 0 to n - 1
    bound = n * (int(np.abs(apart).max(initial=0)) + 1)
    if bound * bound * max(len(sums), 1) < 1 << 63:
        return ((n * apart - rest) ** 2).sum(axis=1).tolist()
    exact = (n * apart.astype(object) - rest.astype(object)) ** 2
    return [v if v < 1 << 63 else None for v in exact.sum(axis=1)]


def whitened(rows: DataFrame, vector: str, model: Whitening) -> DataFrame:
    """The usable rows with ``deviation`` (bigint) and ``whitened`` (array<double>, one entry a component)."""
    size, n, sums = len(model.sums), model.n, model.sums
    transform = model.vectors / np.sqrt(model.values)

    @F.pandas_udf("deviation bigint, whitened array<double>")
    def project(x):
        import pandas as pd

        if not len(x):
            return pd.DataFrame({"deviation": pd.Series(dtype="Int64"), "whitened": pd.Series(dtype=object)})
        held = np.stack(x.to_numpy())
        white = centred(n, sums)(held) @ transform
        return pd.DataFrame({"deviation": pd.array(deviations(held, n, sums), dtype="Int64"), "whitened": list(white)})

    x, both = fresh(rows, "_x"), fresh(rows, "_both")
    own = [c for c in rows.columns if c not in ("deviation", "whitened")]
    usable = rows.withColumn(x, lattice(F.col(vector))).where(F.col(x).isNotNull() & (F.size(x) == size) & F.lit(n > 0))
    # not evaluated again by filters that Spark derives from the result
    return usable.withColumn(both, project.asNondeterministic()(x)).select(*own, f"{both}.deviation", f"{both}.whitened")
