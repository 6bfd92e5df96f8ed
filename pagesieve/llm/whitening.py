"""Embedding whitening: principal components of a distributed covariance, refined from float32 to double precision.

Entries become whole numbers, so counts, sums and co-moments are exact integers whatever the partitioning. The covariance is of the
size of the dimensions squared; its float32 eigenvectors are corrected by the matrix-multiplication iterations of Ogita and Aishima
in extended precision. Eigenvalues too close to be told apart at a step are solved again within their shifted subspace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.session import cut_lineage

COMPONENTS = 8
#: An entry c becomes floor(SCALE * c) + OFFSET; beyond this magnitude it counts as not finite.
SCALE, OFFSET, LARGEST = 1024, 100_000, 2.0**40
#: Steps after which the refinement stops; each about doubles the number of right digits.
MAX_STEPS = 30
#: The precision in which eigenvectors are corrected, beyond the double in which they are used.
High = np.longdouble

MOMENTS = "i int, j int, total decimal(38,0)"


def usable(vector: str) -> Column:
    """Not null, not empty, no null or non-finite entry and none beyond ``LARGEST``."""
    fine = F.forall(vector, lambda e: F.coalesce(F.abs(e.cast("double")) < F.lit(LARGEST), F.lit(False)) & ~F.isnan(e.cast("double")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & fine


def whole(vector: str) -> Column:
    return F.transform(vector, lambda e: F.floor(e.cast("double") * F.lit(float(SCALE))).cast("long") + F.lit(OFFSET).cast("long"))


def matrix_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def exact(values: np.ndarray) -> list:
    from decimal import Decimal

    return [Decimal(int(v)) for v in values.ravel()]


def moment_sums(dims: int, middle: list[int] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each task's exact sums: of every dimension (j = -1), or, about ``middle``, of the products of every two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims,) if middle is None else (dims, dims), object)
        rows = 0
        for batch in batches:
            x = matrix_of(batch, dims)
            rows += len(x)
            for start in range(0, len(x), 1024):
                part = x[start : start + 1024]
                if middle is None:
                    total += part.sum(axis=0).astype(object)
                else:
                    y = part - np.array(middle, np.int64)
                    most = int(np.abs(y).max())
                    # products of small numbers are whole in doubles too; larger ones are multiplied as they are, however large
                    whole_in_doubles = most * most * len(y) < 1 << 53
                    y = y.astype(np.float64) if whole_in_doubles else y.astype(object)
                    product = y.T @ y
                    total += (product.astype(np.int64) if whole_in_doubles else product).astype(object)
        if rows:
            i, j = (np.arange(dims), np.full(dims, -1)) if middle is None else np.triu_indices(dims)
            sums = total if middle is None else total[i, j]
            columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(exact(sums), pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "total"])

    return run


def gathered(moments: DataFrame) -> dict[tuple[int, int], int]:
    """The sums over all tasks: one number for each entry of the model, whatever the number of rows."""
    return {(r.i, r.j): int(r.total) for r in moments.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}


def clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Runs of two or more sorted eigenvalues whose neighbours lie within ``near``."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def orthonormal(x: np.ndarray) -> np.ndarray:
    """The nearest orthonormal columns, for columns that are nearly so."""
    for _ in range(3):
        x = x @ (1.5 * np.eye(x.shape[1], dtype=High) - 0.5 * (x.T @ x))
    return x


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step: eigenvalues, corrected eigenvectors, and how close two eigenvalues may be before they count as clustered."""
    r = np.eye(len(a), dtype=High) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # so that the correction of a close pair turns it and does not skew it
    values = np.diag(s) / (1 - np.diag(r))
    size = np.abs(a).sum(axis=0).max()
    near = float(2 * (np.linalg.norm((s - np.diag(values)).astype(float)) + size * np.linalg.norm(r.astype(float))))
    gaps = values[None, :] - values[:, None]
    apart = np.abs(gaps) > near
    correction = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1), r / 2)
    return values, x + x @ correction, near


def eigenpairs(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues, falling, and unit eigenvectors of a symmetric matrix, to double precision; the largest entry of each is positive.

    Starts from float32 eigenvectors. After each step, eigenvalues within the step's error of one another are taken together: the
    matrix, less their mean, is solved within their subspace, where their differences are no longer small against what is solved.
    Exactly equal eigenvalues get some orthonormal basis of theirs.
    """
    a = np.asarray(covariance, High)
    size = float(np.abs(a).max()) if a.size else 0.0
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / High(size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(High)
    last = np.inf
    for _ in range(MAX_STEPS):
        values, x, near = refine(a, x)
        for run in clusters(values, near):
            basis = orthonormal(x[:, run])
            middle = values[run].mean()
            inner = basis.T @ (a @ basis - middle * basis)
            inner = (inner + inner.T) / 2
            scale = np.abs(inner).max()
            if scale:
                x[:, run] = basis @ np.linalg.eigh((inner / scale).astype(np.float64))[1].astype(High)
        if near >= last / 2 and near < 1e-14 * len(a):
            break
        last = near
    x = x / np.sqrt((x * x).sum(axis=0))
    values = np.diag(x.T @ (a @ x)) * High(size)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])
    return values[order].astype(np.float64), x.astype(np.float64)


def project(n: int, sums: list[int], components: np.ndarray, roots: list[float | None], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(id, deviation, whitened)`` of every row; ``most`` bounds any |n*x - S|."""
    dims = len(sums)
    fits = dims * most * most < 1 << 63
    large = max([n, *map(abs, sums)]) * (int(LARGEST) * SCALE + OFFSET) >= 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch, dims)
            # n*x - S is whole and as exact as the numbers are kept: in 64 bits where they fit, else in numbers of any length
            if fits and most < 1 << 31 or not large and fits:
                centred = x * np.int64(n) - np.array(sums, np.int64)
                deviation = (centred * centred).sum(axis=1).tolist()
            else:
                centred = x.astype(object) * n - np.array(sums, object)
                deviation = [d if d < 1 << 63 else None for d in (centred * centred).sum(axis=1)]
            scores = (centred / n).astype(np.float64) @ components
            columns = [[None] * len(x) if root is None else (scores[:, k] / root).tolist() for k, root in enumerate(roots)]
            whitened = pa.array(list(map(list, zip(*columns))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(deviation, pa.int64()), whitened], ["id", "deviation", "whitened"])

    return run


def identity_error(rows: DataFrame, n: int, used: list[int]) -> float | None:
    """The largest entry of the covariance of the whitened rows less the identity, measured over all of them."""
    if not used:
        return None
    value = {k: F.element_at("whitened", k + 1) for k in used}
    means = rows.agg(*[F.avg(value[k]).alias(f"m{k}") for k in used]).first()
    pairs = [(a, b) for a in used for b in used if a <= b]
    products = [F.sum((value[a] - F.lit(means[f"m{a}"])) * (value[b] - F.lit(means[f"m{b}"]))).alias(f"c{a}_{b}") for a, b in pairs]
    sums = rows.agg(*products).first()
    return max(abs(sums[f"c{a}_{b}"] / n - (a == b)) for a, b in pairs)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for every usable row and component.

    Rows whose vector is null, empty or holds null or non-finite entries (or such beyond 2^40) go; of the others, those not of the
    most frequent length (of the longer, if two are as frequent). What stays is the fit list, repeated rows and null ids included.
    Components are numbered from 1 by falling eigenvalue, at most as many as there are dimensions. One without variance, as of a
    single row or of equal rows, has null ``whitened``; ``explained`` is null if nothing varies and ``identity_error`` if no
    component is usable. ``deviation`` is null where it exceeds a long. No usable rows give no rows; other columns are ignored. A
    covariance, of the size of the dimensions squared, is all that the driver gathers.
    """
    fit = cut_lineage(vectors.where(usable(vector)).select(F.col(vec_id).alias("id"), whole(vector).alias("x")))
    lengths = fit.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    kind = vectors.schema[vec_id].dataType.simpleString()
    out = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return fit.sparkSession.createDataFrame([], out)
    dims, n = lengths.dims, lengths.n
    fit = fit.where(F.size("x") == dims)
    by_dim = gathered(fit.mapInArrow(moment_sums(dims), MOMENTS))
    sums = [by_dim[i, -1] for i in range(dims)]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    products = gathered(fit.mapInArrow(moment_sums(dims, middle), MOMENTS))
    # centred on whole numbers next to the means; what each is off by, half a unit at most, comes off exactly
    rest = [Fraction(s, n) - m for s, m in zip(sums, middle)]
    exactly = [[Fraction(products[min(i, j), max(i, j)], n) - rest[i] * rest[j] for j in range(dims)] for i in range(dims)]
    covariance = np.array([[High(c.numerator // c.denominator) + High(float(c - c.numerator // c.denominator)) for c in row] for row in exactly], High)
    values, axes = eigenpairs(covariance)
    trace = float(sum(exactly[i][i] for i in range(dims)))
    count = min(components, dims)
    floor = max(float(values[0]), 0.0) * dims * np.finfo(np.float64).eps
    roots = [float(np.sqrt(v)) if v > floor else None for v in values[:count]]
    spread = fit.agg(F.max(F.array_max("x")).alias("high"), F.min(F.array_min("x")).alias("low")).first()
    most = max(max(abs(n * spread.high - s), abs(n * spread.low - s)) for s in sums)
    task = project(n, sums, np.ascontiguousarray(axes[:, :count]), roots, most)
    rows = cut_lineage(fit.mapInArrow(task, f"id {kind}, deviation long, whitened array<double>"))
    error = identity_error(rows, n, [k for k, root in enumerate(roots) if root is not None])
    explained = F.array(*[F.lit(float(v) / trace if trace else None).cast("double") for v in values[:count]])
    return rows.select("id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        F.col("id").alias("vec_id"), (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
