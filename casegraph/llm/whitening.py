"""Whitening of embeddings: a compensated covariance of the distinct vectors, its eigenvectors, the rows projected on them.

The covariance is a sum of outer products of centred rows. A row is centred in double-double (the exact mean as a high
and a low part), cut into slices of so few bits that the products of a batch of rows sum without rounding, and these
error-free products are added to a double-double total, a sum with its error. Tasks hand over the two parts of
each row of their matrix; these are merged in the order of the tasks, parts with parts, so that the result doesn't
depend on who came first. Only the d x d matrix, whose size follows from the vectors' length alone, reaches the driver. There it
is made tridiagonal by reflections and solved by divide and conquer: halves are solved apart, the link between them
is a change of rank one, and the new eigenvalues are the roots of its secular equation.

Entries become integers before (``quantised``), so that equal vectors are exactly equal, and the sums and deviations exact.

Defined results: rows whose vector is null or empty, or holds a null, an entry that isn't finite or one too large for 62 bits, are dropped, as
are those whose vector hasn't the commonest length among distinct vectors (of ties the greatest). A vector counts
once in the fit however often it stands there; each of its rows gets a result, whatever its id, null included. A direction in which
the vectors don't differ (but for rounding) is no component, so one distinct vector, or none, gives an empty table.
A deviation that doesn't fit a long is null. Further columns aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import materialise

#: Rows whose products are summed at once, bits of a slice, slices of a number: 2 * BITS + log2(ROWS) is 53, so the sums are exact.
ROWS, BITS, SLICES = 2048, 21, 5
EPS = float(np.finfo(np.float64).eps)
_PART = pa.schema([("task", pa.int32()), ("i", pa.int32()), ("hi", pa.list_(pa.float64())), ("lo", pa.list_(pa.float64()))])


def quantised(embeddings: DataFrame, vec_col: str = "embedding", scale: float = 64, offset: int = 1_000_000) -> DataFrame:
    """The rows with a sound vector, with ``x``: floor(scale * c) + offset for each of its entries c."""
    c = F.col(vec_col)
    sound = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double") * scale) < 2.0**62))
    return embeddings.where(c.isNotNull() & (F.size(c) > 0) & F.coalesce(sound, F.lit(False))).withColumn("x", F.transform(c, lambda e: F.floor(e.cast("double") * F.lit(float(scale))) + F.lit(offset)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def two_sum(a, b):
    """The rounded sum and its error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a, b):
    """The rounded product and its error, exactly: both factors are split into halves of 26 bits."""
    p = a * b
    (ah, al), (bh, bl) = ((h := (t := 134217729.0 * v) - (t - v), v - h) for v in (a, b))
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x - mean as high and low parts."""
    xh = x.astype(np.float64)
    xl = (x - xh.astype(np.int64)).astype(np.float64)
    s, err = two_sum(xh, -mean[0])
    low = err + (xl - mean[1])
    hi = s + low
    return hi, low - (hi - s)


def add_products(total: tuple[np.ndarray, np.ndarray], hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``total`` (high, low) and the sum of the outer products of at most ROWS rows hi + lo."""
    top = np.abs(hi).max(axis=0)
    exponent = np.frexp(np.where(top > 0, top, 1.0))[1]
    cut, rest = [], hi
    for k in range(SLICES):
        if k == 2:
            rest = rest + lo  # what is left of hi is as small as lo by now
        unit = np.ldexp(1.0, exponent - BITS * (k + 1))
        cut.append(np.rint(rest / unit) * unit)
        rest = rest - cut[-1]
    for order in range(SLICES):
        for i in range(order + 1):
            s, err = two_sum(total[0], cut[i].T @ cut[order - i])
            total = s, total[1] + err
    return two_sum(*total)


def _products(d: int, rows_of):
    """Rows of a task's matrix of summed products; ``rows_of``: (hi, lo) of a batch's integer vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = _matrix(b.column(0), d)
            for at in range(0, len(x), ROWS):
                hi, lo = rows_of(x[at : at + ROWS])
                total = add_products((np.zeros((hi.shape[1],) * 2),) * 2 if total is None else total, hi, lo)
        if total is not None:
            k = len(total[0])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * k, pa.int32()), pa.array(range(k), pa.int32()), *(pa.array(list(m), pa.list_(pa.float64())) for m in total)], schema=_PART)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same number, in the order of their tasks, added up: high parts with their errors, low parts."""
    at, total = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([at], pa.int32()), *(pa.array([m], pa.list_(pa.float64())) for m in total)], schema=_PART)
    for b in batches:
        for i, hi, lo in zip(b.column("i").to_pylist(), b.column("hi"), b.column("lo"), strict=True):
            hi, lo = hi.values.to_numpy(), lo.values.to_numpy()
            if i != at:
                if total:
                    yield row()
                at, total = i, (np.zeros(len(hi)), np.zeros(len(hi)))
            s, err = two_sum(total[0], hi)
            total = two_sum(s, total[1] + (err + lo))
    if total:
        yield row()


def second_moments(fit: DataFrame, d: int, n: int, rows_of) -> np.ndarray:
    """The mean outer product of ``rows_of`` the vectors, rounded once."""
    kind = "task int, i int, hi array<double>, lo array<double>"
    parts = materialise(fit.select("x").mapInArrow(_products(d, rows_of), kind), "products")
    merged = parts.repartition("i").sortWithinPartitions("i", "task").mapInArrow(_merged, kind)
    rows = sorted((r["i"], r["hi"], r["lo"]) for r in merged.toLocalIterator())  # d rows
    hi, lo = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    q = hi / n
    p, err = two_product(q, float(n))
    return q + (((hi - p) - err) + lo) / n


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal q of a symmetric a = q t q' whose largest entry is about 1, by reflections."""
    a = a.copy()
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = math.sqrt(v @ v)
        if length <= EPS * EPS:  # nothing beside an entry of about 1
            a[k + 1 :, k] = 0
            continue
        v[0] += math.copysign(length, v[0])
        v /= math.sqrt(v @ v)
        p = 2 * (a[k + 1 :, k + 1 :] @ v)
        w = p - (v @ p) * v
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * (v @ a[k + 1 :, k]) * v
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def _secular(poles: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Root i of 1 + rho * sum(z**2 / (poles - x)), which lies above pole i, as distances: poles[j] - root i at [j, i], and the roots.

    A root is measured from its nearer pole and halved down in the bits of that distance, so that small distances are exact too."""
    k, w = len(poles), rho * z * z
    gap = np.append(np.diff(poles), w.sum())
    middle = 1 + (w[:, None] / (poles[:, None] - (poles + gap / 2)[None, :])).sum(axis=0)
    right = (middle < 0) & (np.arange(k) < k - 1)
    base = np.where(right, np.append(poles[1:], poles[-1]), poles)
    sign = np.where(right, -1.0, 1.0)
    delta = poles[:, None] - base[None, :]
    low, high = np.zeros(k, dtype=np.int64), np.where(np.arange(k) < k - 1, gap / 2, gap * (1 + 4 * EPS)).view(np.int64)
    for _ in range(64):
        mid = low + (high - low) // 2
        mu = sign * mid.view(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            f = 1 + (w[:, None] / (delta - mu[None, :])).sum(axis=0)
        up = np.where(right, f > 0, f < 0)  # the root is farther from the base
        up |= np.isnan(f)
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    mu = sign * np.maximum(high, 1).view(np.float64)
    return delta - mu[None, :], base + mu


def divide_and_conquer(d: np.ndarray, e: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of the symmetric tridiagonal matrix with diagonal d and off-diagonal e; ``scale``: the largest entry of the whole matrix."""
    n = len(d)
    if n == 1:
        return d.copy(), np.ones((1, 1))
    m, rho, sign = n // 2, abs(e[n // 2 - 1]), math.copysign(1.0, e[n // 2 - 1])
    upper, lower = d[:m].copy(), d[m:].copy()
    upper[-1] -= rho
    lower[0] -= rho
    (w1, q1), (w2, q2) = divide_and_conquer(upper, e[: m - 1], scale), divide_and_conquer(lower, e[m:], scale)
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    poles, z = np.concatenate([w1, w2]), np.concatenate([q1[-1], sign * q2[0]])
    order = np.argsort(poles, kind="stable")
    poles, z, q = poles[order], z[order], q[:, order]
    # deflation: a pole without weight is an eigenvalue, and of two equal poles one loses its weight by a rotation
    small = 8 * EPS * scale
    kept, last = [], None
    for j in range(n):
        if rho * abs(z[j]) <= small:
            continue
        if last is not None:
            r = math.hypot(z[last], z[j])
            c, s = z[j] / r, -z[last] / r
            if abs((poles[j] - poles[last]) * c * s) <= small:
                z[j], z[last] = r, 0.0
                q[:, last], q[:, j] = c * q[:, last] + s * q[:, j], -s * q[:, last] + c * q[:, j]
                poles[last], poles[j] = poles[last] * c * c + poles[j] * s * s, poles[last] * s * s + poles[j] * c * c
                kept.pop()
        kept.append(j)
        last = j
    if kept:
        at = np.array(kept)
        p, zk = poles[at], z[at]
        apart, roots = _secular(p, zk, rho)
        k = len(at)
        # the weights for which the computed roots are exact, so that the vectors are orthogonal
        i, j = np.arange(k)[None, :], np.arange(k)[:, None]
        below = p[:, None] - p[None, :]  # pole j - pole i
        above = np.concatenate([below[:, 1:], np.full((k, 1), -rho)], axis=1)
        ratio = apart / np.where(i < j, below, above)
        exact = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=1))), zk)
        u = exact[:, None] / apart
        u /= np.sqrt((u * u).sum(axis=0))
        q[:, at], poles[at] = q[:, at] @ u, roots
    order = np.argsort(poles, kind="stable")
    return poles[order], q[:, order]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    top = float(np.abs(a).max()) or 1.0
    d, e, q = tridiagonal(a / top)
    values, vectors = divide_and_conquer(d, e, max(float(np.abs(d).max()), float(np.abs(e).max(initial=0.0))))
    return values[::-1] * top, (q @ vectors)[:, ::-1]


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64)
        for b in batches:
            x = _matrix(b.column(0), d)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] * d), pa.array(range(d), pa.int32()), pa.array(high), pa.array(low)], names=["n", "i", "high", "low"])

    return run


def _whitened(d: int, n: int, sums: list[int], mean, weights: np.ndarray, explained: np.ndarray, error: float):
    k = weights.shape[1]

    def deviations(x: np.ndarray) -> pa.Array:
        s = np.array(sums, dtype=object)
        if max(max(int(x.max()), -int(x.min())) * n, *(abs(v) for v in sums)) < 2**62:
            y = n * x - np.array(sums, dtype=np.int64)
            if (float(np.abs(y).max()) ** 2) * d < 2.0**62:
                return pa.array((y * y).sum(axis=1))
        exact = [sum(int(v) ** 2 for v in n * row.astype(object) - s) for row in x]
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x = _matrix(b.column("x"), d)
                hi, lo = centred(x, mean)
                w = hi @ weights + lo @ weights
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, dtype=np.int64)), deviations(x).take(each), pa.array(w.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(embeddings: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64, offset: int = 1_000_000) -> DataFrame:
    """A row for each sound vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    rows = quantised(embeddings.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v")), "v", scale, offset).select("vec_id", "x")
    kind = dict(rows.dtypes)["vec_id"]
    out = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    every = materialise(rows.select("x").distinct(), "vectors")
    length = every.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "d")).alias("most")).select("most.d").first()["d"]
    if length is None:
        return embeddings.sparkSession.createDataFrame([], out)
    d = int(length)
    fit = every.where(F.size("x") == d)
    per = fit.mapInArrow(_sums(d), "n long, i int, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
    at = {r["i"]: r for r in per.toLocalIterator()}  # a row an entry of the vector
    n, sums = at[0]["n"], [(int(at[i]["high"]) << 32) + int(at[i]["low"]) for i in range(d)]
    high = np.array([float(Fraction(s, n)) for s in sums])
    mean = high, np.array([float(Fraction(s, n) - Fraction(h)) for s, h in zip(sums, high.tolist(), strict=True)])
    cov = second_moments(fit, d, n, lambda x: centred(x, mean))
    values, vectors = eigen(cov)
    trace = float(np.trace(cov))
    k = int((values[:components] > d * EPS * trace).sum())
    if not k:
        return embeddings.sparkSession.createDataFrame([], out)
    weights = vectors[:, :k] / np.sqrt(values[:k])

    def projected(x):
        hi, lo = centred(x, mean)
        w = hi @ weights + lo @ weights
        return w, np.zeros_like(w)

    error = float(np.abs(second_moments(fit, d, n, projected) - np.eye(k)).max())
    return rows.where(F.size("x") == d).mapInArrow(_whitened(d, n, sums, mean, weights, values[:k] / trace, error), out)
