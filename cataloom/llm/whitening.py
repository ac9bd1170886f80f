"""Whitening of embeddings by a compensated covariance and a tridiagonal divide-and-conquer eigen-solve.

Vectors become integers, floor(256 * c). The fit list holds each integer vector once; its sums are exact. A task takes its share of the list
in blocks: each vector is centred on the exact mean, and the block's outer products are formed without error - a centred value is cut into
slices of ``BITS`` bits, so few that a block's sums of products of two slices are whole multiples that a double holds - and added to a sum
in double-double, whose high and low parts are kept apart. Tasks' sums meet in rounds of ``FAN``, high and low parts together, a row of the matrix at a
time, so neither the driver nor a task ever holds more than one matrix and a bounded number of rows. Householder reflections make the covariance
tridiagonal, and it is torn in halves, solved and joined by the secular equation. A last pass over the fit list measures whitened data against the identity.

Edge cases: vectors that are null or hold a null, NaN or infinite entry have no rows; a row without a vec_id has rows like others. Shorter vectors
count as padded with zeros. Values beyond a long are set to its limits, in x as in ``deviation``. Directions without variance are no components, so
equal vectors, a single one or none give no rows; of equal eigenvalues any orthonormal vectors are taken, the same for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.scratch import drop, written

#: Vectors of a block, bits of a slice (2 * BITS + log2(BLOCK) <= 53), slices of a value; partial sums that one task joins.
BLOCK, BITS, SLICES, FAN = 1024, 21, 5, 32
_LONG = 2**63


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and x array<long> of the rows that take part, all of one width."""
    c = F.col("embedding")
    fine = F.coalesce(F.forall(c, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))), F.lit(False))
    some = embeddings.where(fine).select("vec_id", F.transform(c, lambda e: F.floor(e.cast("double") * scale)).alias("x"))
    width = some.agg(F.max(F.size("x"))).first()[0] or 0
    return some.withColumn("x", F.when(F.size("x") == width, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))))


def _blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with a list column as a matrix."""
    for batch in batches:
        for lo in range(0, len(batch), size):
            part = batch.slice(lo, size)
            flat = part.column(part.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False)
            yield part, flat.reshape(len(part), -1)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's rows and sums by dimension, in whole numbers of any length."""
    n, total = 0, None
    for _, x in _blocks(batches, "x"):
        safe = not x.size or max(-int(x.min()), int(x.max())) < _LONG // BLOCK
        own = x.sum(0).astype(object) if safe else x.astype(object).sum(0)
        n, total = n + len(x), own if total is None else total + own
    if n:
        yield pa.RecordBatch.from_pydict({"dim": np.arange(-1, len(total)), "part": [str(n), *map(str, total)]})


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension."""
    parts = fit.select("x").mapInArrow(_partial_sums, "dim long, part string")
    rows = parts.groupBy("dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()  # one row a dimension
    return (int(rows[0].s), [int(r.s) for r in rows[1:]]) if rows else (0, [])


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, other: np.ndarray, other_low: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two numbers of two parts each."""
    s, e = two_sum(high, other)
    return two_sum(s, e + (low + other_low))


def sliced(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Values high + low as slices of ``BITS`` bits below the power of two over each column; what is left over is below their last bit."""
    top = np.abs(high).max(0, initial=0)
    unit = np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1.0))))
    out, rest, error = [], high, 0.0
    for k in range(SLICES):
        if k == 2:  # two slices in, what is left of the high part is no longer than the low part
            rest, error = two_sum(rest, low)
        unit = unit * 2.0**-BITS
        shift = unit * 1.5 * 2.0**52
        piece = (rest + shift) - shift
        out.append(piece)
        rest = (rest - piece) + error
        error = 0.0
    return out


def outer_sums(high: np.ndarray, low: np.ndarray) -> Iterator[np.ndarray]:
    """Terms of the sum of outer products of the rows, each without error, small ones first."""
    s = sliced(high, low)
    for total in range(SLICES - 1, -1, -1):
        for a in range(total // 2, -1, -1):
            b = total - a
            product = s[a].T @ s[b]
            yield product
            if a != b:
                yield product.T


class Centre:
    """x - S / n in two doubles."""

    def __init__(self, n: int, sums: list[int]):
        means = [Fraction(s, n) for s in sums]
        self.high = np.array([float(m) for m in means])
        self.low = np.array([float(m - Fraction(h)) for m, h in zip(means, self.high.tolist(), strict=True)])

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = x.astype(np.float64)
        rest = (x - whole.astype(np.int64)).astype(np.float64) if np.abs(whole).max(initial=0) >= 2**53 else 0.0
        s, e = two_sum(whole, -self.high)
        return two_sum(s, e - self.low + rest)


def _accumulated(values) -> callable:
    """A task's sum of outer products: a record for each row of the matrix, with its high and low parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        high = low = None
        for _, x in _blocks(batches, "x"):
            for term in outer_sums(*values(x)):
                high, low = (term, np.zeros_like(term)) if high is None else add(high, low, term)
        if high is not None:
            d = len(high)
            yield pa.RecordBatch.from_pydict({"node": np.full(d, TaskContext.get().partitionId(), np.int64), "dim": np.arange(d), "high": pa.array(list(high), pa.list_(pa.float64())), "low": pa.array(list(low), pa.list_(pa.float64()))})

    return run


def _joined(key: tuple, table: pa.Table) -> pa.Table:
    """The parts of one row of the matrix, added up in the order of their tasks."""
    table = table.sort_by("node")
    high, low = (np.array(table.column(c).to_pylist(), np.float64) for c in ("high", "low"))
    h, r = high[0], low[0]
    for k in range(1, len(high)):
        h, r = add(h, r, high[k], low[k])
    return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([key[1].as_py()], pa.int64()), "high": pa.array([h], pa.list_(pa.float64())), "low": pa.array([r], pa.list_(pa.float64()))})


def outer_product_sum(fit: DataFrame, values) -> tuple[np.ndarray, np.ndarray]:
    """High and low parts of the sum of ``values(x)``'s outer products over all rows."""
    spark, spec = fit.sparkSession, "node long, dim long, high array<double>, low array<double>"
    now, path = written(fit.select("x").mapInArrow(_accumulated(values), spec), "outer")
    nodes = (now.agg(F.max("node")).first()[0] or 0) + 1
    while True:
        up = now.withColumn("up", F.expr(f"node div {FAN}"))
        now, after = written(up.groupBy("up", "dim").applyInArrow(_joined, spec), "outer")
        drop(spark, path)
        path, nodes = after, -(-nodes // FAN)
        if nodes == 1:
            break
    rows = now.orderBy("dim").collect()  # one row a dimension
    drop(spark, path)
    return np.array([r.high for r in rows]), np.array([r.low for r in rows])


# ---- eigenvectors


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, side diagonal and Q of a symmetric matrix, a = Q T Q', by Householder reflections."""
    a = np.array(a, np.float64)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        top = np.abs(v).max()
        if top == 0:
            continue
        v /= top  # else squares of small entries are lost
        norm = np.linalg.norm(v)
        v[0] += norm if v[0] >= 0 else -norm
        v /= np.linalg.norm(v)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho sum z^2 / (d - l) = 0 for rising d and rho > 0: to each the nearer pole and the distance from it, by bisection."""
    n = len(d)
    gap = np.append(np.diff(d), rho * (z @ z))
    f = lambda origin, mu: 1 + rho * ((z**2)[None, :] / ((d[None, :] - d[origin][:, None]) - mu[:, None])).sum(1)
    at = np.arange(n)
    with np.errstate(divide="ignore", invalid="ignore"):
        right = (f(at, gap / 2) < 0) & (at < n - 1)  # the root lies in the right half
        origin = np.where(right, at + 1, at)
        lo, hi = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, np.where(at == n - 1, gap, gap / 2))
        for _ in range(1100):
            mid = lo + (hi - lo) / 2
            open_ = (mid > lo) & (mid < hi)
            if not open_.any():
                break
            above = f(origin, mid) > 0
            hi, lo = np.where(open_ & above, mid, hi), np.where(open_ & ~above, mid, lo)
    return origin, np.where(right, lo, hi)


def _rank_one(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors of diag(d) + rho z z' for rho > 0; what hardly couples, and one of two equal poles, is set aside."""
    n = len(d)
    order = np.argsort(d, kind="stable")
    d, z, basis = d[order], z[order].copy(), np.eye(n)[:, order]
    small = 8 * np.finfo(float).eps * max(np.abs(d).max(), abs(rho) * (z @ z), np.finfo(float).tiny)
    last, live = -1, np.zeros(n, bool)
    for i in range(n):
        if abs(rho * z[i]) * np.linalg.norm(z) <= small:
            continue
        if last >= 0 and d[i] - d[last] <= small:  # turned so that the earlier one decouples
            r = np.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            basis[:, [last, i]] = basis[:, [last, i]] @ np.array([[c, s], [-s, c]])
            z[last], z[i] = 0.0, r
            live[last] = False
        last = i
        live[i] = True
    values, vectors = d.copy(), basis.copy()
    k = np.flatnonzero(live)
    if len(k):
        dk, zk = d[k], z[k]
        origin, mu = secular_roots(dk, zk, rho)
        values[k] = dk[origin] + mu
        away = (dk[:, None] - dk[origin][None, :]) - mu[None, :]  # d_j - l_i
        # the z for which these roots are exact: eigenvectors from it are orthogonal
        others = ~np.eye(len(k), dtype=bool)
        ratio = np.where(others, -away / np.where(others, dk[None, :] - dk[:, None], 1.0), 1.0)
        exact = np.sqrt(np.abs(np.prod(ratio, axis=1) * np.diag(away) / rho))
        u = np.copysign(exact, zk)[:, None] / away
        vectors[:, k] = basis[:, k] @ (u / np.linalg.norm(u, axis=0))
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def divide_and_conquer(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors of a symmetric tridiagonal matrix."""
    n = len(d)
    if n <= 1:
        return d.copy(), np.eye(n)
    m, rho = n // 2, e[n // 2 - 1]
    left, right = d[:m].copy(), d[m:].copy()
    left[-1] -= abs(rho)
    right[0] -= abs(rho)
    (w1, q1), (w2, q2) = divide_and_conquer(left, e[: m - 1]), divide_and_conquer(right, e[m:])
    w = np.concatenate([w1, w2])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    if rho == 0:
        order = np.argsort(w, kind="stable")
        return w[order], q[:, order]
    values, vectors = _rank_one(w, np.concatenate([q1[-1], np.sign(rho) * q2[0]]), abs(rho))
    return values, q @ vectors


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns."""
    scale = float(np.abs(a).max(initial=0)) or 1.0
    d, e, q = tridiagonal(np.asarray(a) / scale)
    e[np.abs(e) < np.finfo(float).eps] = 0  # the matrix falls into parts
    values, vectors = divide_and_conquer(d, e)
    vectors = q @ vectors
    return values[::-1] * scale, (vectors / np.linalg.norm(vectors, axis=0))[:, ::-1] if len(vectors) else vectors


# ---- the operator


class Whitener:
    """What whitens: n, sums, and of each component the direction and the root of its eigenvalue."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.trace = n, sums, values, trace
        self.way = vectors / np.sqrt(values)
        self.centre = Centre(n, sums)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centre(x)
        return high @ self.way + low @ self.way

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S)^2, exactly; the greatest long where it is beyond that."""
        d = max(1, x.shape[1])
        most = self.n * max(-int(x.min(initial=0)), int(x.max(initial=0))) + max(map(abs, self.sums), default=0)
        if most * most * d < _LONG:
            y = x * self.n - np.array(self.sums, np.int64)
            return (y * y).sum(1)
        y = x.astype(object) * self.n - np.array(self.sums, object)
        return np.array([min(int(v), _LONG - 1) for v in (y * y).sum(1)], np.int64)


def fit(embeddings: DataFrame, most: int = 4) -> tuple[DataFrame, Whitener | None, float]:
    """The integer vectors, the whitener over their distinct ones (None where nothing varies), and how far whitened data is from the identity."""
    rows = integer_vectors(embeddings)
    distinct, path = written(rows.select("x").distinct(), "fit")
    n, sums = exact_sums(distinct)
    if not n or not sums:
        drop(rows.sparkSession, path)
        return rows, None, 0.0
    high, low = outer_product_sum(distinct, Centre(n, sums))
    covariance = (high + low) / n
    trace = float(np.trace(covariance))
    values, vectors = eigen(covariance)
    keep = np.flatnonzero(values > len(values) * np.finfo(float).eps * max(trace, 0.0))[:most]
    if not len(keep):
        drop(rows.sparkSession, path)
        return rows, None, 0.0
    whitener = Whitener(n, sums, values[keep], vectors[:, keep], trace)
    # ones beside the whitened values bring their sums along
    high, low = outer_product_sum(distinct, lambda x: (np.column_stack([whitener(x), np.ones(len(x))]), np.zeros((len(x), len(keep) + 1))))
    drop(rows.sparkSession, path)
    got = (high + low) / n
    error = float(np.abs(got[:-1, :-1] - np.outer(got[-1, :-1], got[-1, :-1]) - np.eye(len(keep))).max())
    return rows, whitener, error


def whiten(embeddings: DataFrame, most: int = 4) -> DataFrame:
    """Every vector's place along the first ``most`` components, in units of their spread."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows, whitener, error = fit(embeddings, most)
    spark = embeddings.sparkSession
    spec = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if whitener is None:
        return spark.createDataFrame([], spec)
    schema = to_arrow_schema(spark.createDataFrame([], spec).schema)
    explained = whitener.values / whitener.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, "x"):
            w = whitener(x)
            k = w.shape[1]
            ids = part.column(part.schema.get_field_index("vec_id")).take(pa.array(np.repeat(np.arange(len(x)), k)))
            columns = [
                ids, np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(w.size, whitener.n), np.repeat(whitener.deviations(x), k), w.ravel(),
                np.tile(explained, len(x)), np.full(w.size, error),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.select("vec_id", "x").mapInArrow(run, spec)
