"""Whitening of embeddings: exact integer statistics in Spark, principal components by QDWH spectral divide and conquer.

A symmetric matrix shifted into the middle of its spectrum has a polar factor whose eigenvalues are the signs of the shifted
ones; the factor gives the projectors on the subspaces above and below the shift, and these are split in turn. Only matrices of
dimension x dimension reach the driver; vectors stay in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import discard, saved
from .common import table

COMPONENTS = 4
SCALE = 256
EPS = float(np.finfo(float).eps)
#: Vectors of more dimensions are refused: the driver holds some matrices of this size squared.
MOST_DIMENSIONS = 8192


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric nonsingular matrix by QR-based, dynamically weighted Halley steps."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = max(1 / (np.linalg.norm(np.linalg.inv(x)) if np.linalg.cond(x, 1) < 1 / EPS else 1 / EPS), EPS)  # a lower bound of its least singular value
    for _ in range(20):
        square = low * low
        root = np.cbrt(4 * (1 - square) / square**2)
        a_ = np.sqrt(1 + root) + 0.5 * np.sqrt(8 - 4 * root + 8 * (2 - square) / (square * np.sqrt(1 + root)))
        b_ = (a_ - 1) ** 2 / 4
        c_ = a_ + b_ - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c_) * x, np.eye(n)]))
        new = b_ / c_ * x + (a_ - b_ / c_) / np.sqrt(c_) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (a_ + b_ * square) / (1 + c_ * square))
        if abs(1 - low) < 10 * EPS and moved < np.cbrt(EPS):
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if a is a multiple of the identity."""
    n = len(a)
    mean = np.trace(a) / n
    if np.linalg.norm(a - mean * np.eye(n)) <= 4 * n * EPS * max(np.linalg.norm(a), np.finfo(float).tiny):
        return None
    diagonal = np.sort(np.diag(a))
    for shift in (float(np.median(diagonal)), float(mean), *(float(mean + s * np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)) for s in (0.31, -0.37, 0.73, -0.79, 0.05, -0.07))):
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n:
            continue
        start = projector[:, np.argsort(-np.diag(projector), kind="stable")[:k]]
        other = (np.eye(n) - projector)[:, np.argsort(np.diag(projector), kind="stable")[: n - k]]
        q, _ = np.linalg.qr(np.hstack([start, other]))
        for _ in range(2):  # the columns of a projector may be nearly dependent; subspace iteration mends it
            above, _ = np.linalg.qr(projector @ q[:, :k])
            q, _ = np.linalg.qr(np.hstack([above, q[:, k:]]))
        q1, q2 = q[:, :k], q[:, k:]
        if np.linalg.norm(q2.T @ a @ q1) <= 64 * n * EPS * np.linalg.norm(a):
            return q1, q2
    raise ArithmeticError("no shift splits this matrix")


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns: min(most, dimension) of them.

    Only subspaces that hold wanted ones are split further. A last step in extended precision removes what the splits' rounding
    has left."""
    n = len(v)
    found: list[tuple[float, np.ndarray]] = []
    open_: list[np.ndarray] = [np.eye(n)] if n else []  # bases, largest eigenvalues last
    while open_ and len(found) < most:
        basis = open_.pop()
        own = basis.T @ v @ basis
        own = (own + own.T) / 2
        halves = _split(own) if len(own) > 1 else None
        if halves is None:  # one vector, or all of one eigenvalue
            found += [(float(own[i, i]), basis[:, i]) for i in range(len(own))]
        else:
            open_ += [basis @ halves[1], basis @ halves[0]]
    found = sorted(found, key=lambda x: -x[0])[:most]
    if not found:
        return np.zeros(0), np.zeros((n, 0))
    return _refined(v, np.stack([x for _, x in found], 1))


def _refined(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One Newton step for each vector (v - e I) d = -residual, with the residual in extended precision."""
    wide = v.astype(np.longdouble)
    vectors, values = [], []
    for i in range(x.shape[1]):
        u = x[:, i].astype(np.longdouble)
        for _ in range(2):
            u = u / np.sqrt(u @ u)
            e = u @ (wide @ u)
            residual = (wide @ u - e * u).astype(float)
            bordered = np.block([[v - float(e) * np.eye(len(v)), -u[:, None].astype(float)], [u[None, :].astype(float), np.zeros((1, 1))]])
            step = np.linalg.lstsq(bordered, np.append(-residual, 0.0), rcond=None)[0][:-1]
            if np.linalg.norm(step) > 1e-6:  # eigenvalues too close together: as it is
                break
            u = u + step
        u = u / np.sqrt(u @ u)
        for w in vectors:  # close eigenvalues: stay orthogonal
            u = u - (w @ u) * w
        u = u / np.sqrt(u @ u)
        vectors.append(u)
        values.append(u @ (wide @ u))
    order = np.argsort([-float(e) for e in values], kind="stable")
    return np.array([float(values[i]) for i in order]), np.stack([vectors[i].astype(float) for i in order], 1)


def _numbers(column: pa.Array, d: int) -> np.ndarray:
    """Packed rows as a matrix of longs: the entries are shorts where all of a row fit, else longs."""
    out = np.empty((len(column), d), np.int64)
    for i, x in enumerate(column.to_pylist()):
        out[i] = np.frombuffer(x, "<i2" if len(x) == 2 * d else "<i8")
    return out


def whole_numbers(vectors: DataFrame, d: int, scale: int = SCALE) -> DataFrame:
    """vec_id and x, the packed longs floor(scale * c), of the rows of d finite components; what no long holds is the nearest."""
    rows = vectors.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where((F.size("v") == d) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.floor(scale * batch.column("v").flatten().to_numpy().reshape(-1, d))
            x = np.where(v >= 2.0**63, np.iinfo(np.int64).max, np.clip(v, -(2.0**63), 2.0**63 - 1024).astype(np.int64))
            short = (np.abs(v) < 2**15).all(1)
            packed = [(r.astype("<i2") if s else r.astype("<i8")).tobytes() for r, s in zip(x, short.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary())], ["vec_id", "x"])

    return rows.mapInArrow(pack, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, x binary")


def _sums(rows: DataFrame, of, width: int) -> np.ndarray:
    """The sum over all rows of what `of` makes of a batch's packed rows, a matrix of `width` columns: first in each task,
    then row by row in Spark."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of(batch.column("x"))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "s"])

    parts = rows.select("x").mapInArrow(part, "i long, s array<double>")
    added = parts.select("i", F.posexplode("s").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((width, width))
    for r in added.collect():  # dimension squared
        out[r["i"], r["j"]] = r["s"]
    return out


@dataclass(frozen=True)
class Whitening:
    """What a fit has found: dimensions, vectors, per-dimension sums, components and their shares."""

    d: int
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    shares: np.ndarray
    identity_error: float | None

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of longs; NaN for a component without variance."""
        centre = np.array([s / self.n for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (x - centre) @ self.vectors / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; None where no long holds it."""
        rough = ((self.n * x.astype(float) - np.array(self.sums, float)) ** 2).sum(1)
        out: list[int | None] = []
        safe = (np.abs(x.astype(float)).max(1, initial=0) * self.n < 2.0**62) & (rough < 2.0**62)
        if max((abs(s) for s in self.sums), default=0) < 2**62:
            fast = ((self.n * x[safe] - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        else:
            safe, fast = np.zeros(len(x), bool), []
        fast_iter = iter(fast)
        for i, s in enumerate(safe.tolist()):
            value = next(fast_iter) if s else sum((self.n * int(c) - t) ** 2 for c, t in zip(x[i], self.sums))
            out.append(value if value < 2**63 else None)
        return out


def dimensions(vectors: DataFrame) -> int:
    """The commonest length of vectors, of several the least; 0 if there is none."""
    sizes = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d > 0")
    first = sizes.orderBy(F.desc("n"), "d").first()
    if first and first["d"] > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {first['d']} dimensions; at most {MOST_DIMENSIONS}")
    return first["d"] if first else 0


def fit(vectors: DataFrame, most: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """Components of the distinct whole-number vectors' covariance (divisor n, centred before multiplying)."""
    d = dimensions(vectors)
    distinct = saved(whole_numbers(vectors, d, scale).select("x").distinct(), "distinct-vectors")
    n = distinct.count()

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            x = _numbers(batch.column("x"), d)
            for i in range(0, len(x), 1 << 15):
                some = x[i : i + (1 << 15)]
                own = some.sum(0).tolist() if np.abs(some.astype(float)).max(initial=0) < 2.0**47 else [sum(map(int, c)) for c in some.T]
                total = [a + b for a, b in zip(total, own)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int64()), pa.array(list(map(str, total)), pa.string())], ["i", "s"])

    sums = [0] * d
    for r in distinct.mapInArrow(totals, "i long, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        sums[r["i"]] = int(r["s"])
    centre = np.array([s / n for s in sums]) if n else np.zeros(d)

    def products(packed: pa.Array) -> np.ndarray:
        x = _numbers(packed, d) - centre
        return x.T @ x

    v = _sums(distinct, products, d) / n if n else np.zeros((d, d))
    values, axes = components((v + v.T) / 2, most)
    trace = float(np.trace(v))
    small = values <= 16 * d * EPS * max(trace, 0.0)
    values = np.where(small, 0.0, values)
    shares = values / trace if trace > 0 else np.full(len(values), np.nan)
    found = Whitening(d, n, tuple(sums), values, axes, shares, None)
    error = None
    real = int((values > 0).sum())
    if real:
        own = Whitening(d, n, found.sums, values[:real], axes[:, :real], shares[:real], None)

        def squares(packed: pa.Array) -> np.ndarray:
            w = own.project(_numbers(packed, d))
            return w.T @ w

        error = float(np.abs(_sums(distinct, squares, real) / n - np.eye(real)).max())
    discard(distinct)
    return Whitening(d, n, found.sums, values, axes, shares, error)


def whitened(vectors: DataFrame, most: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each remaining row and component.

    Rows whose vector is null, empty, of another length than the commonest, or holds null or non-finite entries are left out;
    repeated rows are whitened each and fitted once; a null id stays. A component without variance has null in whitened; if none
    has any, explained and identity_error are null too. A deviation that no long holds is null. Fewer dimensions than
    components give fewer components; an empty table gives an empty one. Other columns are not read.
    """
    own = fit(vectors, most, scale)
    k = len(own.values)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _numbers(batch.column("x"), own.d)
            w, rows = own.project(x), np.repeat(np.arange(len(x)), k)
            nan = lambda a: pa.array(a, pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), own.n)), pa.array(own.deviations(x), pa.int64()).take(pa.array(rows)),
                 nan(w.ravel()), nan(np.tile(own.shares, len(x))), pa.array([own.identity_error] * len(rows), pa.float64())], names)

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return whole_numbers(vectors, own.d, scale).mapInArrow(project, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
