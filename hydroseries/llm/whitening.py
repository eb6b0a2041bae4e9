"""Whitening of embeddings; leading eigenvalues by spectrum slicing.

Entries become whole numbers first, so sums and products over all vectors are exact and do not depend on the order in
which tasks end. The covariance (dimensions x dimensions, whatever the number of rows) comes to the driver. There an
LDL^T factorisation of the covariance less a shift counts, by the signs of its pivots, the eigenvalues below the shift. Bisection
with these counts isolates each leading eigenvalue, Rayleigh quotient iteration takes it to full precision, and two more
counts on either side of the result certify its number.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.llm.common import map_batches
from hydroseries.session import cut_lineage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Whole numbers travel as digits of 32 bits, which Spark adds as longs.
_DIGIT = 32
_PIVOT = (1 + math.sqrt(17)) / 8
_LONG = (1 << 63) - 1


# --- slicing -------------------------------------------------------------------------------------------------------


def inertia(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric ``a`` below ``shift``: negative pivots of LDL^T with complete pivoting.

    A pivot is one diagonal entry or, where these are small against the rest, a block of two, which has one
    eigenvalue of either sign. A remainder of exact zeros has no negative pivot.
    """
    m = a - shift * np.eye(len(a))
    below = 0
    while len(m):
        d = np.abs(np.diagonal(m))
        i = int(d.argmax())
        off = np.abs(m - np.diag(np.diagonal(m)))
        p, q = divmod(int(off.argmax()), len(m))
        if d[i] == 0 and off[p, q] == 0:
            break
        if d[i] >= _PIVOT * off[p, q]:
            below += bool(m[i, i] < 0)
            rest = np.delete(np.arange(len(m)), i)
            c = m[rest, i]
            m = m[np.ix_(rest, rest)] - np.outer(c, c / m[i, i])
        else:
            below += 1
            rest = np.delete(np.arange(len(m)), [p, q])
            c = m[np.ix_(rest, [p, q])]
            m = m[np.ix_(rest, rest)] - c @ np.linalg.solve(m[np.ix_([p, q], [p, q])], c.T)
        m = (m + m.T) / 2
    return below


def _isolate(a: np.ndarray, want: int, resolution: float) -> list[tuple[float, float, int, int]]:
    """(low, high, first, last): disjoint intervals with the eigenvalues numbered first..last from the top.

    Bisection goes on until an interval holds one eigenvalue or is narrower than ``resolution``: a cluster.
    """
    n = len(a)
    radius = np.abs(a).sum(axis=1) - np.abs(np.diagonal(a))
    low = float((np.diagonal(a) - radius).min()) - resolution
    high = float((np.diagonal(a) + radius).max()) + resolution
    out, stack = [], [(low, high, 0, n)]  # eigenvalues above high, eigenvalues above low
    while stack:
        lo, hi, above_hi, above_lo = stack.pop()
        if above_lo == above_hi or above_hi >= want:
            continue
        middle = (lo + hi) / 2
        if above_lo - above_hi == 1 or hi - lo <= resolution or not lo < middle < hi:
            out.append((lo, hi, above_hi + 1, above_lo))
            continue
        above = min(max(n - inertia(a, middle), above_hi), above_lo)
        stack.append((lo, middle, above, above_lo))
        stack.append((middle, hi, above_hi, above))
    return sorted(out, key=lambda x: x[2])


def _narrow(a: np.ndarray, lo: float, hi: float, first: int, share: float = 0.05) -> tuple[float, float]:
    """Halves an interval with one eigenvalue, for a start from which the iteration stays with it."""
    n, width = len(a), hi - lo
    while hi - lo > share * width and hi - lo > 1e-9 * max(abs(lo), abs(hi)):
        middle = (lo + hi) / 2
        if n - inertia(a, middle) >= first:
            lo = middle
        else:
            hi = middle
    return lo, hi


def _rayleigh(a: np.ndarray, lo: float, hi: float, known: np.ndarray, seed: int, tol: float) -> tuple[float, np.ndarray]:
    """An eigenpair inside [lo, hi], orthogonal to the columns of ``known``.

    Rayleigh quotient iteration; a quotient that leaves the interval is replaced by the middle of the interval, which is
    inverse iteration for that step.
    """
    n = len(a)
    x = np.random.default_rng(seed).standard_normal(n)
    x -= known @ (known.T @ x)
    x /= np.linalg.norm(x)
    shift = (lo + hi) / 2
    value = shift
    for step in range(60):
        try:
            y = np.linalg.solve(a - shift * np.eye(n), x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(a - (shift + tol) * np.eye(n), x)
        for _ in range(2):
            y -= known @ (known.T @ y)
        x = y / np.linalg.norm(y)
        value = float(x @ a @ x)
        if step and np.linalg.norm(a @ x - value * x) <= tol:
            break
        shift = value if lo <= value <= hi else (lo + hi) / 2
    return value, x


def leading_eigenpairs(v: np.ndarray, want: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest positive eigenvalues of a covariance, falling, and unit eigenvectors as columns.

    Eigenvalues at the level of rounding (1e-12 of the trace) count as zero and are left out. Raises where a count does
    not confirm the number of an eigenvalue. Signs: the entry of largest size of a vector is positive.
    """
    n, trace = len(v), float(np.trace(v))
    if not n or not trace > 0:
        return np.empty(0), np.empty((n, 0))
    a = v / trace
    tol = 8 * n * np.finfo(float).eps
    values: list[float] = []
    vectors = np.empty((n, 0))
    for lo, hi, first, last in _isolate(a, want, tol):
        if hi < 1e-12:
            break
        if first == last:
            lo, hi = _narrow(a, lo, hi, first)
        found: list[tuple[float, np.ndarray]] = []
        for number in range(first, last + 1):
            known = np.column_stack([vectors, *[x for _, x in found]])
            found.append(_rayleigh(a, lo - tol, hi + tol, known, number, tol))
        for value, x in sorted(found, key=lambda f: -f[0]):
            values.append(value)
            vectors = np.column_stack([vectors, x])
        low, high = min(f[0] for f in found), max(f[0] for f in found)
        if n - inertia(a, high + 4 * tol) >= first or n - inertia(a, low - 4 * tol) < last:
            raise ArithmeticError(f"counts do not confirm eigenvalues {first} to {last}")
    keep = [i for i, e in enumerate(values[:want]) if e > 1e-12]
    vectors = vectors[:, keep]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(keep))]) if keep else np.empty(0)
    return np.array([values[i] * trace for i in keep]), vectors * signs


# --- sums ----------------------------------------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal-sized lists of whole numbers."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _whole(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x less a whole centre: longs, or Python numbers where these could overflow."""
    limit = 1 << 52
    if len(x) and (np.abs(x.astype(float)).max() > limit or max(map(abs, centre)) > limit):
        return x.astype(object) - np.array(centre, dtype=object)
    return x - np.array(centre, dtype=np.int64)


def _digits(values: Iterable[tuple[int, int, int]]) -> dict:
    """(i, j, whole number) -> rows i, j, k, digit; the last digit carries the sign."""
    out: dict[str, list] = {"i": [], "j": [], "k": [], "digit": []}
    for i, j, v in values:
        k = 0
        while v:
            small = -(1 << (_DIGIT - 1)) <= v < 1 << (_DIGIT - 1)
            out["i"].append(i)
            out["j"].append(j)
            out["k"].append(k)
            out["digit"].append(v if small else v & ((1 << _DIGIT) - 1))
            v = 0 if small else v >> _DIGIT
            k += 1
    return out


def _total(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Sums by (i, j); what comes to the driver is bounded by the square of the dimension."""
    out: dict[tuple[int, int], int] = {}
    for i, j, k, digit in rows.groupBy("i", "j", "k").agg(F.sum("digit")).collect():
        out[i, j] = out.get((i, j), 0) + (int(digit) << (_DIGIT * k))
    return out


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of every dimension."""

    def run(batches):
        n, total = 0, np.zeros(dims, dtype=object)
        for b in batches:
            x = _matrix(b.column(0))
            n += len(x)
            for part in np.array_split(x, max(1, len(x) // 4096)):
                whole = _whole(part, [0] * dims)
                total += whole.sum(axis=0).astype(object)
        yield _digits([(-1, 0, n), *((0, i, int(s)) for i, s in enumerate(total))])

    got = _total(map_batches(fit, run, "i int, j int, k int, digit long"))
    return got.get((-1, 0), 0), [got.get((0, i), 0) for i in range(dims)]


def _products(fit: DataFrame, dims: int, centre: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums of products of every two dimensions, of entries less a whole centre."""

    def run(batches):
        total = np.zeros((dims, dims), dtype=object)
        for b in batches:
            x = _matrix(b.column(0))
            for part in np.array_split(x, max(1, len(x) // 2048)):
                y = _whole(part, centre)
                if y.dtype != object and len(y):
                    # Products of numbers below 2^20 add up exactly as doubles over 2048 rows.
                    y = y.astype(float) if np.abs(y).max() < 1 << 20 else y.astype(object)
                g = y.T @ y if len(y) else np.zeros((dims, dims))
                total += g if g.dtype == object else g.astype(np.int64).astype(object)
        upper = ((i, j, int(total[i, j])) for i in range(dims) for j in range(i, dims))
        yield _digits(upper)

    return _total(map_batches(fit, run, "i int, j int, k int, digit long"))


def _covariance(n: int, sums: list[int], centre: list[int], products: dict[tuple[int, int], int]) -> np.ndarray:
    """Correctly rounded covariance with divisor n."""
    dims = len(sums)
    t = [s - n * c for s, c in zip(sums, centre)]
    v = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            v[i, j] = v[j, i] = (n * products.get((i, j), 0) - t[i] * t[j]) / (n * n)
    return v


def _offsets(x: np.ndarray, n: int, centre: list[int], rest: list[int]) -> np.ndarray:
    """x - S/n as doubles; ``rest`` is S - n * centre."""
    return _whole(x, centre).astype(float) - np.array([r / n for r in rest])


def _identity_error(fit: DataFrame, n: int, centre: list[int], rest: list[int], project: np.ndarray) -> float:
    """Largest entry of the whitened vectors' covariance less the identity."""
    k = project.shape[1]

    def run(batches):
        total, mean = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            z = _offsets(_matrix(b.column(0)), n, centre, rest) @ project
            total += z.T @ z
            mean += z.sum(axis=0)
        yield {"i": [-1] * k + [i for i in range(k) for _ in range(k)], "j": [*range(k)] + [*range(k)] * k,
               "part": [*mean.tolist(), *total.ravel().tolist()]}

    got = {(r[0], r[1]): r[2] for r in
           map_batches(fit, run, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part")).collect()}
    c = np.array([[got[i, j] / n - got[-1, i] * got[-1, j] / n / n for j in range(k)] for i in range(k)])
    return float(np.abs(c - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, centre: list[int], rest: list[int]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2, exact; None beyond the range of a long."""
    y = _whole(x, centre)
    bound = n * int(np.abs(y).max()) + max(map(abs, rest)) if len(y) else 0
    if bound * bound * len(rest) <= _LONG:
        d = n * y.astype(np.int64) - np.array(rest, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    d = n * y.astype(object) - np.array(rest, dtype=object)
    return [s if s <= _LONG else None for s in map(int, (d * d).sum(axis=1))]


def whitened_rows(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: ``components`` rows for each row kept.

    Rows whose vector is null or holds a null or an entry that is no finite number are left out, as are empty vectors. Each
    entry c becomes floor(64*c)+1000000 (as a long; beyond its range the nearest long). The covariance is that of the distinct
    vectors: repeated rows weigh once and get the same result each; a null id is an id like any other. All vectors should have one length; if not, the length
    of most distinct vectors counts (the longer on a tie) and rows of other lengths are left out.

    Components fall by eigenvalue; there are fewer where the vectors span fewer dimensions, and none (no rows) when all
    vectors are equal or the table is empty. Equal eigenvalues get an orthonormal basis of their space. ``deviation`` is null where it is no long.
    Other columns of the table, whatever their names, are not read.
    """
    c = F.col(f"`{vector_col}`")
    good = c.isNotNull() & (F.size(c) > 0) & F.forall(
        c, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != float("inf"))
    )
    # Entries out of the range of a long are held at its ends before the shift, so that nothing wraps around.
    top = float(1 << 62)
    whole = F.transform(c, lambda e: F.floor(F.greatest(F.least(e.cast("double") * SCALE, F.lit(top)), F.lit(-top))) + SHIFT)
    kept = rows.where(F.coalesce(good, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), whole.alias("x"))
    fit = cut_lineage(kept.select("x").distinct())
    lengths = fit.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n"))
    best = lengths.orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dims = best[0]["dims"] if best else 0
    of_size = F.size("x") == dims
    n, sums = _sums(fit.where(of_size), dims) if dims else (0, [])
    centre = [(2 * s + n) // (2 * n) for s in sums] if n else []
    rest = [s - n * m for s, m in zip(sums, centre)]
    v = _covariance(n, sums, centre, _products(fit.where(of_size), dims, centre)) if n else np.zeros((0, 0))
    values, vectors = leading_eigenpairs(v, components)
    k = len(values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    project = vectors / np.sqrt(values)
    explained = values / float(np.trace(v))
    error = _identity_error(fit.where(of_size), n, centre, rest, project)

    def run(batches):
        for b in batches:
            ids, column = b.column(0), b.column(1)
            for at in range(0, len(ids), 4096):
                x = _matrix(column.slice(at, 4096))
                z = _offsets(x, n, centre, rest) @ project
                m = len(x)
                yield {
                    "vec_id": ids.slice(at, m).take(pa.array(np.repeat(np.arange(m), k))),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m), "n": np.full(m * k, n),
                    "deviation": [d for d in _deviations(x, n, centre, rest) for _ in range(k)], "whitened": z.ravel(),
                    "explained": np.tile(explained, m), "identity_error": np.full(m * k, error),
                }

    return map_batches(kept.where(of_size), run, schema)
