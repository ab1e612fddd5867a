"""Whitening of embeddings by the singular values of their centred matrix, which is never multiplied by itself.

Entries become whole numbers, so that counts, sums and centring are exact. Each task brings its centred rows to a triangle R by
QR in blocks; triangles of up to FAN tasks are stacked and brought to one again until few are left. Householder reflections
make R bidiagonal; differential quotient-difference steps (dqds) on the squares of the bidiagonal's entries find all singular
values to high relative accuracy, and twisted factorisations of the shifted product of the bidiagonal with itself give the
wanted directions, which the reflections turn back. Clusters of close values are shifted to their end first, where the
differences between them are large against the values that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodex.llm.common import others, stored

#: Entries are this often whole.
SCALE = 256
#: Rows of a block, and triangles that are stacked at once.
BLOCK_ROWS, FAN = 2048, 16
#: Values closer than this, relatively, are one cluster.
CLOSE = 1e-3
EPS = np.finfo(float).eps
#: Entries that go beyond this when scaled are an error: sums of them might not be exact.
MOST = 1 << 52


# Vectors as whole numbers.


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a column of lists that hold finite numbers only, by number, and their entries as whole numbers. All lists
    are equally long, or the job fails."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    given = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    sizes = sizes[given].astype(np.int64)
    flat = column.take(pa.array(given, pa.int64())).flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
    owner = np.repeat(np.arange(len(given)), sizes)
    odd = np.bincount(owner[~np.isfinite(flat)], minlength=len(given)) > 0
    if len(set(sizes[~odd].tolist())) > 1:
        raise ValueError("vectors of different lengths")
    x = np.floor(SCALE * flat[~odd[owner]]) if len(flat) else flat
    if len(x) and np.abs(x).max() > MOST:
        raise ValueError("an entry is too large to count exactly")
    return given[~odd], x.astype(np.int64).reshape(int((~odd).sum()), -1) if (~odd).any() else np.zeros((0, 0), np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row as bytes, of the least width that holds its entries; equal rows give equal bytes."""
    most = np.abs(x).max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(x)
    for width, mark, least, below in ((2, b"2", -1, 1 << 15), (4, b"4", (1 << 15) - 1, 1 << 31), (8, b"8", (1 << 31) - 1, 1 << 62)):
        for i in np.flatnonzero((most > least) & (most < below)).tolist():
            out[i] = mark + x[i].astype(f"<i{width}").tobytes()
    return out


def unpacked(rows: list[bytes]) -> np.ndarray:
    if len({(len(r) - 1) // int(r[:1]) for r in rows}) > 1:
        raise ValueError("vectors of different lengths")
    return np.array([np.frombuffer(r, f"<i{r[:1].decode()}", offset=1) for r in rows], np.int64)


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in it:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield unpacked(batch.column(0).slice(at, BLOCK_ROWS).to_pylist())


def distinct_vectors(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """x (bytes): each vector that holds finite numbers only once, as whole numbers, stored. Copies meet in their own task
    first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array(packed(whole(batch.column(0))[1]), pa.binary())], names=["x"])

    return stored(vectors.select(F.col(vector_col).cast("array<double>")).mapInArrow(run, "x binary").distinct(), "vectors")


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension. Tasks and partial sums send a row for each dimension."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, width = 0, None, 0
        for x in _blocks(it):
            if width and x.shape[1] != width:
                raise ValueError("vectors of different lengths")
            width, n = x.shape[1], n + len(x)
            if total is None:
                total = [0] * width
            total = [a + b for a, b in zip(total, x.sum(axis=0).tolist(), strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array(map(str, [n, *total]), pa.string())], names=["dim", "total"])

    rows = fit.mapInArrow(run, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.count("*").alias("tasks")).collect()  # a row for each dimension
    if len({r.tasks for r in rows}) > 1:
        raise ValueError("vectors of different lengths")
    known = {r.dim: int(r.total) for r in rows}
    return known.get(-1, 0), [known[k] for k in range(len(known) - 1)]


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - S, exactly: long where that fits, else Python's whole numbers."""
    fits = n * (int(np.abs(x).max(initial=0)) + 1) + max((abs(int(s)) for s in total), default=0) < 1 << 62
    return n * x - total.astype(np.int64) if fits else n * x.astype(object) - total


# The triangle.


def triangle(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """R of the QR factorisation of all centred vectors. A task holds a block of rows and a triangle, or FAN triangles."""
    d, s = len(total), np.array(total, object)

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for x in _blocks(it):
            r = np.linalg.qr(np.vstack([r, centred(x, n, s).astype(float) / n]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()] if len(r) else [], pa.binary())], names=["r"])

    def stacked(rows: list[bytes]) -> np.ndarray:
        return np.linalg.qr(np.vstack([np.frombuffer(r).reshape(-1, d) for r in rows]), mode="r")

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"node": table["node"].slice(0, 1).cast(pa.int64()), "r": pa.array([stacked(table["r"].to_pylist()).tobytes()], pa.binary())})

    rows = stored(fit.mapInArrow(first, "r binary").withColumn("node", F.spark_partition_id().cast("long")), "triangles")
    nodes = fit.rdd.getNumPartitions()
    while nodes > FAN:
        rows, nodes = rows.withColumn("node", F.floor(F.col("node") / FAN).cast("long")).groupBy("node").applyInArrow(merge, "node bigint, r binary"), -(-nodes // FAN)
    left = [bytes(r.r) for r in rows.orderBy("node").select("r").collect()]  # FAN triangles at most
    r = stacked(left) if left else np.zeros((0, d))
    return np.vstack([r, np.zeros((max(0, d - len(r)), d))])


# Singular values and directions of the triangle.


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal and upper diagonal of U^T R V, and V's reflections: from entry k on, I - 2 v v^T."""
    a, d = r.copy(), len(r)
    turned: list[tuple[int, np.ndarray]] = []

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.abs(x[1:]).max(initial=0.0)
        if size == 0:
            return None
        v = x / max(size, abs(x[0]))
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k + 1 < d:
            v = reflector(a[k, k + 1 :])
            if v is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
                turned.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, 1).copy(), turned


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues, falling, of B^T B for the bidiagonal B with squared diagonal `q` and squared upper diagonal `e`.

    Each step is the factorisation of the product of the factors in the other order, less a shift; the shifts add up. A
    shift that makes a factor negative was too large and is halved, in the end to nothing. Values split off at the bottom,
    alone or two at a time, and the whole splits where an upper entry is negligible.
    """
    found: list[float] = []
    tiny = np.finfo(float).tiny
    work = [(q.tolist(), e.tolist(), 0.0)]
    while work:
        q, e, base = work.pop()
        while q:
            n = len(q)
            if n == 1:
                found.append(base + q[0])
                break
            if n == 2 or e[-2] <= EPS**2 * (base + q[-2]):
                found.extend(base + x for x in _two(q[-2], q[-1], e[-1]))
                q, e = q[:-2], e[: max(0, n - 3)]
                continue
            if e[-1] <= EPS**2 * (base + q[-1]):
                found.append(base + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            k = next((i for i in range(n - 3, -1, -1) if e[i] <= EPS**2 * (base + min(q[i], q[i + 1]))), None)
            if k is not None:
                work.append((q[: k + 1], e[:k], base))
                q, e = q[k + 1 :], e[k + 1 :]
                continue
            shift = max(0.0, min(_two(q[-2], q[-1], e[-1])) * (1 - 8 * EPS) - (e[-2] if n > 2 else 0.0))
            while True:
                new_q, new_e, d = [0.0] * n, [0.0] * (n - 1), q[0] - shift
                for i in range(n - 1):
                    new_q[i] = d + e[i]
                    if d < 0 or new_q[i] <= 0:
                        break
                    t = q[i + 1] / new_q[i] if new_q[i] > tiny else 0.0
                    new_e[i], d = e[i] * t, d * t - shift
                else:
                    new_q[-1] = d
                    if d >= 0:
                        break
                if shift == 0:  # a value of nothing: the last one
                    new_q = [max(x, 0.0) for x in new_q]
                    break
                shift = shift / 4 if shift > EPS * (base + tiny) else 0.0
            q, e, base = new_q, new_e, base + shift
            if max(q) <= tiny:
                found.extend([base] * len(q))
                break
    return np.array(sorted(found, reverse=True))


def _two(a: float, b: float, e: float) -> tuple[float, float]:
    """The eigenvalues of the last two rows: trace a + b + e, determinant a * b."""
    half = (a + b + e) / 2
    root = np.sqrt(max(0.0, ((a - b + e) / 2) ** 2 + b * e))
    high = half + root
    return (high, a * (b / high)) if high > 0 else (0.0, 0.0)


def twisted(diagonal: np.ndarray, l: np.ndarray, value: float, place: int | None = None) -> tuple[np.ndarray, float]:  # noqa: E741
    """The direction that L D L^T - value maps to a multiple of one unit vector, of length 1, and the Rayleigh correction of
    the value: factorisations from the top and from the bottom meet at `place`, or where least is left."""
    n = len(diagonal)
    ld = l * diagonal[:-1]
    top, s = np.empty(n - 1), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        plus = diagonal[i] + s[i] or EPS * EPS * (abs(value) + np.finfo(float).tiny)
        top[i] = ld[i] / plus
        s[i + 1] = top[i] * l[i] * s[i] - value
    up, p = np.empty(n - 1), np.empty(n)
    p[-1] = diagonal[-1] - value
    for i in range(n - 2, -1, -1):
        minus = ld[i] * l[i] + p[i + 1] or EPS * EPS * (abs(value) + np.finfo(float).tiny)
        t = diagonal[i] / minus
        up[i] = l[i] * t
        p[i] = p[i + 1] * t - value
    gamma = s + p + value
    r = int(np.argmin(np.abs(gamma))) if place is None else place
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -top[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -up[i] * z[i]
    size = z @ z
    return z / np.sqrt(size), gamma[r] / size


def below(diagonal: np.ndarray, l: np.ndarray, value: float) -> int:  # noqa: E741
    """How many eigenvalues of L D L^T are less than `value`."""
    s, count = -value, 0
    for i in range(len(l)):
        plus = diagonal[i] + s or -EPS * EPS * abs(value)
        count += plus < 0
        s = l[i] * (l[i] * diagonal[i] / plus) * s - value
    return count + (diagonal[-1] + s < 0)


def directions(q: np.ndarray, e: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """The first `k` eigenvectors, as columns, of B^T B with these eigenvalues (falling)."""
    n = len(q)
    if n == 1:
        return np.ones((1, 1))
    diagonal, l = q, np.sqrt(e / np.where(q[:-1] > 0, q[:-1], 1.0))  # B^T B = L D L^T with D of the squares and L of the quotients
    out, a = np.zeros((n, k)), 0
    while a < k:
        b = a + 1
        while b < n and values[b - 1] - values[b] <= CLOSE * values[b - 1]:
            b += 1
        if b - a == 1:
            shift, ds, ls = 0.0, diagonal, l
        else:  # just above the cluster all of it is small and negative
            shift = values[a] * (1 + 4 * n * EPS)
            ds, ls, s = np.empty(n), np.empty(n - 1), -shift
            for i in range(n - 1):
                ds[i] = diagonal[i] + s or EPS * shift
                ls[i] = l[i] * diagonal[i] / ds[i]
                s = ls[i] * l[i] * s - shift
            ds[-1] = diagonal[-1] + s
        for j in range(a, min(b, k)):
            value = values[j] - shift
            if shift:  # the j-th from above, told apart by counting
                low, high = values[b - 1] - shift - CLOSE * shift, 4 * n * EPS * shift
                while high - low > 2 * EPS * max(abs(low), abs(high)):
                    mid = (low + high) / 2
                    if mid in (low, high):
                        break
                    low, high = (low, mid) if n - below(ds, ls, mid) <= j else (mid, high)
                value = (low + high) / 2
            for _ in range(4):
                z, more = twisted(ds, ls, value)
                if abs(more) <= 4 * EPS * abs(value):
                    break
                value += more
            for place in range(n + 1):  # values that are equal to double precision: any twist that gives a new direction
                rest = z - out[:, a:j] @ (out[:, a:j].T @ z)
                if np.linalg.norm(rest) > 0.1:
                    break
                z, _ = twisted(ds, ls, value, place % n)
            rest /= np.linalg.norm(rest)
            rest -= out[:, a:j] @ (out[:, a:j].T @ rest)
            out[:, j] = rest / np.linalg.norm(rest)
        a = b
    return out


def principal(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The `k` greatest singular values of the triangle, or as many as aren't nothing, falling, and their right directions
    as columns."""
    d = len(r)
    size = np.abs(r).max(initial=0.0)
    if not d or size == 0:
        return np.zeros(0), np.zeros((d, 0))
    main, upper, turned = bidiagonal(r / size)
    q, e = main**2, upper**2
    norm = q.max() + e.max(initial=0.0)
    q = np.maximum(q, norm * EPS**4)  # nothing, to double precision, keeps its factor
    ends = [*(np.flatnonzero(e <= norm * EPS**2) + 1).tolist(), d]
    found: list[tuple[float, int, int, np.ndarray]] = []  # of each part between upper entries of nothing
    for begin, end in zip([0, *ends], ends, strict=False):
        own = dqds(q[begin:end], e[begin : end - 1])
        found += [(x, begin, j, own) for j, x in enumerate(own[:k].tolist()) if x > norm * (d * EPS) ** 2]
    found = sorted(found, key=lambda f: -f[0])[:k]
    values, v = np.array([f[0] for f in found]), np.zeros((d, len(found)))
    for begin, end in zip([0, *ends], ends, strict=False):
        mine = [c for c, f in enumerate(found) if f[1] == begin]
        if mine:
            v[begin:end, mine] = directions(q[begin:end], e[begin : end - 1], found[mine[0]][3], len(mine))
    sign = np.concatenate([[1.0], np.cumprod(np.where(main[:-1] * upper < 0, -1.0, 1.0))])  # L's entries are taken as positive
    v = v * sign[:, None]
    for at, w in reversed(turned):
        v[at:] -= 2 * np.outer(w, w @ v[at:])
    return np.sqrt(values) * size, v


# The model and its use.


@dataclass(frozen=True)
class Whitening:
    """n and S of the fit list, component directions (a row each), their variances, their shares of the variance of all
    dimensions, and how far the covariance of the whitened fit list is from the identity."""

    n: int
    total: tuple[int, ...]
    directions: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(vectors: DataFrame, components: int = 4, vector_col: str = "embedding") -> Whitening:
    """Components by falling variance, of each distinct vector of whole numbers once. A null vector, or one with null or
    non-finite entries, takes no part; vectors of different lengths fail the job. Components without variance are left out,
    so an empty table, or copies of one vector, give none."""
    own = distinct_vectors(vectors, vector_col)
    n, total = sums(own)
    r = triangle(own, n, total) if n else np.zeros((0, 0))
    sigma, v = principal(r, components)
    variances = sigma**2 / max(n, 1)
    trace = float((r**2).sum()) / max(n, 1)
    model = Whitening(n, tuple(total), v.T.copy(), variances, variances / trace if trace else variances, 0.0)
    return Whitening(*(getattr(model, f) for f in ("n", "total", "directions", "variances", "explained")), _identity_error(own, model))


def _identity_error(own: DataFrame, model: Whitening) -> float:
    """The covariance of the whitened fit list, centred before multiplying, against the identity."""
    k = len(model.variances)
    if not k:
        return 0.0

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(it):
            w = projected(centred(x, model.n, np.array(model.total, object)), model)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(k)], names=[f"w{i}" for i in range(k)])

    w = own.mapInArrow(run, ", ".join(f"w{i} double" for i in range(k)))
    mean = w.agg(*(F.avg(f"w{i}").alias(f"w{i}") for i in range(k))).first()
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    got = w.agg(*(F.avg((F.col(f"w{i}") - mean[i]) * (F.col(f"w{j}") - mean[j])).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(got[m] - (i == j)) for m, (i, j) in enumerate(pairs))


def projected(c: np.ndarray, model: Whitening) -> np.ndarray:
    return (c.astype(float) / model.n) @ model.directions.T / np.sqrt(model.variances)


def whiten(vectors: DataFrame, model: Whitening, vector_col: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The columns of `vectors` (or those of `keep`), component (from 1), n, deviation (the exact sum over dimensions of
    (n * x - S)^2, null where a long can't hold it), whitened, explained and identity_error: a row for each vector that holds
    finite numbers only and each component. Columns named like the added ones, in letters of either case, are replaced. One
    pass without a shuffle."""
    added = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    kept = [f for f in others(vectors, *added) if keep is None or f.name in keep]
    k = len(model.variances)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(model.total, object)
        for whole_batch in it:
            for at in range(0, whole_batch.num_rows, BLOCK_ROWS):
                batch = whole_batch.slice(at, BLOCK_ROWS)
                rows, x = whole(batch.column(len(kept)))
                m = len(rows)
                c = centred(x, model.n, total) if m else np.zeros((0, len(total)), np.int64)
                if c.dtype == object or c.shape[1] * float(np.abs(c).max(initial=0)) ** 2 >= 2.0**62:
                    deviation = [s if s < 1 << 63 else None for s in (c.astype(object) ** 2).sum(axis=1).tolist()]
                else:
                    deviation = (c**2).sum(axis=1).tolist()
                w = projected(c, model).ravel()
                index = pa.array(np.repeat(rows, k), pa.int64())
                cols = [batch.column(i).take(index) for i in range(len(kept))]
                cols += [pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()), pa.array([s for s in deviation for _ in range(k)], pa.int64())]
                cols += [pa.array(w), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error))]
                yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in kept), *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"])
    return vectors.select(*(F.col(f.name) for f in kept), F.col(vector_col).cast("array<double>").alias("_vector")).mapInArrow(run, schema)
