"""Whitening of embeddings by QDWH spectral divide and conquer (operator 12).

Entries are cut to whole numbers (``floor(256 * c)``), so copies are equal exactly and sums are
exact in any order. Each distinct vector is in the fit list once. Tasks send one partial sum of the
list, then one partial covariance, centred before multiplying.

The covariance, a matrix of the vectors' width, is taken apart on the driver: the unitary polar
factor of ``A - shift`` is 1 on the eigenvectors above the shift and -1 on those below, so it
gives the projectors on both invariant subspaces. An orthonormal basis of each leaves two smaller
problems, until single directions (or multiples of the identity) remain. The polar factor comes
from the QR-based, dynamically weighted Halley iteration. The projection is
broadcast; it has the width of a vector and as many columns as components are asked for.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegate.llm.common import staged

SCALE = 256
#: Rows of one product; a batch is cut to it.
ROWS = 4096
_EDGE = 2.0 ** 62


def polar(a: np.ndarray) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix by QDWH; its signs are those of ``a``."""
    size = len(a)
    norm = np.linalg.norm(a)
    x = a / norm
    # a lower bound of the smallest singular value; too small a one only costs steps
    low = max(1 / (np.linalg.norm(np.linalg.inv(x + 0.0), 1) * np.sqrt(size)), 1e-16)
    eye = np.eye(size)
    for _ in range(40):
        root = np.cbrt(4 * (1 - low ** 2) / low ** 4)
        first = np.sqrt(1 + root)
        one = first + np.sqrt(max(8 - 4 * root + 8 * (2 - low ** 2) / (low ** 2 * first), 0)) / 2
        two = (one - 1) ** 2 / 4
        three = one + two - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(three) * x, eye]))
        fresh = two / three * x + (one - two / three) / np.sqrt(three) * (q[:size] @ q[size:].T)
        fresh = (fresh + fresh.T) / 2
        moved = np.linalg.norm(fresh - x)
        x = fresh
        low = min(low * (one + two * low ** 2) / (1 + three * low ** 2), 1.0)
        if moved < 1e-11 and abs(1 - low) < 1e-11:
            break
    return x


def _bases(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the range of a projector and of what is orthogonal to it."""
    order = np.argsort(-np.diag(projector), kind="stable")
    start = projector[:, order[:rank]]
    # a mix of all columns, so that no direction is missing from the first ``rank`` of them
    blend = np.random.default_rng(rank).standard_normal((len(projector), rank))
    q, _ = np.linalg.qr(projector @ (start + projector @ blend / np.sqrt(len(projector))))
    full, _ = np.linalg.qr(np.hstack([projector @ q, np.eye(len(projector)) - projector]))
    rest = np.eye(len(projector)) - full[:, :rank] @ full[:, :rank].T
    other, _ = np.linalg.qr(rest @ np.random.default_rng(rank + 1).standard_normal(
        (len(projector), len(projector) - rank)))
    return full[:, :rank], other


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and orthonormal eigenvectors of a symmetric matrix."""
    scale = np.linalg.norm(a)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    open_parts = [(a, np.eye(len(a)))]
    while open_parts:
        part, basis = open_parts.pop()
        size, middle = len(part), np.trace(part) / max(len(part), 1)
        if size == 0:
            continue
        if size == 1 or np.linalg.norm(part - middle * np.eye(size)) <= 4e-16 * size * scale:
            values += np.diag(part).tolist()
            vectors += list(basis.T)
            continue
        above, below = _split(part, middle)
        for own in (above, below):
            inner = own.T @ part @ own
            open_parts.append(((inner + inner.T) / 2, basis @ own))
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors)[order].T if len(vectors) else np.eye(0)


def _split(part: np.ndarray, middle: float) -> tuple[np.ndarray, np.ndarray]:
    """Bases of the invariant subspaces above and below a shift."""
    size = len(part)
    spread = np.linalg.norm(part - middle * np.eye(size))
    # the median splits evenly; the mean always has eigenvalues on both sides
    shifts = [np.median(np.diag(part)), middle]
    shifts += [middle + spread * step for step in (1e-3, -1e-3, 3e-2, -3e-2, 1e-1, -1e-1)]
    best = None
    for shift in shifts:
        moved = part - shift * np.eye(size)
        try:
            unitary = polar(moved)
        except np.linalg.LinAlgError:  # an eigenvalue is the shift itself
            continue
        projector = (unitary + np.eye(size)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < size or not np.isfinite(unitary).all():
            continue
        above, below = _bases(projector, rank)
        off = np.linalg.norm(above.T @ part @ below)
        if best is None or off < best[0]:
            best = off, above, below
        if off <= 1e-14 * size * np.linalg.norm(part):
            break
    if best is None:
        raise ArithmeticError("no shift separates the spectrum")
    return best[1], best[2]


@dataclass
class Whitening:
    """What is broadcast: sizes of the vectors' width times the number of components."""
    width: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column per component; NaN where a component has no variance."""
        mean = np.array([s / self.n for s in self.sums])
        scale = np.sqrt(np.where(self.values > 0, self.values, np.nan))
        return (x - mean) @ self.vectors / scale


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose vector can be used, and x of all of them with the bounds of each.

    Vectors that are null or empty, or hold a null, a NaN, an infinity or an entry beyond the
    whole numbers of 64 bits, can't be used.
    """
    wide = column.cast(pa.large_list(pa.float64()))
    sizes = np.asarray(wide.value_lengths().fill_null(0), np.int64)
    flat = wide.flatten()
    bounds = np.append(0, np.cumsum(sizes))
    values = flat.to_numpy(zero_copy_only=False)
    with np.errstate(all="ignore"):
        scaled = np.floor(values * SCALE)
        # a null entry is a NaN here
        bad = ~(np.abs(scaled) < _EDGE)
    total = np.append(0, np.cumsum(bad))
    rows = np.flatnonzero((total[bounds[1:]] == total[bounds[:-1]]) & (sizes > 0))
    inside = np.repeat((total[bounds[1:]] == total[bounds[:-1]]) & (sizes > 0), sizes)
    return rows, scaled[inside].astype(np.int64), np.append(0, np.cumsum(sizes[rows]))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Width and x of each vector, as bytes."""
    for batch in batches:
        _, x, bounds = whole_vectors(batch.column(0))
        raw = x.tobytes()
        yield pa.RecordBatch.from_pydict({
            "width": np.diff(bounds).astype(np.int32),
            "x": pa.array([raw[8 * a:8 * b] for a, b in zip(bounds[:-1], bounds[1:])],
                          pa.binary())})


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, width)


def _sums(fit: DataFrame) -> tuple[int, int, list[int]] | None:
    """Width of most fit vectors (the larger of two), their number and exact sums."""
    widths = fit.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    if widths is None:
        return None
    width = widths["width"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            x = _matrix(batch.column(0), width)
            if len(x) and float(np.abs(x).max()) * len(x) < _EDGE:
                total = [a + b for a, b in zip(total, x.sum(axis=0).tolist())]
            else:
                total = [a + b for a, b in zip(total, x.astype(object).sum(axis=0))
                         ] if len(x) else total
        yield pa.RecordBatch.from_pydict({
            "place": np.arange(width, dtype=np.int32),
            "total": pa.array([str(t) for t in total])})

    rows = fit.filter(F.col("width") == width).select("x").mapInArrow(
        add, "place int, total string").groupBy("place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("place").collect()
    return width, widths["count"], [int(row["total"]) for row in rows]


def _covariance(fit: DataFrame, rows: object, size: int, n: int) -> np.ndarray:
    """``rows(x)`` gives centred rows; their products over ``n``, from one matrix per task."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = rows(batch.column(0).slice(at, ROWS))
                total += own.T @ own
        high, low = np.triu_indices(size)
        yield pa.RecordBatch.from_pydict({
            "high": high.astype(np.int32), "low": low.astype(np.int32), "v": total[high, low]})

    found = fit.mapInArrow(add, "high int, low int, v double").groupBy("high", "low").agg(
        F.sum("v").alias("v")).toArrow()
    out = np.zeros((size, size))
    high, low = found.column("high").to_numpy(), found.column("low").to_numpy()
    out[high, low] = out[low, high] = found.column("v").to_numpy() / n
    return out


def fit_whitening(vectors: DataFrame, embedding: str = "embedding",
                  components: int | None = None) -> Whitening | None:
    """Whitening of the distinct vectors, or None without any that can be used."""
    fit = staged(vectors.select(embedding).mapInArrow(
        _packed, "width int, x binary").distinct(), "vectors")
    found = _sums(fit)
    if found is None:
        return None
    width, n, sums = found
    mean = np.array([s / n for s in sums])
    own = fit.filter(F.col("width") == width).select("x")
    covariance = _covariance(own, lambda column: _matrix(column, width) - mean, width, n)
    values, basis = spectrum(covariance)
    # what is not told from 0 in double precision has no direction of its own
    values = np.where(values > 1e-14 * width * max(values[0], 0), values, 0.0)
    count = min(components or width, width)
    model = Whitening(width, n, sums, values[:count], basis[:, :count], np.trace(covariance))
    real = int((model.values > 0).sum())
    if real:
        gap = _covariance(own, lambda column: model.whitened(_matrix(column, width))[:, :real],
                          real, n) - np.eye(real)
        model.identity_error = float(np.abs(gap).max())
    return model


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2; None beyond 64 bits."""
    n, sums = model.n, model.sums
    most = (float(np.abs(x).max(initial=0)) * n + max(abs(s) for s in sums)) ** 2 * model.width
    if most < _EDGE:
        return ((n * x - np.array(sums)) ** 2).sum(axis=1).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int | None = None, id_column: str = "vec_id",
           embedding: str = "embedding") -> DataFrame:
    """One row per usable vector: its id, n, deviation, whitened, explained, identity_error.

    ``whitened`` and ``explained`` are arrays with an entry per component. Vectors that are null
    or empty, or hold a null, NaN, infinite or over-large entry, give no row; nor do vectors of
    another width than most distinct ones have. Equal vectors count once in the fit and get equal
    results; ids may be null or repeated. A component without variance has null in ``whitened``,
    and all of ``explained`` and ``identity_error`` are null if no component has any. A
    deviation beyond 64 bits is null. Without usable vectors there are no rows. Other columns are
    left out.
    """
    model = fit_whitening(vectors, embedding, components)
    own_id = vectors.schema[id_column].dataType.simpleString()
    schema = (f"`{id_column}` {own_id}, n long, deviation long, whitened array<double>, "
              "explained array<double>, identity_error double")
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        count = len(model.values)
        explained = (model.values / model.trace).tolist() if model.trace > 0 else [None] * count
        for batch in batches:
            rows, x, bounds = whole_vectors(batch.column(1))
            sizes = np.diff(bounds)
            fits = sizes == model.width
            x = x[np.repeat(fits, sizes)].reshape(-1, model.width)
            rows = rows[fits]
            flat = pa.array(model.whitened(x).ravel(), from_pandas=True)
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * count)
            yield pa.RecordBatch.from_pydict({
                id_column: batch.column(0).take(pa.array(rows)),
                "n": pa.array([model.n] * len(rows), pa.int64()),
                "deviation": pa.array(_deviations(x, model), pa.int64()),
                "whitened": pa.ListArray.from_arrays(ends, flat),
                "explained": pa.array([explained] * len(rows), pa.list_(pa.float64())),
                "identity_error": pa.array([model.identity_error] * len(rows), pa.float64())})

    return vectors.select(id_column, embedding).mapInArrow(make, schema)
