"""Whitening of embeddings by an exact, bit-sliced scatter matrix.

Every entry c becomes the integer x = floor(64 * c) + 1000000. The fit list is
each distinct x vector once: rows are packed into short byte strings and made
distinct by Spark. A task then takes its vectors in blocks, shifts each
dimension to start at zero, and packs every bit plane of it over the rows into
64-bit words; the product sum of two dimensions is the weighted sum of the
popcounts of their planes' ANDs, so it is exact whatever the size of the
entries. Tasks give their sums as integers, Spark adds them as decimals, and
the driver centres them as integers (n * sum(xy) - sum(x) * sum(y)) before the
matrix becomes floating point and goes to ``eigh``. What the driver holds, and
what is broadcast, is a matrix of the vectors' width, whatever the rows.

Defined results: rows whose vector is null or holds null or non-finite entries
go, as do rows with an entry too large for an exact integer (64 * c beyond
2**52); an empty vector has no components and so no rows; vectors of another
width are a space of their own, with a fit list of its own; a direction without
variance (fewer distinct vectors than dimensions, a constant dimension) has
``explained`` 0 and ``whitened`` null, and doesn't count for the identity error;
a ``deviation`` beyond a long is null; repeated rows stay in the result and
count once in the fit; a null id stays; an empty table gives no rows; other
columns are ignored, or pass with :func:`whiten`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitflow.session import fresh

#: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Rows of a block of bit planes.
BLOCK = 1 << 14
#: Entries beyond this have no exact place between the integers.
LARGEST = 1 << 52
#: Sums travel in two parts, of which the lower has so many bits.
LOW = 60


def _matrices(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the rows in the column, their x - SHIFT as longs), a matrix for each width, of the rows that remain."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    here = np.flatnonzero(np.asarray(column.is_valid()))
    full = column.take(pa.array(here))
    sizes = np.diff(np.asarray(full.offsets))
    flat = np.asarray(full.values.cast(pa.float64()).fill_null(np.nan))[full.offsets[0].as_py() : full.offsets[-1].as_py()] if len(full) else np.empty(0)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    for width in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == width)
        c = SCALE * flat[begins[rows][:, None] + np.arange(width)]
        good = (np.isfinite(c) & (np.abs(c) < LARGEST)).all(axis=1)
        if good.any():
            yield here[rows[good]], np.floor(c[good]).astype(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(width, bytes an entry, entries) of each vector: the fewest bytes that hold its entries, so equal vectors are equal strings."""
    for batch in batches:
        for _, x in _matrices(batch.column(0)):
            most = np.abs(x).max(axis=1)
            size = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
            for k in map(int, np.unique(size)):
                rows = x[size == k].astype(f"<i{k}")
                code = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * (x.shape[1] * k)), pa.py_buffer(rows.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), x.shape[1], np.int32)), pa.array(np.full(len(rows), k, np.int32)), code], ["width", "size", "code"])


def planes(y: np.ndarray) -> tuple[np.ndarray, int]:
    """Bit planes of a matrix of integers of at least 0: words of 64 rows, planes of a dimension together, and their number."""
    bits = max(1, int(y.max()).bit_length())
    words = -(-len(y) // 64)
    out = np.zeros((y.shape[1], bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((y >> b) & 1).astype(np.uint8).T, axis=1)
        out[:, b, : packed.shape[1]] = packed
    return out.reshape(y.shape[1] * bits, -1).view(np.uint64), bits


def cross_products(y: np.ndarray) -> np.ndarray:
    """Exact sums of y[:, i] * y[:, j] for i <= j (rows of a block, entries of at least 0), as Python integers or longs where these suffice."""
    p, bits = planes(y)
    d = y.shape[1]
    kind = np.int64 if 2 * bits + len(y).bit_length() < 63 else object
    weight = np.array([1 << b for b in range(bits)], kind)
    out = np.zeros((d, d), kind)
    scratch = np.empty_like(p)
    for i in range(d):
        rest = scratch[: len(p) - i * bits]
        for b in range(bits):
            np.bitwise_and(p[i * bits + b], p[i * bits :], out=rest)
            counts = np.bitwise_count(rest).sum(axis=1, dtype=np.int64).reshape(d - i, bits)
            out[i, i:] += (counts.astype(kind) @ weight) * (1 << b)
    return out


class _Sums:
    """Number, sums and product sums of one width, kept as Python integers."""

    def __init__(self, width: int):
        self.n, self.sums, self.products = 0, np.zeros(width, object), np.zeros((width, width), object)

    def add(self, x: np.ndarray) -> None:
        low = x.min(axis=0)
        y = x - low
        s, m = y.sum(axis=0, dtype=object), low.astype(object)
        self.n += len(x)
        self.sums += s + len(x) * m
        self.products += np.triu(cross_products(y).astype(object) + np.outer(m, s) + np.outer(s, m) + len(x) * np.outer(m, m))


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task: (width, i, j, upper part, lower part); j = -1 is the sum of dimension i, i = -1 the number of vectors."""
    found: dict[int, _Sums] = {}
    waiting: dict[tuple[int, int], list[bytes]] = {}

    def flush(key: tuple[int, int]) -> None:
        width, size = key
        x = np.frombuffer(b"".join(waiting.pop(key)), f"<i{size}").reshape(-1, width).astype(np.int64)
        found.setdefault(width, _Sums(width)).add(x)

    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for key, code in zip(keys, batch.column(2).to_pylist(), strict=True):
            rows = waiting.setdefault(key, [])
            rows.append(code)
            if len(rows) == BLOCK:
                flush(key)
    for key in list(waiting):
        flush(key)
    for width, s in found.items():
        i, j = np.triu_indices(width)
        i, j = np.concatenate([[-1], np.arange(width), i]), np.concatenate([[-1], np.full(width, -1), j])
        values = [s.n, *s.sums, *s.products[np.triu_indices(width)]]
        parts = [[str(v >> LOW) for v in values], [v & ((1 << LOW) - 1) for v in values]]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), width, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(parts[0]), pa.array(parts[1], pa.int64())], ["width", "i", "j", "upper", "lower"])


@dataclass(frozen=True)
class Whitening:
    """What a space of one width has been fitted to."""

    n: int
    #: Sums of x - SHIFT a dimension.
    sums: tuple[int, ...]
    #: Unit eigenvectors as columns, by falling eigenvalue.
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


def refine(a: np.ndarray, x: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of ``a`` from near ones, in long doubles (Ogita and Aishima 2018), so that small eigenvalues beside large ones keep their digits."""
    x = x.astype(np.longdouble)
    for _ in range(rounds):
        r = np.eye(len(a)) - x.T @ x
        s = x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= np.abs(values).max(initial=0) * 1e-15
        x = x + x @ np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
    return np.diag(x.T @ a @ x) / np.diag(x.T @ x), x


def solve(n: int, sums: list[int], products: np.ndarray, components: int) -> Whitening:
    """Eigenvectors of the exact covariance; products are sums of (x - SHIFT)(y - SHIFT), upper half."""
    s = np.array(sums, object)
    centred = n * (products + np.triu(products, 1).T) - np.outer(s, s)
    trace = float(sum(centred[i, i] for i in range(len(s)))) / (n * n)
    v = (centred / (n * n)).astype(np.longdouble) if n * n < 1 << 52 else np.array([[np.longdouble(str(c)) for c in row] for row in centred]) / np.longdouble(n) ** 2
    values, vectors = refine(v, np.linalg.eigh(v.astype(float))[1])
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order].astype(float), vectors[:, order].astype(float)
    flat = values <= max(trace, 1e-300) * len(s) * 1e-17
    values = np.where(flat, 0.0, values)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    w = vectors[:, ~flat] / np.sqrt(values[~flat])
    error = float(np.abs(w.T @ v @ w - np.eye(w.shape[1])).max()) if w.shape[1] else 0.0  # of the doubles that rows are multiplied with
    return Whitening(n, tuple(map(int, s)), vectors, values, values / trace if trace else np.zeros_like(values), error)


def fit(rows: DataFrame, vector: str = "embedding", components: int = 16) -> dict[int, Whitening]:
    """The whitening of each width of ``rows``' vectors."""
    codes = rows.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(_pack, "width int, size int, code binary").distinct()
    sums = codes.mapInArrow(_scatter, "width int, i int, j int, upper string, lower bigint").groupBy("width", "i", "j")
    total = sums.agg(F.sum(F.col("upper").cast("decimal(38,0)")).cast("string").alias("upper"), F.sum(F.col("lower").cast("decimal(38,0)")).cast("string").alias("lower"))
    by: dict[int, dict] = {}
    for r in total.toLocalIterator():
        by.setdefault(r.width, {})[r.i, r.j] = (int(r.upper) << LOW) + int(r.lower)
    fitted = {}
    for width, cells in by.items():
        products = np.zeros((width, width), object)
        for i in range(width):
            for j in range(i, width):
                products[i, j] = cells[i, j]
        fitted[width] = solve(cells[-1, -1], [cells[i, -1] for i in range(width)], products, components)
    return fitted


def _deviations(x: np.ndarray, m: Whitening) -> tuple[np.ndarray, list[int | None]]:
    """n * x - S of every entry as doubles, and the sum of its squares as integers (None beyond a long)."""
    s = np.array(m.sums, object)
    most = m.n * int(np.abs(x).max()) + max(map(abs, m.sums))
    if most * most * x.shape[1] < 1 << 63:
        centred = m.n * x - s.astype(np.int64)
        return centred.astype(float), (centred * centred).sum(axis=1).tolist()
    centred = m.n * x.astype(object) - s
    squares = (centred * centred).sum(axis=1).tolist()
    return centred.astype(float), [q if q < 1 << 63 else None for q in squares]


def whiten(rows: DataFrame, vector: str = "embedding", keep: list[str] | None = None, components: int = 16, fitted: dict[int, Whitening] | None = None) -> DataFrame:
    """A row for each remaining row of ``rows`` and component: the columns ``keep``, then component, n, deviation, whitened, explained and identity_error.

    ``fitted`` (of :func:`fit`, perhaps on another table) decides the components; without it the rows' own are taken.
    Vectors of a width that hasn't been fitted give no rows.
    """
    fitted = fit(rows, vector, components) if fitted is None else fitted
    kept = [f for f in rows.schema.fields if f.name in (rows.columns if keep is None else keep) and f.name != vector]
    pre = fresh([f.name for f in kept]) if {f.name.lower() for f in kept} & {"component", "n", "deviation", "whitened", "explained", "identity_error"} else ""
    added = T._parse_datatype_string(f"{pre}component int, {pre}n bigint, {pre}deviation bigint, {pre}whitened double, {pre}explained double, {pre}identity_error double")

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in _matrices(batch.column(0)):
                m = fitted.get(x.shape[1])
                if m is None:
                    continue
                centred, squares = _deviations(x, m)
                flat = m.values == 0
                z = (centred / m.n) @ (m.vectors / np.sqrt(np.where(flat, 1.0, m.values)))
                z[:, flat] = np.nan
                k = len(m.values)
                at = pa.array(np.repeat(places, k))
                tile = lambda v: pa.array(np.tile(v, len(places)))
                cells = [batch.column(c).take(at) for c in range(1, batch.num_columns)]
                cells += [tile(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(len(at), m.n)), pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(len(places)), k)))]
                cells += [pa.array(z.ravel(), from_pandas=True), tile(m.explained), pa.array(np.full(len(at), m.identity_error))]
                yield pa.RecordBatch.from_arrays(cells, [f.name for f in [*kept, *added.fields]])

    return rows.select(F.col(vector).cast("array<double>").alias(vector), *[f.name for f in kept]).mapInArrow(transform, T.StructType([*kept, *added.fields]))
