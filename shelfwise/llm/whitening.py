"""Operator 12: whitening of embeddings by an incremental eigendecomposition.

The vectors in whole numbers, each distinct one once, are the fit list. A Spark
task keeps the spectrum of what it has seen: the count, the mean, and
eigenvalues and eigenvectors of the scatter about that mean. Centred rows enter
it as rank-one updates. An update writes the row in the present eigenvectors;
entries of no weight and equal eigenvalues are deflated; the other new
eigenvalues are the roots of the secular equation between the old ones, found
for all of them at once by rational interpolation inside their brackets; and the
weights are computed anew from the roots, so that the new eigenvectors are
orthogonal to working precision. A block of rows about its own mean is turned
first (QR) into at most as many rows as it has dimensions with the same scatter,
and each of them is one update. Two spectra are combined in the same way: the
second one's eigenvectors, scaled, are successive rank-one updates of the
first, and the difference of the means is one more. Tasks' spectra are combined
in groups of bounded size, round by round.

The basis found so is refined by a Rayleigh-Ritz step over the whole fit list:
tasks add up the covariance in that basis, centred before multiplying on the
exact mean, and its small eigenproblem turns the basis. A second pass over the
fit list measures what whitening then leaves of the covariance.

The driver holds one matrix of as many rows and columns as a vector has
dimensions, never vectors.

Defined results: vectors that are null or hold null or non-finite components
take no part and get no rows; repeated ids each get their rows; a null id is
kept. Vectors of different lengths are tables of their own, one after the other;
a vector without components gets no rows. Components beyond 64 bits after
scaling are held at the largest 64-bit numbers. A component whose eigenvalue is
zero (to rounding, against the largest) cannot be whitened: ``whitened`` is null
there, and ``explained`` is null where the whole covariance is zero. Equal
eigenvalues take any basis of their space. ``deviation`` is null beyond 38
digits. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import keep

BLOCK = 4096  # rows turned into updates at a time
GROUP_BYTES = 32 << 20  # spectra combined by one task, at most; two at least

STATE = "part long, n long, sums array<decimal(38,0)>, mean binary, values binary, vectors binary"
RESULT = (
    "id {id}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
)
EPS = float(np.finfo(np.float64).eps)
STEPS = 80


def _secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(weights / (poles - x))``: ``poles`` ascend, ``weights`` are positive.

    Returns for each root the pole that it is measured from and its distance:
    the nearer pole, so that differences with all poles keep their digits.
    """
    k = len(poles)
    upper = np.append(poles[1:], poles[-1] + weights.sum())
    width = upper - poles
    column = np.arange(k)

    def parts(origin, at):
        gap = (poles[None, :] - origin[:, None]) - at[:, None]
        term = weights / gap
        slope = term / gap
        left = column[None, :] <= column[:, None]
        return gap, (term * left).sum(1), (term * ~left).sum(1), (slope * left).sum(1), (slope * ~left).sum(1)

    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        _, low, high, _, _ = parts(poles, width / 2)
        from_left = (1 + low + high >= 0) | (column == k - 1)
        origin = np.where(from_left, poles, upper)
        near = np.where(from_left, column, np.minimum(column + 1, k - 1))
        last = column == k - 1
        # The last root has no pole above it: its bracket ends at the sum of all weights.
        lo = np.where(from_left, 0.0, -width / 2)
        hi = np.where(from_left & ~last, width / 2, np.where(last, width, 0.0))
        x = (lo + hi) / 2
        for _ in range(STEPS):
            gap, low, high, low_slope, high_slope = parts(origin, x)
            value = 1 + low + high
            lo, hi = np.where(value < 0, x, lo), np.where(value >= 0, x, hi)
            # Interpolate the sums over the poles on each side by one pole each, which gives a quadratic.
            a = gap[column, column]
            b = np.where(last, 1.0, gap[column, np.minimum(column + 1, k - 1)])
            s, t = low_slope * a * a, np.where(last, 0.0, high_slope * b * b)
            c = 1 + (low - low_slope * a) + np.where(last, 0.0, high - high_slope * b)
            p, q = c * (a + b) + s + t, value * a * b
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            step = np.where(last, a + s / c, step)
            new = x + step
            inside = (new > lo) & (new < hi)
            new = np.where(inside, new, (lo + hi) / 2)
            settled = np.abs(value) <= 4 * EPS * k * (1 + np.abs(low) + np.abs(high))
            settled |= np.abs(new - x) <= EPS * np.abs(new)
            x = np.where(settled & (x != 0), x, new)
            if settled.all():
                break
    return near, x


def rank_one_update(values: np.ndarray, vectors: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``vectors diag(values) vectors' + row row'``."""
    z = row @ vectors
    norm2 = float(z @ z)
    if not norm2 > 0:
        return values, vectors
    tolerance = 8 * EPS * max(float(np.abs(values).max(initial=0)), norm2)
    vectors = vectors.copy()
    # Equal eigenvalues: a reflection inside their space leaves the row's weight in one of its directions.
    for run in np.split(np.arange(len(values)), np.flatnonzero(np.diff(values) > tolerance) + 1):
        if len(run) == 1 or np.abs(z[run[:-1]]).max() == 0:
            continue
        size = np.linalg.norm(z[run])
        mirror = z[run].copy()
        sign = -1.0 if mirror[-1] < 0 else 1.0
        mirror[-1] += sign * size
        mirror /= np.linalg.norm(mirror)
        vectors[:, run] -= np.outer(2 * (vectors[:, run] @ mirror), mirror)
        z[run] = 0
        z[run[-1]] = -sign * size
    active = np.flatnonzero(np.abs(z) * np.sqrt(norm2) > tolerance)
    if not len(active):
        return values, vectors
    poles = values[active]
    near, distance = _secular_roots(poles, z[active] ** 2)
    # gap[i, j] = poles[j] - root[i], to full relative precision.
    gap = (poles[None, :] - poles[near][:, None]) - distance[:, None]
    # The weights for which the computed roots are exact.
    spread = poles[:, None] - poles[None, :]
    np.fill_diagonal(spread, 1.0)
    logs = np.log(np.maximum(np.abs(gap), np.finfo(float).tiny)).sum(0) - np.log(np.abs(spread)).sum(0)
    weight = np.exp(logs / 2) * np.where(z[active] < 0, -1.0, 1.0)
    turned = weight / gap
    turned /= np.linalg.norm(turned, axis=1)[:, None]
    new_values = values.copy()
    new_values[active] = poles[near] + distance
    vectors[:, active] = vectors[:, active] @ turned.T
    order = np.argsort(new_values, kind="stable")
    return new_values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, exact sums, mean, and eigenpairs of the scatter about the mean of some vectors."""

    n: int
    sums: np.ndarray  # Python integers
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim, dtype=object), np.zeros(dim), np.zeros(dim), np.eye(dim))

    def _update(self, rows: np.ndarray) -> None:
        for row in rows:
            self.values, self.vectors = rank_one_update(self.values, self.vectors, row)

    def _shift(self, n: int, mean: np.ndarray, sums: np.ndarray) -> None:
        """Account for the distance of another group's mean, and take its count and sums in."""
        total = self.n + n
        self._update(np.sqrt(self.n / total * n) * (mean - self.mean)[None, :])
        self.mean = self.mean + (mean - self.mean) * (n / total)
        self.n, self.sums = total, self.sums + sums

    def add(self, x: np.ndarray) -> None:
        """Take in the rows of ``x``, 64-bit integers."""
        for start in range(0, len(x), BLOCK):
            block = x[start : start + BLOCK]
            sums = _column_sums(block)
            mean = np.array([int(s) / len(block) for s in sums])
            rows = block - mean
            if len(rows) > rows.shape[1]:
                rows = np.linalg.qr(rows, mode="r")
            self._update(rows)
            self._shift(len(block), mean, sums)

    def combine(self, other: Spectrum) -> None:
        if other.n:
            self._update((other.vectors * np.sqrt(np.maximum(other.values, 0))).T[::-1])
            self._shift(other.n, other.mean, other.sums)

    def row(self, part: int) -> list:
        return [
            part, self.n, [Decimal(int(s)) for s in self.sums],
            self.mean.tobytes(), self.values.tobytes(), self.vectors.tobytes(),
        ]

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        mean, values = (np.frombuffer(row[c]) for c in ("mean", "values"))
        vectors = np.frombuffer(row["vectors"]).reshape(len(mean), len(mean))
        return cls(row["n"], np.array([int(s) for s in row["sums"]], dtype=object), mean, values, vectors)


def _column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums of columns, as Python integers."""
    top = int(np.abs(x, dtype=np.float64).max(initial=0)) + 1
    sums = x.sum(axis=0) if top * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
    return np.array([int(s) for s in sums], dtype=object)


STATE_TYPES = [
    ("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))),
    ("mean", pa.binary()), ("values", pa.binary()), ("vectors", pa.binary()),
]


def _states(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(STATE_TYPES)], [name for name, _ in STATE_TYPES]
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a column of lists of 64-bit integers, a row each."""
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, dim)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            yield batch.slice(start, BLOCK)


def _spectra(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = Spectrum.empty(dim)
        for batch in _batches(batches):
            seen.add(_matrix(batch.column("x"), dim))
        if seen.n:
            yield _states([seen.row(TaskContext.get().partitionId())])

    return run


def _combined(states: DataFrame, dim: int, name: str, add: Callable, scratch: str | None) -> dict | None:
    """One state for all, combined in rounds of groups whose size is bounded; None without any."""
    fan_in = max(2, min(32, GROUP_BYTES // (8 * dim * dim)))

    def merge(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([add(sorted(table.to_pylist(), key=lambda r: r["part"]))])

    states = keep(states, name, scratch)
    # Every state gets a number without gaps, so that groups are full: one small row per task.
    parts = {r["part"]: i for i, r in enumerate(states.select("part").orderBy("part").toLocalIterator())}
    if not parts:
        return None
    left = len(parts)
    if left > 1:
        numbers = states.sparkSession.createDataFrame(list(parts.items()), "part long, number long")
        states = states.join(F.broadcast(numbers), "part").withColumn("part", F.col("number")).drop("number")
    while left > 1:
        grouped = states.withColumn("part", F.floor(F.col("part") / fan_in)).select(*states.columns)
        states = keep(grouped.groupBy("part").applyInArrow(merge, states.schema), name, scratch)
        left = -(-left // fan_in)
    return states.first().asDict()


def _add_spectra(rows: list[dict]) -> pa.RecordBatch:
    total = Spectrum.of(rows[0])
    for row in rows[1:]:
        total.combine(Spectrum.of(row))
    return _states([total.row(rows[0]["part"])])


MOMENT = "part long, matrix binary"


def _moments(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["part", "matrix"]
    )


def _add_moments(rows: list[dict]) -> pa.RecordBatch:
    total = sum(np.frombuffer(r["matrix"]) for r in rows)
    return _moments([[rows[0]["part"], total.tobytes()]])


def _projected_moments(dim: int, mean: np.ndarray, basis: np.ndarray):
    """Per task: the sum of ``y y'`` over its vectors, where ``y`` is the centred vector in ``basis``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in _batches(batches):
            y = (_matrix(batch.column("x"), dim) - mean) @ basis
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield _moments([[TaskContext.get().partitionId(), total.tobytes()]])

    return run


@dataclass
class Whitening:
    """A fitted model: count and exact sums of the fit list, the leading eigenpairs, and what was measured."""

    n: int
    sums: list[int]
    values: np.ndarray  # falling
    vectors: np.ndarray  # a column each
    trace: float
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, x``: each usable vector as 64-bit integers ``floor(scale * component)``."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c).cast("long"))
    return rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & sound).select("id", x.alias("x"))


def fit(distinct: DataFrame, dim: int, components: int = 4, scratch: str | None = None) -> Whitening | None:
    """The model of ``distinct (x)``, vectors of ``dim`` integers each; None without any."""
    found = _combined(distinct.select("x").mapInArrow(_spectra(dim), STATE), dim, "spectra", _add_spectra, scratch)
    if found is None:
        return None
    spectrum = Spectrum.of(found)
    sums = [int(s) for s in spectrum.sums]
    n, mean = spectrum.n, np.array([int(s) / spectrum.n for s in sums])

    def covariance(basis: np.ndarray) -> np.ndarray:
        moments = distinct.select("x").mapInArrow(_projected_moments(dim, mean, basis), MOMENT)
        total = _combined(moments, dim, "moments", _add_moments, scratch)
        matrix = np.frombuffer(total["matrix"]).reshape(basis.shape[1], -1) / n
        return (matrix + matrix.T) / 2

    # Products of many updates drift from orthogonality by rounding: put right before the basis is used.
    basis = np.linalg.qr(spectrum.vectors[:, ::-1])[0]
    values, turn = np.linalg.eigh(covariance(basis))
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(values.sum())
    positive = int((values[:components] > max(float(values[0]), 0.0) * dim * 4 * EPS).sum()) if values[0] > 0 else 0
    error = None
    if positive:
        whitener = vectors[:, :positive] / np.sqrt(values[:positive])
        error = float(np.abs(covariance(whitener) - np.eye(positive)).max())
    kept = np.where(np.arange(dim) < positive, values, 0.0)[:components]
    return Whitening(n, sums, kept, vectors[:, :components], trace, error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The sums over dimensions of ``(n * x - sum)`` squared, exactly."""
    top = n * (int(np.abs(x, dtype=np.float64).max(initial=0)) + 1) + max(map(abs, sums))
    if top * top * x.shape[1] < 1 << 62:
        d = n * x - np.array(sums, dtype=np.int64)
        return pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
    d = n * x.astype(object) - np.array(sums, dtype=object)
    exact = [int(v) for v in (d * d).sum(axis=1)]
    return pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def _whiten(dim: int, model: Whitening):
    k = len(model.values)
    sound = model.values > 0
    scale = np.divide(1.0, np.sqrt(model.values), out=np.zeros(k), where=sound)
    explained = [float(v) / model.trace if model.trace > 0 else None for v in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            x = _matrix(batch.column("x"), dim)
            white = ((x - model.mean) @ model.vectors) * scale
            rows = np.repeat(np.arange(len(x)), k)
            each = lambda values, kind: pa.array(list(values) * len(x), kind)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(rows)),
                    each(range(1, k + 1), pa.int32()),
                    pa.array(np.full(len(rows), model.n)),
                    _deviations(x, model.n, model.sums).take(pa.array(rows)),
                    pa.array(white.ravel(), pa.float64(), mask=np.tile(~sound, len(x))),
                    each(explained, pa.float64()),
                    pa.array([model.identity_error] * len(rows), pa.float64()),
                ],
                [c.split()[0] for c in RESULT.split(", ")],
            )

    return run


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    components: int = 4,
    scratch: str | None = None,
) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` per vector and leading component.

    ``n`` counts the fit list, ``deviation`` is the exact sum of squares of
    ``n * x - sums``, ``explained`` the share of the component's eigenvalue in
    the covariance's trace, ``identity_error`` the largest entry of the whitened
    fit list's covariance less the identity. A length of vectors at a time.
    """
    rows = whole_numbers(vectors, id_col, vector_col, scale)
    schema = RESULT.format(id=vectors.schema[id_col].dataType.simpleString())
    distinct = keep(rows.select("x").distinct().withColumn("dim", F.size("x")), "fit-list", scratch)
    lengths = [r["dim"] for r in distinct.select("dim").distinct().orderBy("dim").toLocalIterator()]
    out = vectors.sparkSession.createDataFrame([], schema)
    for dim in lengths:
        model = fit(distinct.filter(F.col("dim") == dim), dim, components, scratch)
        out = out.union(rows.filter(F.size("x") == dim).mapInArrow(_whiten(dim, model), schema))
    return out
