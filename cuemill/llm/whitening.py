"""Whitening of embeddings by an incremental eigendecomposition.

Every task keeps the count, the mean and the spectrum (eigenvalues and eigenvectors) of the scatter of its vectors. A
vector is a centred rank-one update: the new eigenvalues are the roots of a secular equation, after components that
the update does not touch, or that share an eigenvalue, have been deflated. Two spectra are combined by the rank-one
updates of the one's eigenpairs and of the difference of the means, in rounds over a few spectra a task. The
result is a basis close to the eigenvectors; a last distributed Rayleigh-Ritz step projects the exactly centred rows
on it, adds up their products and turns the basis into the eigenvectors to double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import pin, scratch

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries of this size or more leave the range of exact sums; their rows are dropped like those with infinite entries.
LARGEST = float(1 << 40)
COMPONENTS = 32
#: Spectra or matrices that one task combines in a round.
FAN_IN = 8
EPS = np.finfo(float).eps


# --- rank-one updates ------------------------------------------------------------------------------------------


def secular_roots(poles: np.ndarray, weights: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1/rho + sum(weights / (poles - t)), one above each pole: (roots, roots[i] - poles[j] as matrix).

    ``poles`` ascend and differ, ``weights`` and ``rho`` are positive. Each root is sought as a distance from the nearer
    of its two poles, so that differences keep their digits: the sums over the poles on either side are replaced by
    one pole each that agrees in value and slope, which gives a quadratic; steps that leave the bracket halve it.
    """
    k = len(poles)
    upper = np.append(poles[1:], poles[-1] + rho * weights.sum())
    width = upper - poles
    i = np.arange(k)
    middle = poles + width / 2
    at_middle = 1 / rho + (weights / (poles[None, :] - middle[:, None])).sum(1)
    low_half = (at_middle >= 0) | (i == k - 1)
    origin = np.where(low_half, poles, upper)
    gaps = poles[None, :] - origin[:, None]
    lo = np.where(low_half, 0.0, -width / 2)
    hi = np.where(low_half, np.where(at_middle >= 0, width / 2, width), 0.0)
    lo[-1], hi[-1] = (0.0, width[-1] / 2) if at_middle[-1] >= 0 else (width[-1] / 2, width[-1])
    t = (lo + hi) / 2
    left = i[None, :] <= i[:, None]
    a, b = gaps[i, i], gaps[i, np.minimum(i + 1, k - 1)]
    for _ in range(60):
        distance = gaps - t[:, None]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            terms = weights / distance
            slopes = terms / distance
            psi, phi = (terms * left).sum(1), (terms * ~left).sum(1)
            f = 1 / rho + psi + phi
            lo, hi = np.where(f < 0, t, lo), np.where(f < 0, hi, t)
            s, big_s = (slopes * left).sum(1) * (a - t) ** 2, (slopes * ~left).sum(1) * (b - t) ** 2
            c = 1 / rho + psi - s / (a - t) + np.where(i < k - 1, phi - big_s / (b - t), 0.0)
            p, q = c * (a + b) + s + big_s, c * a * b + s * b + big_s * a
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
            one = np.where(p > 0, (p + root) / (2 * c), 2 * q / (p - root))
            two = np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * c))
            step = np.where((one > lo) & (one < hi), one, two)
            step[-1] = a[-1] + s[-1] / c[-1]
        step = np.where((step > lo) & (step < hi), step, (lo + hi) / 2)
        done = (np.abs(f) <= 8 * EPS * (1 / rho + np.abs(psi) + phi)) | (hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
        if done.all():
            break
        t = np.where(done, t, step)
    return origin + t, t[:, None] - gaps


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of ``vectors * values * vectors.T + rho * v * v.T``, values ascending; ``rho`` is not negative."""
    z = v @ vectors
    size = rho * (z @ z)
    tiny = 8 * EPS * max(np.abs(values).max(initial=0), size)
    if size <= tiny * EPS:
        return values, vectors
    vectors = vectors.copy()
    # equal eigenvalues: a reflection inside their space leaves one component of the update
    close = np.flatnonzero(np.diff(values) <= tiny)
    if len(close):
        for run in np.split(close, np.flatnonzero(np.diff(close) > 1) + 1):
            space = slice(run[0], run[-1] + 2)
            part = z[space].copy()
            length = np.linalg.norm(part)
            if length == 0:
                continue
            mirror = part.copy()
            mirror[-1] += np.copysign(length, part[-1])
            mirror /= np.linalg.norm(mirror)
            vectors[:, space] -= 2 * np.outer(vectors[:, space] @ mirror, mirror)
            z[space] = 0
            z[space.stop - 1] = -np.copysign(length, part[-1])
    live = np.flatnonzero(rho * np.abs(z) * np.sqrt(size / rho) > tiny)
    if not len(live):
        return values, vectors
    poles, active = values[live], z[live]
    roots, apart = secular_roots(poles, active**2, rho)
    # the components for which these roots are exact (Gu and Eisenstat): eigenvectors come out orthogonal
    i = np.arange(len(live))
    between = poles[:, None] - poles[None, :]
    between[i, i] = 1
    ratio = apart / between
    exact = np.sqrt(np.abs(np.prod(ratio, axis=0)))
    turn = np.copysign(exact, active)[:, None] / -apart.T
    turn /= np.linalg.norm(turn, axis=0)
    vectors[:, live] = vectors[:, live] @ turn
    values = values.copy()
    values[live] = roots
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, mean, and eigenpairs of the scatter matrix of the vectors seen so far."""

    count: float
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0.0, np.zeros(width), np.zeros(width), np.eye(width))

    def add(self, x: np.ndarray, copies: float = 1) -> None:
        """A centred rank-one update by so many copies of one vector."""
        step = x - self.mean
        total = self.count + copies
        self.values, self.vectors = rank_one(self.values, self.vectors, step, self.count * copies / total)
        self.mean = self.mean + step * (copies / total)
        self.count = total

    def merge(self, other: Spectrum) -> None:
        """The rank-one updates of another spectrum's eigenpairs, then that of the two means."""
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        self.add(other.mean, other.count)

    def pack(self) -> bytes:
        return np.concatenate(([self.count], self.mean, self.values, self.vectors.ravel())).tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Spectrum:
        flat = np.frombuffer(data)
        d = int(round(np.sqrt(len(flat)))) - 1  # 1 + 2 d + d * d entries
        return cls(flat[0], flat[1 : d + 1].copy(), flat[d + 1 : 2 * d + 1].copy(), flat[2 * d + 1 :].reshape(d, d).copy())


def merge_spectra(parts: list[bytes]) -> bytes:
    first = Spectrum.unpack(parts[0])
    for part in parts[1:]:
        first.merge(Spectrum.unpack(part))
    return first.pack()


def add_matrices(parts: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(p) for p in parts], axis=0).tobytes()


# --- distributed -----------------------------------------------------------------------------------------------


def usable(rows: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """``rows`` with ``_x``, the entries as exact integers without the shift, for vectors without null or non-finite entries.

    Vectors of another length than most (of the longer, in a tie) have no place in the covariance and are left out too.
    """
    bounded = F.forall(vec_col, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    x = F.transform(vec_col, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    good = pin(rows.where(F.col(vec_col).isNotNull() & bounded).withColumn("_x", x))
    width = good.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good.where(F.size("_x") == (width["d"] if width else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch of lists of equal length as one matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _combined(parts: DataFrame, combine: Callable[[list[bytes]], bytes]) -> bytes | None:
    """``parts`` (slot, data) combined over ``FAN_IN`` neighbouring slots a task and round; None if there are none."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("slot")
        slot = group.column("slot")[0].as_py() // FAN_IN
        return pa.table({"slot": pa.array([slot], pa.int64()), "data": pa.array([combine(group.column("data").to_pylist())], pa.binary())})

    parts = pin(parts)
    last = parts.agg(F.max("slot")).first()[0]
    while last:
        parts = pin(parts.groupBy(F.floor(F.col("slot") / FAN_IN)).applyInArrow(run, "slot long, data binary"))
        last //= FAN_IN
    got = parts.head()
    return bytes(got["data"]) if got else None


def _each_task(rows: DataFrame, per_task: Callable[[Iterator[np.ndarray]], bytes | None]) -> DataFrame:
    """(slot, data): what ``per_task`` makes of the matrices of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId()
        data = per_task(_matrix(b.column(0)) for b in batches if b.num_rows)
        if data is not None:
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([data], pa.binary())], names=["slot", "data"])

    return rows.mapInArrow(run, "slot long, data binary")


def task_spectrum(matrices: Iterator[np.ndarray]) -> bytes | None:
    """Rank-one updates by all vectors of a task; copies within a batch are one update."""
    spectrum = None
    for x in matrices:
        spectrum = spectrum or Spectrum.empty(x.shape[1])
        rows, copies = np.unique(x, axis=0, return_counts=True)
        for row, n in zip(rows.astype(float), copies.tolist(), strict=True):
            spectrum.add(row, n)
    return spectrum.pack() if spectrum else None


@dataclass
class Whitening:
    """Exact count and sums (without the shift) and the eigenpairs of the covariance, falling."""

    count: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, each entry rounded once: whole numbers are taken off before the division."""
        near = [s // self.count for s in self.sums]
        rest = np.array([(s - m * self.count) / self.count for s, m in zip(self.sums, near, strict=True)])
        return (x - np.array(near, np.int64)) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over the entries of (count * x - sums)^2; None where a long cannot hold it."""
        widest = int(np.abs(x).max(initial=0)) * self.count + max(map(abs, self.sums), default=0)
        kind = np.int64 if x.shape[1] * widest**2 < 2**62 else object
        away = x.astype(kind) * self.count - np.array(self.sums, kind)
        return [d if d < 2**63 else None for d in (away * away).sum(1).tolist()]

    def whiten(self, x: np.ndarray, components: int) -> np.ndarray:
        """Rows on the leading components over the root of their eigenvalue; NaN on components without variance."""
        values = self.values[:components]
        flat = values <= self.values.max(initial=0) * EPS * len(self.values)
        scale = np.divide(1, np.sqrt(np.where(flat, 1, values)), where=~flat, out=np.full(len(values), np.nan))
        return (self.centred(x) @ self.vectors[:, :components]) * scale


def fit(vectors: DataFrame) -> Whitening | None:
    """The whitening of all ``vectors`` (``_x``), or None if there are none. Only sums, one spectrum and one matrix reach the driver."""
    x = vectors.select("_x")

    def batch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                total = _matrix(b.column(0)).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n", "sums"])

    partial = pin(x.mapInArrow(batch_sums, "n long, sums array<long>"))
    count = partial.agg(F.sum("n")).first()[0]
    if not count:
        return None
    by_entry = partial.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in by_entry.orderBy("i").collect()]  # one row per entry of a vector
    if not sums:
        return Whitening(count, sums, np.zeros(0), np.zeros((0, 0)), 0.0)
    basis = np.linalg.qr(Spectrum.unpack(_combined(_each_task(x, task_spectrum), merge_spectra)).vectors)[0]
    guess = Whitening(count, sums, np.zeros(0), basis, 0.0)

    def products(matrices: Iterator[np.ndarray]) -> bytes | None:
        total = None
        for m in matrices:
            y = guess.centred(m) @ guess.vectors
            total = y.T @ y if total is None else total + y.T @ y
        return None if total is None else total.tobytes()

    d = len(sums)
    projected = np.frombuffer(_combined(_each_task(x, products), add_matrices)).reshape(d, d) / count
    values, turn = np.linalg.eigh(projected)
    falling = slice(None, None, -1)
    return Whitening(count, sums, np.maximum(values[falling], 0), (basis @ turn)[:, falling], float(np.trace(projected)))


def whitened_rows(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: (id, component, n, deviation, whitened, explained, identity_error).

    Entries c count as floor(64 c) + 1000000. Rows whose vector is null, or holds null or non-finite entries (or such of
    2^40 and more), are dropped, as are vectors of another length than most; all others are in the fit and in the result, repeated ones
    as often as they come. Components ascend by falling eigenvalue of the covariance (divisor n); there are as many
    as entries where those are fewer than ``components``. On a component without variance ``whitened`` is null, and it does not count for
    ``identity_error``, the largest absolute entry of the whitened values' covariance minus the identity, which is null
    if no component has variance; ``explained`` is then null too. ``deviation`` is null where no long can hold it. An empty
    table gives an empty table; other columns are neither read nor returned.
    """
    spark = rows.sparkSession
    with scratch(spark) as kept:
        vectors = usable(rows.select(F.struct(F.col(id_col)).alias("_row"), F.col(vec_col).alias("_vec")), "_vec").select("_row", "_x")
        found = fit(vectors)
        kind = vectors.schema["_row"].dataType.simpleString()
        columns = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        if found is None or not found.sums:
            return spark.createDataFrame([], f"_row {kind}, {columns}").select("_row.*", *(c.split()[0] for c in columns.split(", ")))
        model = spark.sparkContext.broadcast(found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column("_x")) if b.num_rows else np.zeros((0, len(model.value.sums)), np.int64)
                white = model.value.whiten(x, components)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1], pa.array(white.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(model.value.deviations(x), pa.int64()), lists], names=["row", "deviation", "white"])

        white = pin(vectors.mapInArrow(run, f"row {kind}, deviation long, white array<double>"), kept)

        def moments(matrices: Iterator[np.ndarray]) -> bytes | None:
            total = None
            for m in matrices:
                y = np.column_stack([np.ones(len(m)), m])
                total = y.T @ y if total is None else total + y.T @ y
            return None if total is None else total.tobytes()

        k = min(components, len(found.sums))
        full = np.frombuffer(_combined(_each_task(white.select("white"), moments), add_matrices)).reshape(k + 1, k + 1) / found.count
        away = np.abs(full[1:, 1:] - np.outer(full[0, 1:], full[0, 1:]) - np.eye(k))
        error = float(away[~np.isnan(away)].max()) if (~np.isnan(away)).any() else None
    share = [float(v / found.trace) if found.trace > 0 else None for v in found.values[:k]]
    shares = F.array(*(F.lit(s).cast("double") for s in share))
    each = white.select("row", "deviation", F.posexplode("white").alias("i", "whitened"))
    return each.select(
        "row.*", (F.col("i") + 1).alias("component"), F.lit(found.count).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("i") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
