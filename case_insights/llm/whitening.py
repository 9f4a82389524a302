"""Whitening by an incremental eigendecomposition of the covariance.

- Distinct vectors are dealt to parts of bounded size. A part keeps the spectrum of its scatter matrix and adds its
  rows one by one: the row, centred by the mean so far, is a rank-one update. The new eigenvalues are the roots of the
  secular equation; entries that are negligible or belong to equal eigenvalues are deflated first.
- Spectra of parts are combined, a few at a time and in rounds, by successive rank-one updates too: one for each
  direction of the smaller part and one for the distance of the means.
- The basis so found is refined by a distributed Rayleigh-Ritz step: one pass adds up the covariance in that basis,
  whose small eigenproblem gives the components to double precision.

Counts and sums are whole numbers and exact. A rank-one update costs the cube of the dimension, whatever the number of
rows; matrices of the dimension's size are the largest things that leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from case_insights.llm.store import discard, saved

EPS = np.finfo(float).eps
SPECTRUM = "part long, n long, total array<long>, values array<double>, vectors array<double>"


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + z z' for rising d and z without zeros, and the matrix d[i] - root[j] (row j, column
    i), accurate also where a root lies close to its pole."""
    m = len(d)
    z2 = z * z
    gap = np.append(d[1:] - d[:-1], z2.sum())  # a root lies above each pole, within the gap
    pole, above = np.arange(m), np.minimum(np.arange(1, m + 1), m - 1)
    # origin of each root: the nearer of the two poles around it
    term = z2 / (d - (d + gap / 2)[:, None])
    middle = 1 + term.sum(1)
    right = (middle < 0) & (pole < m - 1)
    origin = np.where(right, above, pole)
    delta = d - d[origin][:, None]  # pole i seen from the origin of root j
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, np.where(pole < m - 1, gap / 2, gap))
    below = np.tril(np.ones((m, m)))
    near, far = delta[pole, pole], delta[pole, above]
    with np.errstate(all="ignore"):
        # start from the root of the two poles around it, the others taken where they are in the middle
        rest = middle - term[pole, pole] - np.where(pole < m - 1, term[pole, above], 0)
        mu = _between(rest, rest * (near + far) + z2 + z2[above], rest * near * far + z2 * far + z2[above] * near)
        mu[-1] = z2[-1] / rest[-1]
        mu = np.where((mu > low) & (mu < high), mu, (low + high) / 2)
        at = pole  # roots still to be found
        for _ in range(80):
            apart = 1 / (delta[at] - mu[at, None])
            term = z2 * apart
            f = 1 + term.sum(1)
            open_ = np.flatnonzero(np.abs(f) > 16 * EPS * (1 + np.abs(term).sum(1)))
            if not len(open_):
                break
            if len(open_) < len(at):
                at, f, term, apart = at[open_], f[open_], term[open_], apart[open_]
            slope = term * apart
            both, psi = slope.sum(1), np.einsum("ij,ij->i", slope, below[at])
            x = mu[at]
            low[at], high[at] = np.where(f < 0, x, low[at]), np.where(f < 0, high[at], x)
            d1, d2 = near[at] - x, far[at] - x
            # two simple poles that agree with f and its slopes; for the last root there is one
            two = _between(f - d1 * psi - d2 * (both - psi), (d1 + d2) * f - d1 * d2 * both, d1 * d2 * f)
            new = x + np.where(at < m - 1, two, d1 + d1 * d1 * psi / (f - d1 * psi))
            mu[at] = np.where((new >= low[at]) & (new <= high[at]), new, (low[at] + high[at]) / 2)
    return d[origin] + mu, delta - mu[:, None]


def _between(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The root of c x^2 - a x + b that lies between the two poles."""
    root = np.sqrt(np.abs(a * a - 4 * b * c))
    return np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (rising values, vectors as columns) of ``vectors diag(values) vectors' + v v'``."""
    z = vectors.T @ v
    length = np.sqrt(z @ z)
    if length == 0:
        return values, vectors
    tiny = 8 * EPS * max(values[-1], length * length)
    live = np.flatnonzero(np.abs(z) * length > tiny)
    d, w = values[live], z[live]
    if (np.diff(d) * np.abs(w[1:] * w[:-1]) <= tiny * (w[1:] ** 2 + w[:-1] ** 2)).any():
        # equal eigenvalues: turn their directions until one of them holds all of z
        values, vectors, z = values.copy(), vectors.copy(), z.copy()
        for i, j in zip(live, live[1:]):
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            if (values[j] - values[i]) * abs(c * s) <= tiny:
                vectors[:, i], vectors[:, j] = c * vectors[:, i] - s * vectors[:, j], s * vectors[:, i] + c * vectors[:, j]
                values[i], values[j] = c * c * values[i] + s * s * values[j], s * s * values[i] + c * c * values[j]
                z[i], z[j] = 0, r
        live = live[np.abs(z[live]) * length > tiny]
        live = live[np.argsort(values[live], kind="stable")]
        d, w = values[live], z[live]
    if not len(live):
        return values, vectors
    roots, apart = secular_roots(d, w)
    # z that has exactly these roots, so that the new vectors are orthogonal
    poles = d - d[:, None]
    np.fill_diagonal(poles, -1)
    w = np.copysign(np.sqrt(np.abs((apart / poles).prod(0))), w)
    turn = w / apart
    turn = (turn / np.sqrt((turn * turn).sum(1, keepdims=True))).T
    new_values, new_vectors = values.copy(), vectors.copy()
    new_values[live], new_vectors[:, live] = roots, vectors[:, live] @ turn
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


def add_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of the scatter matrix of the rows of ``x`` around their mean, row by row."""
    dimension = x.shape[1]
    values, vectors, mean = np.zeros(dimension), np.eye(dimension), np.zeros(dimension)
    for n, row in enumerate(x.astype(np.float64)):
        away = row - mean
        if n:
            values, vectors = rank_one(values, vectors, away * np.sqrt(n / (n + 1)))
        mean = mean + away / (n + 1)
    return values, vectors


def combine(one: tuple, two: tuple) -> tuple:
    """(n, total, values, vectors) of both parts' rows together."""
    (n, s, values, vectors), (m, t, others, directions) = sorted((one, two), key=lambda p: -np.count_nonzero(p[2]))
    away = np.array([float(b) / m - float(a) / n for a, b in zip(s, t)]) * np.sqrt(n / (n + m) * m)
    for v in [*(directions[:, others > 0] * np.sqrt(others[others > 0])).T, away]:
        values, vectors = rank_one(values, vectors, v)
    return n + m, s + t, values, vectors


def _row(part: int, n: int, total: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> pa.Table:
    return pa.table({
        "part": pa.array([part], pa.int64()), "n": pa.array([n], pa.int64()),
        "total": pa.array([total.tolist()], pa.list_(pa.int64())), "values": pa.array([values], pa.list_(pa.float64())),
        "vectors": pa.array([vectors.ravel()], pa.list_(pa.float64())),
    })


def _matrix(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), kind).reshape(len(column), -1)


def _spectrum_of_part(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("place")
    x = _matrix(rows.column("x"), np.int64)
    return _row(rows.column("part")[0].as_py(), len(x), x.sum(0), *add_rows(x))


def _spectrum_of_parts(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("part")
    out = None
    for i in range(rows.num_rows):
        values = np.array(rows.column("values")[i].as_py())
        one = (
            rows.column("n")[i].as_py(), np.array(rows.column("total")[i].as_py(), np.int64), values,
            np.array(rows.column("vectors")[i].as_py()).reshape(len(values), -1),
        )
        out = combine(out, one) if out else one
    return _row(rows.column("up")[0].as_py(), *out)


def _in_rounds(df: DataFrame, parts: int, step: Callable, schema: str, fan: int) -> DataFrame:
    """One row from one for each part 0 .. parts - 1: ``fan`` parts at a time become one, which has their number
    divided by ``fan``."""
    df = saved(df, "whitening-parts")
    while parts > 1:
        before = df
        df = saved(df.withColumn("up", F.expr(f"part div {fan}")).groupBy("up").applyInArrow(step, schema), "whitening-parts")
        discard(before)
        parts = -(-parts // fan)
    return df


def _gram(n: int, total: np.ndarray, basis: np.ndarray) -> Callable:
    """Rows (part, values): the scatter of a part's centred rows in ``basis``, flat."""

    def run(rows: pa.Table) -> pa.Table:
        y = ((_matrix(rows.sort_by("place").column("x"), np.int64) * n - total) / n) @ basis
        return pa.table({"part": rows.column("part")[:1], "values": pa.array([(y.T @ y).ravel()], pa.list_(pa.float64()))})

    return run


def _added(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("part")
    return pa.table({"part": rows.column("up")[:1], "values": pa.array([_matrix(rows.column("values"), np.float64).sum(0)], pa.list_(pa.float64()))})


def _whitened(n: int, total: np.ndarray, axes: np.ndarray, explained: list, error: float, largest: float) -> Callable:
    dimension, k = axes.shape
    fits = dimension * (2 * n * largest) ** 2 < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            away = _matrix(batch.column("x"), np.int64) * n - total
            if fits:
                deviation = pa.array((away * away).sum(1), pa.int64())
                exact = deviation.cast(pa.decimal128(38, 0))
            else:
                sums = [sum(v * v for v in row) for row in away.tolist()]
                deviation = pa.array([v if v < 1 << 63 else None for v in sums], pa.int64())
                exact = pa.array([v if v < 10**38 else None for v in sums], pa.decimal128(38, 0))
            white = (away / n) @ axes
            rows = len(batch)
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, np.int64)), deviation.take(each),
                    pa.array(white.ravel(), pa.float64(), from_pandas=True), pa.array(explained * rows, pa.float64()),
                    pa.array(np.full(rows * k, error)), exact.take(each),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
            )

    return run


def whiten(vectors: DataFrame, components: int = 4, part_rows: int = 2048, fan: int = 16) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact``: for each row of
    ``vectors`` (vec_id, x: whole numbers; other columns are ignored) its first ``components`` whitened coordinates.

    The mean and the covariance (divisor n) are those of the n distinct vectors. Components are numbered from 1 by
    falling eigenvalue; the largest entry of each is positive. whitened is (x - mean) on the component over the square
    root of the eigenvalue, explained the eigenvalue over their sum. deviation is the sum over dimensions of
    (n * x - sum of the vectors)^2, exact, or null where that is over 64 bits; deviation_exact has 38 digits
    (null beyond).
    identity_error is measured: the largest entry of the covariance of whitened minus the identity.

    Rows with a null x, a null in x, or another dimension than most rows (the smaller, if equally many) take no
    part; a null vec_id is a value like any other, and repeated rows each return theirs. Vectors have as many
    components at most as dimensions. A component without variance (fewer or dependent vectors) has null in whitened
    and 0 in explained, and doesn't count in identity_error. An empty table gives no rows. Sums n * x that don't fit 62
    bits are an error."""
    spark = vectors.sparkSession
    out = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double, deviation_exact decimal(38,0)"
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("x").cast("array<long>").alias("x"))
    rows = rows.filter("x is not null and forall(x, c -> c is not null)")
    peak = F.max(F.array_max(F.transform("x", lambda c: F.abs(c.cast("double")))))
    dimension, largest = rows.agg(F.mode(F.size("x"), True), peak).first()
    if not dimension:
        return spark.createDataFrame([], out)
    rows = rows.filter(F.size("x") == dimension)
    fit = saved(rows.select("x").distinct().withColumn("place", F.xxhash64("x")), "whitening-fit")
    count = fit.count()
    if 2 * count * largest >= 1 << 62:
        raise ValueError(f"{count} vectors with components up to {largest:g}: sums don't fit 62 bits")
    parts = -(-count // part_rows)
    dealt = fit.withColumn("part", F.pmod("place", F.lit(parts)))
    # a part that the hash leaves empty is no row, which the rounds don't mind
    spectrum = _in_rounds(dealt.groupBy("part").applyInArrow(_spectrum_of_part, SPECTRUM), parts, _spectrum_of_parts, SPECTRUM, fan)
    whole = spectrum.first()  # one row: as large as the square of the dimension
    n, total = whole.n, np.array(whole.total, np.int64)
    basis, _ = np.linalg.qr(np.array(whole.vectors).reshape(dimension, dimension)[:, ::-1])

    grams = dealt.groupBy("part").applyInArrow(_gram(n, total, basis), "part long, values array<double>")
    gram = _in_rounds(grams, parts, _added, "part long, values array<double>", 64).first()
    values, turn = np.linalg.eigh(np.array(gram["values"]).reshape(dimension, dimension) / n)
    values, axes = values[::-1], (basis @ turn)[:, ::-1]
    k = min(components, dimension)
    kept = values[:k] > max(values[0], 0) * dimension * EPS * 4
    values, axes = np.where(kept, values[:k], 0), axes[:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    trace = np.trace(np.array(gram["values"]).reshape(dimension, dimension)) / n
    explained = [float(v / trace) if trace else 0.0 for v in values]
    axes = axes / np.sqrt(np.where(kept, values, np.nan))

    live = int(kept.sum())
    error = 0.0
    if live:
        spread = dealt.groupBy("part").applyInArrow(_gram(n, total, axes[:, :live]), "part long, values array<double>")
        spread = _in_rounds(spread, parts, _added, "part long, values array<double>", 64).first()
        error = float(np.abs(np.array(spread["values"]).reshape(live, live) / n - np.eye(live)).max())
    return rows.mapInArrow(_whitened(n, total, axes, explained, error, largest), out)
