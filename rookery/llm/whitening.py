"""Embedding whitening: projection on the principal components of the covariance, each to variance 1.

An entry c of a vector becomes the whole number x = floor(1024 * c) + 100000. Three passes over the vectors fit the projection:
exact sums of whole numbers give n, S and the mean S / n; sums of outer products of rows centred on that mean, a NumPy product of matrices
to each batch, give the covariance; the covariance of what the projection makes gives its distance from the identity. Each task
hands on one partial result and ``treeAggregate`` merges them; LAPACK's symmetric eigensolver works on the driver, which
gets matrices of the dimension only. The projection is broadcast: it has the dimension times COMPONENTS numbers.

Null vectors and those with null, infinite or NaN entries are left out. A vector shorter than the longest is as if zeros
followed; empty vectors alone have no component. Entries beyond LIMIT after scaling count as LIMIT. A component whose
eigenvalue is no more than rounding has null in ``whitened`` (one vector, equal vectors). Repeated rows and ids count each for
itself; equal eigenvalues come in the solver's order; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rookery.llm.common import table

SCALE, SHIFT, LIMIT, COMPONENTS = 1024, 100_000, 1 << 53, 8


def whole(column, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors kept in an Arrow column of lists, and their whole numbers, one row to each, ``width`` or as wide as the longest."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries are NaN
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(lengths)
    kept = column.is_valid().to_numpy(zero_copy_only=False) & (wrong[ends] == wrong[ends - lengths])
    width = int(lengths[kept].max(initial=0)) if width is None else width
    found = np.zeros((int(kept.sum()), width))
    found[np.arange(width) < lengths[kept][:, None]] = values[np.repeat(kept, lengths)]
    return np.flatnonzero(kept), np.clip(np.floor(SCALE * found), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def _sums(x: np.ndarray) -> list[int]:
    """Exact sums of columns: halves of the numbers cannot overflow."""
    low = (x & ((1 << 20) - 1)).sum(0)
    return [(int(h) << 20) + int(l) for h, l in zip((x >> 20).sum(0), low)]  # noqa: E741


def _added(a: tuple[int, list[int]], b: tuple[int, list[int]]) -> tuple[int, list[int]]:
    """Counts and sums of two sets of vectors; the shorter ones' missing entries are zeros, so SHIFT each."""
    width = max(len(a[1]), len(b[1]))
    (n, s), (m, t) = ((k, v + [k * SHIFT] * (width - len(v))) for k, v in (a, b))
    return n + m, [x + y for x, y in zip(s, t)]


def _merged(vectors: DataFrame, partial, zero, add):
    """``partial`` of each task's batches, merged by ``add`` along a tree of tasks."""

    def run(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(partial(b.column(0) for b in batches))], pa.binary())], ["part"])

    return vectors.mapInArrow(run, "part binary").rdd.map(lambda r: pickle.loads(r.part)).treeAggregate(zero, add, add)


@dataclass(frozen=True)
class Whitening:
    """What the fit found: n vectors with sums S, eigenvalues ``e`` by size and their unit eigenvectors as columns, and the error of the first ``k`` components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    k: int
    identity_error: float | None

    @property
    def known(self) -> np.ndarray:
        """Which of the first k eigenvalues are more than rounding."""
        e = self.values
        return e[: self.k] > len(e) * np.finfo(float).eps * max(float(e[0]), 0.0) if len(e) else np.zeros(0, bool)

    @property
    def projection(self) -> np.ndarray:
        """The matrix that takes a centred row to its whitened components; columns of components that are rounding are NaN."""
        e = np.where(self.known, self.values[: self.k], np.nan)
        return self.vectors[:, : self.k] / np.sqrt(e)

    @property
    def explained(self) -> list[float | None]:
        total = float(self.values.sum())
        return [max(float(e), 0.0) / total if total > 0 else None for e in self.values[: self.k]]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: the whole part of the mean is subtracted from whole numbers, so nothing but the last digit is rounded."""
    return (x - np.array([s // n for s in sums], np.int64)) - np.array([(s % n) / n for s in sums])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sums over dimensions of (n * x - S)^2, exact at any size."""
    if not x.size:
        return [0] * len(x)
    apart = x - np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    most = n * (int(np.abs(apart).max()) + 1)
    if most * most * x.shape[1] < 1 << 63:
        d = n * apart - np.array(rest, np.int64)
        return (d * d).sum(1).tolist()
    d = apart.astype(object) * n - np.array(rest, object)
    return (d * d).sum(1).tolist()


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors of ``df``; None where there is none, or none with an entry."""
    vectors = df.select(F.col(f"`{vector}`").alias("v"))

    def sums_of(columns):
        found = (0, [])
        for c in columns:
            _, x = whole(c)
            found = _added(found, (len(x), _sums(x)))
        return found

    n, sums = _merged(vectors, sums_of, (0, []), _added)
    if not n or not sums:
        return None
    d = len(sums)

    def products_of(rows):
        def partial(columns):
            found = 0.0
            for c in columns:
                a = rows(whole(c, d)[1])
                found = found + a.T @ a
            return found

        return partial

    covariance = _merged(vectors, products_of(lambda x: _centred(x, n, sums)), 0.0, lambda a, b: a + b) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1].copy(), axes[:, ::-1].copy()
    axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(d)] < 0, -1.0, 1.0)  # either sign is right; this one is always the same
    found = Whitening(n, sums, values, axes, min(components, d), None)
    if not found.known.any():
        return found
    p = found.projection[:, found.known]
    made = _merged(vectors, products_of(lambda x: _centred(x, n, sums) @ p), 0.0, lambda a, b: a + b) / n
    return Whitening(n, sums, values, axes, found.k, float(np.abs(made - np.eye(p.shape[1])).max()))


def whiten(df: DataFrame, fitted: Whitening, vector: str = "embedding", name: str = "whitened") -> DataFrame:
    """``df`` and ``name``, the components of each vector (null for vectors left out, NaN for components that are rounding), as arrays."""
    held = df.sparkSession.sparkContext.broadcast((fitted.n, fitted.sums, fitted.projection))

    def run(batches):
        import pyarrow as pa

        n, sums, p = held.value
        for batch in batches:
            places, x = whole(batch.column(len(batch.schema) - 1), len(sums))
            made, out = _centred(x, n, sums) @ p, [None] * len(batch)
            for i, row in zip(places, made.tolist()):
                out[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))], names)

    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    names = [*plain.columns, "made"]
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(plain.columns, df.schema)), T.StructField("made", T.ArrayType(T.DoubleType()))])
    return plain.select("*", F.col(f"c{df.columns.index(vector)}").alias("v")).mapInArrow(run, schema).toDF(*df.columns, name)


def components(df: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """A row to each vector kept and component up to ``k``: the id, component (from 1), n, deviation, whitened, explained and identity_error.

    ``deviation`` is null where the exact number is beyond a long (n over some millions); ``deviation_digits`` always has it.
    """
    schema = T.StructType([
        T.StructField(id, df.schema[id].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")), T.StructField("deviation_digits", T.StringType()),
    ])
    fitted = fit(df, vector, k)
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema)
    held = df.sparkSession.sparkContext.broadcast((fitted.n, fitted.sums, fitted.projection, fitted.explained, fitted.identity_error))

    def run(batches):
        import pyarrow as pa

        n, sums, p, explained, error = held.value
        each = p.shape[1]
        for batch in batches:
            places, x = whole(batch.column(1), len(sums))
            made, apart = (_centred(x, n, sums) @ p).ravel(), _deviations(x, n, sums)
            rows, m = np.repeat(places, each), len(places)
            columns = [
                batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, each + 1, dtype=np.int32), m)), pa.array(np.full(m * each, n)),
                pa.array([v if v < 1 << 63 else None for v in apart for _ in range(each)], pa.int64()), pa.array(made, pa.float64(), mask=np.isnan(made)),
                pa.array(explained * m, pa.float64()), pa.array([error] * (m * each), pa.float64()), pa.array([s for v in apart for s in [str(v)] * each], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.select(F.col(f"`{id}`"), F.col(f"`{vector}`")).mapInArrow(run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's whitened components."""
    return components(table(spark, sf_dir, "embeddings"))
