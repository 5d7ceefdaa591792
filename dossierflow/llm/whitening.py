"""Whitening of embeddings by shifted CholeskyQR, repeated and composed.

Entries become integers, so sums are exact. The distinct integer vectors are the list that is
fitted. Their centred matrix A is never brought together: every pass over it is a distributed
Gram product, of which only d x d sums per task leave (d is the number of dimensions). The
first pass adds a shift to the Gram matrix, so that its Cholesky factor exists whatever the
condition of A; the rows are divided by that factor with a triangular solve, which leaves
nearly orthogonal columns, and the next passes orthogonalise what is left. The product of the
triangular factors is R with A'A = R'R to working precision, without squaring the condition
of A as one Gram product would. The singular values and right vectors of R give the
eigenvalues and eigenvectors of the covariance.

Rows whose vector is null, or holds a null or a non-finite entry, are left out. So are vectors
of another length than the most frequent one (the longest of several), as they have no place in
the same space, and vectors with an entry beyond a long. Components without variance can't be
whitened and have no rows: with fewer than two distinct vectors the result is empty, as for an
empty table. Repeated rows count once in the fit and come back each. ``deviation`` is null
where it does not fit a long. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierflow.llm.batches import column, freeing
from dossierflow.llm.store import keep

#: an entry c becomes floor(SCALE * c) + OFFSET
SCALE, OFFSET = 64, 1_000_000
#: components that are returned, at most
COMPONENTS = 16
#: Gram passes; the first is shifted
PASSES = 3
#: variance below this share of the largest one, times the number of dimensions, is none
NOTHING = 1e-13
#: rows of a matrix that are worked on at once
ROWS = 8192


def integers(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """All rows whose vector has only finite entries, with ``x``: the entries as longs."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))
    inside = F.forall(
        vector,
        lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < F.lit(2.0**62)), F.lit(False)),
    )
    usable = vectors.where(F.col(vector).isNotNull() & inside & (F.size(vector) > 0))
    lengths = usable.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths.d if lengths else 0
    return usable.where(F.size(vector) == d).withColumn(
        "x", F.transform(scaled, lambda c: c.cast("long") + F.lit(OFFSET).cast("long"))
    )


def _matrix(values: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as a matrix."""
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 1)


class Centre:
    """Integer sums of n vectors; subtracts their mean before anything is multiplied."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s - int(w) * n for s, w in zip(sums, self.whole)]
        self.fraction = np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, null where it is over a long."""
        near = x - self.whole
        most = int(np.abs(near).max(initial=0)) + 1
        if most * self.n < 1 << 31 and len(self.rest) * (most * self.n) ** 2 < 1 << 63:
            t = near * self.n - np.array(self.rest, np.int64)
            return (t * t).sum(axis=1).tolist()
        t = near.astype(object) * self.n - np.array(self.rest, object)
        out = (t * t).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in out]


def divided(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a r^-1 by forward substitution over the columns of the triangular ``r``."""
    q = np.empty_like(a, order="F")
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _gram(fit: DataFrame, rows_of) -> np.ndarray:
    """Sum over all vectors of q q', for the rows q that ``rows_of`` makes of a batch: d (d + 1) / 2
    sums of each task, added up by Spark; the driver gets one number for each pair of columns."""

    def run(batches):
        total = None
        for b in batches:
            x = _matrix(column(b, "x"))
            for lo in range(0, len(x), ROWS):
                q = rows_of(x[lo : lo + ROWS])
                total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"]
            )

    sums = fit.select("x").mapInArrow(freeing(run), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    d = max((s.j for s in sums), default=-1) + 1
    out = np.zeros((d, d))
    for s in sums:
        out[s.i, s.j] = out[s.j, s.i] = s.v
    return out


def _cholesky(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper factor of the Gram matrix, shifted on request or where it isn't positive definite."""
    d = len(gram)
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    unit = np.finfo(float).eps / 2
    shift = 11 * (n * d + d * (d + 1)) * unit * max(np.linalg.norm(gram, 2), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 16


def fit_components(fit: DataFrame, centre: Centre, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of the covariance of the vectors of ``fit``."""
    factors: list[np.ndarray] = []
    whole = None
    for k in range(passes):

        def rows_of(x, factors=tuple(factors)):
            q = centre.centred(x)
            for r in factors:
                q = divided(q, r)
            return q

        gram = _gram(fit, rows_of)
        if not gram.any():  # all vectors are equal
            return np.zeros(0), np.zeros((len(gram), 0))
        if k + 1 < passes:
            r = _cholesky(gram, centre.n, shifted=k == 0)
            factors.append(r)
        else:
            # the last factor is used, not divided by: its square root serves without a shift
            e, v = np.linalg.eigh(gram)
            r = np.sqrt(np.maximum(e, 0))[:, None] * v.T
        whole = r if whole is None else r @ whole
    _, sigma, vt = np.linalg.svd(whole)
    return sigma**2 / centre.n, vt.T


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error of every usable row and component."""
    schema = T.StructType([
        vectors.schema[key],
        T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")],
    ])
    rows = keep(integers(vectors.select(key, vector), vector).select(key, "x"), "integers")
    fit = keep(rows.select("x").distinct(), "fit")
    # one row for each dimension: exact sums
    sums = (
        fit.select(F.posexplode("x").alias("i", "v")).groupBy("i")
        .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
    )
    empty = vectors.sparkSession.createDataFrame([], schema)
    if not sums:
        return empty
    centre = Centre(sums[0].n, [int(s.s) for s in sums])
    e, v = fit_components(fit, centre)
    k = min(most, int((e > len(sums) * NOTHING * e[0]).sum())) if len(e) else 0
    if not k:
        return empty
    project, explained = v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()
    covariance = _gram(fit, lambda x: centre.centred(x) @ project) / centre.n
    error = float(np.abs(covariance - np.eye(k)).max())

    def run(batches):
        for b in batches:
            x = _matrix(column(b, "x"))
            m = len(x)
            whitened = centre.centred(x) @ project
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    column(b, key).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, centre.n, np.int64)),
                    pa.array(centre.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(whitened.reshape(-1)),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=[f.name for f in schema],
            )

    return rows.mapInArrow(freeing(run), schema)
