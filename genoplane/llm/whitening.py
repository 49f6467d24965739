"""Whitening of embeddings: distributed centred scatter, cyclic Jacobi on the driver, projection of every row.

Entries become whole numbers, floor(256 c), so copies are equal exactly. The fit list is
each distinct vector once; copies are merged in each task before the shuffle. Sums are
exact. Each task multiplies its centred vectors to a d x d part of the scatter; the parts
are added up entry by entry in Spark, and only the d x d sum reaches the driver. There
cyclic Jacobi rotations run until all off-diagonal entries vanish beside their diagonal,
which keeps the small eigenvalues accurate. The matrix of whitening is broadcast (d x d).

Defined cases. Rows whose vector is null or holds null or non-finite entries are left out;
a null id stays, and repeated rows give rows each. Shorter vectors count as filled up with
zeros (an empty one is all zeros). Entries beyond a long are taken to its ends. A component
without variance has a null ``whitened``, explains 0 and does not enter
``identity_error``, which is 0 if no component has any. ``deviation`` is null where it is
beyond a long. Equal eigenvalues keep the order of their columns. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import finite, matrix
from .workspace import tidy, type_of, written

SCALE = 256
COMPONENTS = 4
SWEEPS = 60
#: Rows that are multiplied or projected at once.
ROWS = 4096


def jacobi(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit eigenvectors as columns, by cyclic rotations.

    An entry counts as vanished below the rounding of the two diagonal entries that it joins.
    """
    a, n = symmetric.astype(np.float64).copy(), len(symmetric)
    vectors = np.eye(n)
    tiny = np.finfo(np.float64).eps
    for _ in range(SWEEPS):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                off, scale = a[p, q], np.sqrt(abs(a[p, p])) * np.sqrt(abs(a[q, q]))
                if off == 0 or abs(off) <= tiny * scale:
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = (1 if theta >= 0 else -1) / (abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                s = t * c
                column_p, column_q = a[:, p].copy(), a[:, q].copy()
                a[:, p], a[:, q] = c * column_p - s * column_q, s * column_p + c * column_q
                row_p, row_q = a[p].copy(), a[q].copy()
                a[p], a[q] = c * row_p - s * row_q, s * row_p + c * row_q
                a[p, q] = a[q, p] = 0.0
                vector_p, vector_q = vectors[:, p].copy(), vectors[:, q].copy()
                vectors[:, p], vectors[:, q] = c * vector_p - s * vector_q, s * vector_p + c * vector_q
        if not turned:
            break
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def per_batch(df: DataFrame, column: str, work, schema: str) -> DataFrame:
    """One call of work for each task, on an iterator of Arrow batches of the column."""
    return df.select(column).mapInArrow(work, schema)


def scatter(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """Sum over the fit list of the centred vectors' outer products."""
    dims = len(mean)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                centred = matrix(batch.column(0).slice(at, ROWS), dims).astype(np.float64) - mean
                total += centred.T @ centred
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "part"])

    summed = per_batch(fit, "x", work, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("part")).toArrow()
    out = np.zeros((dims, dims))
    i, j, part = (summed[c].to_numpy() for c in ("i", "j", "part"))
    out[i, j] = out[j, i] = part
    return out


def identity_error(fit: DataFrame, mean: np.ndarray, directions: np.ndarray, n: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit list, minus the identity."""
    held, dims = directions.shape[1], len(mean)
    if not held:
        return 0.0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, sums and centred products of each batch, merged over the task."""
        count, middle, products = 0, np.zeros(held), np.zeros((held, held))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = (matrix(batch.column(0).slice(at, ROWS), dims).astype(np.float64) - mean) @ directions
                count, middle, products = merged((count, middle, products), (len(y), y.mean(axis=0), (y - y.mean(axis=0)).T @ (y - y.mean(axis=0))))
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([middle.tolist()]), pa.array([products.ravel().tolist()])], names=["count", "middle", "products"])

    state = (0, np.zeros(held), np.zeros((held, held)))
    for count, middle, products in per_batch(fit, "x", project, "count long, middle array<double>, products array<double>").toLocalIterator():
        state = merged(state, (count, np.array(middle), np.array(products).reshape(held, held)))
    return float(np.abs(state[2] / n - np.eye(held)).max())


def merged(one: tuple, other: tuple) -> tuple:
    """Counts, means and centred products of two sets of rows together."""
    if not one[0] or not other[0]:
        return one if one[0] else other
    n = one[0] + other[0]
    apart = other[1] - one[1]
    return n, one[1] + apart * (other[0] / n), one[2] + other[2] + np.outer(apart, apart) * (one[0] * other[0] / n)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 for each row, in whole numbers of any size; null beyond a long."""
    most, total = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))), max(abs(s) for s in sums)
    fits = most * max(most, total) * x.shape[1] < 1 << 62
    wide, s = (x, np.array(sums, dtype=np.int64)) if fits else (x.astype(object), np.array(sums, dtype=object))
    squares, crossed, rest = (wide * wide).sum(axis=1).tolist(), (wide * s).sum(axis=1).tolist(), sum(v * v for v in sums)
    exact = [n * (n * q - 2 * p) + rest for q, p in zip(squares, crossed, strict=True)]
    return [v if v < 1 << 63 else None for v in exact]


@tidy
def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each remaining row and component."""
    spark = embeddings.sparkSession
    kind = type_of(embeddings, "vec_id")
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    clean = finite(embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "embedding")
    rows = clean.select("vec_id", F.transform("embedding", lambda c: F.floor(F.lit(float(SCALE)) * c).cast("long")).alias("x"))
    dims = rows.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return spark.createDataFrame([], schema)
    short = F.lit(dims) - F.size("x")
    filled = rows.withColumn("x", F.when(short > 0, F.concat("x", F.array_repeat(F.lit(0).cast("long"), short))).otherwise(F.col("x")))
    fit = written(filled.select("x").distinct(), "fit")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, [0] * dims
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), dims)
                bound = max(abs(int(x.max())), abs(int(x.min()))) * len(x)
                part = (x if bound < 1 << 62 else x.astype(object)).sum(axis=0).tolist()
                count, total = count + len(x), [a + b for a, b in zip(total, part, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([[str(v) for v in total]])], names=["count", "total"])

    parts = per_batch(fit, "x", add, "count long, total array<string>").select("count", F.posexplode("total").alias("i", "s"))
    sums, n = [0] * dims, 0
    for i, count, s in parts.groupBy("i").agg(F.sum("count"), F.sum(F.col("s").cast("decimal(38,0)"))).collect():
        sums[i], n = int(s), count
    mean = np.array([s / n for s in sums])
    values, vectors = jacobi(scatter(fit, mean) / n)
    trace = float(values.sum())
    shown = min(components, dims)
    # Below the rounding of the largest eigenvalue nothing varies.
    varies = [bool(values[c] > 0 and values[c] > dims * np.finfo(np.float64).eps * values[0]) for c in range(shown)]
    directions = vectors[:, :shown][:, varies] / np.sqrt(values[:shown][varies])
    error = identity_error(fit, mean, directions, n)
    explained = [float(values[c] / trace) if varies[c] else 0.0 for c in range(shown)]
    model = spark.sparkContext.broadcast((mean, directions, sums))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, directions, sums = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x, m = matrix(batch.column(1), dims), batch.num_rows
                y = (x.astype(np.float64) - mean) @ directions
                away = pa.array(deviations(x, n, sums), pa.int64())
                column = 0
                for c in range(shown):
                    whitened = pa.array(y[:, column]) if varies[c] else pa.nulls(m, pa.float64())
                    column += varies[c]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array(np.full(m, c + 1, dtype=np.int32)), pa.array(np.full(m, n)), away, whitened, pa.array(np.full(m, explained[c])), pa.array(np.full(m, error))],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return filled.select("vec_id", "x").mapInArrow(project, schema)
