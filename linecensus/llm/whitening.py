"""Whitening of embeddings by shifted CholeskyQR.

Vectors are put on an integer grid (`floor(64 c) + 1000000`), so counts, sums and deviations are exact and
equal vectors are recognised; each distinct one counts once. A Gram pass sums `QᵀQ` of the
centred rows `Q` over all tasks in two levels; its Cholesky factor `R` orthogonalises the rows of the next
pass by a triangular solve. The first factor is taken with a shift, which keeps it regular whatever the
condition of the rows; each further pass repairs what the shift and rounding left, until the Gram
matrix is the identity. The factors, composed, are the R of the centred rows up to the
root of the last Gram matrix; the singular values and right vectors of that product are the deviations and
directions of the components, without ever squaring the condition number.

Only sums of a vector's length squared reach the driver, whatever the number of rows.

- Rows whose vector is null, empty, or holds a null, non-finite or (64 times 2**46 or more) ungridded entry go.
- Where lengths differ, the most common length stays (the greater of equally common ones).
- Repeated rows each get their result; a null `vec_id` is passed through; other columns are ignored.
- Directions without variance (singular value at most 1e-12 of the first) are no components: vectors that
  are all equal, a single vector and an empty table give an empty result.
- A `deviation` that does not fit a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecensus.session import write_table

COMPONENTS = 16
# Grid: entries times SCALE, rounded down, plus OFFSET.
SCALE, OFFSET, WIDEST = 64, 1_000_000, 2.0**52
# Gram passes at most, and how near to the identity the last Gram matrix must be.
PASSES, ORTHOGONAL = 6, 1e-13
# Singular values up to this share of the first have no direction of their own.
NO_VARIANCE = 1e-12
# Tasks of the first level that add the sums of others.
ADDERS = 16
# Rows whose numbers are worked on together.
BLOCK = 4096

SCHEMA = (
    "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


def grid_vectors(rows: DataFrame, identifier: str, vector: str) -> DataFrame:
    """`(identifier, x)` of the rows with a whole vector of the most common length, on the integer grid."""
    scaled = F.transform(F.col(vector), lambda c: c.cast("double") * SCALE)
    whole = F.forall("scaled", lambda c: F.coalesce(F.abs(c) < WIDEST, F.lit(False)))
    kept = rows.select(F.col(identifier), scaled.alias("scaled"))
    kept = kept.filter(F.col("scaled").isNotNull() & (F.size("scaled") > 0)).filter(whole)
    x = F.transform("scaled", lambda c: F.floor(c).cast("long") + OFFSET).alias("x")
    lengths = kept.groupBy(F.size("scaled").alias("length")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return kept.filter(F.size("scaled") == (common[0]["length"] if common else 0)).select(identifier, x)


def _blocks(batches) -> Iterator[np.ndarray]:
    """Matrices of at most BLOCK rows."""
    for batch in batches:
        column = batch.column("x")
        for start in range(0, len(column), BLOCK):
            part = column.slice(start, BLOCK)
            yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def _total(rows: DataFrame, of_block: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray:
    """The sum of `of_block` over all rows, added in the tasks, then in groups of tasks, then in one."""
    import pyarrow as pa

    def result(total):
        return pa.RecordBatch.from_arrays([pa.array([total.astype(kind).tobytes()], pa.binary())], ["total"])

    def of_task(batches):
        total = None
        for block in _blocks(batches):
            part = of_block(block)
            total = part if total is None else total + part
        if total is not None:
            yield result(total)

    def added(batches):
        total = None
        for batch in batches:
            for value in batch.column("total"):
                part = np.frombuffer(value.as_py(), kind)
                total = part if total is None else total + part
        if total is not None:
            yield result(total)

    sums = rows.mapInArrow(of_task, "total binary")
    sums = sums.repartition(ADDERS).mapInArrow(added, "total binary")
    sums = sums.repartition(1).mapInArrow(added, "total binary")
    return np.frombuffer(sums.collect()[0]["total"], kind)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """`x - sums / n`, rounded once."""
    return (x * n - sums) / float(n)


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """`rows @ inv(factor)` of an upper triangular factor, column by column."""
    result = np.empty_like(rows)
    for j in range(len(factor)):
        result[:, j] = (rows[:, j] - result[:, :j] @ factor[:j, j]) / factor[j, j]
    return result


def _factor(gram: np.ndarray, n: int, always_shift: bool) -> np.ndarray:
    """The upper Cholesky factor; shifted as far as rounding can have moved the least eigenvalue."""
    size = len(gram)
    if not always_shift:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    unit = np.finfo(float).eps / 2
    shift = 11.0 * (min(n * size, 1e12) + size * (size + 1)) * unit * np.linalg.norm(gram, 2)
    return np.linalg.cholesky(gram + shift * np.eye(size)).T


def whitening_components(fit: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray] | None:
    """`(n, sums, eigenvalues, components as columns)` of the vectors `x`, each one row of `fit`."""
    n = fit.count()
    if not n:
        return None
    sums = _total(fit, lambda block: block.sum(axis=0), np.int64)
    size = len(sums)
    factors: list[np.ndarray] = []

    def gram_of(block):
        rows = centred(block, n, sums)
        for factor in factors:
            rows = solved(rows, factor)
        return (rows.T @ rows).ravel()

    gram = _total(fit, gram_of, np.float64).reshape(size, size)
    if not gram.trace() > 0:
        return None
    for turn in range(PASSES):
        factors.append(_factor(gram, n, always_shift=turn == 0))
        gram = _total(fit, gram_of, np.float64).reshape(size, size)
        if np.abs(gram - np.eye(size)).max() < ORTHOGONAL * size:
            break
    # Where rows have no variance in some direction, the last Gram matrix says so.
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    composed = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
    for factor in reversed(factors):
        composed = composed @ factor
    _, deviations, directions = np.linalg.svd(composed)
    return n, sums, deviations**2 / n, directions.T


def whiten(
    rows: DataFrame, identifier: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row for each vector and component: `(identifier, component, n, deviation, whitened, ...)`."""
    import pyarrow as pa

    spark = rows.sparkSession
    placed = grid_vectors(rows, identifier, vector)
    kind = placed.schema[identifier].dataType.simpleString()
    schema = f"`{identifier}` {kind}, {SCHEMA}"
    fit = write_table(placed.select("x").distinct(), "fit-list")
    found = whitening_components(fit)
    if found is None:
        return spark.createDataFrame([], schema)
    n, sums, values, directions = found
    real = values > values[0] * NO_VARIANCE**2
    count = min(components, int(real.sum()))
    scaled = directions[:, :count] / np.sqrt(values[:count])
    explained = values[:count] / values.sum()

    def second_moments(block):
        y = centred(block, n, sums) @ scaled
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

    moments = _total(fit, second_moments, np.float64)
    means = moments[count * count :] / n
    covariance = moments[: count * count].reshape(count, count) / n - np.outer(means, means)
    identity_error = float(np.abs(covariance - np.eye(count)).max())
    names = [identifier, *(part.split()[0] for part in SCHEMA.split(", "))]

    def whitened(batches):
        for batch in batches:
            first = 0
            for block in _blocks([batch]):
                size = len(block)
                ids = batch.column(identifier).slice(first, size)
                first += size
                every = np.repeat(np.arange(size), count)
                columns = [
                    ids.take(pa.array(every)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * count, n, np.int64)),
                    pa.array(_squares(block * n - sums), pa.int64()).take(pa.array(every)),
                    pa.array((centred(block, n, sums) @ scaled).ravel()),
                    pa.array(np.tile(explained, size)),
                    pa.array(np.full(size * count, identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return placed.mapInArrow(whitened, schema)


def _squares(differences: np.ndarray) -> list[int | None]:
    """Exact sums of the squares of each row; None beyond the range of a long."""
    largest = int(np.abs(differences).max(initial=0))
    if largest * largest * differences.shape[1] < 2**63:
        return (differences * differences).sum(axis=1).tolist()
    exact = [sum(int(d) * int(d) for d in row) for row in differences]
    return [total if total < 2**63 else None for total in exact]


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
