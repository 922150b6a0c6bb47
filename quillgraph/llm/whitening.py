"""Whitening of embeddings by an exact scatter in residue numbers.

Entries become whole numbers, and each partition multiplies its rows modulo several primes: the products of residues and their
sums over a block stay below 2^53, so the float64 GEMM of each prime is exact. The residues of all partitions are summed up, and
Chinese remaindering gives the exact sum of products of any two dimensions; a last dimension of ones gives the sums and the number
of rows. n^2 times the covariance is then a whole number, and the covariance is that number rounded once, whatever the mean is.
Its eigenvectors, in double precision, go to all rows.

The number of primes follows from the number of rows and the largest entry, so no product of them is too small.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt, prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import remove, shared_dir, written

#: Rows of a block: with residues from -p/2 to p/2 and p below 2^20, a block's sums stay below 2^11 * 2^38 = 2^49.
BLOCK = 1 << 11
#: Whole numbers beyond this size are set to it: see whitened().
MOST = 1 << 61
OFFSET, SCALE = 1_000_000, 64.0


def primes(over: int, below: int = 1 << 20) -> list[int]:
    """The largest primes under ``below`` whose product is greater than ``over``."""
    out, p = [], below - 1
    while prod(out) <= over:
        if all(p % d for d in range(3, isqrt(p) + 1, 2)):
            out.append(p)
        p -= 2
    return out


def whole(v: np.ndarray) -> np.ndarray:
    """floor(64 v) + 1000000 as 64-bit numbers."""
    return np.clip(np.floor(SCALE * v), -MOST, MOST).astype(np.int64) + OFFSET


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _residues(batches: Iterator[pa.RecordBatch], dims: int, moduli: list[int]) -> Iterator[pa.RecordBatch]:
    """(prime, i, j, s): for each prime and i <= j the sum of x_i x_j of this partition modulo the prime; dimension ``dims`` is 1."""
    sums = np.zeros((len(moduli), dims + 1, dims + 1), np.int64)
    for batch in batches:
        x = whole(_matrix(batch.column("v"), dims))
        for k in range(0, len(x), BLOCK):
            block = x[k : k + BLOCK]
            for p, total in zip(moduli, sums, strict=True):
                r = np.ones((len(block), dims + 1))
                r[:, :dims] = block % p
                r[:, :dims][r[:, :dims] > p // 2] -= p
                total += (r.T @ r).astype(np.int64)
                total %= p
    i, j = np.triu_indices(dims + 1)
    for p, total in zip(moduli, sums, strict=True):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), p, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["prime", "i", "j", "s"])


def from_residues(residues: dict[int, int]) -> int:
    """The whole number nearest to 0 with these remainders."""
    m = prod(residues)
    x = sum(r % p * (m // p) * pow(m // p, -1, p) for p, r in residues.items()) % m
    return x - m if x > m // 2 else x


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, total): the exact sums, as text, of cells (i, j, r: list of prime and remainder)."""
    for batch in batches:
        total = [str(from_residues({x["prime"]: x["s"] for x in r})) for r in batch.column("r").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("j"), pa.array(total, pa.string())], ["i", "j", "total"])


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of rows whose vector has entries, all of them finite."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vectors.select(F.col("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(F.exists("v", bad), F.lit(False)))


def scatter(rows: DataFrame, dims: int, n: int, largest: int) -> tuple[list[list[int]], list[int]]:
    """(scatter, sums): exact sums of x_i x_j over rows (v), and of x_i. largest: a bound on the size of entries."""
    spark = rows.sparkSession
    root = shared_dir(spark, "scatter")
    moduli = primes(2 * n * max(largest, 1) ** 2)
    parts = rows.select("v").mapInArrow(lambda it: _residues(it, dims, moduli), "prime int, i int, j int, s long")
    # the cells of a partition are few and bounded; a cell has as many rows as there are partitions, summed up before and after the shuffle
    sums = written(parts.groupBy("i", "j", "prime").agg(F.sum("s").alias("s")), f"{root}/residues")
    cells = sums.groupBy("i", "j").agg(F.collect_list(F.struct("prime", "s")).alias("r")).mapInArrow(_exact, "i int, j int, total string")
    total = [[0] * (dims + 1) for _ in range(dims + 1)]
    for i, j, x in cells.toLocalIterator():
        total[i][j] = total[j][i] = int(x)
    remove(spark, root)
    return [row[:dims] for row in total[:dims]], total[dims][:dims]


def covariance(products: list[list[int]], sums: list[int], n: int) -> np.ndarray:
    """(n * products - sums sums^T) / n^2, each entry rounded once."""
    return np.array([[(n * x - a * b) / (n * n) for x, b in zip(row, sums, strict=True)] for row, a in zip(products, sums, strict=True)])


def _centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x - S/n: the whole parts are subtracted as whole numbers, so nothing is lost to the size of the mean."""
    base = [s // n for s in sums]
    left = np.array([(s - n * b) / n for s, b in zip(sums, base, strict=True)])
    low = np.clip(np.array(base, dtype=object), -(1 << 62), 1 << 62).astype(np.int64)
    return (x - low).astype(np.float64) - left


def _deviations(x: np.ndarray, sums: list[int], n: int) -> pa.Array:
    """The sums over dimensions of (n x - S)^2; null where 64 bits cannot hold one."""
    c = _centred(x, sums, n)
    rough = np.square(c * n).sum(axis=1)
    if len(x) and rough.max(initial=0) < 2.0**62 and n * (np.abs(x).max(initial=0) + 1.0) < 2.0**62 and max(map(abs, sums)) < 2**62:
        return pa.array(np.square(x * n - np.array(sums, np.int64)).sum(axis=1))
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())


def _moments(batches: Iterator[pa.RecordBatch], dims: int, sums: list[int], n: int, project: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each partition with rows: its number, mean and centred scatter of the whitened vectors (row by row)."""
    k = project.shape[1]
    m, mean, spread = 0, np.zeros(k), np.zeros((k, k))
    for batch in batches:
        w = _centred(whole(_matrix(batch.column("v"), dims)), sums, n) @ project
        if len(w):
            mid = w.mean(axis=0)
            step = mid - mean
            spread += (w - mid).T @ (w - mid) + np.outer(step, step) * (m * len(w) / (m + len(w)))
            mean, m = mean + step * len(w) / (m + len(w)), m + len(w)
    if m:
        # m d d^T sums up to the scatter between partitions once the mean of all is known, which is 0 up to rounding
        yield pa.RecordBatch.from_pydict({"m": [m], "mean": [mean.tolist()], "spread": [(spread + m * np.outer(mean, mean)).ravel().tolist()]})


def _identity_error(rows: DataFrame, dims: int, sums: list[int], n: int, project: np.ndarray) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, summed up over all rows."""
    k = project.shape[1]
    if not k:
        return 0.0
    each = rows.select("v").mapInArrow(lambda it: _moments(it, dims, sums, n, project), "m long, mean array<double>, spread array<double>")
    mean = each.select("m", F.posexplode("mean").alias("at", "x")).groupBy("at").agg(F.sum(F.col("m") * F.col("x")).alias("x"))
    spread = each.select(F.posexplode("spread").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    got = mean.select(F.lit(0).alias("what"), "at", "x").unionByName(spread.select(F.lit(1).alias("what"), "at", "x")).collect()  # k + k * k numbers
    mid, cov = np.zeros(k), np.zeros(k * k)
    for what, at, x in got:
        (cov if what else mid)[at] = x / n
    return float(np.abs(cov.reshape(k, k) - np.outer(mid, mid) - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = 32) -> DataFrame:
    """One row for each usable row of vectors (vec_id, embedding) and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty or holds null, NaN or infinite entries are dropped; so are those whose length is not the
    commonest (of equally common ones, the greatest). Rows that repeat count each time; a null vec_id is kept. Entries c are x = floor(64 c) + 1000000;
    beyond 2^61, floor(64 c) is set to that. deviation is null if 64 bits cannot hold it. A component without variance (an eigenvalue below the largest times dimensions times
    2^-52) has null as whitened and no part in identity_error; explained is 0 for all if there is no variance at all. Empty table, or none
    usable: no rows. Other columns are not read. The driver holds matrices of dimensions times dimensions, nothing that grows with the rows.
    """
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable = _usable(vectors)
    top = F.array_max(F.transform("v", lambda c: F.abs(c)))
    sizes = usable.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(top).alias("top")).orderBy(F.desc("n"), F.desc("dims")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dims, n = sizes["dims"], sizes["n"]
    rows = usable.where(F.size("v") == dims)
    largest = OFFSET + 1 + min(MOST, int(min(sizes["top"] * SCALE, float(MOST))) + 1)
    products, sums = scatter(rows, dims, n, largest)
    v = covariance(products, sums, n)
    trace, (values, vectors_) = float(np.trace(v)), np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    e, u = values[order], vectors_[:, order]
    real = e > max(values.max(), 0.0) * dims * 2.0**-52
    project = np.where(real, u / np.sqrt(np.where(real, e, 1.0)), np.nan)
    explained = [float(x) / trace if trace > 0 else 0.0 for x in np.maximum(e, 0.0)]
    off = _identity_error(rows, dims, sums, n, np.ascontiguousarray(project[:, real]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(_matrix(batch.column("v"), dims))
            w = _centred(x, sums, n) @ np.where(real, project, 0.0)
            flat = pa.array(w.ravel(), mask=np.tile(~real, len(w)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * len(e)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _deviations(x, sums, n), lists], ["vec_id", "deviation", "w"])

    wide = rows.mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>")
    part = F.element_at(F.array(*map(F.lit, explained)), F.col("at") + 1)
    return wide.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", part.alias("explained"), F.lit(off).alias("identity_error"))
