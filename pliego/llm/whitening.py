"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

* Fit, in Spark: entries become integers; each task adds up their sums and products
  exactly, and Spark adds up the tasks' figures as decimals.  n * products - sums is
  the scatter A, a matrix of integers whose eigenvalues are n * n times those of the
  covariance.
* Characteristic polynomial: Spark tasks reduce A modulo a prime each to Hessenberg
  form and give the polynomial's residues; Chinese remaindering over enough primes
  for a proven bound of the coefficients gives the polynomial itself.
* Eigenvalues: the polynomial has real roots only, so the sign changes of its shift to
  x are the number of roots over x (Descartes, exact here, multiplicities counted).
  Bisection on binary fractions isolates the leading roots to ``DIGITS`` bits.
* Components: inverse iteration with the null space of A - root, in fixed-point
  integers of ``BITS`` bits, made orthogonal within a multiple root.
* Whitening, in Spark: one product a batch.

What is held outside tasks has the size of the vectors' dimension, not of the table.
"""
from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import comb, isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Entries become floor(1024 * entry) + 100000.  Deviations, covariances and whitened values don't depend on
#: the offset, so the integers are summed up without it.
SCALE = 1024
#: Bits to which a root is known relative to the largest, and bits of fixed-point numbers.
DIGITS = 192
BITS = 512
#: Roots this close (in bits below the trace) count as one multiple root.
SAME = 160
ROWS = 4096
#: Largest number that a double holds with all smaller ones.
EXACT = 1 << 53


# ------------------------------------------------------------- exact scatter

def valid(vector: str):
    """Vectors that are not null and hold no null, NaN or infinite entry."""
    return F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def integers(column: pa.Array) -> np.ndarray:
    """int64[n, d]: floor(1024 * entry); an entry whose integer passes 2 ** 62 is an error."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    y = np.floor(SCALE * flat)
    if len(y) and np.abs(y).max() >= 2.0 ** 62:
        raise OverflowError("an embedding's entry is too large for a long")
    return y.astype(np.int64).reshape(n, -1)


def product_sums(y: np.ndarray) -> np.ndarray:
    """Exact y' y as an object array of Python integers."""
    top = int(np.abs(y).max()) if y.size else 0
    if top * top * max(1, len(y)) < EXACT:  # every partial sum is a whole number that a double holds
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T.dot(z)


def scatter_sums(vectors: DataFrame) -> DataFrame:
    """(i, j, s): sums of entries (i = -1, j), of products (i <= j), and the count (-1, -1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, None, None
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                y = integers(b.column(0).slice(k, ROWS))
                if sums is None:
                    sums, products = np.zeros(y.shape[1], object), np.zeros((y.shape[1], y.shape[1]), object)
                n += len(y)
                sums = sums + y.astype(object).sum(axis=0)
                products = products + product_sums(y)
        if n:
            at = np.triu_indices(len(sums))
            i = np.concatenate((np.full(len(sums) + 1, -1), at[0]))
            j = np.concatenate(([-1], np.arange(len(sums)), at[1]))
            s = [n, *sums.tolist(), *products[at].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                              pa.array([Decimal(int(x)) for x in s], pa.decimal128(38, 0))], names=["i", "j", "s"])
    return vectors.mapInArrow(run, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").cast("decimal(38,0)").alias("s"))


def scatter(vectors: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """(n, sums of the integers less the offset, n * products - sums * sums) of column 0, exact."""
    got = {(r.i, r.j): int(r.s) for r in scatter_sums(vectors).collect()}  # d * d / 2 numbers
    n = got.pop((-1, -1), 0)
    d = sum(i < 0 for i, _ in got)
    sums = [got[-1, j] for j in range(d)]
    a = np.zeros((d, d), object)
    for i in range(d):
        for j in range(i, d):
            a[i, j] = a[j, i] = n * got[i, j] - sums[i] * sums[j]
    return n, sums, a


# ------------------------------------------------------------- characteristic polynomial

def primes_below(top: int) -> Iterator[int]:
    """Primes below ``top`` (under 2 ** 31) in falling order."""
    small = [p for p in range(2, isqrt(top) + 1) if all(p % q for q in range(2, isqrt(p) + 1))]
    p = top - 1
    while True:
        if all(p % q for q in small):
            yield p
        p -= 1


def hessenberg_mod(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``a`` modulo the prime ``p`` (under 2 ** 31) with zeros below the first subdiagonal."""
    h = a.copy()
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        k = m + int(below[0])
        if k != m:
            h[[k, m]] = h[[m, k]]
            h[:, [k, m]] = h[:, [m, k]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
        # the columns' counterpart: many products are added, so each is reduced first
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(axis=1)) % p
    return h


def charpoly_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t - a) modulo ``p``, constant first, by the recurrence over leading Hessenberg blocks."""
    h = hessenberg_mod(a, p)
    d = len(h)
    polys = [np.array([1], np.int64)]
    for m in range(1, d + 1):
        q = np.zeros(m + 1, np.int64)
        q[1:] = polys[m - 1]
        q[:m] = (q[:m] - h[m - 1, m - 1] * polys[m - 1] % p) % p
        run = 1
        for i in range(1, m):
            run = run * int(h[m - i, m - i - 1]) % p
            if not run:
                break
            c = int(h[m - i - 1, m - 1]) * run % p
            q[:m - i] = (q[:m - i] - c * polys[m - i - 1] % p) % p
        polys.append(q % p)
    return polys[d]


def characteristic_polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Integer coefficients of det(t - a), constant first, of a positive semidefinite integer matrix.

    The k-th coefficient is the k-th elementary symmetric function of roots that are not negative,
    at most C(d, k) * (trace / d) ** k; the primes' product passes twice the largest of these.
    """
    d = len(a)
    trace = sum(int(a[i, i]) for i in range(d))
    bound = 2 * max(comb(d, k) * -(-trace ** k // d ** k) for k in range(d + 1)) + 1
    primes, size = [], 1
    for p in primes_below(1 << 31):
        primes.append(p)
        size *= p
        if size > bound:
            break
    entries = [[str(x) for x in row] for row in a.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array([[int(x) for x in row] for row in entries], object)
        for b in batches:
            for p in b.column(0).to_pylist():
                c = charpoly_mod((whole % p).astype(np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([c.tolist()], pa.list_(pa.int64()))], names=["p", "c"])
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 64))
    residues = {r.p: r.c for r in rows.mapInArrow(run, "p long, c array<long>").collect()}
    modulus = prod(primes)
    weights = [modulus // p * pow(modulus // p, -1, p) for p in primes]
    out = []
    for k in range(d + 1):
        c = sum(w * residues[p][k] for w, p in zip(weights, primes)) % modulus
        out.append(c - modulus if 2 * c > modulus else c)
    return out


# ------------------------------------------------------------- roots and components

def roots_over(poly: list[int], x: int, shift: int) -> int:
    """Number of roots, with multiplicity, over x / 2 ** shift of a polynomial whose roots are all real."""
    d = len(poly) - 1
    c = [a << shift * (d - k) for k, a in enumerate(poly)]  # roots times 2 ** shift
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += x * c[k + 1]
    signs = [a > 0 for a in c if a]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def leading_roots(poly: list[int], top: int, trace: int) -> tuple[list[tuple[int, int]], int]:
    """((root, multiplicity) ..., shift): the largest roots in units of 2 ** -shift, falling, ``top`` of them or all that are positive.

    Roots are halved down to ``DIGITS`` bits below the trace.  What is still one interval then is one multiple root.
    """
    shift = max(0, DIGITS - trace.bit_length())
    high = (trace << shift) + 1
    step = max(1, high >> DIGITS)
    out: list[tuple[int, int]] = []
    low = 0
    todo = [(low, high, roots_over(poly, low, shift), 0)]  # roots in (low, high]
    while todo and sum(m for _, m in out) < top:
        low, high, over_low, over_high = todo.pop()
        if over_low == over_high:
            continue
        if high - low <= step:
            out.append(((low + high) // 2, over_low - over_high))
            continue
        mid = (low + high) // 2
        over = roots_over(poly, mid, shift)
        todo += [(low, mid, over_low, over), (mid, high, over, over_high)]
    near: list[tuple[int, int]] = []
    for root, m in out:  # a root on the edge of two intervals may be found in both
        if near and near[-1][0] - root <= (trace << shift) >> SAME:
            near[-1] = (near[-1][0], near[-1][1] + m)
        else:
            near.append((root, m))
    return near, shift


def inverse_iteration(a: np.ndarray, root: int, shift: int, seed: int, against: list[list[int]], rounds: int = 3) -> list[int]:
    """Unit vector in units of 2 ** -BITS: a null vector of a - root / 2 ** shift, at right angles to ``against``."""
    d = len(a)
    unit = 1 << BITS
    size = max(1, max(abs(int(a[i, i])) for i in range(d)))
    lu = [[(int(a[i, j]) * unit - ((root << BITS) >> shift if i == j else 0)) // size for j in range(d)] for i in range(d)]
    order = list(range(d))
    for k in range(d):  # elimination with row pivots
        best = max(range(k, d), key=lambda r: abs(lu[r][k]))
        lu[k], lu[best] = lu[best], lu[k]
        order[k], order[best] = order[best], order[k]
        if not lu[k][k]:
            lu[k][k] = 1  # a pivot of zero is the null space itself
        for r in range(k + 1, d):
            f = (lu[r][k] << BITS) // lu[k][k]
            lu[r][k] = f
            if f:
                row, pivot = lu[r], lu[k]
                for c in range(k + 1, d):
                    row[c] -= f * pivot[c] >> BITS
    start = np.random.default_rng(seed).integers(1, 1 << 30, d).tolist()
    z = unit_vector([x << (BITS - 30) for x in start], against)
    for _ in range(rounds):
        b = [z[order[k]] for k in range(d)]
        for k in range(d):
            b[k] -= sum(lu[k][c] * b[c] for c in range(k)) >> BITS
        for k in reversed(range(d)):
            b[k] = ((b[k] << BITS) - sum(lu[k][c] * b[c] for c in range(k + 1, d))) // lu[k][k]
        z = unit_vector(b, against)
    return z


def unit_vector(z: list[int], against: list[list[int]]) -> list[int]:
    for _ in range(2):
        for v in against:
            along = sum(x * y for x, y in zip(z, v)) >> BITS
            z = [x - (along * y >> BITS) for x, y in zip(z, v)]
    norm = isqrt(sum(x * x for x in z))
    return [(x << BITS) // norm for x in z]


class Components:
    """n, sums, eigenvalues of the covariance, share of the trace, and unit vectors (rows) of the fit."""

    def __init__(self, spark: SparkSession, n: int, sums: list[int], a: np.ndarray, top: int = 8):
        self.n, self.sums = n, sums
        trace = sum(int(a[i, i]) for i in range(len(a)))
        self.values: list[float] = []
        self.share: list[float] = []
        vectors: list[list[int]] = []
        if trace:
            poly = characteristic_polynomial(spark, a)
            roots, shift = leading_roots(poly, top, trace)
            for root, times in roots:
                found: list[list[int]] = []
                for k in range(min(times, top - len(vectors))):
                    found.append(inverse_iteration(a, root, shift, 1 + k, found))
                    vectors.append(found[-1])
                    self.values.append(root / (n * n << shift))
                    self.share.append(root / (trace << shift))
        self.vectors = np.array([[x / (1 << BITS) for x in v] for v in vectors], np.float64).reshape(len(vectors), len(a))
        for v in self.vectors:  # the same sign in each run
            if v[np.argmax(np.abs(v))] < 0:
                v *= -1


def whitened_rows(vectors: DataFrame, fit: Components) -> DataFrame:
    """(vec_id, deviation, w): exact squared deviation and whitened coordinates of (vec_id, vector)."""
    n, sums, v, values = fit.n, [int(s) for s in fit.sums], fit.vectors, fit.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(sums, object)
        scale = v.T / np.sqrt(np.array(values))
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                y = integers(part.column(1))
                top = n * (int(np.abs(y).max()) if y.size else 0) + max((abs(s) for s in sums), default=0)
                if top * top * max(1, len(sums)) < 1 << 62:
                    dev = n * y - total.astype(np.int64)
                    square = (dev * dev).sum(axis=1).astype(object)
                else:
                    dev = n * y.astype(object) - total
                    square = (dev * dev).sum(axis=1)
                w = (dev / n).astype(np.float64) @ scale
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([Decimal(int(x)) for x in square], pa.decimal128(38, 0)),
                     pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))],
                    names=["vec_id", "deviation", "w"])
    return vectors.mapInArrow(run, "vec_id long, deviation decimal(38,0), w array<double>")


def identity_error(rows: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of w less the identity; centred before multiplying."""
    mean = rows.agg(*[F.avg(F.get("w", F.lit(i))).alias(f"m{i}") for i in range(k)]).first()
    off = [F.get("w", F.lit(i)) - F.lit(mean[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = rows.agg(*[F.avg(off[i] * off[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs))


def whiten(embeddings: DataFrame, vector: str = "embedding", top: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    Vectors that are null or hold null, NaN or infinite entries are left out, as are empty vectors and, where
    lengths differ, vectors of another length than the most frequent (the longer of equally frequent ones).
    Components are those of positive variance, ``top`` at most: vectors that are all equal, a single
    vector and an empty table give no rows.  Repeated rows and null ids count like any other.
    Components of one multiple eigenvalue are any orthonormal basis of its space.
    deviation is a decimal of 38 digits; an entry whose integer passes 2 ** 62 is an error.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(valid("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).filter("d > 0").limit(1).first()
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == lengths["d"])
    n, sums, a = scatter(rows.select("v"))
    fit = Components(spark, n, sums, a, top)
    k = len(fit.values)
    if not k:
        return spark.createDataFrame([], schema)
    white = written(whitened_rows(rows, fit), "whitened")
    error = identity_error(white, k)
    share = F.array(*[F.lit(x) for x in fit.share])
    return white.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
