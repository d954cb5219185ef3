"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix.

1. Vectors become integers; ``n^2`` times their covariance is an integer matrix, summed exactly over all tasks.
2. Its characteristic polynomial is computed modulo many primes, one row per prime: modular reduction to Hessenberg form
   and the recurrence of the leading minors. Chinese remaindering gives the integer coefficients.
3. All roots are real, so the sign changes of the shifted coefficients count the roots above any point exactly. Each
   wanted root is isolated by halving until 192 bits are known, one row per component.
4. A component is a null vector of the matrix minus its root: inverse iteration with 100 digits, rounded at the end.
5. Every row is projected. What reaches the driver is bounded by the dimension: matrix, residues, roots and components.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostwarden.llm.support import prepare
from hostwarden.session import stage

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries of this size and more have no integer of 64 bits.
LARGEST = 2.0**56
#: Bits of a root that are isolated, and decimal digits of the inverse iteration.
ROOT_BITS, DIGITS = 192, 100
_SMALL = 1 << 18  # squares of smaller entries add up exactly in double precision over any Arrow batch


# --- exact sums -----------------------------------------------------------------------------------------------------
def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column as an integer matrix, without the common shift."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) - SHIFT


def exact_product(a: np.ndarray) -> np.ndarray:
    """``a.T @ a`` of an int64 matrix as Python integers."""
    small = (np.abs(a) < _SMALL).all(axis=1)
    out = np.zeros((a.shape[1], a.shape[1]), object)
    for lo in range(0, len(a), 1 << 16):
        part = a[lo : lo + (1 << 16)][small[lo : lo + (1 << 16)]].astype(np.float64)
        out = out + (part.T @ part).astype(np.int64).astype(object)
    if not small.all():
        wide = a[~small].astype(object)
        out = out + wide.T @ wide
    return out


_SUMS = "line int, part int, numbers array<string>"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lines: dict[int, list[int]] = {}
    for batch in batches:
        for line, numbers in zip(batch["line"].to_pylist(), batch["numbers"].to_pylist()):
            held = lines.get(line)
            lines[line] = [int(x) for x in numbers] if held is None else [x + int(y) for x, y in zip(held, numbers)]
    for line, numbers in lines.items():
        yield pa.RecordBatch.from_pydict({"line": pa.array([line], pa.int32()), "part": pa.array([0], pa.int32()), "numbers": pa.array([[str(x) for x in numbers]])})


def integer_sums(fit: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows of ``fit(x)``, their sums and sums of products per dimension, all exact, without the shift.

    Tasks add up their own rows, the tables of the tasks are added in two steps on the executors.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1), object)
        for batch in batches:
            y = _matrix(batch.column(0), dim)
            total[0, 0] += len(y)
            total[0, 1:] += y.astype(object).sum(axis=0) if len(y) else 0
            total[1:, 1:] += exact_product(y)
        if total[0, 0]:
            part = TaskContext.get().partitionId() % 64
            for line in range(dim + 1):
                yield pa.RecordBatch.from_pydict({"line": pa.array([line], pa.int32()), "part": pa.array([part], pa.int32()), "numbers": pa.array([[str(x) for x in total[line]]])})

    once = fit.select("x").mapInArrow(partial, _SUMS).repartition("line", "part").mapInArrow(_added, _SUMS)
    lines = {row["line"]: [int(x) for x in row["numbers"]] for row in once.repartition("line").mapInArrow(_added, _SUMS).collect()}
    if not lines:
        return 0, [0] * dim, [[0] * dim for _ in range(dim)]
    return lines[0][0], lines[0][1:], [lines[k + 1][1:] for k in range(dim)]


# --- characteristic polynomial --------------------------------------------------------------------------------------
def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number below 3.2e9."""
    if n < 2 or any(n % q == 0 and n != q for q in (2, 3, 5, 7)):
        return False
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if base % n and x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2^31 whose product exceeds ``2 * bound``, and one more as a check."""
    out, product, n = [], 1, 1 << 31
    while product <= 2 * bound or len(out) < 2 or product // out[-1] <= 2 * bound:
        n -= 1
        if _is_prime(n):
            out.append(n)
            product *= n
    return out


def coefficient_bound(trace: int, dim: int) -> int:
    """No coefficient is larger if all roots are real, none is negative and they add up to ``trace`` (Maclaurin)."""
    return max(math.comb(dim, k) * trace**k // dim**k + 1 for k in range(dim + 1))


def charpoly_mod(matrix: Sequence[Sequence[int]], p: int) -> list[int]:
    """Coefficients of ``det(t I - matrix)`` modulo the prime ``p`` below 2^31, constant term first."""
    d = len(matrix)
    h = np.array([[x % p for x in line] for line in matrix], np.int64)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        if (i := k + int(below[0])) != k:
            h[[k, i]] = h[[i, k]]
            h[:, [k, i]] = h[:, [i, k]]
        factor = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - factor[:, None] * h[k]) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factor % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    chain = np.zeros(0, np.int64)  # products of the subdiagonal from row i + 1 down to row k
    for k in range(d):
        if k:
            chain = np.append(chain, 1) * h[k, k - 1] % p
        term = (minors[k] * int(h[k, k])) % p
        if k:
            term = (term + ((h[:k, k] * chain % p)[:, None] * minors[:k] % p).sum(axis=0)) % p
        minors[k + 1, 1:] = minors[k, :-1]
        minors[k + 1] = (minors[k + 1] - term) % p
    return minors[d].tolist()


def chinese_remainder(residues: dict[int, list[int]]) -> list[int]:
    """The integers of least size with these residues by prime."""
    product = math.prod(residues)
    basis = {p: product // p * pow(product // p, -1, p) for p in residues}
    out = []
    for k in range(len(next(iter(residues.values())))):
        value = sum(basis[p] * r[k] for p, r in residues.items()) % product
        out.append(value - product if 2 * value > product else value)
    return out


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of ``det(t I - matrix)`` of a positive semidefinite integer matrix, constant term first; one row per prime."""
    dim = len(matrix)
    primes = primes_for(coefficient_bound(sum(matrix[k][k] for k in range(dim)), dim))
    shared = spark.sparkContext.broadcast(matrix)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"p": pa.array([p], pa.int64()), "residues": pa.array([charpoly_mod(shared.value, p)], pa.list_(pa.int64()))})

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 64)).mapInArrow(residues, "p long, residues array<long>").collect()
    found = {row["p"]: list(row["residues"]) for row in rows}
    check = found.pop(primes[-1])
    out = chinese_remainder(found)
    if [c % primes[-1] for c in out] != check:
        raise ArithmeticError("the residues of the characteristic polynomial do not fit together")
    return out


# --- roots and components -------------------------------------------------------------------------------------------
def _shifted(poly: list[int], by: int) -> list[int]:
    """Coefficients of ``poly(t + by)``."""
    out = list(poly)
    for lo in range(len(out) - 1):
        for k in range(len(out) - 2, lo - 1, -1):
            out[k] += out[k + 1] if by == 1 else by * out[k + 1]
    return out


def _positive_roots(poly: list[int]) -> int:
    """Positive roots with multiplicity of a polynomial whose roots are all real (rule of signs)."""
    signs = [c > 0 for c in poly if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def isolate(poly: list[int], k: int, bits: int = ROOT_BITS) -> tuple[int, int, int, int]:
    """The ``k``-th largest root, counted from 1, of a polynomial with only real roots, the wanted one positive.

    Returns ``low, places, place, multiplicity``: the root is in ``(low, low + 1] / 2^places``, it is number ``place``
    (from 0) of the ``multiplicity`` roots there, and ``low`` has ``bits`` bits.
    """
    high = 1
    while _positive_roots(_shifted(poly, high)) >= k:
        high *= 2
    low = 0
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if _positive_roots(_shifted(poly, middle)) >= k else (low, middle)
    q, places = _shifted(poly, low), 0
    d = len(poly) - 1
    while low.bit_length() < bits:
        q = [c << (d - j) for j, c in enumerate(q)]
        low, places = 2 * low, places + 1
        if _positive_roots(upper := _shifted(q, 1)) >= k:
            q, low = upper, low + 1
    above = _positive_roots(_shifted(q, 1))
    return low, places, k - 1 - above, _positive_roots(q) - above


def null_vector(matrix: Sequence[Sequence[int]], root: Decimal, place: int) -> list[Decimal]:
    """Unit vector number ``place`` of an orthonormal basis of the eigenspace of ``root``, by inverse iteration.

    To be called in a decimal context of enough digits.
    """
    d = len(matrix)
    a = [[Decimal(x) for x in line] for line in matrix]
    for k in range(d):
        a[k][k] -= root
    tiny = max((abs(x) for line in a for x in line), default=Decimal(1)) * Decimal(10) ** -(DIGITS - 10) or Decimal(10) ** -DIGITS
    order = list(range(d))
    for k in range(d):
        i = max(range(k, d), key=lambda r: abs(a[r][k]))
        a[k], a[i], order[k], order[i] = a[i], a[k], order[i], order[k]
        if abs(a[k][k]) < tiny:
            a[k][k] = tiny
        pivot = a[k]
        for r in range(k + 1, d):
            line = a[r]
            if line[k]:
                f = line[k] = line[k] / pivot[k]
                for c in range(k + 1, d):
                    line[c] -= f * pivot[c]

    def solved(b: list[Decimal]) -> list[Decimal]:
        y = [b[i] for i in order]
        for k in range(d):
            y[k] -= sum((a[k][c] * y[c] for c in range(k)), Decimal(0))
        for k in reversed(range(d)):
            y[k] = (y[k] - sum((a[k][c] * y[c] for c in range(k + 1, d)), Decimal(0))) / a[k][k]
        return y

    basis: list[list[Decimal]] = []
    start = 0
    while len(basis) <= place:
        # Fixed starts without a common pattern; one that lies in the span found so far is passed over.
        v = [Decimal(1) + Decimal((start * 7919 + (k + 1) * (k + 1 + start) * 104729) % 1009) / 1009 for k in range(d)]
        for _ in range(2):
            v = solved(v)
            for _ in range(2):
                for u in basis:
                    along = sum((x * y for x, y in zip(u, v)), Decimal(0))
                    v = [y - along * x for x, y in zip(u, v)]
            length = sum((x * x for x in v), Decimal(0)).sqrt()
            v = [x / length for x in v]
        start += 1
        image = sum((sum((Decimal(m) * x for m, x in zip(line, v)), Decimal(0)) - root * x0) ** 2 for line, x0 in zip(matrix, v)).sqrt()
        if image <= abs(root) * Decimal(10) ** -30:
            basis.append(v)
    v = basis[place]
    lead = max(range(d), key=lambda k: (abs(v[k]), -k))
    return [-x for x in v] if v[lead] < 0 else v


_COMPONENT = "component int, root string, vector array<double>"


def principal_components(spark: SparkSession, matrix: list[list[int]], most: int = COMPONENTS) -> list[tuple[Decimal, list[float]]]:
    """The ``most`` largest positive eigenvalues of a positive semidefinite integer matrix with their unit eigenvectors.

    Falling, as often as their multiplicity; eigenvalues of zero are left out. One row per component.
    """
    dim = len(matrix)
    poly = characteristic_polynomial(spark, matrix)
    rank = dim - next(k for k, c in enumerate(poly) if c)
    wanted = min(most, rank)
    if not wanted:
        return []
    shared = spark.sparkContext.broadcast((matrix, poly[dim - rank :]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, reduced = shared.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                low, places, place, _ = isolate(reduced, k)
                with decimal.localcontext(prec=DIGITS + len(str(sum(whole[j][j] for j in range(dim))))):
                    root = (Decimal(low) + Decimal("0.5")) / (Decimal(2) ** places)
                    vector = [float(x) for x in null_vector(whole, root, place)]
                yield pa.RecordBatch.from_pydict({"component": pa.array([k], pa.int32()), "root": pa.array([str(root)]), "vector": pa.array([vector], pa.list_(pa.float64()))})

    rows = spark.createDataFrame([(k,) for k in range(1, wanted + 1)], "component int").repartition(wanted).mapInArrow(found, _COMPONENT).collect()
    return [(Decimal(row["root"]), list(row["vector"])) for row in sorted(rows, key=lambda r: r["component"])]


# --- rows -----------------------------------------------------------------------------------------------------------
def integers(vector: Column) -> Column:
    """The integer vector of a vector; null if it is null or empty or an entry is null, non-finite or too large."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST)))
    values = F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long") + F.lit(SHIFT))
    return F.when((F.size(vector) > 0) & F.coalesce(sound, F.lit(False)), values)


def centred(y: np.ndarray, n: int, sums: Sequence[int]) -> np.ndarray:
    """``n * y - sums``, exact: int64 where it fits, else Python integers."""
    most = n * int(np.abs(y).max(initial=0)) + max((abs(s) for s in sums), default=0)
    return n * y - np.array(sums, np.int64) if most < 1 << 62 else n * y.astype(object) - np.array(sums, object)


def squared_lengths(rows: np.ndarray) -> pa.Array:
    """Exact sums of squares, null where they leave 64 bits."""
    if rows.dtype != object and int(np.abs(rows).max(initial=0)) ** 2 * rows.shape[1] < 1 << 63:
        return pa.array((rows * rows).sum(axis=1), pa.int64())
    sums = [sum(int(x) ** 2 for x in row) for row in rows]
    return pa.array([s if s < 1 << 63 else None for s in sums], pa.int64())


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Every usable row of ``vectors(vec_id, embedding)`` on its first ``most`` components:
    ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Rows go whose vector is null or empty or holds null or non-finite entries, or entries of 2^56 and more, which have
    no 64-bit integer. Vectors of another length than the most frequent (the shorter one on a tie) go too, as they have
    no common covariance. The fit list holds each integer vector once, however often it occurs; every usable row is
    returned, repeated ones as often as they occur, and a null ``vec_id`` stays null. Components without variance are left
    out, so a single vector, equal vectors or an empty table give no rows. ``deviation`` is null where it leaves 64 bits.
    Equal eigenvalues have an orthonormal basis that is the same for all rows. Further columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("x")).where("x IS NOT NULL")
    lengths = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    nothing = spark.createDataFrame([], _OUT)
    if not lengths:
        return nothing
    dim = lengths[0]["dim"]
    rows = rows.where(F.size("x") == dim)
    fit = stage(rows.select("x").distinct(), "whitening-fit")
    n, sums, products = integer_sums(fit, dim)
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    components = principal_components(spark, scatter, most)
    if not components:
        return nothing
    trace = sum(scatter[k][k] for k in range(dim))
    # x - S/n is (n x - S) / n and its variance root / n^2, so the factor n cancels.
    with decimal.localcontext(prec=50):
        explained = np.array([float(root / trace) for root, _ in components])
        axes = np.array([v for _, v in components]).T / np.array([float(root.sqrt()) for root, _ in components])
    size = len(components)

    def products_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cross = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            w = centred(_matrix(batch.column(0), dim), n, sums).astype(np.float64) @ axes
            total, cross = total + w.sum(axis=0), cross + w.T @ w
        i, j = np.divmod(np.arange(size * (size + 1)), size)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "value": pa.array(np.concatenate([cross.ravel(), total]))})

    added = fit.select("x").mapInArrow(products_of, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    table = np.zeros((size + 1, size))
    for row in added:
        table[row["i"], row["j"]] = row["value"] / n
    error = float(np.abs(table[:size] - np.outer(table[size], table[size]) - np.eye(size)).max())

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = centred(_matrix(batch["x"], dim), n, sums)
            w = far.astype(np.float64) @ axes
            each = np.repeat(np.arange(len(far)), size)
            yield pa.RecordBatch.from_arrays([
                batch["vec_id"].take(pa.array(each)), pa.array(np.tile(np.arange(1, size + 1), len(far)), pa.int32()), pa.array(np.full(len(each), n), pa.int64()),
                squared_lengths(far).take(pa.array(each)), pa.array(w.ravel()), pa.array(np.tile(explained, len(far))), pa.array(np.full(len(each), error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(projected, _OUT)
